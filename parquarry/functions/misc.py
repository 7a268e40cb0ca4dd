"""Small helpers without Spark: sizes, nested attributes, partition paths, intervals."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from typing import Any
from urllib.parse import unquote

UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def humanize_size(size: float) -> str:
    """1024-based, one decimal from KB on."""
    if size < 0:
        raise ValueError("a size is not negative")
    k = 0
    while size >= 1024 and k < len(UNITS) - 1:
        size, k = size / 1024, k + 1
    return f"{int(size)} B" if k == 0 else f"{size:.1f} {UNITS[k]}"


def humanized_size_to_bytes(text: str) -> int:
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([A-Za-z]*)\s*", text or "")
    unit = (m[2].upper() or "B") if m else ""
    unit = unit + "B" if unit in {u[0] for u in UNITS[1:]} else unit
    if not m or unit not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** UNITS.index(unit))


def run_parallel(f: Callable, items: Iterable, *args: Any, n_jobs: int = 8, **kwargs: Any) -> list:
    """f(item, *args, **kwargs) for each item, in their order."""
    with ThreadPoolExecutor(max(1, n_jobs if n_jobs > 0 else 16)) as pool:
        return list(pool.map(lambda x: f(x, *args, **kwargs), items))


def _path(path: str) -> list[str]:
    if not path:
        raise ValueError("empty path")
    return path.split(".")


def getattr_rec(obj: Any, path: str) -> Any:
    for p in _path(path):
        obj = obj[p] if isinstance(obj, dict) else getattr(obj, p)
    return obj


def setattr_rec(obj: Any, path: str, value: Any) -> None:
    *up, last = _path(path)
    for p in up:
        obj = obj.setdefault(p, {}) if isinstance(obj, dict) else getattr(obj, p)
    if isinstance(obj, dict):
        obj[last] = value
    else:
        setattr(obj, last, value)


def delattr_rec(obj: Any, path: str) -> None:
    *up, last = _path(path)
    for p in up:
        obj = obj[p] if isinstance(obj, dict) else getattr(obj, p)
    if isinstance(obj, dict):
        del obj[last]
    else:
        delattr(obj, last)


def get_nested_keys(tree: dict, prefix: str = "") -> list[str]:
    """Dotted paths of all leaves."""
    out = []
    for k, v in tree.items():
        out += get_nested_keys(v, f"{prefix}{k}.") if isinstance(v, dict) and v else [f"{prefix}{k}"]
    return out


def get_partitions_from_path(path: str, partitioning: str | list[str]) -> list[tuple[str, str]]:
    """(name, value) pairs: of ``name=value`` folders for "hive", else of the leading folders."""
    if partitioning is None:
        raise TypeError("partitioning is None")
    parts = path.strip("/").split("/")
    if parts and "." in parts[-1] and "=" not in parts[-1]:
        parts = parts[:-1]
    if partitioning == "hive":
        return [(k, unquote(v)) for k, v in (p.split("=", 1) for p in parts if "=" in p)]
    if isinstance(partitioning, str):
        return [(partitioning, parts[0])] if parts else []
    return list(zip(partitioning, parts[-len(partitioning) :] if len(parts) >= len(partitioning) else parts, strict=False))


_INTERVALS = {"us": "microsecond", "ms": "millisecond", "s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "mo": "month", "q": "quarter", "y": "year"}


def get_timedelta_str(text: str, to: str = "sql") -> str:
    """"1d" as "1 day"; "1d" again for other dialects; unknown units are passed on."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", text)
    if not m:
        raise ValueError(f"not an interval: {text!r}")
    if to != "sql":
        long = {v: k for k, v in _INTERVALS.items()}
        return f"{m[1]}{long.get(m[2].rstrip('s') if m[2] not in _INTERVALS else m[2], m[2])}"
    return f"{m[1]} {_INTERVALS.get(m[2], m[2])}"


def parse_interval(interval: str | timedelta) -> timedelta:
    if isinstance(interval, timedelta):
        out = interval
    else:
        n, unit = get_timedelta_str(interval).split()
        days = {"week": 7, "month": 30, "quarter": 91, "year": 365}
        key = unit.rstrip("s")
        if key not in set(_INTERVALS.values()):
            raise ValueError(f"not an interval: {interval!r}")
        out = timedelta(days=int(n) * days[key]) if key in days else timedelta(**{key + "s": int(n)})
    if out <= timedelta(0):
        raise ValueError("an interval is longer than nothing")
    return out


def timestamp_from_string(text: str, naive: bool = False) -> datetime:
    """ISO text; a date is its midnight; ``naive`` drops an offset."""
    out = datetime.fromisoformat(text.strip())
    return out.replace(tzinfo=None) if naive else out
