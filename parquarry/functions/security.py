"""Escaping, and checks of names, values and paths that come from outside."""

from __future__ import annotations

import os
import re
from datetime import date, datetime
from decimal import Decimal

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def escape_sql_identifier(name: str, quote: str = '"') -> str:
    """A plain identifier in quotes; anything else is refused. Spark SQL wants backticks."""
    if not isinstance(name, str) or not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return f"{quote}{name}{quote}"


def escape_sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, (date, datetime)):
        value = value.isoformat(" ") if isinstance(value, datetime) else value.isoformat()
    return "'" + str(value).replace("'", "''") + "'"


def spark_literal(value: object) -> str:
    """As above for Spark's parser, in which a backslash escapes too."""
    return escape_sql_literal(value.replace("\\", "\\\\") if isinstance(value, str) else value)


def validate_partition_name(name: str) -> str:
    if not isinstance(name, str) or not 0 < len(name) <= 255 or not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"not a partition name: {name!r}")
    return name


def validate_partition_value(value: str) -> str:
    text = str(value)
    if len(text) > 1024 or any(x in text for x in ("../", "..\\", "\0", "\n", "\r")):
        raise ValueError("not a partition value")
    return text


def tokens(sql: str) -> list[tuple[str, str]]:
    """(kind, text) of SQL text, kinds being string, name (quoted), comment, word, space and other."""
    spec = [
        ("string", r"'(?:[^']|'')*'"),
        ("name", r'"(?:[^"]|"")*"|`(?:[^`]|``)*`'),
        ("comment", r"--[^\n]*|/\*.*?\*/"),
        ("word", r"[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9_.]*"),
        ("space", r"\s+"),
        ("other", r"."),
    ]
    pattern = re.compile("|".join(f"(?P<{k}>{p})" for k, p in spec), re.S)
    return [(m.lastgroup or "other", m.group()) for m in pattern.finditer(sql)]


def sanitize_filter_expression(text: str) -> str:
    """Without NULs, newlines and comments (not those inside quotes); open quotes are refused."""
    out = []
    for kind, t in tokens(text.replace("\0", "")):
        if kind == "other" and t in "'\"`":
            raise ValueError("unbalanced quotes")
        out.append(" " if kind == "comment" or kind == "space" else t)
    return re.sub(r"[\r\n]", " ", "".join(out)).strip()


def validate_path(path: str, base: str | None = None) -> str:
    if not path or "\0" in path:
        raise ValueError("empty path or NUL in path")
    full = os.path.abspath(os.path.join(base, path) if base else path)
    if base:
        root = os.path.abspath(base)
        if os.path.commonpath([root, full]) != root:
            raise ValueError(f"{path!r} leads out of {base!r}")
    elif ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"{path!r} climbs up")
    return full


def safe_join(base: str, *paths: str) -> str:
    return validate_path(os.path.join(*paths) if paths else "", base) if paths else os.path.abspath(base)


def sanitize_filename(name: str, replacement: str = "_") -> str:
    out = re.sub(r'[<>:"/\\|?*\x00-\x1f]', replacement, name).strip(". ")
    return (out or replacement)[:255]


def redact(text: str) -> str:
    """Hides what follows key=, secret=, token= or password= and credentials in a URI."""
    text = re.sub(r"(?i)((?:key|secret|token|password)[\w.]*\s*[=:]\s*)[^\s,;&]+", r"\1***", text)
    return re.sub(r"(\w+://)[^/@\s]+@", r"\1***@", text)
