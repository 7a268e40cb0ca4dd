"""The only code that puts files in place of others: stage, move in, then remove the old."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from parquarry.sources.storage import Storage


class PartialWriteError(RuntimeError):
    """New files are in place but old ones could not all be removed; ``files`` are the new ones."""

    def __init__(self, message: str, files: list[str]):
        super().__init__(message)
        self.files = files


def stage(storage: Storage, df: DataFrame, partition_by: Sequence[str] = (), compression: str = "zstd", max_rows_per_file: int | None = None) -> str:
    """``df`` written under a folder that readers of the dataset don't see; its relative name."""
    name = f"_stage-{uuid.uuid4().hex}"
    w = df.write.option("compression", compression)
    if max_rows_per_file:
        w = w.option("maxRecordsPerFile", max_rows_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        w.parquet(storage.full(name))
    except Exception:
        storage.delete(name)
        raise
    return name


def move_in(storage: Storage, staged: str, basename: str | None = None) -> list[str]:
    """Staged files renamed into the dataset, in the order of their names; all or none."""
    base = basename or f"data-{int(time.time() * 1e6)}-{uuid.uuid4().hex[:16]}"
    found = sorted(f for f in Storage(storage.spark, storage.full(staged)).files(".parquet"))
    done: list[str] = []
    counts: dict[str, int] = {}
    try:
        for f in found:
            folder = f.rpartition("/")[0]
            i = counts[folder] = counts.get(folder, -1) + 1
            to = f"{folder}/{base}-{i:06d}.parquet" if folder else f"{base}-{i:06d}.parquet"
            storage.rename(f"{staged}/{f}", to)
            done.append(to)
    except Exception:
        for f in done:
            storage.delete(f)
        raise
    finally:
        storage.delete(staged)
    return done


def publish(storage: Storage, staged: str, old: Sequence[str] = (), basename: str | None = None) -> list[str]:
    """New files in, then old files out. Until the first old file goes, a failure leaves the dataset as it was."""
    new = move_in(storage, staged, basename)
    try:
        for f in old:
            storage.delete(f)
    except Exception as e:
        raise PartialWriteError(f"new files are in place, old ones remain: {e}", new) from e
    storage.spark.catalog.refreshByPath(storage.root)
    return new
