"""What several operators share: word rules, checkpoints and Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these (space and tab to carriage return).
SPACES = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Largest Arrow batch handed to Python. Whole texts travel in these, so memory in a
#: worker is a small multiple of this or of the longest text, whichever is larger.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_BYTES / BATCH_ROWS, for rows that carry whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on one
    machine (tests); on a cluster an error, as executors share no folder of the driver's."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        jsc = spark.sparkContext._jsc.sc()
        where = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if where is None:
        if re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="parquarry-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; its lineage ends there."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as a Parquet table and read back."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, path: str) -> DataFrame:
    """``df`` written at ``path`` in as many buckets of ``key`` as shuffles have partitions, and read back: joins
    on the key then move the other side alone. ``unbucketed`` ends it."""
    spark = df.sparkSession
    name = _bucketed_name(path)
    n = min(shuffle_partitions(spark), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def unbucketed(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_bucketed_name(path)}")
    remove(spark, path)


def _bucketed_name(path: str) -> str:
    return "parquarry_" + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for helpers that clash with none of ``df``'s, whatever those are."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unsigned_hex(c: Column) -> Column:
    """A long as 16 lowercase hex digits, read as unsigned."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files that nothing can read any more, now rather than at the
    driver's next full collection. Twice, since Python's handles are let go between collections."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


_model: dict[tuple, object] = {}


def _trim() -> None:
    """Memory that has been freed goes back to the system, where the C library can do that."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def only(key: tuple, make) -> object:
    """In a Python worker: what ``make`` gives, kept for later tasks until another key is asked for.

    Workers outlive their tasks, so one operator's model must not stay beside the next one's.
    """
    if key not in _model:
        _model.clear()
        _trim()
        _model[key] = make()
    return _model[key]

