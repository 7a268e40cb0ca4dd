"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Triplets of bytes within a sliding window of five are hashed into 256 buckets; each bucket's count
is encoded as the quartile it falls in (2 bits), and the length as one logarithmic byte. Two digests
differ by the sum of quartile steps, an extreme step counting extra, plus a bounded length term; the
likeness is 1 less that difference over a bound near what unrelated texts show, never below 0.

Edge cases. Null text counts as empty; the empty text's digest has all buckets in the lowest
quartile. Texts of under five bytes have few or no triplets and differ by their length byte. Equal
texts have equal digests. ``neighbours`` orders by id, nulls first, ties by the text's hash and the
text; equal rows follow one another. An only row is its own neighbour. Empty table: no rows. Ids are
whole numbers; others are refused. Columns of the caller's pass through ``fingerprint``, which replaces
one of the name that it adds.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquarry.llm._common import bounded_batches, col, shuffle_partitions

BUCKETS = 256
#: Bytes of a text that are counted at a time.
CHUNK = 1 << 20
#: Steps between quartiles 0, 1, 2 and 3 apart.
STEP = np.array([0, 1, 2, 6], np.uint8)
#: A difference at which texts count as unlike: about the mean over independent digests.
BOUND = 416
LENGTH_BOUND = 64
#: Places in a five-byte window of the triplets that hold its last byte, and a multiplier for each.
TRIPLETS = [(4, 3, 2, 0x9E3779B1), (4, 3, 1, 0x85EBCA6B), (4, 2, 1, 0xC2B2AE35), (4, 2, 0, 0x27D4EB2F), (4, 3, 0, 0x165667B1), (4, 1, 0, 0xD3A2646D)]


def _count(data: np.ndarray, owner: np.ndarray | None, n: int) -> np.ndarray:
    """Bucket counts (n, BUCKETS) of byte windows; a window counts only if one owner holds all of it."""
    if len(data) < 5:
        return np.zeros((n, BUCKETS), np.int64)
    wide = data.astype(np.uint32)
    parts = [wide[k : len(wide) - 4 + k] for k in range(5)]
    base, whole = None, slice(None)
    if owner is not None:
        whole = owner[:-4] == owner[4:]
        base = owner[:-4][whole] * BUCKETS
    total = np.zeros(n * BUCKETS, np.int64)
    for a, b, c, by in TRIPLETS:
        h = parts[a] | (parts[b] << np.uint32(8))
        h |= parts[c] << np.uint32(16)
        h *= np.uint32(by)
        h >>= np.uint32(24)
        total += np.bincount(h if base is None else h[whole] + base, minlength=n * BUCKETS)
    return total.reshape(n, BUCKETS)


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Counts for each text, short texts together and long ones a chunk at a time."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
            owner = np.repeat(np.arange(len(group), dtype=np.int32), [len(texts[i]) for i in group])
            out[group] = _count(data, owner, len(group))
        group, size = [], 0

    for i, t in enumerate(texts):
        if len(t) >= CHUNK:
            data = np.frombuffer(t, np.uint8)
            for at in range(0, len(data), CHUNK):  # neighbouring chunks share four bytes
                out[i] += _count(data[at : at + CHUNK + 4], None, 1)[0]
            continue
        group.append(i)
        size += len(t)
        if size >= CHUNK:
            flush()
    flush()
    return out


def quartiles(counts: np.ndarray) -> np.ndarray:
    """Codes 0 to 3: how many of its row's three quartiles a bucket's count exceeds."""
    if not len(counts):
        return np.zeros(counts.shape, np.uint8)
    q = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
    return sum((counts > q[:, [BUCKETS * k // 4 - 1]]).astype(np.uint8) for k in (1, 2, 3))


def length_code(n: int) -> int:
    """8 steps a doubling, at most 255."""
    return min(255, round(8 * float(np.log2(1 + n))))


class Digests:
    """Digests of a list of texts: quartile codes (n, BUCKETS) and length codes (n)."""

    def __init__(self, texts: list[bytes]):
        self.codes = quartiles(bucket_counts(texts))
        self.lengths = np.array([length_code(len(t)) for t in texts], np.int64)

    def hex(self) -> list[str]:
        if not len(self.codes):
            return []
        four = self.codes.reshape(len(self.codes), -1, 4)
        packed = four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6
        return [f"{n:02x}{row.tobytes().hex()}" for n, row in zip(self.lengths, packed.astype(np.uint8), strict=True)]


def likeness(a_codes: np.ndarray, a_len: np.ndarray, b_codes: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for differences of BOUND or more; row by row."""
    steps = STEP[np.abs(a_codes.astype(np.int8) - b_codes.astype(np.int8))].sum(axis=1, dtype=np.int64)
    diff = steps + np.minimum(LENGTH_BOUND, 2 * np.abs(a_len - b_len))
    return 1.0 - np.minimum(diff, BOUND) / BOUND


def parse(digest: str) -> tuple[np.ndarray, int]:
    """Codes and length code of a hex digest."""
    packed = np.frombuffer(bytes.fromhex(digest[2:]), np.uint8)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1), int(digest[:2], 16)


def compare(a: str, b: str) -> float:
    (x, n), (y, m) = parse(a), parse(b)
    return float(likeness(x[None], np.array([n]), y[None], np.array([m]))[0])


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` plus the hex digest of each whole text."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    keep = [i for i, c in enumerate(docs.columns) if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            names = [*[b.schema.names[i] for i in keep], out_col]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(Digests(texts).hex(), pa.string())], names=names)

    schema = T.StructType([*[docs.schema[i] for i in keep], T.StructField(out_col, T.StringType())])
    return docs.mapInArrow(run, schema)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """All rows as ``bucket, guest, doc_id, text`` such that, sorted by bucket, guest, doc_id, hash and
    text, each row's next within its bucket is its next in the whole table, the last's the first.

    Buckets are ranges of ids between approximate quantiles, about equal in rows; rows without an id, and
    those of an id that several quantiles fall on, are parted further by their text's hash. Texts are
    shuffled once; each bucket also gets the following bucket's first row as a guest, which is all that
    crosses a boundary.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}; ids must be whole numbers")
    n = partitions or shuffle_partitions(spark)
    ids = col(id_col).cast("long")
    cuts = [c for c in docs.select(ids.alias("id")).approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n) if c is not None] if n > 1 else []
    total, without = docs.agg(F.count(F.lit(1)), F.count_if(ids.isNull())).first()
    hot = {c: k + 1 for c, k in Counter(cuts).items() if k > 1}  # n / 2 at most
    many = {None: -(-n * without // max(total, 1)), **hot}
    rows = docs.select(ids.alias("doc_id"), ids.cast("double").alias("at"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("text"))
    if cuts:
        rows = Bucketizer(splits=[-float("inf"), *sorted(set(cuts)), float("inf")], inputCol="at", outputCol="b", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("b", F.lit(0.0))
    # a hot id begins its bucket, so its parts come first in it, in the order of the hash
    last = max(many.values())
    share = F.xxhash64("text") / F.lit(2.0**64) + F.lit(0.5)
    parts = F.lit(many[None])
    if hot:
        parts = F.when(F.col("doc_id").isNull(), parts).otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col("at")))
    sub = F.when(F.col("doc_id").isNull() | F.col("at").isin(list(hot)), F.least(F.floor(share * parts), parts - 1)).otherwise(last)
    base = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("b"))
    rows = rows.select((base * (last + 1) + sub).cast("int").alias("bucket"), "doc_id", "text")
    # some n rows: each bucket's smallest id, and the bucket that comes before
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect()
    order = sorted(r["bucket"] for r in firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    heads = spark.createDataFrame([(r["bucket"], r["first"], before[r["bucket"]]) for r in firsts], "head int, first long, to int")
    first = rows.join(F.broadcast(heads), (F.col("bucket") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("first")))
    first = first.groupBy("to").agg(F.min_by(F.struct("doc_id", "text"), F.struct(F.xxhash64("text"), F.col("text"))).alias("r"))
    guests = first.select(F.col("to").alias("bucket"), F.lit(True).alias("guest"), "r.doc_id", "r.text")
    return rows.select("bucket", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests)


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Every text against its edited text and its successor (by ascending id, the last's the first).

    The edited text has the last floor(n / 2) code points replaced by the successor's first as many.
    Rows: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or shuffle_partitions(spark)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, which waits for its successor
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            rows = ([held] if held else []) + rows
            held = rows[-1] if rows and not rows[-1][1] else None
            own = Digests([t for *_, t in rows])
            names = own.hex()
            pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            if not pairs:
                continue
            edited, n_chars = [], []
            for i in pairs:
                text, following = rows[i][3].decode("utf-8", "replace"), rows[i + 1][3].decode("utf-8", "replace")
                k = len(text) // 2
                n_chars.append(len(text))
                edited.append((text[: len(text) - k] + following[:k]).encode())
            new = Digests(edited)
            nxt = [i + 1 for i in pairs]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in pairs], pa.int64()),
                    pa.array(n_chars, pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                    pa.array([names[i] for i in pairs], pa.string()),
                    pa.array(new.hex(), pa.string()),
                    pa.array(likeness(own.codes[pairs], own.lengths[pairs], new.codes, new.lengths), pa.float64()),
                    pa.array(likeness(own.codes[pairs], own.lengths[pairs], own.codes[nxt], own.lengths[nxt]), pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    spread = neighbours(docs, id_col, text_col, n).repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return spread.mapInArrow(run, schema)
