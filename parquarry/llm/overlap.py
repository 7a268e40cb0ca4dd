"""Near copies by the share of word shingles that two texts have in common (Jaccard), exactly.

Two sets of which at least 4/5 of the union is common share one of their first n - ceil(4n/5) + 1
members in any order that holds for all sets (prefix filtering). So every text posts only those, in
an order that puts shingles common in a sample last: shared passages then hardly ever meet. The
sample decides cost only; no pair is lost, whatever the order.

Texts that meet in a list of postings are compared with all their shingles. First only neighbours in
each list and each with the list's first are, which joins large groups of near copies at a cost in
proportion to their size; then all pairs of a list that are not connected yet and that sizes, places in
the order and parities of their shingles leave possible.

Edge cases. A text of fewer words than a shingle is one shingle; texts without words are copies of one
another. Empty table: no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parquarry.llm._common import checkpointed, only, release, remove, temporary, written
from parquarry.llm.components import components

WORDS = 5
#: Texts are near copies from this share of common shingles on, as numerator and denominator.
SHARE = (4, 5)
#: Texts whose shingles are counted to tell common ones, about; and columns of the counts.
SAMPLE, COLUMNS = 20_000, 1 << 21
#: Pairs of one text that one task compares, about.
PAIRS = 256
#: Bits of a text's parities.
BITS = 512


def shingles(text: bytes, width: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, ascending; words as in ``simhash.hash_words``."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - width + 1, 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two results of ``shingles`` have SHARE of their union in common."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * (SHARE[0] + SHARE[1]) >= SHARE[0] * (len(a) + len(b))


def _column(h: np.ndarray, columns: int) -> np.ndarray:
    return (h >> np.uint64(64 - (columns.bit_length() - 1))).astype(np.int64)


def _common(texts: DataFrame, n: int, width: int) -> np.ndarray:
    """How many texts of a sample have a shingle of each column."""
    take, columns = min(1.0, SAMPLE / max(n, 1)), COLUMNS
    some = texts.where(F.shiftrightunsigned(F.xxhash64("node", F.lit(5)), 33) < F.lit(take * (1 << 31))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(("overlap",), lambda: None)
        total = np.zeros(columns, np.int32)
        for b in batches:
            for t in b.column(0):
                np.add.at(total, _column(shingles(t.as_py(), width), columns), 1)
        (at,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    found = some.mapInArrow(run, "at int, n int").groupBy("at").agg(F.sum("n").cast("int").alias("n")).toArrow()
    out = np.zeros(columns, np.int32)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def postings(texts: DataFrame, n: int, width: int = WORDS) -> DataFrame:
    """``token, node, n, place``: the first shingles of each text that suffice, with the text's number of them."""
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts, n, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(("overlap",), lambda: None)
        common = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                tokens, sizes = [], []
                for t in part.column(1):
                    h = shingles(t.as_py(), width)
                    first = len(h) - -(-SHARE[0] * len(h) // SHARE[1]) + 1
                    tokens.append(h[np.argsort(common[_column(h, len(common))], kind="stable")[:first]])
                    sizes.append(len(h))
                long = [len(x) for x in tokens]
                place = np.concatenate([np.arange(x, dtype=np.int32) for x in long])
                node = np.repeat(part.column(0).to_numpy(), long)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(node), pa.array(np.repeat(np.array(sizes, np.int32), long)), pa.array(place)], names=["token", "node", "n", "place"])

    return texts.select("node", "text").mapInArrow(run, "token long, node long, n int, place int")


def verified(pairs: DataFrame, texts: DataFrame, width: int = WORDS) -> DataFrame:
    """Those of ``pairs`` (long ``u, v``) whose texts are near copies.

    Of each pair the end that is in fewer pairs brings its text to the other one, whose text is sent once for every
    PAIRS of them: a text that is near any number of others is no hot key. Where ``texts`` are bucketed by node, only
    texts of pairs move.
    """
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    given = pairs
    for end in ("u", "v"):
        given = given.join(ends.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n")), end)
    turned, pieces = F.col("u_n") < F.col("v_n"), F.ceil(F.greatest("u_n", "v_n") / F.lit(PAIRS))
    given = given.select(F.when(turned, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(turned, F.col("u")).otherwise(F.col("v")).alias("v"), pieces.alias("pieces"))
    given = checkpointed(given.select("u", "v", F.pmod(F.xxhash64("v"), "pieces").alias("piece")))
    many = given.select("u", "piece").distinct().join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    given = given.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(many, ["u", "piece"]).select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(("overlap",), lambda: None)
        last, one = None, None
        for b in batches:
            ok = []
            for u, x, y in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if u != last:  # pairs of one text mostly follow one another
                    last, one = u, shingles(x.as_py(), width)
                ok.append(similar(one, shingles(y.as_py(), width)))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

    return given.mapInArrow(run, "u long, v long")


def _possible(n: Column, place: Column, n2: Column, place2: Column) -> Column:
    """Whether two texts may have enough in common if nothing before these places is."""
    return F.least(n - place, n2 - place2) * F.lit(SHARE[0] + SHARE[1]) >= (n + n2) * F.lit(SHARE[0])


def parities(texts: DataFrame, width: int = WORDS) -> DataFrame:
    """``node, bits`` (array of longs): of each of BITS columns, whether an odd number of shingles falls
    there. Two texts differ in at least as many shingles as in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(("overlap",), lambda: None)
        for b in batches:
            odd = [np.bincount((shingles(t.as_py(), width) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1 for t in b.column(1)]
            bits = [np.packbits(x.astype(np.uint8)).view("<i8") for x in odd]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["node", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, bits array<long>")


def links(texts: DataFrame, known: DataFrame, width: int = WORDS) -> DataFrame:
    """``u, v``: near copies among ``texts`` (long ``node``, distinct; binary ``text``), the ``known`` ones
    included, whose groups are not compared again. Pairs may be missing, but never a connection."""
    known = checkpointed(known)
    release(texts.sparkSession)
    joined = components(known)
    w = Window.partitionBy("token").orderBy("place", "n", "node")
    this = F.struct("node", "n", "place")
    lists = postings(texts, texts.count(), width).withColumns({"before": F.lag(this).over(w), "first": F.first(this).over(w), "after": F.lead("node").over(w)})
    spark = texts.sparkSession
    at, at_rest = temporary(spark, "lists"), temporary(spark, "rest")
    lists = written(lists.where(F.col("before").isNotNull() | F.col("after").isNotNull()).drop("after"), at)
    release(spark)
    # the first of a list has the fewest shingles of its own: the likeliest to be near many others
    near = lists.where(F.col("before").isNotNull()).select("node", "n", "place", F.explode(F.array("before", "first")).alias("o"))
    near = near.where(_possible(F.col("n"), F.col("place"), F.col("o.n"), F.col("o.place")))
    near = near.select(F.least("o.node", "node").alias("u"), F.greatest("o.node", "node").alias("v")).distinct()
    for end in ("u", "v"):
        near = near.join(joined.select(F.col("node").alias(end), F.col("component").alias(f"{end}_group")), end, "left")
    near = checkpointed(near.where(F.coalesce(F.col("u_group") != F.col("v_group"), F.lit(True))).select("u", "v"))
    found = checkpointed(known.unionByName(verified(near, texts, width)))
    release(spark)
    of = components(found).withColumnRenamed("component", "group")
    rest = lists.select("token", "node", "n", "place").join(of, "node", "left").withColumn("group", F.coalesce("group", "node"))
    open_ = rest.groupBy("token").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a != b").select("token")
    rest = checkpointed(rest.join(open_, "token", "left_semi"))
    rest = written(rest.join(parities(texts.join(rest.select("node").distinct(), "node", "left_semi"), width), "node"), at_rest)
    release(spark)
    a, b = rest.alias("a"), rest.alias("b")
    n, differ = F.col("a.n") + F.col("b.n"), sum((F.bit_count(F.col("a.bits")[k].bitwiseXOR(F.col("b.bits")[k])) for k in range(BITS // 64)), F.lit(0))
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.group") != F.col("b.group"))
    on &= _possible(F.col("a.n"), F.col("a.place"), F.col("b.n"), F.col("b.place")) & (differ * F.lit(SHARE[0] + SHARE[1]) <= n * F.lit(SHARE[1] - SHARE[0]))
    pairs = a.join(b, on).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    pairs = checkpointed(pairs.join(near, ["u", "v"], "left_anti"))
    remove(spark, at)
    remove(spark, at_rest)
    release(spark)
    return found.unionByName(verified(pairs, texts, width))
