"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 64 bits are linked at ``max_bits`` (4) or fewer differing bits. Those touch at most
4 of the 8 bytes, so linked fingerprints agree in at least 4 bytes at their positions. Postings are
keyed by the bytes at several positions at once: the groups of positions are chosen such that any 4
positions contain one of them, so linked fingerprints meet under some key. Among fingerprints that
meet, equal positional bytes are tallied pair by pair, pairs under the guaranteed 4 are dropped, and
the rest are verified bit by bit.

Equal fingerprints are one row from the start, so exact copies cost nothing here. A list of postings
is worked on in blocks of bounded size, every pair of blocks in a task of its own; within a pair of
blocks links found so far spare comparisons, and only a spanning forest comes out: a group of n near
copies makes about n rows, not n squared. No link is lost: forests keep who is connected to whom.

Edge cases. Null text: no words, like an empty one; both have fingerprint zero and link like any
other. Null ids keep their row; a component of null ids only has a null id. Repeated ids or rows
stay rows. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parquarry.llm import overlap
from parquarry.llm._common import bounded_batches, bucketed, checkpointed, col, fresh, only, release, shuffle_partitions, temporary, unbucketed, unsigned_hex
from parquarry.llm.components import components

WORDS, BITS, SEED = 4, 4, 42
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 17
#: Fingerprints of one list of postings that one task compares with one another or another block.
BLOCK = 4096
#: Groups of byte positions. Any 4 of 8 positions hold both positions of some pair of the first list
#: (three classes, so two of the 4 fall in one), three of some triple of the second, or a quadruple.
PAIRS = [c for part in ((0, 1, 2), (3, 4, 5), (6, 7)) for c in combinations(part, 2)]
QUADS = list(combinations(range(8), 4))


def _triples() -> list[tuple[int, ...]]:
    """Triples such that any 4 of 8 positions hold one: three cyclic classes, each triple within a
    class or two of one class and one of the next."""
    part = {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2}
    out = []
    for c in combinations(range(8), 3):
        n = [sum(part[x] == k for x in c) for k in range(3)]
        if 3 in n or any(n[k] == 2 and n[(k + 1) % 3] == 1 for k in range(3)):
            out.append(c)
    return out


TRIPLES = _triples()


def hash_words(text: bytes, width: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, repeats included, some at a time."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: A-Z only, and just the six ASCII spaces
    if not words:
        return
    if len(words) < width:
        yield np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    join = b" ".join
    for at in range(0, len(words) - width + 1, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        yield np.fromiter((xxh64_intdigest(join(w), SEED) for w in zip(*[part[k:] for k in range(width)], strict=False)), np.uint64)


def simhash(text: bytes, width: int = WORDS) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes; 0 without words."""
    total, n = np.zeros(64, np.int64), 0
    for h in hash_words(text, width):
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = WORDS, out_col: str = "simhash", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) plus the fingerprint as a long, in place of a column of its name."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    (text,) = fresh(docs, "simhash_text")
    given = docs.select(*[col(c) for c in keep], F.coalesce(col(text_col), F.lit("")).cast("binary").alias(text))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(("simhash",), lambda: None)
        for b in batches:
            found = np.array([simhash(t.as_py(), width) for t in b.column(n)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(found, pa.int64())], names=[*b.schema.names[:n], out_col])

    return given.mapInArrow(run, given.drop(text).withColumn(out_col, F.lit(0).cast("long")).schema)


def groups_for(n: float) -> list[tuple[int, ...]]:
    """The groups of positions whose keys cost least over n fingerprints: a posting against comparisons.

    All three lists find every link; longer groups make more postings but shorter lists.
    """
    return min((PAIRS, TRIPLES, QUADS), key=lambda g: len(g) * (1 + n / 256.0 ** len(g[0]) / 1000))


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def forest(values: np.ndarray, split: int, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what pairs of ``values`` within ``max_bits`` connect, as index pairs.

    With ``split`` > 0 only pairs across that border count (the sides are worked on elsewhere).
    Breadth first: what a component has reached is not compared again.
    """
    n, out = len(values), []
    left = np.arange(n)
    one, low = np.uint64(1), np.uint64(0x0101010101010101)
    side = np.arange(n) < split
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:256], front[256:]
            x = values[some][:, None] ^ values[left][None, :]
            # tally equal positional bytes: fold each byte onto its lowest bit, count those unset
            y = x | x >> np.uint64(4)
            y |= y >> np.uint64(2)
            y |= y >> one
            near = np.bitwise_count(y & low) <= max_bits
            i, j = np.nonzero(near)
            ok = np.bitwise_count(x[i, j]) <= max_bits
            if split:
                ok &= side[some[i]] != side[left[j]]
            i, j = i[ok], j[ok]
            if len(j):
                j, first = np.unique(j, return_index=True)
                out += zip(some[i[first]].tolist(), left[j].tolist(), strict=True)
                front = np.concatenate([front, left[j]])
                left = np.delete(left, j)
    return out


def links(prints: DataFrame, max_bits: int = BITS, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """``u, v``: links between the distinct fingerprints of ``prints`` (one long column ``simhash``).

    Pairs linked may be missing, but never a connection.
    """
    spark = prints.sparkSession
    n = prints.count()
    parts = partitions or shuffle_partitions(spark)
    if not 0 <= max_bits <= 4:
        raise ValueError("the groups of positions guarantee up to 4 differing bits")
    keys = F.array(*[F.struct(F.lit(i).alias("g"), F.col("simhash").bitwiseAND(F.lit(_mask(p))).alias("key")) for i, p in enumerate(groups_for(n))])
    posts = prints.select(F.explode(keys).alias("k"), "simhash").select("k.g", "k.key", "simhash")
    sizes = posts.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    posts = posts.join(sizes, ["g", "key"])
    # lists longer than a block: every fingerprint goes to its block's pairings with all blocks
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    posts = posts.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("simhash"), blocks).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    posts = posts.select("g", "key", "simhash", "own", other).select("g", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "simhash")
    posts = posts.repartition(parts, "g", "key", "a", "b").sortWithinPartitions("g", "key", "a", "b", "own", "simhash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        name = None

        def work(rows: np.ndarray) -> pa.RecordBatch:
            values = rows[:, 5].copy().view(np.uint64)
            split = int((rows[:, 4] == rows[0, 2]).sum()) if rows[0, 2] != rows[0, 3] else 0
            pairs = np.array(forest(values, split, max_bits), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rows[pairs[:, 0], 5]), pa.array(rows[pairs[:, 1], 5])], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            m = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
            cuts = np.flatnonzero((m[1:, :4] != m[:-1, :4]).any(axis=1)) + 1
            found = []
            for run_rows in np.split(m, cuts):
                here = tuple(run_rows[0, :4])
                if held and here != name:
                    rows = np.concatenate(held)
                    held = []
                    if len(rows) > 1:
                        found.append(work(rows))
                held.append(run_rows)
                name = here
            if found:
                yield from found
        if held:
            rows = np.concatenate(held)
            if len(rows) > 1:
                yield work(rows)

    return posts.mapInArrow(run, "u long, v long")


def _found(docs: DataFrame, id_col: str, text_col: str, width: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, text_hash, simhash`` and, per fingerprint, ``simhash, component``."""
    given = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("text_hash"), col(text_col).alias("text"))
    rows = checkpointed(fingerprints(given, "text", width, keep=["doc_id", "text_hash"]))
    distinct = checkpointed(rows.select("simhash").distinct())
    linked = components(links(distinct, max_bits)).withColumnRenamed("node", "simhash")
    return rows, distinct.join(linked, "simhash", "left").select("simhash", F.coalesce("component", "simhash").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, max_bits: int = BITS) -> DataFrame:
    """Per row ``doc_id, simhash, fingerprint`` (16 hex digits) and ``component_id``: the smallest id
    reachable over links, its own included."""
    rows, of = _found(docs, id_col, text_col, width, max_bits)
    least = rows.groupBy("simhash").agg(F.min("doc_id").alias("least")).join(of, "simhash")
    least = least.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(least, "component").select("simhash", "component_id")
    return rows.join(of, "simhash").select("doc_id", "simhash", unsigned_hex(F.col("simhash")).alias("fingerprint"), "component_id")


def near_texts(texts: DataFrame, width: int = overlap.WORDS, max_bits: int = BITS) -> DataFrame:
    """``u, v``: links that connect all of ``texts`` (long ``node``, distinct; binary ``text``) that share
    ``overlap.SHARE`` of their ``width``-word shingles.

    Fingerprints within ``max_bits`` come from the index and their texts are compared; that joins most
    groups. But texts of that similarity may differ in more bits than byte positions can guarantee (about
    10 of 64 on average at 0.8), so ``overlap`` finds, exactly, what connections are still missing.
    """
    prints = checkpointed(fingerprints(texts, "text", width, keep=["node"]))
    first = checkpointed(prints.groupBy("simhash").agg(F.min("node").alias("u")))
    same = prints.join(first, "simhash").where(F.col("node") != F.col("u")).select("u", F.col("node").alias("v"))
    met = links(first.select("simhash"), max_bits).withColumnsRenamed({"u": "a", "v": "b"})
    for end, name in (("a", "u"), ("b", "v")):
        met = met.join(first.select(F.col("simhash").alias(end), F.col("u").alias(name)), end)
    candidates = checkpointed(same.unionByName(met.select("u", "v")).distinct())
    return overlap.links(texts, overlap.verified(candidates, texts, width), width)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = overlap.WORDS, max_bits: int = BITS) -> DataFrame:
    """``docs`` without near copies (``near_texts``): of each group of connected ones the row of the
    smallest id stays.

    Null ids come after all others; rows of the same id go by their text's hash, and of rows equal in
    both one stays.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(col(text_col), F.lit(""))
    names = fresh(docs, "kept_no_id", "kept_id", "kept_node")
    place = [col(id_col).isNull(), F.coalesce(col(id_col), F.lit(0)), F.xxhash64(text)]
    rows = checkpointed(docs.select(*[c.alias(x) for c, x in zip(place, ("no_id", "id", "node"), strict=True)]))
    path = temporary(docs.sparkSession, "texts")
    texts = bucketed(docs.select(F.xxhash64(text).alias("node"), text.cast("binary").alias("text")).dropDuplicates(["node"]), "node", path)
    release(docs.sparkSession)
    of = components(near_texts(texts, width, max_bits))
    unbucketed(docs.sparkSession, path)  # components are checkpointed
    release(docs.sparkSession)
    best = rows.groupBy("node").agg(F.min(F.struct("no_id", "id", "node")).alias("p")).join(of, "node", "left")
    best = best.groupBy(F.coalesce("component", "node")).agg(F.min("p").alias("p"))
    best = best.select(*[F.col(f"p.{f}").alias(x) for f, x in zip(("no_id", "id", "node"), names, strict=True)])
    keyed = docs.withColumns(dict(zip(names, place, strict=True)))
    return keyed.join(best, names).dropDuplicates(names).select(*[col(c) for c in docs.columns])
