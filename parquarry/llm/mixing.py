"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow. Its documents, shuffled by a seeded hash, queue up; a document's virtual
finish time is the source's cumulative words (this document included) over the source's target.
A second pass of the same queue follows the first, so a document can be taken up to ``max_repeats``
times. All queues are merged by virtual finish time and cut where the words taken reach the total
budget, which leaves every source within one document of its target.

Nothing here is ordered in one task: a source is split by hash range into blocks whose sums are
prefixed on their own; the merged queue is partitioned by ranges of virtual finish time, ranges of
about as many rows each, their words are summed and prefixed, and only the range in which the budget
runs out is added up row by row. ``mix`` gives the documents sorted by virtual finish time.

Edge cases. Null or empty text: size 0, never taken. Null source: a source of its own, ordered
last. Null or repeated ids: rows of different text stay apart; rows equal in id, source and text are
taken together, as often each (so the mix may miss a target by such a group). Empty table: no rows.
Only the id, source and text columns are read; others pass through ``mix`` untouched, whatever they
are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parquarry.llm._common import WORD_PATTERN, checkpointed, col, fresh, shuffle_partitions

WEIGHTS = (5, 2, 1)
#: Rows a block of one source holds on average at most: what one task orders at once. Smaller tables get
#: smaller blocks, so that all tasks have some.
BLOCK_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, share: float = 1.5, max_repeats: int = 2, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Per source (columns ``source``, ``source_size``): its ``target`` in words.

    Sources by code point, null last, weigh ``weights`` in rotation and share ``share`` times all
    words; a target stops at ``max_repeats`` times its source and the excess goes to the others by
    weight until none is above. That fixed point is a water level: ordered by cap over weight, the
    first k sources are capped and the rest get level * weight, where level is what is left over
    the weight that is left. One row a source, so its window is as small as the list of sources.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.select("source", "source_size", weight.alias("weight"), (F.lit(float(max_repeats)) * F.col("source_size")).alias("cap"))
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left_budget"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left_weight"),
    )
    # a source is capped if its cap is below its share of what is left when its turn comes
    w = w.withColumn("open", F.col("cap") * F.col("left_weight") > F.col("left_budget") * F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("left_budget") / F.col("left_weight")))).over(everything).getField("col2")
    return w.select("source", "source_size", "weight", F.when(F.col("open"), level * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def _before(df: DataFrame, keys: list[str], order: list[Column], value: str) -> Column:
    """Sum of ``value`` over the rows ordered before this one within ``keys``."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(over), F.lit(0).cast("long"))


def virtual_times(docs: DataFrame, id_col: str, source_col: str, text_col: str, *, share: float = 1.5, max_repeats: int = 2, weights: Sequence[float] = WEIGHTS, seed: int = 42, block_rows: int | None = None) -> DataFrame:
    """One row for each set of equal documents: ``doc_id, source, size, n_equal, source_size, target, done``, ...

    ``done`` is the source's cumulative words through this document on the first pass; on pass p
    (from 0) the virtual finish time is (p * source_size + done) / target.
    """
    rows = docs.select(
        col(id_col).alias("doc_id"),
        col(source_col).alias("source"),
        word_count(col(text_col)).alias("size"),
        F.xxhash64(col(id_col), col(text_col), F.lit(seed)).alias("tie"),
        F.xxhash64(col(text_col)).alias("tie2"),
    )
    # read three times below: counted once, as equal rows together
    rows = checkpointed(rows.groupBy("doc_id", "source", "size", "tie", "tie2").agg(F.count(F.lit(1)).alias("n_equal")).withColumn("words", F.col("size") * F.col("n_equal")))
    per_source = rows.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = source_targets(per_source.select("source", "source_size"), share, max_repeats, weights)
    # one row a source; the planner broadcasts it only if its size allows, else AQE splits hot sources
    per_source = per_source.drop("source_size").withColumnRenamed("source", "s2").join(targets, F.col("s2").eqNullSafe(F.col("source"))).drop("s2").withColumnRenamed("source", "s3")
    rows = rows.join(per_source, F.col("source").eqNullSafe(F.col("s3"))).drop("s3", "weight")
    if block_rows is None:
        block_rows = max(1, min(BLOCK_ROWS, rows.count() // (2 * shuffle_partitions(docs.sparkSession))))
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_rows") / F.lit(block_rows)))
    # the block is the leading part of the order, so blocks follow one another in it
    u = F.shiftrightunsigned(F.col("tie"), 33)  # 31 bits, uniform
    rows = rows.withColumn("block", F.floor(u * blocks / F.lit(float(1 << 31))).cast("long"))
    sums = rows.groupBy("source", "block").agg(F.sum("words").alias("block_size"))
    sums = sums.withColumn("offset", _before(sums, ["source"], [F.col("block")], "block_size")).select(F.col("source").alias("s4"), F.col("block").alias("b4"), "offset")
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s4")) & (F.col("block") == F.col("b4"))).drop("s4", "b4")
    order = [u, F.col("tie"), F.col("doc_id"), F.col("tie2"), F.col("size")]
    done = F.col("offset") + _before(rows, ["source", "block"], order, "words") + F.col("words")
    return checkpointed(rows.select("doc_id", "source", "size", "n_equal", "words", "source_size", "target", "tie", "tie2", done.alias("done")))


def _passes(times: DataFrame, max_repeats: int) -> DataFrame:
    """One row for each time a document could be taken, with its virtual finish time."""
    sized = times.where((F.col("size") > 0) & (F.col("target") > 0))
    again = sized.select("*", F.explode(F.array(*[F.lit(p) for p in range(max_repeats)])).alias("p"))
    return again.withColumn("finish", (F.col("p") * F.col("source_size") + F.col("done")) / F.col("target"))


def cut_point(times: DataFrame, share: float = 1.5, max_repeats: int = 2, partitions: int | None = None) -> DataFrame:
    """One row (``cut``): the last place of the merged queue, in (finish, tie, ...), within budget; null if none is.

    The queue is range-partitioned by place; only the partition in which the budget runs out is added up
    row by row.
    """
    place = ["finish", "tie", "doc_id", "tie2", "p"]
    n = partitions or shuffle_partitions(times.sparkSession)
    items = _passes(times, max_repeats).select(*place, "words").repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in place])
    items = checkpointed(items.withColumn("part", F.spark_partition_id()))  # ranges are drawn: they must not be drawn twice
    budget = times.agg((F.lit(float(share)) * F.sum("words")).alias("budget"))
    # one row a partition
    parts = items.groupBy("part").agg(F.sum("words").alias("part_size"), F.max(F.struct(*place)).alias("last"))
    parts = parts.withColumn("below", F.coalesce(F.sum("part_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    parts = parts.crossJoin(F.broadcast(budget))  # one row
    whole = parts.where(F.col("below") + F.col("part_size") <= F.col("budget")).agg(F.max("last").alias("cut"))
    edge = parts.where((F.col("below") <= F.col("budget")) & (F.col("below") + F.col("part_size") > F.col("budget"))).select("part", "below", "budget")
    # at most one partition holds the edge
    edge = items.join(F.broadcast(edge), "part").withColumn("through", F.col("below") + F.sum("words").over(Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in place]).rowsBetween(Window.unboundedPreceding, 0)))
    within = edge.where(F.col("through") <= F.col("budget")).agg(F.max(F.struct(*place)).alias("cut"))
    return whole.unionByName(within).agg(F.max("cut").alias("cut"))


def _place(p: int) -> Column:
    """A row's place in the merged queue on pass ``p``."""
    finish = (F.lit(p) * F.col("source_size") + F.col("done")) / F.col("target")
    return F.struct(finish.alias("finish"), F.col("tie"), F.col("doc_id"), F.col("tie2"), F.lit(p).alias("p"))


def _taken(docs: DataFrame, id_col: str, source_col: str, text_col: str, *, share: float = 1.5, max_repeats: int = 2, weights: Sequence[float] = WEIGHTS, seed: int = 42, block_rows: int | None = None) -> DataFrame:
    """``virtual_times`` plus ``places``: those of each pass on which a document is taken."""
    times = virtual_times(docs, id_col, source_col, text_col, share=share, max_repeats=max_repeats, weights=weights, seed=seed, block_rows=block_rows)
    out = times.crossJoin(F.broadcast(cut_point(times, share, max_repeats)))  # cut is one row
    some = (F.col("size") > 0) & (F.col("target") > 0) & F.col("cut").isNotNull()
    # the target is 0 only where the size is
    places = F.when(some, F.array(*[F.when(_place(p) <= F.col("cut"), _place(p)) for p in range(max_repeats)]))
    return out.withColumn("places", F.coalesce(F.array_compact(places), F.array())).drop("cut")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """Per set of ``n_equal`` equal documents: ``source, size, source_size, target, tie2, copies`` and
    the words ``taken`` of each of them. Documents equal in id, source and text are taken together."""
    out = _taken(docs, id_col, source_col, text_col, **how).withColumn("copies", F.size("places"))
    return out.select("doc_id", "source", "size", "n_equal", "source_size", "target", "tie2", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: ``docs``' columns, each document as often as it is taken, sorted by virtual finish time."""
    i, s, t, at = fresh(docs, "mix_id", "mix_source", "mix_text", "mix_place")
    places = F.transform("places", lambda x: F.struct(x["finish"], x["tie"], x["p"]))
    taken = _taken(docs, id_col, source_col, text_col, **how).where(F.size("places") > 0).select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("tie2").alias(t), places.alias(at))
    same = col(id_col).eqNullSafe(F.col(i)) & col(source_col).eqNullSafe(F.col(s)) & (F.xxhash64(col(text_col)) == F.col(t))
    hit = docs.join(taken, same).select(*[col(c) for c in docs.columns], F.explode(at).alias(at))
    return hit.orderBy(at).drop(at)
