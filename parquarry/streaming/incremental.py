"""Keeping a dataset current from a folder that grows: Structured Streaming into a keyed merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from parquarry.operators.dataset import ParquetDataset


def merge_stream(source: DataFrame, target: ParquetDataset, key_columns: Sequence[str], checkpoint: str, strategy: str = "upsert") -> StreamingQuery:
    """Each micro-batch of a streaming frame merged into ``target``; what is there is taken, then it ends.

    A batch that is run again after a failure merges the same rows again, which an upsert or an insert
    leaves as they are.
    """

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            target.merge(batch, strategy=strategy, key_columns=key_columns)

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
