"""JSON files of any layout: an array, one object over many lines, or lines of objects."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from parquarry.functions.types import union_diagonal
from parquarry.plans.stats import open_file

#: Bytes of a file's beginning that tell its layout; a first line longer than this counts as one of lines.
HEAD = 1 << 20
FILES_PER_TASK = 64


def is_document(head: bytes, whole: bool) -> bool:
    """Whether a file that begins so is one JSON value, rather than lines of objects."""
    text = head.removeprefix(b"\xef\xbb\xbf").lstrip()
    if not text.startswith(b"{"):
        return True
    line, newline, _ = text.partition(b"\n")
    if not newline and not whole:
        return False
    try:
        json.loads(line)
    except ValueError:
        return True
    return False


def _kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = []
        for uri in b["uri"]:
            with open_file(uri) as f:
                head = f.read(HEAD)
            found.append(is_document(head, len(head) < HEAD))
        yield pd.DataFrame({"uri": b["uri"], "document": found})


def read_json(spark: SparkSession, uris: Sequence[str], **options: str) -> DataFrame:
    """The rows of all files, in the columns of all; executors look at how each file begins."""
    listed = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(-(-len(uris) // FILES_PER_TASK))
    kinds = {r["uri"]: r["document"] for r in listed.mapInPandas(_kinds, "uri string, document boolean").collect()}
    frames = [spark.read.options(**{**options, "multiLine": str(k).lower()}).json(some) for k in (False, True) if (some := [u for u in uris if kinds[u] is k])]
    return frames[0] if len(frames) == 1 else union_diagonal(frames)
