"""From raw documents to a tokenised, deduplicated mix: five stages one after another.

Each stage works on all that the one before kept, and its result is written before the next begins.
Every stage passes on all columns of its rows, whatever they are called; the last gives token ids in
place of the text. An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parquarry.llm import bpe, langid, mixing, quality, simhash
from parquarry.llm._common import exists, remove, shared_dir
from parquarry.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the cascade keep."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in some language; ``lang`` is what was found where a document names none."""
    return langid.keep(docs, fill=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts that share 0.8 of their five-word shingles."""
    return simhash.keep_one(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target lets it be taken."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts."""
    import public_tokenizers

    coded = bpe.tokenize(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.drop("text")


STAGES = [
    ("quality", quality_rules),
    ("language", language_id),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing_weights),
    ("tokens", byte_bpe),
]

#: SQL can't express the language, near-copy and token stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's rows are removed when the next ones are written. With ``at``, a folder of the caller's, a run that was
    broken off goes on after the last stage that it finished there.
    """
    base = at or f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    paths = [f"{base}/{i}-{name}" for i, (name, _) in enumerate(STAGES)]
    done = max((i for i, p in enumerate(paths) if exists(spark, f"{p}/_SUCCESS")), default=-1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet" if done < 0 else paths[done])
    for i in range(done + 1, len(STAGES)):
        STAGES[i][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[i])
        docs = spark.read.parquet(paths[i])
        if i:
            remove(spark, paths[i - 1])
    return docs
