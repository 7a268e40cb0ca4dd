"""The subpackage's registered queries and their SQL. Each applies one operator, with the
parameters meant for production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parquarry.llm import bpe, chat, digest, katz, langid, licenses, mixing, quality, simhash, urlrules

#: Given URL rules of op8; mined rules decide the rest.
URL_RULES = [
    urlrules.HostRule(urlrules.BLOCK, "net"),
    urlrules.HostRule(urlrules.ALLOW, "example.net", "/en/"),
    urlrules.HostRule(urlrules.BLOCK, "example.com", "/de/"),
    urlrules.HostRule(urlrules.ALLOW, "org", "/fr/"),
]
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.expand(turns.unionByName(planted)))


def op2_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_edited(table(spark, sf_dir, "documents"))


def op3_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.train_and_score(docs, held_out=langid.held_out(F.col("doc_id"), 10))


def op7_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"), 5)
    model = langid.train(docs.where(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(bad, urlrules.BLOCK).otherwise(urlrules.ALLOW).alias("label"))
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", "label")
    return urlrules.judge(pages, URL_RULES, labelled).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op9_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.known_licenses(spark)).select("doc_id", "canonical_chars", "license_digest", "license_id")


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mixing.mix_counts(table(spark, sf_dir, "documents"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_equal"))).alias("one")
    return counts.select("doc_id", "source", "size", "source_size", "target", "taken", again).drop("one")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_prefix_targets, op2_quartile_digest, op3_rule_cascade, op4_byte_bpe, op5_simhash, op6_katz, op7_naive_bayes, op8_url_rules, op9_license_digest, op10_fair_mix)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_rule_cascade": quality.ORACLE, "op9_license_digest": licenses.oracle()}
