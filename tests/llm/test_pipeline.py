"""The whole pipeline against a plain version of each of its stages."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from parquarry.llm import bpe, langid
from tests.llm.test_operators import brute_targets
from tests.llm.test_overlap import survivors

SF = "/root/testdata/sf0.001"


def passes(text):
    """The base rules and the default ones, told plainly."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {x for x in windows if windows.count(x) > 1}
    repeat = len({i + d for i, x in enumerate(windows) if x in again for d in range(3)})
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    chars = sum(map(len, w))
    count = lambda p: len(re.findall(p, t))
    return not (
        len(w) < 50
        or 100 * repeat > 50 * len(w)
        or 10 * count(r"[#*$%&|<>]") > len(w)
        or not 2 * len(w) <= chars <= 20 * len(w)
        or 100 * (len(lines) - len(set(lines))) > 30 * len(lines)
        or 100 * count("[A-Z]") > 40 * chars
        or 10 * count("!") > 3 * len(w)
        or 100 * count("[0-9]") > 30 * chars
    )


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Real documents of the smallest table, with rows that each stage must decide on."""
    r = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("quality_row", F.lit("own"))
    some = [x for x in docs.where("length(text) > 900 AND lang = 'en'").collect() if passes(x["text"])][:6]
    extra = []
    for i, x in enumerate(some):
        words = x["text"].split(" ")
        words[len(words) // 2] = "otherwise"
        extra.append((10_000 + i, " ".join(words), None if i % 2 else "en", x["source"], 0, "near"))
    noise = lambda: " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(90))
    extra += [(20_000 + i, noise(), "en" if i else None, "web", 0, "noise") for i in range(3)]
    extra += [(30_000, "", "en", "web", 0, "empty"), (30_001, None, None, None, None, "null"), (None, some[0]["text"], "en", None, 0, "no id")]
    at = tmp_path_factory.mktemp("pipe")
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(3).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_pipeline(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    given = docs.collect()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], table)
        out.append(spark.createDataFrame(made.collect(), made.schema))
        if len(out) < len(corpus_pipeline.STAGES) + 1:
            assert out[-1].columns == docs.columns
    kept, spoken, unlike, mixed, coded = [x.collect() for x in out[1:]]
    key = lambda x: (x["doc_id"], x["text"])
    text = lambda rows: sorted(map(key, rows), key=str)
    assert text(kept) == text(x for x in given if passes(x["text"]))
    # noise of consonants goes, all else stays and has a language
    assert text(spoken) == text(x for x in kept if x["quality_row"] != "noise") and any(x["quality_row"] == "noise" for x in kept)
    assert all(x["lang"] for x in spoken) and {x["lang"] for x in spoken if x["quality_row"] == "near"} == {"en"}
    assert sorted((x["doc_id"] for x in unlike), key=str) == sorted(survivors([key(x) for x in spoken]), key=str)
    assert not any(x["quality_row"] == "near" for x in unlike)
    # each source within one document of its target, no row more than twice
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes, taken, most = {}, {}, {}
    for rows, into in ((unlike, sizes), (mixed, taken)):
        for x in rows:
            into[x["source"]] = into.get(x["source"], 0) + size(x["text"])
            most[x["source"]] = max(most.get(x["source"], 0), size(x["text"]))
    target = brute_targets(sizes)
    assert all(abs(taken.get(s, 0) - target[s]) <= most[s] for s in sizes)
    assert max(map([key(x) for x in mixed].count, map(key, unlike))) <= 2
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((x["doc_id"], theirs.encode_ordinary(x["text"])) for x in mixed)
    assert want == sorted((x["doc_id"], np.frombuffer(x["ids"], "<u4").tolist()) for x in coded) and all(x["round_trip"] for x in coded)


def test_run_resumes_and_cleans(spark, table, tmp_path, monkeypatch):
    done = []
    stages = [(n, lambda s, d, sf, n=n: (done.append(n), d)[1]) for n in ("a", "b", "c")]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    at = str(tmp_path / "run")
    n = spark.read.parquet(f"{table}/documents.parquet").count()
    assert corpus_pipeline.run(spark, table, at).count() == n and done == ["a", "b", "c"]
    assert sorted(x.name for x in (tmp_path / "run").iterdir()) == ["2-c"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages, ("d", stages[0][1])])
    assert corpus_pipeline.run(spark, table, at).count() == n and done == ["a", "b", "c", "a"]


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_is_filled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400")
    some = docs.withColumn("said", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    got = langid.keep(some, fill=True).collect()
    assert got and all(x["lang"] == x["said"] for x in got if x["doc_id"] % 3 == 0)
