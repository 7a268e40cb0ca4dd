"""Near copies by shared five-word shingles, against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from parquarry.llm import overlap, simhash


def grams(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def survivors(rows):
    """Least id of each component of the texts whose five-word Jaccard is 0.8 or more."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        c = find(i)
        least[c] = k if least.get(c) is None else least[c] if k is None else min(k, least[c])
    return least.values()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(40)]
    texts = []
    for k in range(40):
        base = [word() for _ in range(r.randint(50, 120))] + (passage if k % 2 else [])
        texts.append(base)
        for _ in range(r.randint(0, 5)):  # replaced words make 0.7 to 1 of the shingles common
            base = [*texts[-1]] if r.random() < 0.5 else [*base]
            for at in r.sample(range(len(base)), r.randint(0, 3)):
                base[at] = word()
            texts.append(base)
    texts = [" ".join(t) for t in texts] + ["one two", "One  two", "three", "", None, " \n"]
    out = list(enumerate(texts))
    r.shuffle(out)
    return [*out, out[5], (None, out[6][1]), (None, "only here without an id")]


def test_stage_finds_all_pairs_of_four_fifths(spark, rows):
    """Copies of 0.8 to 0.9, most of which differ in more than 4 bits of a SimHash, go too."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(survivors(rows), key=str)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((x["doc_id"] for x in got), key=str) == want
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("parquarry_texts")]


def test_order_of_shingles_changes_no_result(spark, rows, monkeypatch):
    monkeypatch.setattr(overlap, "SAMPLE", 10)
    monkeypatch.setattr(overlap, "COLUMNS", 1 << 6)
    monkeypatch.setattr(overlap, "PAIRS", 2)  # texts of more pairs are sent several times
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((x["doc_id"] for x in simhash.keep_one(docs).collect()), key=str) == sorted(survivors(rows), key=str)


def test_verified_against_all_pairs(spark, monkeypatch):
    """A text of many pairs, a chain and pairs of both ends many, checked in pieces."""
    monkeypatch.setattr(overlap, "PAIRS", 3)
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(24):
        t = [*base]
        for at in r.sample(range(60), k % 6):
            t[at] = f"x{r.random()}"
        texts.append(" ".join(t))
    pairs = [(0, k) for k in range(1, 24)] + [(k, k + 1) for k in range(1, 23)] + [(k, 20) for k in range(2, 19, 2)]
    given = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "node long, text binary").repartition(4)
    got = overlap.verified(spark.createDataFrame(pairs, "u long, v long"), given).collect()
    sets = [grams(t) for t in texts]
    want = {(u, v) for u, v in pairs if 5 * len(sets[u] & sets[v]) >= 4 * len(sets[u] | sets[v])}
    assert sorted(tuple(sorted(x)) for x in got) == sorted(tuple(sorted(x)) for x in want) and 0 < len(want) < len(pairs)
