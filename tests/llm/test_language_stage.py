"""What is in none of the labelled languages goes, whatever the posterior says of it."""

import random

from parquarry.llm import langid

SYLLABLES = {"aa": "ba de li mo nu ra si to", "bb": "xu xy zaq zu qe kwi vyx ox"}


def words(r, of, n):
    return " ".join("".join(r.choice(of) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_gibberish_and_unknown_scripts_go(spark):
    r = random.Random(9)
    data = [(i, words(r, SYLLABLES[x].split(), r.randint(50, 150)), x) for i, x in enumerate(["aa", "bb"] * 100)]
    data += [(500 + i, words(r, "bcdfghjklmnpqrstvwxz", 80), None) for i in range(5)]
    data += [(600, words(r, "при вет мир как де ла".split(), 80), None), (601, words(r, "при вет мир".split(), 80), "aa")]
    data += [(700, words(r, SYLLABLES["aa"].split(), 80), None), (701, "ba de", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    scores = {x["doc_id"]: x["score"] for x in langid.predict(docs, langid.train(docs)).collect()}
    assert min(scores[i] for i in range(500, 505)) > langid.MIN_SCORE  # the posterior alone lets them pass
    got = langid.keep(docs)
    assert got.columns == docs.columns
    assert {x["doc_id"] for x in got.collect()} == {*range(200), 700, 701}
