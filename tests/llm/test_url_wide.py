"""Rules on tokens of labelled URLs that have many are all found."""

from parquarry.llm import urlrules


def test_rules_of_urls_with_many_tokens(spark):
    # a and b together are blocked; twelve other segments each say more alone, none enough
    noise = [f"n{i}" for i in range(12)]
    rows = [("/".join([*noise, "a", "b"]), "block")] * 20 + [("a/c", "allow")] * 40 + [("b/c", "allow")] * 40
    rows += [(x, "allow") for x in noise for _ in range(5)]
    df = spark.createDataFrame([(f"http://h.io/{p}", y) for p, y in rows], "url string, label string")
    got = {tuple(r["tokens"]): (r["confidence"], r["support"]) for r in urlrules.mine(df).collect()}
    pairs = {(x, y) for x in ["a", "b", *noise] for y in ["a", "b", *noise] if x < y}
    assert got == {(f"path:{x}", f"path:{y}"): (1.0, 20 / len(rows)) for x, y in pairs}
