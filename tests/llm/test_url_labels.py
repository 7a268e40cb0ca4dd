"""Labels alone are mined, those of pages that a given rule decides included."""

from pyspark.sql import functions as F

from parquarry.llm import urlrules

RULES = [urlrules.HostRule("block", "net")]


def test_few_labels_decide_beside_many_decided_pages(spark):
    pages = [(i, f"http://a.net/x/p{i}") for i in range(2000)] + [(3000, "http://b.io/spam"), (3001, "http://b.io/news")]
    labels = [("http://c.io/spam", "block")] * 6 + [("http://c.net/bad", "block")] * 6 + [("http://c.io/news", "allow")] * 6
    df = spark.createDataFrame([*pages, (3002, "http://d.io/bad")], "page_id long, url string")
    labelled = spark.createDataFrame(labels, "url string, label string")
    got = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in urlrules.judge(df, RULES, labelled).where(F.col("page_id") >= 3000).collect()}
    assert got == {3000: ("block", "path:spam"), 3001: ("allow", None), 3002: ("block", "path:bad")}


def test_given_verdicts_are_evidence_only_without_labels(spark):
    df = spark.createDataFrame([(i, "http://a.net/bad") for i in range(9)] + [(10, "http://b.io/bad")], "page_id long, url string")
    none = spark.createDataFrame([(None, "block"), ("http://b.io/bad", None)], "url string, label string")
    some = spark.createDataFrame([("http://b.io/bad", "allow")], "url string, label string")
    verdict = lambda labelled: urlrules.judge(df, RULES, labelled).where("page_id = 10").first()["verdict"]
    assert [verdict(None), verdict(none), verdict(some)] == ["block", "block", "allow"]


def test_long_urls_of_one_pattern(spark):
    """Tokens that always come together are one: 30 segments do not make 2 ** 30 item sets."""
    long = "http://a.b.c.d.io/" + "/".join(f"s{i}" for i in range(30))
    labels = [(f"{long}/{k}", "block") for k in range(40)] + [(long, "allow")] * 2 + [("http://e.io/s1/s2", "allow")] * 40
    nested = [("http://n.io/" + "/".join(f"t{i}" for i in range(25 - k % 20)), "block" if k % 12 else "allow") for k in range(300)]
    df = spark.createDataFrame([(1, f"{long}/new"), (2, "http://e.io/s1"), (3, "http://n.io/" + "/".join(f"t{i}" for i in range(25)))], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge(df, RULES, spark.createDataFrame(labels + nested, "url string, label string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}


def test_equally_sure_rules_and_clashing_columns(spark):
    labels = [("http://c.io/aa", "block")] * 6 + [("http://d.io/bb", "block")] * 6 + [("http://c.io/x", "allow"), ("http://d.io/x", "allow")] * 6
    df = spark.createDataFrame([(1, "http://z.io/aa/bb", "own", "mine"), (2, None, "own", "mine")], "page_id long, url string, url_tokens string, verdict string")
    got = urlrules.judge(df, RULES, spark.createDataFrame([(*x, 1) for x in labels], "url string, label string, host int")).orderBy("page_id").collect()
    assert [(r["verdict"], r["mined_rule"], r["url_tokens"]) for r in got] == [("block", "path:bb", "own"), ("allow", None, "own")]
