"""URL filters: a given list of host and path rules, and association rules mined from labelled URLs.

Every URL is a set of tokens (host suffixes, path segments, names of query parameters). FP-growth
finds the token combinations that are frequent among labelled URLs together with the label
``block``; those whose confidence and support reach a threshold, and that no shorter kept rule
implies, become rules. An inverted index from each rule's rarest token to the rule finds candidate
rules; a candidate fits if all its tokens are there.

Before FP-growth, whose work doubles with every token that URLs share: tokens that are too rare to
be in any rule go; tokens that alone point to ``block`` surely enough are rules at once, and those without
exception leave nothing to combine. Where a URL then still has more than MAX_ITEMS tokens, combinations
are grown level by level instead (``_grown``), and only those that can become kept rules: all of these are found.

Edge cases. Null or malformed url: empty host and path, no tokens, so no mined rule fits; verdict
allow. No labels or no blocked ones: no mined rule. Equally sure rules: the better supported, then
the greater by tokens. Repeated rows: each its own result. Empty table: no rows. A given rule with an
empty path fits every path of its host. Columns of the caller's pass through, those that ``judge``
adds are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parquarry.llm._common import LOWER, UPPER, checkpointed, col, fresh

BLOCK, ALLOW = "block", "allow"
LABEL = "label:"
#: A rule needs this share of labelled URLs, and to be right in this share of those it fits.
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.9
#: Whatever the share, it needs so many.
MIN_COUNT = 5
#: With more tokens than these left in some labelled URL, combinations are grown level by level, not by FP-growth.
MAX_ITEMS = 10
#: Given rules are tried one after another in an expression; more than this many are refused.
MAX_GIVEN = 500


@dataclass(frozen=True)
class HostRule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens, sorted: host suffixes, path segments, query parameters' names."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda _, i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    names = F.filter(F.transform(F.split(query_of(url), "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1))), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(suffixes, F.transform(segments, lambda x: F.concat(F.lit("path:"), x)), F.transform(names, lambda x: F.concat(F.lit("query:"), x)))))


def given_rule(host: Column, path: Column, rules: list[HostRule]) -> Column:
    """The longest of ``rules`` that fits, as struct<rule, verdict>, or null; equal lengths: block first."""
    if len(rules) > MAX_GIVEN:
        raise ValueError(f"{len(rules)} given rules; at most {MAX_GIVEN} are tried in one expression")
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.verdict != BLOCK, r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = (F if out is None else out).when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")))
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _mined_items(urls: DataFrame, n: int, min_count: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """``urls`` (``row, tokens, bad``) to ``row, bad, items``, all that combinations can hold, and the tokens that
    are rules alone (``tokens, confidence, support``)."""
    seen = urls.select("row", "bad", F.explode("tokens").alias("token"))
    per = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))
    per = checkpointed(per.where(F.col("n_bad") >= min_count))
    alone = per.where(F.col("n_bad") / F.col("n") >= min_confidence).select(F.array("token").alias("tokens"), (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / F.lit(n)).alias("support"))
    rest = per.where("n_bad < n").select("token")
    return seen.join(rest, "token").groupBy("row", "bad").agg(F.sort_array(F.collect_list("token")).alias("items")), alone


def _grown(items: DataFrame, n: int, n_good: int, min_count: int, min_confidence: float) -> DataFrame:
    """Rules on two tokens or more of ``items`` (``row, bad, items``), of all labelled URLs ``n``, ``n_good`` not blocked.

    A token that excludes no allowed URL which the others of its combination fit can't make a rule surer, nor
    any longer one: without it that would be as sure and better supported. So a combination is grown only
    where each of its tokens excludes one, and where enough blocked URLs have it. Work grows with these.
    """
    seen = items.select("row", "bad", F.explode("items").alias("token"))
    per = seen.groupBy("token").agg(F.count_if(~F.col("bad")).alias("good"))
    last = checkpointed(per.where(F.col("good") < n_good).select(F.array("token").alias("tokens"), "good"))
    seen = checkpointed(seen.join(last.select(F.col("tokens")[0].alias("token")), "token", "left_semi").select("row", "bad", "token"))
    held = seen.select("row", F.array("token").alias("tokens"))
    found = items.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double")
    while not last.isEmpty():
        held = held.join(seen, "row").where(F.col("token") > F.element_at("tokens", -1)).select("row", "bad", F.concat("tokens", F.array("token")).alias("tokens"))
        level = held.groupBy("tokens").agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("good")).where(F.col("n_bad") >= min_count)
        less = F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("less")
        before = last.select(F.col("tokens").alias("less"), F.col("good").alias("less_good"))
        fit = level.select("*", less).join(before, "less").where("good < less_good").groupBy("tokens", "n_bad", "good").agg(F.count(F.lit(1)).alias("k"))
        level = checkpointed(fit.where(F.col("k") == F.size("tokens")).drop("k"))
        sure = F.col("n_bad") / (F.col("n_bad") + F.col("good"))
        found = found.unionByName(level.where(sure >= min_confidence).select("tokens", sure.alias("confidence"), (F.col("n_bad") / F.lit(n)).alias("support")))
        last = level.where("good > 0").select("tokens", "good")
        held = checkpointed(held.join(last.select("tokens"), "tokens", "left_semi").select("row", "tokens"))
    return found


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "label", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``tokens (array<string>), confidence, support`` that point to ``block``.

    ``labelled`` has one row a labelled URL; rows without a url or label are no evidence. A rule is
    dropped if a rule on fewer of its tokens is kept and at least as sure.
    """
    spark = labelled.sparkSession
    urls = labelled.where(col(url_col).isNotNull() & col(label_col).isNotNull()).select(tokens_of(col(url_col)).alias("tokens"), (col(label_col) == BLOCK).alias("bad"))
    urls = checkpointed(urls.withColumn("row", F.monotonically_increasing_id()))
    n, n_block = urls.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    empty = spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    if not n_block:
        return empty
    min_count = max(MIN_COUNT, math.ceil(min_support * n - 1e-9))
    items, found = _mined_items(urls, n, min_count, min_confidence)
    items = checkpointed(items)
    n_items, most = items.agg(F.count(F.lit(1)), F.max(F.size("items"))).first()
    if n_items and most > MAX_ITEMS:
        found = found.unionByName(_grown(items, n, n - n_block, min_count, min_confidence))
    elif n_items:
        items = items.select(F.concat("items", F.array(F.when(F.col("bad"), LABEL + BLOCK).otherwise(LABEL))).alias("items"))
        # support is a share of all labelled rows, also of those that have no item left
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_count - 0.5) / n_items), minConfidence=min_confidence).fit(items)
        some = model.associationRules.where((F.element_at("consequent", 1) == LABEL + BLOCK) & (F.size("antecedent") > 1) & ~F.exists("antecedent", lambda t: t.startswith(LABEL)))
        found = found.unionByName(some.select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * F.lit(n_items / n)).alias("support")))
    found = checkpointed(found)
    # a shorter rule that implies this one: look it up by this one's subsets, 2 ** MAX_ITEMS at most, or by one token
    t = F.col("tokens")
    whole = found
    found = whole.where(F.size(t) <= MAX_ITEMS)
    subsets = F.transform(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(t)) - 2), lambda m: F.filter(t, lambda _, i: F.call_function("getbit", m, i) == 1))
    subsets = F.when(F.size(t) > 1, subsets).otherwise(F.array().cast("array<array<string>>"))
    short = found.select(t.alias("sub"), F.col("confidence").alias("sub_confidence"))
    implied = found.select("tokens", "confidence", F.explode(subsets).alias("sub")).join(short, "sub").where(F.col("sub_confidence") >= F.col("confidence")).select("tokens").distinct()
    by_token = whole.select(t.alias("sub"), F.col("confidence").alias("sub_confidence"), F.col("tokens")[0].alias("token"))
    longer = whole.where(F.size(t) > MAX_ITEMS).select("tokens", "confidence", F.explode("tokens").alias("token")).join(by_token, "token")
    longer = longer.where((F.size("sub") < F.size("tokens")) & (F.col("sub_confidence") >= F.col("confidence")) & (F.size(F.array_except("sub", "tokens")) == 0))
    return whole.join(implied.unionByName(longer.select("tokens").distinct()), "tokens", "left_anti")


def _index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``rules`` keyed by the token of each that fewest of ``urls`` have."""
    needed = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode("tokens").alias("token")).join(needed, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    places = rules.select("*", F.explode("tokens").alias("token")).join(seen, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token")))
    return places.groupBy("tokens", "confidence", "support").agg(rarest.alias("key"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Of ``urls`` (``url``, distinct, and ``tokens``) those that a rule fits, with the surest: ``url, mined``."""
    index = checkpointed(_index(rules, urls).select("key", F.col("tokens").alias("needs"), "confidence", "support"))
    found = urls.select("url", "tokens", F.explode("tokens").alias("key")).join(index, "key").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max_by(F.array_join("needs", " + "), F.struct("confidence", "support", "needs"))
    return found.groupBy("url").agg(best.alias("mined"))


def judge(pages: DataFrame, rules: list[HostRule], labelled: DataFrame | None = None, url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``pages`` plus ``host, path, rule, mined_rule, verdict``; columns of these names are replaced.

    Rules are mined from ``labelled`` (columns ``url, label``) alone, all of it, so that support is a share
    of the labels; only where it has no url with a label, from the urls that a given rule decides, with
    its verdict.
    The mined rules decide only where no given rule fits: block if one fits, else allow.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "mined_rule", "verdict")]
    u, given, key, hit = fresh(pages, "url_url", "url_given", "url_key", "url_mined")
    out = pages.select(*[col(c) for c in keep], col(url_col).alias(u)).withColumns({"host": host_of(col(u)), "path": path_of(col(u))})
    out = out.withColumn(given, given_rule(F.col("host"), F.col("path"), rules))
    open_ = F.col(given).isNull() & (F.col("host") != "")
    evidence = None if labelled is None else labelled.select("url", "label").where(F.col("url").isNotNull() & F.col("label").isNotNull())
    if evidence is None or evidence.isEmpty():
        evidence = out.where(F.col(given).isNotNull()).select(col(u).alias("url"), F.col(given)["verdict"].alias("label"))
    mined = mine(evidence, min_support=min_support, min_confidence=min_confidence)
    urls = out.where(open_).select(col(u).alias("url")).distinct().withColumn("tokens", tokens_of(F.col("url")))
    hits = match(urls, mined).select(F.col("url").alias(key), F.col("mined").alias(hit))
    # only rows that a mined rule could decide meet the hits: null and decided urls share no key
    undecided = out.where(open_).join(hits, col(u) == F.col(key), "left").drop(key)
    out = undecided.unionByName(out.where(~open_).withColumn(hit, F.lit(None).cast("string")))
    verdict = F.coalesce(F.col(given)["verdict"], F.when(F.col(hit).isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return out.select(*[col(c) for c in keep], "host", "path", F.col(given)["rule"].alias("rule"), F.col(hit).alias("mined_rule"), verdict.alias("verdict"))
