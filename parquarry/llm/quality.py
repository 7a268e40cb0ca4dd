"""Quality rules as a short-circuit cascade, on DataFrame functions only.

A rule is a condition on features of a text under which the document goes. What a rule costs is what
its features cost that no earlier rule has made. On a bounded sample every feature is timed, over the
sample repeated up to a fixed size in one task, less the time of a pass that makes none, and rounded to
a power of two, so that noise does not change the order; every combination of verdicts is counted.
Rules are then ordered greedily by rejections, among the documents that earlier rules let pass, per
cost. Each step of the cascade makes its rule's features only for documents still in the running
(CASE WHEN none has rejected), so a rejected document pays for nothing that comes after. The order
changes cost only, never which documents pass.

Edge cases. Null text: no words, rejected by the length rule. Empty table: every rule keeps its
given place. Rules that evaluate to null do not reject. Columns of other names pass through, whatever
they are called; ``judge`` replaces columns of the names that it adds.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parquarry.llm._common import SPACE_CLASS, col, fresh

#: Symbols that mark leftovers of markup and tables. A fixed value.
SYMBOLS = "#*$%&|<>"
#: Rows that the ordering of rules is estimated on; the only part that reads a sample.
SAMPLE_ROWS = 1000
#: Bytes of text that each feature is timed on, the sample being repeated up to it.
TIMED_BYTES = 4 << 20

Get = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives the condition under which a document goes, from a function of a feature's name."""

    name: str
    rejects: Callable[[Get], Column]

    def needs(self) -> list[str]:
        """Names of the features that the condition asks for, in order."""
        asked: dict[str, None] = {}

        def ask(name: str) -> Column:
            asked[name] = None
            return F.lit(0)

        self.rejects(ask)
        return list(asked)


@dataclass(frozen=True)
class Feature:
    """Steps, each a column made from the text (``get("text")``) and the steps before it; the last is the feature."""

    steps: Sequence[tuple[str, Callable[[Get], Column]]]


def count_of(chars: str) -> Feature:
    """Characters of a regular expression's class ``chars``."""
    return Feature([("n", lambda get: F.regexp_count(get("text"), F.lit(f"[{chars}]")).cast("long"))])


def _words(get: Get) -> Column:
    return F.filter(F.split(get("text"), SPACE_CLASS + "+"), lambda w: w != "")


def _windows(get: Get) -> Column:
    """Hashes of the three-word windows, from 64-bit hashes of the words. Within a text of n words two
    differ under one hash in about n^2 / 2^64."""
    h = get("hashes")
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(h, i + 1), F.get(h, i + 2)))


def _sorted(get: Get) -> Column:
    """(window, place) in order, so that equal ones meet; none where all windows differ. Never quadratic."""
    w = get("windows")
    made = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(w)) < F.size(w), made).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _same(get: Get) -> Column:
    """Whether a window equals the next one in order."""
    w = get("sorted")
    return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))


def _repeated_places(get: Get) -> Column:
    """Places of windows that equal a neighbour in their order, ascending."""
    w, same = get("sorted"), get("same")
    m = F.size(w)
    pairs = F.zip_with(w, same, lambda a, b: F.struct(a["i"].alias("i"), b.alias("n")))
    hit = F.zip_with(pairs, F.concat(F.array(F.lit(False)), F.slice(same, 1, F.greatest(m - 1, F.lit(0)))), lambda a, b: F.when(a["n"] | b, a["i"]))
    return F.when(m > 0, F.sort_array(F.filter(hit, lambda i: i.isNotNull()))).otherwise(F.array().cast("array<int>"))


def _covered(get: Get) -> Column:
    """Words under those windows: each place covers three, or as many as there are up to the next."""
    p = get("places")
    k = F.size(p)
    gaps = F.zip_with(F.slice(p, 1, F.greatest(k - 1, F.lit(0))), F.slice(p, 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), b - a))
    return F.when(k > 0, F.aggregate(gaps, F.lit(3), lambda s, g: s + g)).otherwise(0).cast("long")


def _lines(get: Get) -> Column:
    return F.filter(F.split(get("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


#: What rules may ask for. Each step is a column of its own, so that the next one's lambdas read it
#: rather than make it anew for every element; steps of one name are made once.
FEATURES: dict[str, Feature] = {
    "n_words": Feature([("words", _words), ("n", lambda get: F.size(get("words")).cast("long"))]),
    "word_chars": Feature([("words", _words), ("n", lambda get: F.char_length(F.array_join(get("words"), "")).cast("long"))]),
    "n_symbols": count_of(SYMBOLS),
    "n_capitals": count_of("A-Z"),
    "n_digits": count_of("0-9"),
    "n_exclamations": count_of("!"),
    "n_lines": Feature([("lines", _lines), ("n", lambda get: F.size(get("lines")).cast("long"))]),
    "n_dup_lines": Feature([("lines", _lines), ("n", lambda get: (F.size(get("lines")) - F.size(F.array_distinct(get("lines")))).cast("long"))]),
    "n_repeat_words": Feature(
        [
            ("words", _words),
            ("hashes", lambda get: F.transform(get("words"), lambda w: F.xxhash64(w))),
            ("windows", _windows),
            ("sorted", _sorted),
            ("same", _same),
            ("places", _repeated_places),
            ("n", _covered),
        ]
    ),
}
#: Those that ``judge`` returns.
BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _with_features(docs: DataFrame, names: dict[str, str], text: str, helpers: dict[str, str], only_if: Column | None = None) -> DataFrame:
    """``with_features`` that leaves its helpers, and takes those of ``helpers`` (step to column) as made."""
    out = docs
    taken = {c.lower() for c in (*docs.columns, *names.values())}
    todo = {n: list(FEATURES[n].steps) for n in names}
    while any(todo.values()):
        made: dict[str, Column] = {}
        for n, steps in todo.items():
            if not steps:
                continue
            step, build = steps.pop(0)
            if steps and step in helpers:
                continue
            at = names[n]
            if steps:
                at = f"quality_{step}"
                while at.lower() in taken:
                    at = "_" + at
                taken.add(at.lower())
                helpers[step] = at
            value = build(lambda x: F.coalesce(col(text), F.lit("")) if x == "text" else col(helpers[x]))
            made[at] = value if only_if is None else F.when(only_if, value)
        out = out.withColumns(made) if made else out
    return out


def with_features(docs: DataFrame, names: dict[str, str], text: str) -> DataFrame:
    """``docs`` plus features (name to column's name) of the column ``text``. Columns of the given names
    are replaced."""
    helpers: dict[str, str] = {}
    return _with_features(docs, names, text, helpers).drop(*helpers.values())


def base_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus BASE (long): words, code points in words, symbols, lines with a word, those equal to an
    earlier one, words in repeated three-word windows. Columns of these names are replaced."""
    return with_features(docs, {n: n for n in BASE}, text_col)


#: Thresholds in whole numbers, so that every engine agrees.
def base_rules() -> list[Rule]:
    return [Rule("short", lambda f: f("n_words") < 50), Rule("repeats", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words"))]


def default_rules() -> list[Rule]:
    return [
        Rule("symbols", lambda f: 10 * f("n_symbols") > f("n_words")),
        Rule("word_length", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 20 * f("n_words"))),
        Rule("dup_lines", lambda f: 100 * f("n_dup_lines") > 30 * f("n_lines")),
        Rule("capitals", lambda f: 100 * f("n_capitals") > 40 * f("word_chars")),
        Rule("exclamations", lambda f: 10 * f("n_exclamations") > 3 * f("n_words")),
        Rule("digits", lambda f: 100 * f("n_digits") > 30 * f("word_chars")),
    ]


def _shared(feature: str) -> list[str]:
    """Steps of a feature that other features have too."""
    return [step for step, _ in FEATURES[feature].steps[:-1] if any(step == s for f, x in FEATURES.items() if f != feature for s, _ in x.steps[:-1])]


def _timed(sample: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Seconds that each feature takes on the sample (one partition, cached), as powers of two; steps that
    features share stand for themselves, and a feature's own is what it takes besides."""
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    again = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(max(1, min(4096, -(-TIMED_BYTES // size)))))).alias("again"))

    def seconds(made: DataFrame, *of: Column) -> float:
        best = math.inf
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            made.agg(F.sum(F.octet_length("text")), *of).collect()
            best = min(best, time.perf_counter() - began)
        return best

    nothing = min(seconds(again) for _ in range(2))
    cost: dict[str, float] = {}
    for step, build in {s: b for f in features for s, b in FEATURES[f].steps[:-1] if s in _shared(f)}.items():
        cost[step] = seconds(again.withColumn("step", build(lambda _: F.col("text"))), F.sum(F.size("step"))) - nothing
    for f in features:
        cost[f] = seconds(with_features(again, {f: "feature"}, "text"), F.sum("feature")) - nothing - sum(cost[s] for s in _shared(f))
    return {f: 2.0 ** round(math.log2(max(c, 1e-3))) for f, c in cost.items()}


def order_rules(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7, ready: Sequence[str] = ()) -> list[Rule]:
    """``rules`` by rejections per cost, both from a sample of about ``sample_rows`` of ``docs``.

    Features that are ``ready`` cost nothing. What comes to the driver is one row a combination of
    verdicts, 2 ** len(rules) at most and never more than the sample has rows, and times.
    """
    n = docs.count()
    if n == 0:
        return list(rules)
    sample = docs.sample(fraction=min(1.0, sample_rows / n), seed=seed).select(F.coalesce(col(text_col), F.lit("")).alias("text")).repartition(1).cache()
    try:
        asked = list(dict.fromkeys(f for r in rules for f in r.needs()))
        said = with_features(sample, {f: f for f in asked}, "text").groupBy(*[F.coalesce(r.rejects(col), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)])
        verdicts = [(tuple(row[:-1]), row[-1]) for row in said.count().collect()]
        cost = _timed(sample, [f for f in asked if f not in ready])
    finally:
        sample.unpersist()
    order, left, have = [], list(range(len(rules))), set(ready)
    parts = [{x for f in r.needs() if f not in ready for x in (f, *_shared(f))} for r in rules]
    while left:

        def worth(i: int) -> tuple[float, int]:
            # a condition on what is there already costs little, but not nothing
            price = sum(cost[x] for x in parts[i] - have) + 1e-4
            return sum(c for v, c in verdicts if v[i]) / price, -i

        best = max(left, key=worth)
        verdicts = [(v, c) for v, c in verdicts if not v[best]]
        have |= parts[best]
        order.append(rules[best])
        left.remove(best)
    return order


def cascade(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", out_col: str = "rejected_by", ready: dict[str, str] | None = None) -> DataFrame:
    """Adds the first of ``rules``, in their order, that rejects a document, null where none does.

    Features that are not ``ready`` (name to column) are made step by step, for documents that no
    rule before has rejected.
    """
    at = dict(ready or {})
    helpers: dict[str, str] = {}
    (verdict,) = fresh(docs, "quality_verdict")
    out = docs.withColumn(verdict, F.lit(None).cast("string"))
    for r in rules:
        new = [f for f in r.needs() if f not in at]
        at |= dict(zip(new, fresh(out, *[f"quality_{f}" for f in new]), strict=True))
        alive = col(verdict).isNull()
        # what is made for those alive now is there for the fewer alive later
        out = _with_features(out, {f: at[f] for f in new}, text_col, helpers, alive) if new else out
        out = out.withColumn(verdict, F.when(~alive, col(verdict)).when(r.rejects(lambda f: col(at[f])), F.lit(r.name)))
    found = col(verdict).alias(out_col)
    return out.select(*[col(c) for c in docs.columns if c != out_col], found)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the base features of every document, ``base_failed`` and ``kept`` (passes base and cascade)."""
    rules = default_rules() if rules is None else list(rules)
    ready = {n: n for n in BASE}
    ordered = order_rules(docs, rules, text_col, sample_rows, ready=BASE)
    (verdict,) = fresh(docs, "quality_rejected_by")
    featured = with_features(docs, ready, text_col).withColumn("base_failed", base_failed())
    # a document that the base rules reject costs the cascade nothing
    gate = Rule("base", lambda f: f("base_failed"))
    out = cascade(featured, [gate, *ordered], text_col, verdict, {**ready, "base_failed": "base_failed"})
    return out.withColumn("kept", col(verdict).isNull()).drop(verdict)


def keep(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns, whatever their names: base rules
    and others in one cascade, by rejections per cost."""
    rules = [*base_rules(), *(default_rules() if rules is None else rules)]
    row, kept = fresh(docs, "quality_row", "quality_kept")
    whole = docs.select(F.struct(*[col(c) for c in docs.columns]).alias(row), col(text_col).alias("text"))
    judged = cascade(whole, order_rules(docs, rules, text_col, sample_rows), "text", kept)
    # a filter on the verdict would be pushed below the steps it is made of and repeat them inside the
    # lambdas, once a word; no row is generated from a null, which has the same effect up here
    return judged.select(row, F.explode(F.when(col(kept).isNull(), F.array(F.lit(True)))).alias("kept")).select(f"{row}.*")


ORACLE = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         length(t) - length(replace(t, '!', '')) AS n_bang, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits
  FROM w LEFT JOIN rw ON w.doc_id = rw.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_upper > 40 * word_chars OR 10 * n_bang > 3 * n_words
            OR 100 * n_digits > 30 * word_chars) AS kept
FROM b
"""
