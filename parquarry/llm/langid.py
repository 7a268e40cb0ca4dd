"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one space, and runs of 2 and 3 characters are
hashed into a fixed number of columns. The model is a matrix of log-probabilities, one row a
language, add-one smoothed, with log priors. Scoring sums matrix columns over a text's n-grams, in
numpy, for many texts at once.

Bounds. The matrix is at most MATRIX_BYTES: more languages get fewer columns, so it may be broadcast.
``train`` fits it on at most about ``max_docs`` labelled texts of each language (a documented bound on
training, drawn by a hash of the id), or on all with None; ``keep`` takes all, for its model and for what
is usual. Counts are summed on the executors and arrive as one number a language and column.
Prediction reads whole texts, a piece at a time.

Edge cases. Null text or no letter: language ``und``, score 0. A text with letters but no n-gram
has at least its space-padded ones. No labelled rows: every text is ``und``. Ties between languages
go to the first by name. Repeated rows get the same answer; empty table, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parquarry.llm._common import bounded_batches, col, fresh, only, remove, temporary, written

UNKNOWN = "und"
MAX_DOCS = 5000
MATRIX_BYTES = 64 << 20
COLUMNS = 1 << 15
MAX_LANGUAGES = 1 << 13
#: Characters that are hashed at a time.
PIECE = 1 << 18


def columns_for(n_languages: int) -> int:
    """A power of two, COLUMNS at most, so that the matrix stays within MATRIX_BYTES."""
    if n_languages > MAX_LANGUAGES:
        raise ValueError(f"{n_languages} languages; the model's bound is {MAX_LANGUAGES}")
    n = COLUMNS
    while n * max(1, n_languages) * 4 > MATRIX_BYTES:
        n //= 2
    return n


def normalise(text: str) -> str:
    """Lower-case letters, each run of anything else one space; a space at both ends; '' without letters."""
    import regex

    out = regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip()
    return f" {out} " if regex.search(r"\p{L}", out) else ""


def gram_columns(codes: np.ndarray, n_columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the 2-grams and of the 3-grams that begin at each place (the last places have none)."""
    shift = np.uint64(64 - (n_columns.bit_length() - 1))
    c = codes.astype(np.uint64)
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] + c[2:] * np.uint64(0x165667B19E3779F9) + np.uint64(0x27D4EB2F165667C5)

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> shift).astype(np.int64)

    return mix(two), mix(three)


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, owner's index) of normalised texts, up to about PIECE at a time; pieces of one
    text share two characters, so that every n-gram lies within one."""
    group, owner, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - 2, 1), PIECE):
            part = t[at : at + PIECE + 2]
            group.append(part)
            owner.append(i)
            size += len(part)
            if size >= PIECE:
                yield np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4"), np.repeat(owner, [len(g) for g in group])
                group, owner, size = [], [], 0
    if size:
        yield np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4"), np.repeat(owner, [len(g) for g in group])


def grams(texts: list[str], n_columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, owner's index) of all n-grams of normalised texts. Where a text is cut into pieces, the
    2-gram of the two characters that they share counts once more, in training and scoring alike."""
    for codes, owner in _pieces(texts):
        if len(codes) < 2:
            continue
        two, three = gram_columns(codes, n_columns)
        in_two, in_three = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
        yield np.concatenate([two[in_two], three[in_three]]), np.concatenate([owner[:-1][in_two], owner[:-2][in_three]])


class Model:
    """``languages`` by name and their ``weights`` (languages, columns) and ``priors``."""

    def __init__(self, languages: list[str], weights: np.ndarray, priors: np.ndarray):
        self.languages, self.priors = languages, priors
        self.by_column = np.ascontiguousarray(weights.T, np.float32)
        #: log-probability of each column in the languages taken together, each as likely as the others
        self.any = np.logaddexp.reduce(weights, axis=0) - np.log(len(languages)) if languages else np.zeros(weights.shape[1])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior probability."""
        langs, scores, *_ = self.judge(texts)
        return langs, scores

    def judge(self, texts: list[str | None], usual: bool = False) -> tuple[list[str], list[float], np.ndarray, np.ndarray]:
        """``predict`` and, if ``usual``, the mean log-probability of each text's n-grams in all languages
        together (a text that mixes known languages is as likely as others), and their number."""
        n, k = len(texts), len(self.languages)
        norm = [normalise(t) if t else "" for t in texts]
        mean, many = np.zeros(n), np.zeros(n, np.int64)
        if not k:
            return [UNKNOWN] * n, [0.0] * n, mean, many
        total = np.tile(self.priors, (n, 1))
        for columns, owner in grams(norm, len(self.by_column)):
            w = self.by_column[columns]
            for j in range(k):
                total[:, j] += np.bincount(owner, weights=w[:, j], minlength=n)
            if usual:
                mean += np.bincount(owner, weights=self.any[columns], minlength=n)
                many += np.bincount(owner, minlength=n)
        best = total.argmax(axis=1)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        score = 1.0 / share.sum(axis=1)
        known = [bool(t) for t in norm]
        langs = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
        return langs, [float(s) if ok else 0.0 for s, ok in zip(score, known, strict=True)], mean / np.maximum(many, 1), many

    def means(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The last two of ``judge``, without a language."""
        mean, many = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for columns, owner in grams([normalise(t) for t in texts], len(self.by_column)):
            mean += np.bincount(owner, weights=self.any[columns], minlength=len(texts))
            many += np.bincount(owner, minlength=len(texts))
        return mean / np.maximum(many, 1), many


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, seed: int = 0) -> DataFrame:
    """``lang, text, draw`` of the rows that have both."""
    return docs.where(col(text_col).isNotNull() & col(lang_col).isNotNull()).select(col(text_col).alias("text"), col(lang_col).alias("lang"), F.xxhash64(col(id_col), F.lit(seed)).alias("draw"))


def _drawn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int | None, seed: int) -> tuple[DataFrame, dict[str, int]]:
    """``lang, text`` of about ``max_docs`` labelled rows of each language (None: all), and how many rows each has."""
    spark = labelled.sparkSession
    rows = _labelled(labelled, id_col, text_col, lang_col, seed)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if max_docs is None:
        return rows.select("lang", "text"), counts
    # draw is uniform: a threshold keeps the wanted share of each language
    share = spark.createDataFrame([(x, min(1.0, max_docs / n)) for x, n in counts.items()], "lang string, share double")
    rows = rows.join(F.broadcast(share), "lang").where(F.shiftrightunsigned("draw", 33) < F.col("share") * F.lit(float(1 << 31))).select("lang", "text")
    return rows, counts


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int | None = MAX_DOCS, seed: int = 11) -> Model:
    """Fits on rows with a text and a language; about ``max_docs`` of each language, by a hash, or all (None)."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows, counts = _drawn(labelled, id_col, text_col, lang_col, max_docs, seed)
    languages = sorted(counts)
    n_columns = columns_for(len(languages))
    if not languages:
        return Model([], np.zeros((0, n_columns)), np.zeros(0))
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        only(("langid",), lambda: None)
        for b in batches:
            langs = [number[x] for x in b.column(0).to_pylist()]
            texts = [normalise(t) for t in b.column(1).to_pylist()]
            for columns, owner in grams(texts, n_columns):
                key = np.array(langs, np.int64)[owner]
                for lang in np.unique(key):
                    total[int(lang)] = total.get(int(lang), 0) + np.bincount(columns[key == lang], minlength=n_columns)
        for lang, c in total.items():
            (at,) = np.nonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "at", "n"])

    summed = rows.mapInArrow(run, "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros((len(languages), n_columns))
    m[summed["lang"].to_numpy(), summed["at"].to_numpy()] = summed["n"].to_numpy()
    m += 1.0
    prior = np.array([counts[x] for x in languages], float)
    return Model(languages, np.log(m / m.sum(axis=1, keepdims=True)), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) plus the language and its posterior probability."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = [c for c in docs.columns if c not in (lang_out, score_out)] if keep is None else keep
    (text,) = fresh(docs, "langid_text")
    own = text_col not in keep  # else the text travels once
    given = docs.select(*[col(c) for c in keep], *[col(text_col).alias(text)] * own)
    at = len(keep) if own else keep.index(text_col)
    shared = spark.sparkContext.broadcast(model)  # MATRIX_BYTES at most
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = only(("langid",), lambda: None) or shared.value
        for b in batches:
            langs, scores = m.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:n], lang_out, score_out])

    return given.mapInArrow(run, given.drop(text).withColumns({lang_out: F.lit(""), score_out: F.lit(0.0)}).schema)


#: Documents whose language is less certain than this go.
MIN_SCORE = 0.5
#: So do those whose n-grams are so many deviations less likely than those of its labelled texts.
MAX_DEVIATIONS = 6.0
#: Neighbouring n-grams overlap: about so many count as one independent one.
OVERLAP = 5.0


@dataclass(frozen=True)
class Usual:
    """Per language the mean log-probability of an n-gram (as in ``Model.judge``) in a usual text, the median;
    how far texts lie below it, from the lower quartile; and how far n-grams do. nan without texts."""

    middle: np.ndarray
    between: np.ndarray
    within: np.ndarray

    def lowest(self, lang: np.ndarray, n: np.ndarray, deviations: float = MAX_DEVIATIONS) -> np.ndarray:
        """The least mean that a text of ``n`` n-grams may have; ``lang`` are numbers of languages."""
        return self.middle[lang] - deviations * np.sqrt(self.between[lang] ** 2 + self.within[lang] ** 2 * OVERLAP / np.maximum(n, 1))


#: Bins of means in which quartiles are looked up, to a unit of log-probability.
BINS = 4096


def _quartiles(means: DataFrame) -> dict[int, list[float]]:
    """Lower quartile and median of ``mean`` by ``lang``, exact, as ``percentile`` has them: bins are counted,
    and only those that hold a wanted rank are put in order."""
    each = means.groupBy("lang", "mean").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", F.floor(F.col("mean") * BINS))
    before = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = each.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    bins = bins.withColumns({"first": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("lang"))})
    place = [(F.col("total") - 1) * p for p in (0.25, 0.5)]
    ranks = F.array(*[F.struct(F.lit(2 * i + k).alias("which"), rank.cast("long").alias("rank"), F.col("total")) for i, p in enumerate(place) for k, rank in enumerate((F.floor(p), F.ceil(p)))])
    wanted = bins.select("lang", "bin", "first", F.col("n").alias("in_bin"), F.explode(ranks).alias("at")).where("at.rank >= first AND at.rank < first + in_bin").select("lang", "bin", "first", "at.*")
    held = each.join(F.broadcast(wanted.select("lang", "bin").distinct()), ["lang", "bin"], "left_semi")
    upto = Window.partitionBy("lang", "bin").orderBy("mean").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(wanted), ["lang", "bin"])
    found: dict[int, list[float]] = {}
    total = {}
    for r in held.where("rank >= first + upto - n AND rank < first + upto").select("lang", "which", "mean", "total").collect():
        found.setdefault(r["lang"], [np.nan] * 4)[r["which"]] = r["mean"]
        total[r["lang"]] = r["total"]
    return {lang: [q[2 * i] + (q[2 * i + 1] - q[2 * i]) * ((total[lang] - 1) * p % 1) for i, p in enumerate((0.25, 0.5))] for lang, q in found.items()}


def usual(model: Model, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Usual:
    """What all labelled texts show; medians, so that some wrongly labelled texts among them do not count."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = _labelled(labelled, id_col, text_col, lang_col).select("lang", "text")
    shared = spark.sparkContext.broadcast(model)
    number = {x: i for i, x in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = only(("langid",), lambda: None) or shared.value
        for b in batches:
            langs = [number[x] for x in b.column(0).to_pylist()]
            mean, n = m.means(b.column(1).to_pylist())
            ok = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.array(langs, np.int32)[ok]), pa.array(mean[ok])], names=["lang", "mean"])

    path = temporary(spark, "langid-means")
    try:
        found = _quartiles(written(rows.mapInArrow(run, "lang int, mean double"), path))
    finally:
        remove(spark, path)
    k = len(model.languages)
    middle, between = np.full(k, np.nan), np.full(k, np.nan)
    for lang, (lower, half) in found.items():
        # the lower half's spread: what lies above the middle is never too unlikely
        middle[lang], between[lang] = half, (half - lower) * 1.4826
    p = np.exp(model.by_column.astype(float))
    spread = model.any**2 @ p - (model.any @ p) ** 2
    return Usual(middle, between, np.sqrt(np.maximum(spread, 0)))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE, deviations: float = MAX_DEVIATIONS, fill: bool = False) -> DataFrame:
    """``docs`` whose text has a language, by a model of all their own labels; without any label, all that
    have a letter. With ``fill`` a null ``lang_col`` becomes the language found.

    The posterior tells languages apart but is near 1 for any long text, also of none of them; so the
    mean log-probability of the text's n-grams must besides be one that labelled texts of the language have.
    """
    model = train(docs, id_col, text_col, lang_col, max_docs=None)
    if not model.languages:
        return docs.where(F.coalesce(col(text_col), F.lit("")).rlike(r"\p{L}"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, usual(model, docs, id_col, text_col, lang_col)))
    at, label = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(("langid",), lambda: None)
        m, known = shared.value
        place = {x: i for i, x in enumerate(m.languages)}
        for b in batches:
            texts = b.column(at).to_pylist()
            langs, scores, mean, n = m.judge(texts, usual=True)
            best = [place.get(x, 0) for x in langs]
            lowest = known.lowest(np.array(best, np.int64), n, deviations)
            ok = np.array([x != UNKNOWN for x in langs], bool) & (np.array(scores) >= min_score) & ~(mean < lowest)
            if fill:
                named = b.column(label).to_pylist()
                b = b.set_column(label, b.schema.field(label), pa.array([y if x is None else x for x, y in zip(named, langs, strict=True)], b.schema.field(label).type))
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == 0, F.lit(False))
