"""Language-model scoring: a bigram model with Katz backoff.

P(w | h) is g2(c(h w)) / c(h) where training has seen h w, else alpha(h) * P(w); P(w) is g1(c(w)) / N
where training has seen w, else the mass that g1 leaves, for all unknown words together. g is the
Good-Turing discounted count: r * d_r for r up to k, with k the largest (5 at most) for which all
d_r lie strictly between 0 and 1; counts above k lose what k loses, so that every history keeps mass
for unseen words. Where counts of counts admit no k, every count loses one half. The weight
alpha(h) = (1 - sum of P over words seen after h) / (1 - sum of their P(w)) normalises exactly.
An unseen history has weight 1. Each text begins with a mark (a history only) and ends with an end token.

How it is computed. Words are their 64-bit hashes, bigrams a 64-bit mix of two. Nothing the size of
the corpus is broadcast or collected:

1. Texts are cut into chunks of about CHUNK tokens. A chunk sends each distinct word and bigram it
   holds, with its training count, to the partition of the key's range; a key comes once a chunk
   however often it occurs, so hot words weigh no more than others.
2. Each partition adds up its keys, sends the totals back to the chunks that asked, names one chunk
   the owner of each trained bigram, and reports counts of counts. This is written as a table.
3. A chunk scores what needs no weight, sums discounts and P(w) per history over the bigrams that it
   owns, and sends those sums, and its unseen (history, document) pairs, to the history's partition.
4. That partition makes alpha, and sends each chunk the weights' logarithms added up by document.
5. A chunk adds them to its documents' scores.

Memory in a task: one chunk, or one range's keys (RANGE_BYTES of text make one, however large the corpus),
or one row. A chunk is named by its input partition, so a stage that is run again after a lost executor must find its
input partitions as they were: scans, checkpoints and written tables do; write a shuffled input first.

Edge cases. Null text counts as
empty: one end token. Null ids train. No training text: P is 1 for the unknown, scores 0. Repeated
rows and ids keep a row each. Empty table: no rows. Very long texts: a text is one document of its
chunk; a chunk grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parquarry.llm._common import bounded_batches, col, release, shuffle_partitions, temporary, written

CHUNK = 2_000_000
#: Bytes of text to a range of keys on average at most: more ranges than shuffle partitions where there is more.
RANGE_BYTES = 16 << 20
MAX_K = 5
#: Words remembered with their hashes in a worker; forgotten when there are more.
MAX_WORDS = 400_000
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: What travels between steps: to a place (a partition of keys, or a chunk), of some kind, about a chunk.
ROW = "place long, kind int, chunk long, part int, a binary, b binary, c binary, d binary"
#: Kinds, in the order a task reads them.
CHUNK_ROW, WORDS, BIGRAMS, STATS, SUMS, UNSEEN, DOCS, WEIGHTS = range(8)


def pack(x: np.ndarray, delta: bool = False) -> bytes:
    """Whole or real numbers as compressed byte planes; ``delta`` for ascending ones."""
    import zstandard

    if delta and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T if len(x) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type, delta: bool = False) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind) if len(raw) else np.zeros(0, kind)
    return np.cumsum(x, dtype=kind) if delta else x


def word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, 0)


def mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit key for a history and a word."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def ranges(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Slices of ascending ``keys`` by n equal ranges of 64-bit keys, empty ones left out."""
    of = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    at = np.searchsorted(of, np.arange(n + 1, dtype=np.uint64))
    for p in range(n):
        if at[p] < at[p + 1]:
            yield p, slice(int(at[p]), int(at[p + 1]))


class Discount:
    """g of one level, from its counts of counts ``n[r]`` (r = 1 .. MAX_K + 1) and number of types."""

    def __init__(self, n: list[int], types: int):
        self.d = np.ones(1)
        for k in range(MAX_K, 1, -1):
            if all(n[r] > 0 for r in range(1, k + 2)):
                a = (k + 1) * n[k + 1] / n[1]
                d = [((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a != 1 else 0.0 for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d):
                    self.d = np.array([1.0, *d])
                    break
        k = len(self.d) - 1
        self.loss = (1 - self.d[k]) * k if k else 0.5
        self.left = sum(n[r] * (1 - self.d[r]) * r for r in range(1, k + 1)) + (types - sum(n[1 : k + 1])) * self.loss

    def g(self, c: np.ndarray) -> np.ndarray:
        k = len(self.d) - 1
        c = c.astype(np.float64)
        return np.where(c <= k, c * self.d[np.minimum(c, k).astype(np.int64)], c - self.loss)


class Constants:
    """What every chunk needs to know of the whole training text: a few numbers."""

    def __init__(self, stats: dict[int, list[int]], train_docs: int):
        words, bigrams = stats.get(WORDS, [0] * (MAX_K + 3)), stats.get(BIGRAMS, [0] * (MAX_K + 3))
        self.tokens, self.types, self.train_docs = words[0], words[MAX_K + 2], train_docs
        self.one = Discount([0, *words[1 : MAX_K + 2]], self.types)
        self.two = Discount([0, *bigrams[1 : MAX_K + 2]], bigrams[MAX_K + 2])
        self.unknown = self.one.left / self.tokens if self.tokens else 1.0

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.one.g(np.maximum(c, 1)) / max(self.tokens, 1), self.unknown)


def _row(place: int, kind: int, chunk: int, part: int = 0, *blobs: bytes) -> tuple:
    return (place, kind, chunk, part, *blobs, *[None] * (4 - len(blobs)))


_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
_NAMES = ["place", "kind", "chunk", "part", "a", "b", "c", "d"]


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 64):
        part = rows[at : at + 64]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _TYPES, strict=True)], names=_NAMES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


class Chunk:
    """Documents as one run of word numbers; each document ends in the end token."""

    def __init__(self, vocab: np.ndarray, seq: np.ndarray, sizes: np.ndarray, held: np.ndarray):
        self.vocab, self.seq, self.sizes, self.held = vocab, seq, sizes, held
        self.begin = np.uint64(word_hash(b" begin"))
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.history = np.concatenate([[0], seq[:-1]]).astype(np.int64) if len(seq) else np.zeros(0, np.int64)
        self.history[self.starts] = len(vocab)  # the begin mark comes after all words
        self.names = np.concatenate([vocab, np.array([self.begin], np.uint64)])
        self.trains = ~held[self.owner]

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys ascending, a token at which each occurs, and each token's key's number."""
        return np.unique(mix(self.names[self.history], self.vocab[self.seq]), return_index=True, return_inverse=True)

    def requests(self, chunk: int, n: int) -> Iterator[tuple]:
        keys, _, inverse = self.bigrams()
        for kind, k, of in ((WORDS, self.vocab, self.seq), (BIGRAMS, keys, inverse)):
            counts = np.bincount(of[self.trains], minlength=len(k)).astype(np.uint32)
            for p, s in ranges(k, n):
                yield _row(p, kind, chunk, p, pack(k[s], delta=True), pack(counts[s]))


def _cut(batches: Iterator[pa.RecordBatch], task: int, places: int) -> Iterator[list[tuple]]:
    """Step 1: chunk rows and requests, a chunk at a time, from batches of doc_id, held_out, text."""

    class Hashes(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) >= MAX_WORDS:
                self.clear()
            found = self[word] = word_hash(word)
            return found

    find = Hashes().__getitem__
    end = word_hash(b" end")
    ids, held, runs, total, number = [], [], [], 0, 0

    def done() -> list[tuple]:
        nonlocal ids, held, runs, total, number
        vocab, seq = np.unique(np.concatenate(runs), return_inverse=True)
        c = Chunk(vocab, seq, np.array([len(r) for r in runs], np.int64), np.array(held, bool))
        name = (task << 24) + number
        no_id = np.array([i is None for i in ids], np.uint8)
        docs = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
        about = np.stack([docs, c.sizes.astype(np.uint64), c.held.astype(np.uint64) + 2 * no_id.astype(np.uint64)], axis=1)
        out = [_row(name, CHUNK_ROW, name, 0, pack(vocab, delta=True), pack(seq.astype(np.uint32)), about.tobytes()), *c.requests(name, places)]
        ids, held, runs, total, number = [], [], [], 0, number + 1
        return out

    for b in batches:
        for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            words = (t.as_py() or b"").lower().split()
            run = np.empty(len(words) + 1, np.uint64)
            run[:-1] = np.fromiter(map(find, words), np.uint64, len(words))
            run[-1] = end
            ids.append(i)
            held.append(bool(h))
            runs.append(run)
            total += len(run)
            if total >= CHUNK:
                yield done()
    if ids:
        yield done()


def _tally(asked: list[tuple[int, int, np.ndarray, np.ndarray]], kind: int) -> Iterator[tuple]:
    """Step 2 for the keys of one range: answers to the chunks, and counts of counts."""
    keys, inverse = np.unique(np.concatenate([k for *_, k, _ in asked]), return_inverse=True)
    given = np.concatenate([c for *_, c in asked]).astype(np.int64)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, inverse, given)
    # the first that trained on a key owns it
    mine = np.zeros(len(inverse), np.int64)
    trained = np.flatnonzero(given > 0)
    _, first = np.unique(inverse[trained], return_index=True)
    mine[trained[first]] = 1
    answer = total[inverse] * 2 + mine
    at = 0
    for chunk, part, k, _ in asked:
        yield _row(chunk, kind, chunk, part, pack(answer[at : at + len(k)]))
        at += len(k)
    low = np.bincount(total[total <= MAX_K + 1], minlength=MAX_K + 2)
    stats = [int(total.sum()), *[int(x) for x in low[1:]], int((total > 0).sum())]
    yield _row(0, STATS, 0, kind, np.array(stats, np.int64).tobytes())


def _evaluate(row: tuple, words: np.ndarray, bigrams: np.ndarray, const: Constants, places: int) -> Iterator[tuple]:
    """Step 3 for one chunk: its documents so far, sums of the bigrams it owns, and unseen pairs."""
    name = row[2]
    about = np.frombuffer(row[6], np.uint64).reshape(-1, 3)
    c = Chunk(unpack(row[4], np.uint64, delta=True), unpack(row[5], np.uint32).astype(np.int64), about[:, 1].astype(np.int64), (about[:, 2] & np.uint64(1)).astype(bool))
    n_docs = len(about)
    count = words >> 1
    p_word = const.unigram(count)
    of_history = np.concatenate([count, [const.train_docs]])
    _, first, inverse = c.bigrams()
    pair = bigrams >> 1
    seen = pair[inverse] > 0
    with np.errstate(divide="ignore"):
        score = np.where(seen, np.log10(const.two.g(np.maximum(pair, 1)))[inverse] - np.log10(of_history)[c.history], np.log10(p_word)[c.seq])
    base = np.log10((count + 0.1) / (const.tokens + 0.1 * (const.types + 1)))
    sums = np.stack([np.bincount(c.owner, weights=x, minlength=n_docs) for x in ((count > 0)[c.seq], base[c.seq], score)], axis=1)
    yield _row(name, DOCS, name, 0, row[6], np.ascontiguousarray(sums).tobytes())
    own = np.flatnonzero(bigrams & 1)
    h, w, r = c.history[first[own]], c.seq[first[own]], pair[own]
    left = np.bincount(h, weights=(r - const.two.g(r)) / of_history[h], minlength=len(c.names))
    lower = np.bincount(h, weights=p_word[w], minlength=len(c.names))
    some = np.flatnonzero(np.bincount(h, minlength=len(c.names)))
    some = some[np.argsort(c.names[some])]
    for p, s in ranges(c.names[some], places):
        yield _row(p, SUMS, name, p, pack(c.names[some][s], delta=True), pack(left[some][s]), pack(lower[some][s]))
    ask = np.flatnonzero(~seen & (of_history[c.history] > 0))
    keys = c.names[c.history[ask]]
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], c.owner[ask][order].astype(np.uint32)
    for p, s in ranges(keys, places):
        yield _row(p, UNSEEN, name, p, pack(keys[s], delta=True), pack(docs[s]))


def _weights(sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Step 4: histories of one range, ascending, and the logarithms of their weights."""
    if not sums:
        return np.zeros(0, np.uint64), np.zeros(0)
    keys, inverse = np.unique(np.concatenate([k for k, _, _ in sums]), return_inverse=True)
    left, lower = (np.bincount(inverse, weights=np.concatenate([s[i] for s in sums]), minlength=len(keys)) for i in (1, 2))
    return keys, np.log10(left) - np.log10(np.maximum(1.0 - lower, 1e-300))


def train_and_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", places: int | None = None) -> DataFrame:
    """Trains on rows where ``held_out`` is false and scores all rows: RESULT."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0
    n = places or max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _cut(batches, TaskContext.get().partitionId(), n):
            yield from _batches(out)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, now = [], None
        for r in _read(batches):
            here = (r[0], r[1])
            if asked and here != now:
                yield from _batches(list(_tally(asked, now[1])))
                asked = []
            now = here
            if r[1] == CHUNK_ROW:
                yield from _batches([r])
            else:
                asked.append((r[2], r[3], unpack(r[4], np.uint64, delta=True), unpack(r[5], np.uint32)))
        if asked:
            yield from _batches(list(_tally(asked, now[1])))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "place").sortWithinPartitions("place", "kind", "chunk", "part")

    counted = written(dealt(rows.mapInArrow(cut, ROW)).mapInArrow(tally, ROW), temporary(spark, "katz-counts"))
    release(spark)
    stats: dict[int, list[int]] = {}
    # a row of MAX_K + 3 numbers for each of the n partitions and level
    for r in counted.where(F.col("kind") == STATS).select("part", "a").toLocalIterator():
        got = np.frombuffer(r["a"], np.int64).tolist()
        stats[r["part"]] = [x + y for x, y in zip(stats.get(r["part"], [0] * len(got)), got, strict=True)]
    train_docs = rows.where(~F.col("held")).count()
    const = Constants(stats, train_docs)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, answers = None, {WORDS: [], BIGRAMS: []}

        def done() -> Iterator[pa.RecordBatch]:
            found = [np.concatenate(answers[k]) if answers[k] else np.zeros(0, np.int64) for k in (WORDS, BIGRAMS)]
            yield from _batches(list(_evaluate(held, *found, const, n)))

        for r in _read(batches):
            if r[1] == CHUNK_ROW:
                if held:
                    yield from done()
                held, answers = r, {WORDS: [], BIGRAMS: []}
            else:
                answers[r[1]].append(unpack(r[4], np.int64))
        if held:
            yield from done()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sums, model = None, [], None
        for r in _read(batches):
            if r[1] == DOCS:
                yield from _batches([r])
                continue
            if r[0] != place:
                place, sums, model = r[0], [], None
            if r[1] == SUMS:
                sums.append((unpack(r[4], np.uint64, delta=True), unpack(r[5], np.float64), unpack(r[6], np.float64)))
                continue
            model = model or _weights(sums)
            doc = unpack(r[5], np.uint32)
            weight = model[1][np.searchsorted(model[0], unpack(r[4], np.uint64, delta=True))]
            ids, of = np.unique(doc, return_inverse=True)
            yield from _batches([_row(r[2], WEIGHTS, r[2], r[3], pack(ids), pack(np.bincount(of, weights=weight)))])

    names = [x.split()[0] for x in RESULT.split(", ")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = sums = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(about[:, 0].view(np.int64), mask=about[:, 2] > 1),
                    pa.array((about[:, 2] & np.uint64(1)).astype(bool)),
                    pa.array(about[:, 1].view(np.int64)),
                    pa.array(sums[:, 0].astype(np.int64)),
                    pa.array(np.full(len(about), const.tokens, np.int64)),
                    pa.array(sums[:, 1]),
                    pa.array(sums[:, 2]),
                ],
                names=names,
            )

        for r in _read(batches):
            if r[1] == DOCS:
                if about is not None:
                    yield done()
                about = np.ascontiguousarray(np.frombuffer(r[4], np.uint64).reshape(-1, 3).T.copy()).T
                sums = np.frombuffer(r[5], np.float64).reshape(-1, 3).copy()
            else:
                sums[unpack(r[4], np.uint32), 2] += unpack(r[5], np.float64)
        if about is not None:
            yield done()

    scored = dealt(counted.where(F.col("kind") != STATS)).mapInArrow(evaluate, ROW)
    return dealt(dealt(scored).mapInArrow(weigh, ROW)).mapInArrow(finish, RESULT)
