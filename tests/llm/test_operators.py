"""Each operator against a plain version of itself, and on odd tables."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from parquarry.llm import bpe, chat, digest, katz, langid, licenses, mixing, quality, simhash, urlrules

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string"


def prose(r: random.Random, n: int, words: int = 60) -> str:
    return " ".join("".join(r.choice(["ta", "ri", "no", "ke", "lu", "é", "so"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(n, words)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = [prose(r, 5) for _ in range(60)]
    odd = [None, "", " \t\n", "a", "one two three four", "For " * 300, "x" * 5000, "###$$$ %%% ||| a", "A\nA\nb\n\nA"]
    copies = [texts[3]] * 6 + [texts[7] + " ki"] * 3
    out = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b"][min(2, i % 7)]) for i, t in enumerate(texts + odd + copies)]
    return [*out, out[4], out[4], (None, texts[9], "en", "a"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_chat_round_trip(spark):
    said = ["### Assistant: </turn> ok", "<turn user>\n", "&lt;&amp;", "", None, "a\n</turn>\nb"]
    turns = [(c, t, role, said[(c + t) % len(said)]) for c in range(8) for t, role in enumerate(["system", "user", "assistant", "user", "assistant", "user"][: 1 + c % 6])]
    turns += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, None, None, "first"), (9, 0, "a>\n&", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    examples = chat.expand(df, partitions=3)
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    groups = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0)):
        groups[c].append((role, text or ""))
    assert set(got) == set(groups)
    for c, g in groups.items():
        loss = "".join(t for r, t in g if r == "assistant")
        assert got[c]["n_turns"] == len(g)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{t}\n" for r, t in g).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss)
    for r in chat.full_text(examples).collect():
        assert list(chat.read_turns(r["text"])) == groups[r["conv_id"]][: len(list(chat.read_turns(r["text"])))]
        if r["target_start"] is not None:
            assert chat.unescape(r["text"][r["target_start"] : r["target_end"]]) == list(chat.read_turns(r["text"]))[-1][1]
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


def test_digest(docs, rows, empty):
    ids = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    got = digest.with_edited(docs, partitions=4).collect()
    assert len(got) == len(rows)
    want = Counter((i, len(t or "")) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == want
    unique = [x for x in ids if x[0] is not None and want[(x[0], len(x[1] or ""))] == 1]
    by = {r["doc_id"]: r for r in got}
    for a, b in itertools.pairwise(unique):
        if b[0] == a[0] + 1:
            k = len(a[1] or "") // 2
            edited = (a[1] or "")[: len(a[1] or "") - k] + (b[1] or "")[:k]
            assert by[a[0]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert by[a[0]]["near_edited"] == pytest.approx(digest.compare(by[a[0]]["fingerprint"], by[a[0]]["edited_fingerprint"]))
    text = {}
    for r in digest.fingerprint(docs).collect():
        assert text.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"]
    assert all(0 <= r["near_next"] <= 1 for r in got)
    assert digest.with_edited(empty).count() == 0
    only = digest.with_edited(docs.where("doc_id = 1")).collect()
    assert only[0]["near_next"] == 1


def test_digest_skewed_ids_and_clashes(spark):
    """A third of the rows without an id, a third of one id: the successor is the next row in id, hash, text."""
    r = random.Random(5)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "".join(r.choice("abc ") for _ in range(r.randint(0, 40))), "own") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = digest.with_edited(docs, partitions=8).collect()
    keyed = docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("binary")).alias("h")).collect()
    order = sorted(keyed, key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, x["h"], x["text"].encode()))
    want = Counter()
    for x, y in zip(order, [*order[1:], order[0]], strict=True):
        k = len(x["text"]) // 2
        want[x["doc_id"], len(x["text"]), hashlib.sha256((x["text"][: len(x["text"]) - k] + y["text"][:k]).encode()).hexdigest()] += 1
    assert Counter((x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in got) == want
    spread = digest.neighbours(docs, partitions=8).where("NOT guest").groupBy("bucket").count().collect()
    assert max(x["count"] for x in spread) < 40
    assert digest.fingerprint(docs).columns == docs.columns
    with pytest.raises(TypeError):
        digest.with_edited(docs.withColumn("doc_id", F.lit("a")))


def test_quartiles_and_likeness_told_plainly():
    r = random.Random(9)
    texts = [bytes(r.randrange(97, 123) for _ in range(n)) for n in (9, 400, 401, 3000)]
    d = digest.Digests(texts)
    for t, codes, length in zip(texts, d.codes, d.lengths, strict=True):
        counts = digest.bucket_counts([t])[0].tolist()
        q1, q2, q3 = (sorted(counts)[k] for k in (63, 127, 191))
        assert codes.tolist() == [0 if c <= q1 else 1 if c <= q2 else 2 if c <= q3 else 3 for c in counts]
        assert length == round(8 * math.log2(1 + len(t)))
    a, b = 1, 3
    steps = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(int(x) - int(y))] for x, y in zip(d.codes[a], d.codes[b], strict=True))
    want = max(0.0, 1 - (steps + min(64, 2 * abs(int(d.lengths[a]) - int(d.lengths[b])))) / 416)
    names = d.hex()
    assert digest.compare(names[a], names[b]) == pytest.approx(want) and digest.compare(names[a], names[a]) == 1


def test_digest_chunks_and_brute_force(monkeypatch):
    r = random.Random(1)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 3, 5, 6, 700, 4000)]

    def brute(t):
        out = np.zeros(digest.BUCKETS, int)
        for i in range(len(t) - 4):
            for a, b, c, by in digest.TRIPLETS:
                out[((t[i + a] | t[i + b] << 8 | t[i + c] << 16) * by % 2**32) >> 24] += 1
        return out

    monkeypatch.setattr(digest, "CHUNK", 512)
    assert (digest.bucket_counts(texts) == np.array([brute(t) for t in texts])).all()


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_quality_features_and_cascade(docs, rows, empty):
    got = {(r["doc_id"], r["text"]): r for r in quality.judge(docs).collect()}
    assert quality.judge(docs).count() == len(rows)
    for i, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0d]", x):
                dup += x in seen
                seen.add(x)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(windows)
        repeat = len({k + d for k, x in enumerate(windows) if n[x] > 1 for d in range(3)})
        r = got[i, text]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), dup, repeat)
        assert r["base_failed"] == (len(w) < 50 or 100 * repeat > 50 * len(w))
    assert quality.keep(docs).columns == docs.columns
    assert quality.judge(empty).count() == 0
    clash = docs.withColumn("kept", F.lit("mine")).withColumn("quality_words", F.lit(1))
    assert {r["kept"] for r in quality.keep(clash).collect()} <= {"mine"}


def test_rules_are_ordered_by_rejection_per_cost(spark):
    df = spark.createDataFrame([(i, "w " * 60) for i in range(200)], "doc_id long, text string")
    never = quality.Rule("never", lambda f: F.lit(False))
    none = quality.Rule("none", lambda f: f("n_words") < 0)
    always = quality.Rule("always", lambda f: f("n_words") > 0)
    costly = quality.Rule("costly", lambda f: f("n_repeat_words") > 0)
    found = [[r.name for r in quality.order_rules(df, [never, none, costly, always])] for _ in range(2)]
    # both reject all; the cheap one goes first, and the rest, which then reject nothing, as given
    assert found[0] == found[1] == ["always", "never", "none", "costly"]
    assert [r.name for r in quality.order_rules(df, [costly, always], ready=["n_repeat_words", "n_words"])] == ["costly", "always"]


def test_a_cascade_makes_no_feature_for_what_is_rejected(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (2, "a b c d")], "doc_id long, text string")
    bomb = quality.Feature([("n", lambda get: F.when(F.char_length(get("text")) < 5, F.raise_error(F.lit("made"))).otherwise(F.char_length(get("text"))).cast("long"))])
    monkeypatch.setitem(quality.FEATURES, "bomb", bomb)
    few = quality.Rule("few", lambda f: f("n_words") < 3)
    loud = quality.Rule("loud", lambda f: f("bomb") > 100)
    assert rows_of(quality.cascade(df, [few, loud]), "doc_id", "rejected_by") == [(1, "few"), (2, None)]
    with pytest.raises(Exception, match="made"):
        quality.cascade(df, [loud, few]).collect()


def test_judge_keeps_columns_of_helpers_names(spark):
    df = spark.createDataFrame([(1, "w " * 60, "mine", "own")], "doc_id long, text string, rejected_by string, quality_words string")
    got = quality.judge(df).first()
    assert (got["rejected_by"], got["quality_words"]) == ("mine", "own")
    assert quality.keep(df, rules=[]).columns == df.columns


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_against_tiktoken(name, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 500)  # most steps then go unremembered
    monkeypatch.setattr(bpe, "MAX_PAIRS", 300)
    monkeypatch.setattr(bpe, "MAX_MATCHES", 50)
    ranks = bpe.load_ranks(public_tokenizers.path(name))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours, back = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks)
    r, tokens = random.Random(2), list(ranks)
    for n in range(400):
        t = "".join(r.choice(tokens).decode("utf-8", "ignore") if r.random() < 0.7 else r.choice([" ", "é", "日本", "😀", "1", "aaa", "\n"]) for _ in range(r.randint(0, 25)))
        t = t + "a" * 3000 + " " * 2000 if n == 7 else t
        ids = ours.encode(t)
        assert bpe.unpack(ids) == theirs.encode_ordinary(t)
        assert back.decode(ids, 3) == t


def test_utf8_machine_replaces_ill_formed_bytes():
    r = random.Random(3)
    for _ in range(2000):
        data = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(r.randint(0, 8)))
        m = bpe.Utf8Machine()
        assert "".join([*[m.feed(data[i : i + 1]) for i in range(len(data))], m.end()]) == data.decode("utf-8", "replace")


def test_bpe_columns(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.tokenize(docs, path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    assert {r["ids"] for r in got if r["text"] is None} == {None}
    two = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).where(~F.col("decoded").eqNullSafe(F.col("text")))
    assert two.count() == 0
    assert bpe.tokenize(empty, path, public_tokenizers.PATTERN).count() == 0


def brute_simhash(t):
    w = WORDS.findall((t or "").encode().lower())
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(values, bits=4):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_position_groups_hold_in_any_four():
    for g in (simhash.PAIRS, simhash.TRIPLES, simhash.QUADS):
        assert all(any(set(x) <= set(four) for x in g) for four in itertools.combinations(range(8), 4))


@pytest.mark.parametrize("groups", [simhash.PAIRS, simhash.TRIPLES, simhash.QUADS])
@pytest.mark.parametrize("block", [4096, 7])
def test_links_lose_no_connection(spark, monkeypatch, groups, block):
    r = random.Random(4)
    values = set()
    for _ in range(12):
        v = r.getrandbits(64)
        for _ in range(15):
            v ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 6)))
            values.add(v)
    values = sorted(values)
    monkeypatch.setattr(simhash, "groups_for", lambda n: groups)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "simhash long"), block=block, partitions=3)).collect()
    of = {r["node"] % (1 << 64): r["component"] for r in found}
    want = closure(values)
    ours = [of.get(v, v - (1 << 64) if v >> 63 else v) for v in values]
    assert len(set(zip(ours, want, strict=True))) == len(set(ours)) == len(set(want))


def test_near_duplicates(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = [brute_simhash(t) for _, t, *_ in rows]
    assert Counter(r["fingerprint"] for r in got) == Counter(f"{p:016x}" for p in prints)
    comp = closure(prints)
    least = {}
    for (i, *_), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((x[0], least.get(c)) for x, c in zip(rows, comp, strict=True))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_katz(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 300)
    held_out = langid.held_out(F.col("doc_id"), 10)
    got = katz.train_and_score(docs, held_out, places=3).collect()
    assert len(got) == len(rows)
    tok = [[*WORDS.findall((t or "").encode().lower()), None] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows]
    c, b, starts = Counter(), Counter(), 0
    for t, h in zip(tok, held, strict=True):
        if not h:
            starts += 1
            c.update(t)
            b.update(zip([0, *t[:-1]], t, strict=True))
    n, types = sum(c.values()), len(c)

    def discount(counts):
        of = [0] + [sum(v == r for v in counts.values()) for r in range(1, 7)]
        return katz.Discount(of, len(counts))

    g1, g2 = (lambda r, d=discount(x): float(d.g(np.array([r]))[0]) for x in (c, b))
    unknown = sum(v - g1(v) for v in c.values()) / n
    p = lambda w: g1(c[w]) / n if w in c else unknown
    history = Counter({**c, 0: starts})
    after = defaultdict(list)
    for h, w in b:
        after[h].append(w)
    alpha = {h: (1 - sum(g2(b[h, w]) for w in ws) / history[h]) / (1 - sum(p(w) for w in ws)) for h, ws in after.items()}
    cond = lambda h, w: g2(b[h, w]) / history[h] if (h, w) in b else alpha.get(h, 1) * p(w)
    for h in list(after)[:20]:  # exactly normalised over all words and the unknown one
        assert sum(cond(h, w) for w in [*c, "never seen"]) == pytest.approx(1, abs=1e-9)
    want = Counter()
    for (i, *_), t, h in zip(rows, tok, held, strict=True):
        s = sum(math.log10(cond(x, w)) for x, w in zip([0, *t[:-1]], t, strict=True))
        base = sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (types + 1))) for w in t)
        want[i, h, len(t), sum(w in c for w in t), n, round(base, 6), round(s, 6)] += 1
    ours = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    assert ours == want
    assert katz.train_and_score(empty, held_out).count() == 0
    assert katz.train_and_score(docs, F.lit(True)).agg(F.max(F.abs("score"))).first()[0] == 0


def test_discount_falls_back():
    d = katz.Discount([0, 0, 0, 0, 0, 0, 0], 3)
    assert list(d.g(np.array([1, 9]))) == [0.5, 8.5] and d.left == 1.5


def test_language_id(spark, empty):
    r = random.Random(6)
    said = {"aa": "ba be bi bo", "bb": "xu xy zaq zu", "cc": "ñé çà ôu êè"}
    data = [(i, " ".join(r.choice(said[x].split()) for _ in range(20)), x, None) for i, x in enumerate(list(said) * 60)]
    data += [(500, None, "aa", None), (501, "12 $$", "bb", None), (502, "ba be", None, None), (None, "zaq", "bb", None), (503, "BA  be" * 200_000, "aa", None)]
    df = spark.createDataFrame(data, DOCS).repartition(4)
    held = langid.held_out(F.col("doc_id"), 5)
    model = langid.train(df.where(~held))
    got = langid.predict(df.withColumn("score", F.lit("mine")).withColumn("held", held), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["held"] and r["doc_id"] < 500)
    by = {r["doc_id"]: r for r in got}
    assert by[500]["lang_pred"] == by[501]["lang_pred"] == "und" and by[502]["lang_pred"] == "aa" and by[503]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(df, langid.train(empty)).collect()} == {"und"}
    assert {r["doc_id"] for r in langid.keep(df).collect()} == {r[0] for r in data} - {500, 501}


def test_language_against_plain_bayes(spark):
    """Multinomial naive Bayes told plainly: counts plus one over hashed 2- and 3-grams, log priors."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").select("doc_id", "text", "lang")
    rows = docs.collect()
    model = langid.train(docs)
    grams = {}
    for x in rows:
        kept = "".join(c if c.isalpha() or unicodedata.category(c).startswith("M") else " " for c in x["text"].lower()).split()
        t = f" {' '.join(kept)} " if any(c.isalpha() for w in kept for c in w) else ""
        two, three = langid.gram_columns(np.array([ord(c) for c in t], np.uint32), langid.COLUMNS) if t else ((), ())
        grams[x["doc_id"]] = [*two, *three]
    names = sorted({x["lang"] for x in rows})
    count = {y: Counter(g for x in rows if x["lang"] == y for g in grams[x["doc_id"]]) for y in names}
    size = {y: sum(c.values()) + langid.COLUMNS for y, c in count.items()}
    prior = Counter(x["lang"] for x in rows)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for x in rows:
        g = Counter(grams[x["doc_id"]])
        if not g:
            assert (got[x["doc_id"]]["lang_pred"], got[x["doc_id"]]["score"]) == ("und", 0)
            continue
        logs = [math.log(prior[y] / len(rows)) + sum(n * math.log((count[y][k] + 1) / size[y]) for k, n in g.items()) for y in names]
        best = max(logs)
        assert got[x["doc_id"]]["lang_pred"] == names[logs.index(best)]
        assert got[x["doc_id"]]["score"] == pytest.approx(1 / sum(math.exp(v - best) for v in logs), abs=1e-3)


def test_good_turing_told_plainly():
    """d_r = (r*/r - a) / (1 - a) with r* = (r + 1) n_{r+1} / n_r and a = (k + 1) n_{k+1} / n_1, k as large as may be."""
    n = {1: 1000, 2: 300, 3: 140, 4: 80, 5: 52, 6: 36}
    types = sum(n.values()) + 90
    got = katz.Discount([0, *n.values()], types)
    k = 5
    a = (k + 1) * n[k + 1] / n[1]
    want = [((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, k + 1)]
    assert all(0 < d < 1 for d in want) and got.d[1:].tolist() == pytest.approx(want)
    c = np.array([1, 2, 5, 6, 400])
    assert got.g(c).tolist() == pytest.approx([want[0], 2 * want[1], 5 * want[4], 6 - 5 * (1 - want[4]), 400 - 5 * (1 - want[4])])
    assert got.left == pytest.approx(sum(n[r] * r * (1 - want[r - 1]) for r in range(1, 6)) + (types - sum(n[r] for r in range(1, 6))) * 5 * (1 - want[4]))


def test_language_pieces_agree(monkeypatch):
    text = langid.normalise("some words to cut in pieces " * 30)
    whole = Counter(np.concatenate([c for c, _ in langid.grams([text, " a "], 1 << 10)]).tolist())
    monkeypatch.setattr(langid, "PIECE", 50)
    cut = Counter(np.concatenate([c for c, _ in langid.grams([text, " a "], 1 << 10)]).tolist())
    assert sum((cut - whole).values()) <= 2 * (len(text) // 50 + 1) and not whole - cut
    assert langid.columns_for(5000) * 5000 * 4 <= langid.MATRIX_BYTES


def test_url_rules(spark):
    urls = ["http://a.example.net/en/1", "https://example.net/de/2", "http://x.example.com/de/3", "HTTP://X.EXAMPLE.COM/fr/3?q=1", "http://example.org/fr/9#z", "http://notexample.net.org/de/", "nothing", "", None, "://h", "ftp://net", "x://a.net?u=://b.org/fr/"]
    rules = [urlrules.HostRule("block", "net"), urlrules.HostRule("allow", "example.net", "/en/"), urlrules.HostRule("block", "example.com", "/de/"), urlrules.HostRule("allow", "org", "/fr/")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(1, urls[1])], "page_id long, url string")
    got = {r["page_id"]: r for r in urlrules.judge(df, rules).collect()}

    def plain(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        return m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]

    for i, u in enumerate(urls):
        host, path = plain(u)
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best.name if best else None)
        if best:
            assert got[i]["verdict"] == best.verdict
    assert urlrules.judge(df, rules).count() == len(urls) + 1
    assert urlrules.judge(df.limit(0), rules).count() == 0


def test_mined_rules_against_brute_force(spark):
    r = random.Random(8)
    data = []
    for _ in range(300):
        path = r.sample(["spam", "win", "news", "blog"], r.randint(1, 3))
        data.append((f"http://{r.choice('ab')}.x.io/{'/'.join(path)}", "block" if "spam" in path and "win" in path or r.random() < 0.05 else "allow"))
    df = spark.createDataFrame(data, "url string, label string")
    found = {tuple(r["tokens"]): r["confidence"] for r in urlrules.mine(df, min_support=0.05, min_confidence=0.8).collect()}
    sets = [(frozenset(r["t"]), r["label"]) for r in df.select(urlrules.tokens_of(F.col("url")).alias("t"), "label").collect()]
    every = sorted(set().union(*[s for s, _ in sets]))
    want = {}
    for k in range(1, 6):
        for combo in itertools.combinations(every, k):
            fit = [y for s, y in sets if s >= set(combo)]
            if sum(y == "block" for y in fit) >= 0.05 * len(sets) and sum(y == "block" for y in fit) >= 0.8 * len(fit):
                want[combo] = sum(y == "block" for y in fit) / len(fit)
    kept = {c: v for c, v in want.items() if not any(set(d) < set(c) and w >= v for d, w in want.items())}
    assert found.keys() == kept.keys() and all(found[c] == pytest.approx(v) for c, v in kept.items())
    seen = df.select("url").distinct().withColumn("tokens", urlrules.tokens_of(F.col("url")))
    hits = {r["url"] for r in urlrules.match(seen, urlrules.mine(df, min_support=0.05, min_confidence=0.8)).collect()}
    tokens = {r["url"]: set(r["tokens"]) for r in seen.collect()}
    assert hits == {u for u, s in tokens.items() if any(s >= set(c) for c in kept)}


def test_licenses(spark, empty):
    mit = licenses.KNOWN["MIT"][0]
    texts = ["Copyright (c) 2024 Someone\n\n" + mit.upper().replace("SUBLICENSE", "Sublicence"), mit + " more", "", None, "Released under the MIT Licence!", "Copyright 2020 A. Person"]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] + [(0, texts[0], "mine")], "doc_id long, text string, known_digest string")
    got = licenses.scan(df, licenses.known_licenses(spark)).collect()
    assert len(got) == 7
    assert {r["doc_id"]: r["license_id"] for r in got} == {0: "MIT", 1: None, 2: None, 3: None, 4: "MIT", 5: None}
    assert next(r for r in got if r["doc_id"] == 3)["license_digest"] is None
    assert licenses.scan(empty, licenses.known_licenses(spark)).count() == 0
    assert licenses.scan(df, licenses.known_licenses(spark).limit(0)).where("license_id IS NOT NULL").count() == 0


def test_planted_whole_licenses(spark):
    """Every known text with other case, spelling, layout and copyright lines, in a table with clashing names."""
    marks = ["Copyright (c) 2021 The Authors. All rights reserved.\n\n", "COPYRIGHT © SOME COMPANY\n", "(c) 2019-2024 A. Person\n\n"]
    rows = [(k, marks[i % 3] + t.replace("license", "licence").replace(". ", ".\n  ").title() * 1) for k, texts in licenses.KNOWN.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "mine", "own") for r in rows], "want string, text string, known_license string, license_canonical string")
    got = licenses.scan(df, licenses.known_licenses(spark)).collect()
    assert len(got) == len(rows) and all(r["license_id"] == r["want"] and r["known_license"] == "mine" and r["license_canonical"] == "own" for r in got)


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= over
    return target


def plain_queue(docs, target, seed=42):
    """Weighted fair queueing as it is told: (id, source, text's hash) to (times taken, size)."""
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("tie"), F.xxhash64("text").alias("tie2")).collect()
    groups = Counter((r["doc_id"], r["source"], r["tie2"], r["tie"], len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))) for r in keyed)
    nulls_first = lambda x: (x is not None, x or 0)
    total = {s: sum(g[4] * n for g, n in groups.items() if g[1] == s) for s in target}
    places = []
    for s in target:
        done = 0
        for g in sorted((g for g in groups if g[1] == s), key=lambda g: ((g[3] % 2**64) >> 33, g[3], nulls_first(g[0]), g[2])):
            done += g[4] * groups[g]
            if g[4]:
                places += [((p * total[s] + done) / target[s], g[3], nulls_first(g[0]), g[2], p, g) for p in (0, 1)]
    left, taken = 1.5 * sum(total.values()), Counter()
    for *_, g in sorted(places, key=lambda x: x[:5]):
        left -= g[4] * groups[g]
        if left < 0:
            break
        taken[g] += 1
    return {g[:3]: (taken[g], g[4]) for g in groups}


@pytest.mark.parametrize("block", [50_000, 7])
def test_mixing(docs, rows, empty, block):
    got = mixing.mix_counts(docs, block_rows=block).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    target = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"] * r["n_equal"]
        largest[r["source"]] = max(largest[r["source"]], r["size"] * r["n_equal"])
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_counts(docs, block_rows=block).collect()))
    assert sum(r["n_equal"] for r in got) == len(rows)
    want = plain_queue(docs, target)
    assert Counter((r["doc_id"], r["source"], r["tie2"], r["taken"]) for r in got) == Counter((*k, n * size_) for k, (n, size_) in want.items())
    mixed = mixing.mix(docs, block_rows=block)
    assert mixed.columns == docs.columns
    assert sum(size(r["text"]) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_copyright_lines(spark):
    """Lines end at newlines alone, as in plain regular expressions, and a long line of marks is quick."""
    r = random.Random(3)
    bits = ["©", "(c)", "copyright", " ", "2024", "\n", "\r", " ", "\u0085", "all rights reserved", "[year]", "x", "# "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(400)]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_replace("t", F.lit(licenses.COPYRIGHT_LINE), "_")).collect()]
    assert got == [re.sub(licenses.COPYRIGHT_LINE_PLAIN, "_", t, flags=re.ASCII) for t in texts]
    marks = spark.createDataFrame([("©" * 400_000,)], "t string")
    assert marks.select(F.length(F.regexp_replace("t", F.lit(licenses.COPYRIGHT_LINE), "_"))).first()[0] == 400_000
