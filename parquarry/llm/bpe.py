"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Encoding. Of all ways to cut a byte string into tokens, the merges pick the one whose neighbouring
pairs are all *stable*: merging the bytes of the two tokens together gives back just those two. So
the encoding of every prefix of a string ends in one token, and the last tokens of prefixes form an
automaton: a hypothesis is the token the encoding of some earlier prefix ends in, plus a path in the
trie of the vocabulary for the bytes since. Reading a byte moves every path down the trie; where one
reaches a token that is stable after its predecessor, that is where the encoding of this prefix ends,
and a new hypothesis starts there. The set of hypotheses, with the tokens each has made but the
others have not, is the state of the determinised transducer: tokens on which all agree come out at
once, so output lags by a bounded lookahead, the longest token. States and transitions are made when
first needed, up to a number that bounds memory; beyond it the same step is taken without being
remembered, until it leads back to a state that is.

Before the merges a pattern splits the text; each match is encoded on its own. A match that is a
token as a whole is that token, as in tiktoken.

Decoding. A UTF-8 state machine takes one token's bytes at a time and puts out characters as soon
as they are complete, an ill-formed sequence as U+FFFD; its state is a few bytes, so ids can come in
pieces of any size.

Edge cases. Null text: no ids; null ids: empty text. Very long texts or matches take time in
proportion and, besides the text and its ids, memory within fixed bounds. An unknown id raises.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parquarry.llm._common import bounded_batches, col, fresh, only

#: States numbered, pairs and whole matches remembered in a worker. Beyond the first, steps are
#: taken without being remembered; pairs and matches are forgotten and begun anew.
MAX_STATES = 60_000
MAX_PAIRS = 300_000
MAX_GROWN = 30_000
MAX_MATCHES = 200_000
#: Bytes of input after which a task forgets its matches when it ends, rather than leave them to an idle worker.
LONG_TASK = 4 << 20
#: Longer matches are not remembered.
LONG_MATCH = 64
#: Characters of texts whose matches are looked up together.
GROUP_CHARS = 1 << 21
START = -1
if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are packed as little-endian 32-bit integers, which this machine's are not")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], told: list | None = None) -> list[int]:
    """The merges carried out one by one, lowest rank first, leftmost of equals: for short pieces.

    ``told`` gets (rank, first part, last part) after each merge.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            break
        rank, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if told is not None:
            told.append((rank, parts[0], parts[-1]))
    return [ranks[p] for p in parts]


#: After the last merge of a token nothing more merges within it.
NEVER = 1 << 62


#: What precedes the first token: nothing merges in it or across its border.
_NOTHING = ([NEVER], [b""], [b""])


class Transducer:
    """See the module's text. One instance serves one vocabulary in one process."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"not a byte-level vocabulary: no token for byte {missing[0]}")
        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        # the trie: node * 256 + byte to the next node, the token that ends there, whether it goes on
        self.child: dict[int, int] = {}
        self.token, self.goes_on = [-1], [True]
        for t, r in ranks.items():
            node = 0
            for byte in t:
                self.goes_on[node] = True
                down = self.child.get(node << 8 | byte)
                if down is None:
                    down = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.goes_on.append(False)
                node = down
            self.token[node] = r
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple | None] = {}
        first = ((0, START, ()),)
        self.number = {first: 0}
        self.states = [first]
        #: state * 256 + byte to the next state and the tokens that are then certain
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def grown(self, token: int) -> tuple | None:
        """How a token's own bytes merge: ranks in order, first parts and last parts, each from the
        single bytes on; None if they do not end in the token."""
        if token not in self.edges:
            if len(self.edges) >= MAX_GROWN:
                self.edges.clear()
            told: list = []
            t = self.bytes[token]
            ends = merge(t, self.ranks, told)
            self.edges[token] = ([*[r for r, _, _ in told], NEVER], [t[:1], *[a for _, a, _ in told]], [t[-1:], *[z for _, _, z in told]]) if ends == [token] else None
        return self.edges[token]

    def stable(self, left: int, right: int) -> bool:
        """Whether the merges of the two tokens' bytes end in the two tokens: whether, as both sides
        merge in order of rank, no merge across the border is ever due first. After START: whether
        the right one's bytes end in it."""
        known = self.pairs.get(left << 32 | right)
        if known is not None:
            return known
        a, b = self.grown(left) if left != START else _NOTHING, self.grown(right)
        known = a is not None and b is not None
        i = j = 0
        while known:
            across = self.ranks.get(a[2][i] + b[1][j], NEVER) if left != START else NEVER
            if across < a[0][i] and across <= b[0][j]:
                known = False
            elif a[0][i] <= b[0][j]:
                if a[0][i] == NEVER:
                    break
                i += 1
            else:
                j += 1
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = known
        return known

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The next set of hypotheses, and the tokens on which all of them now agree."""
        alive, end = [], None
        child, token, goes_on, pairs = self.child, self.token, self.goes_on, self.pairs
        for h in state:
            down = child.get(h[0] << 8 | byte)
            if down is None:
                continue
            last = h[1]
            if goes_on[down]:
                alive.append((down, last, h[2]))
            t = token[down]
            if t >= 0 and end is None:
                ok = pairs.get(last << 32 | t)
                if ok is None:
                    ok = self.stable(last, t)
                if ok:
                    end = (0, t, (*h[2], t))
        if end is None:
            raise ValueError("the vocabulary's merges don't determine an encoding")
        sure = end[2]
        n = len(sure)
        for h in alive:
            out = h[2]
            n = min(n, len(out))
            while n and out[:n] != sure[:n]:
                n -= 1
            if not n:
                alive.append(end)
                return tuple(alive), ()
        alive.append(end)
        return tuple([(node, last, out[n:]) for node, last, out in alive]), sure[:n]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        moves, number, states = self.moves, self.number, self.states
        now, key = 0, states[0]  # now is -1 in a state without a number
        for byte in piece:
            move = moves.get(now << 8 | byte) if now >= 0 else None
            if move is not None:
                now, sure = move
            else:
                key, sure = self.step(states[now] if now >= 0 else key, byte)
                before, now = now, number.get(key, -1)
                if now < 0 and len(states) < MAX_STATES:
                    now = number[key] = len(states)
                    states.append(key)
                if before >= 0 and now >= 0:
                    moves[before << 8 | byte] = (now, sure)
            if sure:
                out += sure
        out += (states[now] if now >= 0 else key)[-1][2]
        return out

    def encode_ascending(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of each of ``pieces``, which ascend and are short: where one begins like the one before it,
        the states and the tokens of those bytes are taken over."""
        moves, number, states, step = self.moves, self.number, self.states, self.step
        # after so many bytes: the state's number or -1, its hypotheses if -1, and how many tokens were certain
        at: list[tuple] = [(0, states[0], 0)]
        out: list[int] = []
        before = b""
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                yield [whole]
                continue
            same = 0
            for a, b in zip(before, piece, strict=False):
                if a != b:
                    break
                same += 1
            del at[same + 1 :]
            now, key, n = at[same]
            del out[n:]
            for byte in piece[same:]:
                move = moves.get(now << 8 | byte) if now >= 0 else None
                if move is not None:
                    now, sure = move
                else:
                    key, sure = step(states[now] if now >= 0 else key, byte)
                    left, now = now, number.get(key, -1)
                    if now < 0 and len(states) < MAX_STATES:
                        now = number[key] = len(states)
                        states.append(key)
                    if left >= 0 and now >= 0:
                        moves[left << 8 | byte] = (now, sure)
                if sure:
                    out += sure
                at.append((now, key, len(out)))
            before = piece
            yield out + [*(states[now] if now >= 0 else key)[-1][2]]


class Encoder:
    """Splits texts by a pattern and encodes each match; whole matches are remembered as packed ids.

    They are kept in two generations: when the newer is full it becomes the older, which is then
    forgotten. Matches not met yet are encoded together, in ascending order, for the texts of a group.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(ranks)
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drops the remembered matches, most of what an idle worker would hold; states stay."""
        self.newer, self.older = {}, {}

    def _learn(self, matches: Iterable[str]) -> list[str]:
        """Puts ``matches`` among the newer ones; those that are too long to stay there are returned."""
        newer, older = self.newer, self.older
        short, long = [], []
        for m in matches:
            if m not in newer:
                known = older.get(m)
                if known is not None:
                    newer[m] = known
                elif len(m) <= LONG_MATCH:
                    short.append(m)
                else:
                    long.append(m)
        short.sort()  # the order of code points is that of their UTF-8
        for m, ids in zip(short, self.transducer.encode_ascending(m.encode() for m in short), strict=True):
            newer[m] = array("I", ids).tobytes()
        for m in long:
            newer[m] = array("I", self.transducer.encode(m.encode())).tobytes()
        return long

    def _end(self, long: list[str]) -> None:
        for m in long:
            del self.newer[m]
        if len(self.newer) >= MAX_MATCHES:
            self.newer, self.older = {}, self.newer

    def _long_text(self, text: str) -> bytes:
        out, found = [], self.pattern.finditer(text)
        while some := [m.group() for m in islice(found, 1 << 17)]:
            long = self._learn(dict.fromkeys(some))
            out.append(b"".join(map(self.newer.__getitem__, some)))
            self._end(long)
        return b"".join(out)

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers."""
        group: list[list[str]] = []
        size = 0

        def done() -> list[bytes]:
            nonlocal group, size
            long = self._learn(set(chain.from_iterable(group)))
            out = [b"".join(map(self.newer.__getitem__, g)) for g in group]
            self._end(long)
            group, size = [], 0
            return out

        for t in texts:
            if len(t) >= GROUP_CHARS:
                yield from done()
                yield self._long_text(t)
                continue
            group.append(self.pattern.findall(t))
            size += len(t)
            if size >= GROUP_CHARS:
                yield from done()
        yield from done()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


class Utf8Machine:
    """An incremental decoder. State: the bytes of a character that has begun, and what may follow."""

    def __init__(self) -> None:
        self.held = b""
        self.need, self.low, self.high = 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.need:
                if self.low <= byte <= self.high:
                    self.held += bytes([byte])
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode())
                        self.held = b""
                    continue
                out.append("�")  # what has begun can't go on; the byte may begin anew
                self.held, self.need, self.low, self.high = b"", 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self.held = bytes([byte])
                self.need = 1 + (byte >= 0xE0) + (byte >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        out = "�" if self.need else ""
        self.__init__()
        return out


class Decoder:
    """Tokens to text. From its rest state the machine takes a well-formed token in one step."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = {r: t for t, r in ranks.items()}
        self.whole: dict[int, str | None] = {}
        for r, t in self.bytes.items():
            try:
                self.whole[r] = t.decode()
            except UnicodeDecodeError:
                self.whole[r] = None

    def stream(self, pieces: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text for each piece of ids, as far as it is certain; one more for what is left at the end."""
        machine = Utf8Machine()
        for ids in pieces:
            out = list(map(self.whole.__getitem__, ids))
            if machine.need or None in out:
                for k, i in enumerate(ids):
                    if machine.need or out[k] is None:
                        out[k] = machine.feed(self.bytes[i])
            yield "".join(out)
        yield machine.end()

    def decode(self, packed: bytes, at_a_time: int = 1 << 16) -> str:
        ids = np.frombuffer(packed, "<u4")
        return "".join(self.stream(ids[k : k + at_a_time].tolist() for k in range(0, len(ids), at_a_time)))


def _both(path: str, pattern: str | None) -> tuple[Encoder | None, Decoder]:
    """This worker's encoder (if there is a pattern) and decoder."""

    def make() -> tuple[Encoder | None, Decoder]:
        ranks = load_ranks(path)
        return Encoder(ranks, pattern) if pattern is not None else None, Decoder(ranks)

    return only(("bpe", path, pattern), make)


def _mapped(docs: DataFrame, in_col: str, outs: dict[str, str], make: Callable[[], Callable], done: Callable[[], None] | None = None) -> DataFrame:
    """``docs`` with columns ``outs`` (name to binary or string) made of the values of ``in_col`` that are
    not null by what ``make`` returns: an iterable of values to one of tuples. ``done`` ends a long task."""
    bounded_batches(docs.sparkSession)
    src = docs.columns.index(in_col)
    at = [i for i, c in enumerate(docs.columns) if c not in outs]
    names = [*[docs.columns[i] for i in at], *outs]
    types = [pa.binary() if t == "binary" else pa.string() for t in outs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        nothing = (None,) * len(types)
        size = 0
        for b in batches:
            given = b.column(src)
            size += given.nbytes
            found = iter(f(x.as_py() for x in given if x.is_valid))
            values = [next(found) if ok else nothing for ok in given.is_valid().to_pylist()]
            made = zip(*values, strict=True) if values else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in at], *[pa.array(x, t) for x, t in zip(made, types, strict=True)]], names=names)
        if size > LONG_TASK and done is not None:
            done()

    return docs.mapInArrow(run, docs.drop(*outs).withColumns({c: F.lit(None).cast(t) for c, t in outs.items()}).schema)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds each text's ids, packed as little-endian unsigned 32-bit integers (``unpack`` gives an array)."""

    def make() -> Callable:
        encoder = _both(path, pattern)[0]
        return lambda texts: ((ids,) for ids in encoder.encode_all(texts))

    return _mapped(docs, text_col, {out_col: "binary"}, make, lambda: _both(path, pattern)[0].forget())


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text that each row's packed ids stand for."""

    def make() -> Callable:
        decoder = _both(path, None)[1]
        return lambda packed: ((decoder.decode(ids),) for ids in packed)

    return _mapped(docs, ids_col, {out_col: "string"}, make)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids", back_col: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` of what it gave, in the same worker."""

    def make() -> Callable:
        encoder, decoder = _both(path, pattern)
        return lambda texts: ((ids, decoder.decode(ids)) for ids in encoder.encode_all(texts))

    return _mapped(docs, text_col, {out_col: "binary", back_col: "string"}, make, lambda: _both(path, pattern)[0].forget())


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def tokenize(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``ids`` (packed), ``n_tokens`` and ``round_trip``: whether the ids decode to the text.

    Columns of these names are replaced.
    """
    (back,) = fresh(docs, "bpe_decoded")
    coded = encode_and_decode(docs, path, pattern, text_col, "ids", back)
    return coded.withColumns({"n_tokens": (F.octet_length("ids") / 4).cast("long"), "round_trip": F.col(back).eqNullSafe(col(text_col))}).drop(back)
