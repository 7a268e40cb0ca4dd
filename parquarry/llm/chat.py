"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and of its
text only that reply is trainable. An example's text is the formatted conversation up to and with
the reply, context spelled out, so the examples of a conversation are prefixes of one another and
together grow with the square of its length. ``prefix_chars`` is the length of the example before.

Template. A turn is ``<turn ROLE>\\n``, the text, ``\\n</turn>\\n``. Inside roles and texts, ``&`` becomes
``&amp;`` and ``<`` becomes ``&lt;``, and in roles also ``>`` becomes ``&gt;`` and a newline ``&#10;``, so
no text can hold a control string, and unescaping in reverse restores every text exactly.

Edge cases. Null text: empty. Null role: a role of its own, written ``<turn>``, never trainable.
Turns are ordered by turn number, nulls first, ties by role and text; repeated rows are repeated
turns. Turns after the last reply, or all turns where there is none, make one more row without a
target (``target_start`` null), so no turn is lost. Null conv_id: one conversation. Empty table: no rows.
An example longer than a cell of Arrow holds (2 GB) is an error, never cut.
Only the four columns named are read; an example has none of a turn's others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parquarry.llm._common import bounded_batches, col, shuffle_partitions

ASSISTANT = "assistant"
CLOSE = "\n</turn>\n"
EXAMPLES = "conv_id long, example long, n_turns long, prefix_chars long, text string, target_start long, target_end long"
#: Code points of examples put out at a time.
OUT_CHARS = 4 << 20


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def unescape(text: str) -> str:
    return text.replace("&lt;", "<").replace("&amp;", "&")


def open_turn(role: str | None) -> str:
    if role is None:
        return "<turn>\n"
    return f"<turn {escape(role).replace('>', '&gt;').replace(chr(10), '&#10;')}>\n"


def read_role(mark: str) -> str | None:
    """The role of an opening mark without its angle brackets and newline."""
    return None if mark == "turn" else unescape(mark[5:].replace("&#10;", "\n").replace("&gt;", ">"))


def read_turns(formatted: str) -> Iterator[tuple[str | None, str]]:
    """(role, text) of whole formatted turns."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith("<turn", at):
            raise ValueError(f"no turn begins at {at}")
        end = formatted.index(">\n", at)
        close = formatted.index(CLOSE, end + 1)
        yield read_role(formatted[at + 1 : end]), unescape(formatted[end + 2 : close])
        at = close + len(CLOSE)


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Examples as in EXAMPLES, in order within their partition; a conversation lies in one partition.

    Turns are sorted by conversation and number and read as a stream: a task holds the formatted text
    of one conversation, so far as it has been read, and the examples of one batch.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    n = partitions or shuffle_partitions(spark)
    rows = turns.select(col(conv_col).cast("long").alias("conv_id"), col(turn_col).alias("turn"), col(role_col).alias("role"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    names = [x.split()[0] for x in EXAMPLES.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in EXAMPLES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        conv, begun = None, False
        example = n_turns = 0
        context = ""  # the text of the example before
        parts: list[str] = []
        size = 0  # code points of parts

        def put(start: int | None, end: int | None) -> None:
            nonlocal example, context, parts, size, chars
            text = "".join([context, *parts])
            out.append((conv, example, n_turns, len(context), text, start, end))
            example, context, chars = example + 1, text, chars + len(text)
            parts, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, chars
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out, chars = [], 0
            return got

        for b in batches:
            for c, role, text in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if not begun or c != conv:
                    if parts:
                        put(None, None)
                    conv, begun, example, n_turns, context = c, True, 0, 0, ""
                head, body = open_turn(role), escape(text)
                start = len(context) + size + len(head)
                parts += [head, body, CLOSE]
                size += len(head) + len(body) + len(CLOSE)
                n_turns += 1
                if role == ASSISTANT:
                    put(start, start + len(body))
                if chars >= OUT_CHARS:
                    yield flush()
            if out:
                yield flush()
        if parts:
            put(None, None)
        if out:
            yield flush()

    return rows.mapInArrow(run, EXAMPLES)


def full_text(examples: DataFrame) -> DataFrame:
    """Examples with their whole ``text``: context and reply, as ``expand`` gives them."""
    return examples


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from ``expand``'s rows alone: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars`` (the latter of the longest example, which holds all turns). Needs the order
    that ``expand`` leaves. Every example must begin with the whole one before; what it adds is read."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, now, context = None, False, None, ""
        for b in batches:
            out = []
            for c, _, n_turns, prefix, text, start, end in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if not begun or c != conv:
                    if begun:
                        out.append((conv, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4]))
                    conv, begun, now, context = c, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], ""
                if prefix != len(context) or not text.startswith(context):
                    raise ValueError(f"conversation {c}: an example without its context, or out of order")
                for role, said in read_turns(text[prefix:]):
                    now[0] += 1
                    now[1].update(f"{role or ''}\n{said}\n".encode())
                if n_turns != now[0]:
                    raise ValueError(f"conversation {c}: {now[0]} turns read, {n_turns} told")
                if start is not None:
                    loss = unescape(text[start:end])
                    now[2] += len(loss)
                    now[3].update(loss.encode())
                now[4], context = len(text), text
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4]), types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return examples.mapInArrow(run, schema)
