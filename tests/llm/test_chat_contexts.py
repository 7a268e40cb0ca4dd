"""Every example holds its whole context, not what it adds to the one before."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parquarry.llm import chat


def test_examples_hold_their_contexts(spark, monkeypatch):
    monkeypatch.setattr(chat, "OUT_CHARS", 500)
    roles = ["user", "assistant", "assistant", "system", "user"]
    turns = [(c, t, roles[(c + t) % 5], f"<{c}> & \n{t}") for c, n in enumerate([1, 2, 7, 60]) for t in range(n)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    said = defaultdict(list)
    for c, _, role, text in turns:
        said[c].append((role, text))
    got = defaultdict(list)
    for r in chat.expand(df, partitions=2).orderBy("conv_id", "example").collect():
        got[r["conv_id"]].append(r)
    for c, all_turns in said.items():
        ends = [i + 1 for i, (role, _) in enumerate(all_turns) if role == "assistant"]
        ends += [len(all_turns)] if not ends or ends[-1] < len(all_turns) else []
        assert [list(chat.read_turns(r["text"])) for r in got[c]] == [all_turns[:n] for n in ends]
        assert [r["n_turns"] for r in got[c]] == ends
        for r, n in zip(got[c], ends, strict=True):
            if all_turns[n - 1][0] == "assistant":
                assert chat.unescape(r["text"][r["target_start"] : r["target_end"]]) == all_turns[n - 1][1]
            else:
                assert r["target_start"] is None and r["target_end"] is None
    back = {r["conv_id"]: r for r in chat.read_back(chat.expand(df, partitions=2)).collect()}
    assert {c: (r["n_turns"], r["formatted_chars"]) for c, r in back.items()} == {c: (len(x), len(got[c][-1]["text"])) for c, x in said.items()}


def test_a_lost_context_is_an_error(spark):
    df = spark.createDataFrame([(1, t, r, f"ok {t}") for t, r in enumerate(["user", "assistant"] * 2)], "conv_id long, turn long, role string, text string")
    cut = chat.expand(df, partitions=1).withColumn("text", F.expr("substr(text, prefix_chars + 1)"))
    with pytest.raises(Exception, match="without its context"):
        chat.read_back(cut).collect()
