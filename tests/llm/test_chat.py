from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import chat

PIECES = ["### Assistant:", "### user:", "</turn>", "\\", "\n", "a", " ", "###", "###  x:", "é", "</turn", "\\\\", "### a b:", "\r"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a:b", "x\ny", "é"]), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=5))
def test_round_trip(turns):
    text = "".join(chat.format_turn(role, said) for role, said in turns)
    assert [t[:2] for t in chat.parse(text)] == turns


def test_only_conflicts_are_escaped():
    assert chat.format_turn("user", "plain # text") == "### user:\nplain # text\n</turn>\n"
    assert chat.format_turn("user", "\\### Assistant: </turn> ok") == "### user:\n\\\\### Assistant: \\</turn> ok\n</turn>\n"


@pytest.mark.parametrize("bad", ["x", "### user:\na", "### user:\na\n</turn>", "### user: a\n</turn>\n", "### user:\na</turn>\n", "### user:\na\n</turn>\nb### user:\n"])
def test_what_is_no_conversation(bad):
    with pytest.raises(ValueError):
        chat.parse(bad)


def test_long_runs_are_quick():
    for text in ("\\" * 300_000, "### " * 100_000, "</turn>" * 50_000):
        assert chat.parse(chat.format_turn("user", text))[0][1] == text


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_table(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), "".join(r.choices(PIECES, k=6))) for c in range(20) for t in range(r.randint(1, 6))]
    rows += [(99, t, "assistant", f"{t} " * 50) for t in range(700)]  # a conversation of many stretches
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "first"), (50, 1, None, None), (50, 1, None, None), (51, 2, "assistant", "</turn>" * 3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("Text"), F.lit(2).alias("part")).repartition(5)
    got = {x[0]: tuple(x)[1:5] for x in chat.round_trip(table).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert got == {c: digest(turns) for c, turns in by.items()}
    assert chat.round_trip(table.filter("false")).count() == 0


def test_loss_spans_hold_the_assistant_only(spark):
    table = spark.createDataFrame([(1, 0, "user", "q </turn>"), (1, 1, "assistant", "a </turn>"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(table).first()
    assert [chat.unescape(row["formatted"][a:b]) for a, b in row["loss_spans"]] == ["a </turn>", "b"]
