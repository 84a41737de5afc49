"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role ":" newline text newline "</turn>" newline

A turn is rendered plainly, parsed by the same parser that readers use, and compared with its source. If they differ,
control strings in the text, with the backslashes before them, get one backslash more, which the parser takes away, and the
result is parsed and compared again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import bounded_batches, pick, written

LOSS_ROLE = "assistant"
#: A stretch of a conversation that one row of the formatted table holds.
STRETCH_CHARS, STRETCH_TURNS = 1_000_000, 64

_CONTROL = re.compile(r"(?<!\\)(\\*)(### [A-Za-z0-9_.~%-]*:|</turn>)")


def render(role: str, text: str) -> str:
    return f"### {quote(role, safe='')}:\n{text}\n</turn>\n"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1][1:] + m[2], text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; the place is that of the escaped text. Anything else raises ValueError."""
    turns, at, opened = [], 0, None
    for m in _CONTROL.finditer(formatted):
        if m[1]:
            if opened is None:
                raise ValueError(f"text between turns at {m.start()}")
        elif m[2] == "</turn>":
            if opened is None or formatted[m.start() - 1] != "\n" or m.start() - 1 < opened[1] or formatted[m.end() : m.end() + 1] != "\n":
                raise ValueError(f"a turn ends where it should not, at {m.start()}")
            a, b = opened[1], m.start() - 1
            turns.append((opened[0], unescape(formatted[a:b]), a, b))
            opened, at = None, m.end() + 1
        else:
            if opened is not None or m.start() != at or formatted[m.end() : m.end() + 1] != "\n":
                raise ValueError(f"a turn begins where it should not, at {m.start()}")
            opened = unquote(m[2][4:-1]), m.end() + 1
    if opened is not None or at != len(formatted):
        raise ValueError("the last turn has no end")
    return turns


def format_turn(role: str, text: str) -> str:
    """The turn rendered so that parsing gives back exactly its role and text."""
    for body in (text, escape(text)):
        formatted = render(role, body)
        try:
            if [t[:2] for t in parse(formatted)] == [(role, text)]:
                return formatted
        except ValueError:
            continue
    raise ValueError("the turn does not survive its own grammar")


_STRETCH = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("stretch", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64())))])


def format_conversations(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, part, stretch, formatted, loss_spans): conversations as formatted text, in stretches ordered by (part, stretch).

    Rows are dealt out by ranges of (conversation, turn), so a long conversation spans several tasks and none gathers it.
    Turns follow their number, nulls first; rows of one number follow role, then text, and repeated rows stay. Null roles
    and texts are empty; null conversations form one. loss_spans: start and end of each text of `loss_role`, escapes included.
    """
    plain = pick(conversations, conv_id=conv, turn=turn, role=role, text=text)
    ready = plain.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    bounded_batches(conversations.sparkSession)
    dealt = ready.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, stretch, current = TaskContext.get().partitionId(), 0, None
        pieces: list[str] = []
        spans: list[list[int]] = []
        size = 0
        done: list[tuple] = []

        def close():
            nonlocal pieces, spans, size, stretch
            if pieces:
                done.append((current, part, stretch, "".join(pieces), spans))
                stretch += 1
            pieces, spans, size = [], [], 0

        for batch in batches:
            for c, who, said in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if c != current or size > STRETCH_CHARS or len(pieces) >= STRETCH_TURNS:
                    close()
                    current = c
                piece = format_turn(who, said)
                if who == loss_role:
                    (_, _, a, b) = parse(piece)[0]
                    spans.append([size + a, size + b])
                pieces.append(piece)
                size += len(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _STRETCH)], schema=_STRETCH)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _STRETCH)], schema=_STRETCH)

    return dealt.mapInArrow(run, "conv_id long, part long, stretch long, formatted string, loss_spans array<array<bigint>>")


DIGESTS = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))])


def digests(formatted: DataFrame) -> DataFrame:
    """What parsing the formatted table gives for each conversation (columns of DIGESTS).

    A conversation's stretches pass one task as a stream in their order, with running digests and no stretch kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def close():
            if state is not None:
                turns, loss, n, chars, total = state
                done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            for c, text, spans in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                if state is None or c != current:
                    close()
                    current, state = c, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, said, _, _ in parse(text):
                    state[0].update(f"{role}\n{said}\n".encode())
                    state[2] += 1
                for a, b in spans:
                    said = unescape(text[a:b])
                    state[1].update(said.encode())
                    state[3] += len(said)
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, pa.int64()) for i, x in enumerate(zip(*done))], names=DIGESTS.names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, pa.int64()) for i, x in enumerate(zip(*done))], names=DIGESTS.names)

    bounded_batches(formatted.sparkSession)
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part", "stretch").mapInArrow(run, DIGESTS)


def round_trip(conversations: DataFrame, **columns: str) -> DataFrame:
    """Format all conversations, write the formatted table, and digest what is read back from it."""
    return digests(written(format_conversations(conversations, **columns), "formatted")[0])
