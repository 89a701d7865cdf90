"""Operator 9: chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are its context and only its reply is
trainable.  ``expand`` keeps examples of a conversation, which are each other's beginnings, in shared form:
a row holds the turns since the example before it, the number of characters that come before (the
segments of the rows before it, in order), and the reply's place in the example's whole text.  So what
is shuffled or stored grows with the input.  Turns after the last reply, and very long stretches without
one, are rows without a target.

``spell_out`` forms every example with its whole context, one after the other, in batches of bounded size;
``whole_examples`` returns them.  ``read_back`` takes everything from these whole examples: each is split into all
its turns, its context must be the turns of the examples before it, its mask must cover the text of its last turn,
an assistant's, and nothing else; its length and digest are those of its text.  This takes time with
the square of a conversation, as the examples' texts together have that size, but no more than one example at a
time is held beside the conversation.

A turn is ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and a newline.  In roles and texts a
backslash becomes two and ``<|`` becomes ``<\\|``, and a newline in a role becomes ``\\n``, so no text
can look like a mark and everything reads back as it was.

Turns are read in the order of (turn, role, text), nulls first, one sorted stream per partition.  A
conversation is read by one task, as its digests need its order; that task holds some copies of its text, which
also has to stay below 2 GB, Arrow's limit for a string.

Cases: null texts and roles are empty; rows without a conv_id are one conversation; ties and repeated
turns stay, in that order; a very long turn is a segment of its own and must fit a worker some twenty
times over; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import store

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT_CHARS = 4 << 20
#: The conversation that the query adds.
EXTRA_TEXT = "<|im_end|><|im_start|>assistant ok"
#: Whole examples are handed on in batches of about so many characters.
BATCH_CHARS = 4 << 20
_BACK = {"n": "\n"}
EXAMPLES = "conv_id long, example long, prefix_chars long, segment string, target_start long, target_end long"
WHOLE = {"conv_id": pa.int64(), "example": pa.int64(), "text": pa.string(), "target_start": pa.int64(), "target_end": pa.int64()}
READ = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_examples": pa.int64(), "examples_sha256": pa.string()}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|") if "\\" in text or "<|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK.get(m[1], m[1]), text) if "\\" in text else text


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _whole(rows: list[tuple]) -> pa.RecordBatch:
    """Like _batch for rows of WHOLE; pa.array takes many times as long for long texts."""
    data = [r[2].encode() for r in rows]
    ends = np.array([*accumulate(map(len, data), initial=0)], dtype=np.int32)  # raises beyond 2 GB
    texts = pa.StringArray.from_buffers(len(data), pa.py_buffer(ends), pa.py_buffer(b"".join(data)))
    return pa.RecordBatch.from_arrays([texts if c == "text" else pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(WHOLE.items())], names=[*WHOLE])


def expand(conversations: DataFrame) -> DataFrame:
    """The examples in shared form: conv_id, example, prefix_chars, segment, target_start, target_end."""
    store.ship_package(conversations.sparkSession)
    empty = F.lit("")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text")
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names, types = ["conv_id", "example", "prefix_chars", "segment", "target_start", "target_end"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, before, length, parts = (), 0, 0, 0, []
        out: list[tuple] = []

        def close(target: tuple | None = None) -> None:
            nonlocal number, before, length, parts
            if parts:
                out.append((current[0], number, before, "".join(parts), *(target or (None, None))))
                number, before, length, parts = number + 1, before + length, 0, []

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if current != (conv,):
                    close()
                    current, number, before, length, parts = (conv,), 0, 0, 0, []
                head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
                at = before + length + len(head)
                parts.append(f"{head}{body}{END}\n")
                length += len(parts[-1])
                if role == "assistant":
                    close((at, at + len(body)))
                elif length >= SEGMENT_CHARS:
                    close()
            yield _batch(out, names, types)
            out.clear()
        close()
        yield _batch(out, names, types)

    return turns.mapInArrow(run, EXAMPLES)


def spell_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in shared form, in order: every example with its whole text, then, without a target, what follows
    a conversation's last one."""
    current, context, after, so_far, size = (), "", [], 0, 0
    out: list[tuple] = []

    def put(*row: object) -> Iterator[pa.RecordBatch]:
        nonlocal size
        if out and size + len(row[2]) > BATCH_CHARS:
            yield _whole(out)
            out.clear()
            size = 0
        out.append(row)
        size += len(row[2])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "example", "prefix_chars", "segment", "target_start", "target_end"))
        for conv, number, before, segment, start, end in zip(*columns, strict=True):
            if current != (conv,):
                for n, text in after:
                    yield from put(*current, n, text, None, None)
                current, context, after, so_far = (conv,), "", [], 0
            if before != so_far:
                raise ValueError(f"a row's context has {before} characters, the rows before it {so_far}")
            so_far += len(segment)
            after.append((number, segment))
            if start is not None:
                context = "".join((context, *(text for _, text in after)))
                after = []
                yield from put(conv, number, context, start, end)
    for n, text in after:
        yield from put(*current, n, text, None, None)
    yield _whole(out)


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from the rows of ``spell_out``."""
    current: tuple = ()
    state: _Read | None = None
    out: list[tuple] = []
    for batch in batches:
        columns = (batch.column(c) for c in ("conv_id", "text", "target_start", "target_end"))
        for values in zip(*columns, strict=True):
            conv, *row = (v.as_py() for v in values)
            if current != (conv,):
                if state:
                    out.append((current[0], *state.result()))
                current, state = (conv,), _Read()
            state.add(*row)
        yield _batch(out, [*READ], [*READ.values()])
        out.clear()
    if state:
        out.append((current[0], *state.result()))
    yield _batch(out, [*READ], [*READ.values()])


def _ordered(examples: DataFrame) -> DataFrame:
    store.ship_package(examples.sparkSession)
    return examples.select("conv_id", "example", "prefix_chars", "segment", "target_start", "target_end").repartition("conv_id").sortWithinPartitions("conv_id", "prefix_chars")


def whole_examples(examples: DataFrame) -> DataFrame:
    """conv_id, example, text, target_start, target_end with each example's whole text; this grows with the square of a conversation."""
    return _ordered(examples).mapInArrow(spell_out, "conv_id long, example long, text string, target_start long, target_end long").filter("target_start is not null")


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, examples_sha256, from the
    whole examples alone.  formatted_chars is the length of all whole examples and of the turns after the last one;
    examples_sha256 is over the digests of the whole examples, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read(spell_out(batches))

    return _ordered(examples).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, examples_sha256 string")


class _Read:
    """What is read back of one conversation's whole examples, in order."""

    def __init__(self) -> None:
        self.loss_chars = self.formatted = self.examples = 0
        self.seen: list[str] = []
        self.turns, self.loss, self.digests = (hashlib.sha256() for _ in range(3))

    def add(self, text: str, start: int | None, end: int | None) -> None:
        *turns, torn = text.split(f"{END}\n")
        n = 0 if start is None else len(self.seen)
        if n and turns[:n] != self.seen or start is not None and len(turns) == n:
            raise ValueError("an example's context isn't the turns before it")
        new = turns[n:]
        if torn or not all(t.startswith(START) for t in new):
            raise ValueError("a text isn't made of turns")
        if start is not None:
            role, _, body = turns[-1].removeprefix(START).partition("\n")
            if role != "assistant" or text[start:end] != body or end + len(END) + 1 != len(text):
                raise ValueError("an example's mask isn't its reply")
            reply = unescape(body)
            self.loss_chars += len(reply)
            self.loss.update(reply.encode())
            self.examples += 1
            self.digests.update(hashlib.sha256(text.encode()).hexdigest().encode())
        for turn in new:
            role, _, body = turn.removeprefix(START).partition("\n")
            self.turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
        self.seen += new
        self.formatted += len(text)

    def result(self) -> tuple:
        return len(self.seen), self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted, self.examples, self.digests.hexdigest()


def digests(conversations: DataFrame) -> DataFrame:
    """The query: all conversations and one more whose texts look like marks."""
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return read_back(expand(conversations.select("conv_id", "turn", "role", "text").unionByName(extra)))
