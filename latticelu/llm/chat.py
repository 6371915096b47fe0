"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and
only its text is under the loss mask.  Turns are written as

    <|im_start|>role\\n text <|im_end|>\\n

(without the blanks), and texts and roles are escaped so that they never hold the
control strings: a backslash becomes two, and `<|` becomes `<\\|`.

An example holds its whole context, so examples grow with the square of a conversation's
turns.  For conversations of more than `CHUNK` characters the part of the context that is
complete, `CHUNK` characters of whole turns at a time, is a row of its own (without an
example number), and an example names how many such rows its context begins with; so no row
and no task holds more than a chunk and a turn.  Turns after the last assistant turn are an
example without a target, so that nothing is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CHUNK = 1 << 20
EXAMPLES = "conv_id bigint, example bigint, chunks bigint, text string, target_start bigint, target_end bigint"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    """As escape(), and a line end becomes a backslash and an n, for a role is one line."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn's characters, and where in them its text begins."""
    head = f"{START}{escape_role(role)}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def parse_turns(formatted: str, at: int = 0) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn from `at` on; start and end of the escaped text."""
    out = []
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        stop = formatted.index(END + "\n", at)
        line = formatted.index("\n", at)
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop]), line + 1, stop))
        at = stop + len(END) + 1
    return out


class _Rows:
    """Collects rows and gives them out as record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 64
        if self.size > 4 << 20:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
            self.rows, self.size = [], 0


_EXAMPLE = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("chunks", pa.int64()), ("text", pa.string()), ("target_start", pa.int64()), ("target_end", pa.int64())])


def _expand(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    out, conv, begun = _Rows(_EXAMPLE), None, False
    number = chunks = 0
    text, waiting = "", False  # turns since the last whole chunk; whether the last turn is in no example

    for batch in batches:
        for c, role, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            role, said = role or "", said.as_py() or ""
            if not begun or c != conv:
                if waiting:
                    yield from out.add((conv, number, chunks, text, None, None), len(text))
                conv, begun, number, chunks, text, waiting = c, True, 0, 0, "", False
            turn, at = format_turn(role, said)
            start = len(text) + at
            text += turn
            waiting = role != "assistant"
            if not waiting:
                yield from out.add((c, number, chunks, text, start, len(text) - len(END) - 1), len(text))
                number += 1
            if len(text) >= chunk:
                yield from out.add((c, None, chunks, text, None, None), len(text))
                chunks, text = chunks + 1, ""
    if waiting:
        yield from out.add((conv, number, chunks, text, None, None), len(text))
    yield from out.rest()


def expand(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The examples of every conversation (conv_id, turn, role, text), in order within partitions.

    A row is an example: its text is its context and its target, the target from
    target_start to target_end (null: no target).  `chunks` counts the rows without an
    example number that its context begins with; those hold `chunk` characters or more and
    only conversations that long have any.

    Null texts and roles count as empty.  Turns go by turn, then role, then text, so ties
    and repeated rows are kept in a fixed order; null turns come first; rows with a null
    conv_id form one conversation.  An empty table gives no example.  Columns besides these
    four are not read.  A conversation streams through one task, which holds a chunk and a
    turn of it.
    """
    dealt = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(lambda batches: _expand(batches, chunk), EXAMPLES)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64()), ("example_chars", pa.int64())])


class _Conversation:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = self.examples = self.example_chars = self.chunks = 0
        self.known = ""  # what this chunk's rows have shown so far

    def read(self, text: str) -> None:
        """`text` must begin with what is known; the turns after that are new."""
        if not text.startswith(self.known):
            raise ValueError("an example's context is not the turns before it")
        for role, said, _, _ in parse_turns(text, len(self.known)):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        self.formatted += len(text) - len(self.known)
        self.known = text


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, conv, state = _Rows(_DIGEST), None, None

    def close():
        s = state
        return out.add((conv, s.n_turns, s.turns.hexdigest(), s.loss_chars, s.loss.hexdigest(), s.formatted, s.examples, s.example_chars), 0)

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5)]
        for c, example, chunks, start, end, text in zip(*columns, batch.column(3)):
            text = text.as_py()
            if state is None or c != conv:
                if state is not None:
                    yield from close()
                conv, state = c, _Conversation()
            if chunks != state.chunks:
                raise ValueError(f"conversation {c}: an example follows {chunks} chunks, not {state.chunks}")
            state.read(text)
            if example is None:
                state.chunks, state.known = state.chunks + 1, ""
                continue
            state.example_chars += state.formatted
            if start is not None:
                target = unescape(text[start:end])
                state.loss_chars += len(target)
                state.loss.update(target.encode("utf-8", "surrogatepass"))
                state.examples += 1
    if state is not None:
        yield from close()
    yield from out.rest()


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples hold when they are parsed again.

    `examples` as expand() gives them: whole conversations in order within partitions.  Each
    example's context is compared with the examples before it.  formatted_chars counts the
    conversation once, example_chars the whole texts of all its examples, chunks included.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint, example_chars bigint"
    return examples.mapInArrow(_digest, schema)
