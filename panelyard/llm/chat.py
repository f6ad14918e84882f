"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, its text alone is under the loss
mask.  Turns are written as ``<|turn|>role``, a line feed, the text, ``<|end|>`` and a line feed.  Control strings within a
text get a backslash after their first character (one more where some stand already), and lose it when read back.

Conversations are dealt out by their ids and sorted by turn, and each task goes through its rows once: it holds one
conversation's formatted prefix, whatever the number of conversations.  The expansion itself grows with the square of a
conversation's turns, as the method has it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.shared import kept

TURN, END, TRAINED = "<|turn|>", "<|end|>", "assistant"
#: Strings that must not stand in a text as they are, ours and those of other common templates.
CONTROLS = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]")
_ENDINGS = "|".join(sorted({re.escape(c[1:]) for c in CONTROLS}))
_PLAIN, _ESCAPED = re.compile(rf"([<\[])(\\*)(?={_ENDINGS})"), re.compile(rf"([<\[])\\(\\*)(?={_ENDINGS})")
_PARSE = re.compile(r"<\|turn\|>((?:[^\n\\]|\\.)*)\n(.*?)<\|end\|>\n", re.DOTALL)
_BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text stands in it."""
    head = TURN + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn that stands in a formatted string."""
    role = lambda r: re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(r))
    return [(role(m[1]), unescape(m[2])) for m in _PARSE.finditer(formatted)]


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("known", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
    rows: list[tuple] = []
    current, prefix, known, example, held = None, "", 0, 0, 0  # prefix: empty before the first row only

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, schema.types, strict=True)], schema=schema)
        rows.clear()
        return out

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != current:
                if prefix:
                    rows.append((current, example, prefix[known:], 0, None, None))
                current, prefix, known, example = conv, "", 0, 0
            turn, a, b = format_turn(role, text)
            if role == TRAINED:
                rows.append((conv, example, prefix + turn, known, len(prefix) + a, len(prefix) + b))
                example, known = example + 1, len(prefix) + len(turn)
            prefix += turn
            held += len(prefix) if role == TRAINED else 0
            if held > _BATCH_CHARS:
                yield flush()
                held = 0
    if prefix:
        rows.append((current, example, prefix[known:], 0, None, None))
    yield flush()


def examples(conversations: DataFrame) -> DataFrame:
    """One row for each assistant turn, and one for each conversation: conv_id, example, text, known, loss_start, loss_end.

    text is context and target; known is how many of its characters the conversation's earlier examples have already;
    loss_start and loss_end bound the trainable characters.  A conversation's last row has no target (null bounds): its text
    is what follows the last assistant turn, perhaps nothing.  Turns stand in the order of turn (nulls first), role, text;
    null roles and texts are empty; repeated rows are turns of their own; rows without conv_id are one conversation.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_expand, "conv_id long, example long, text string, known long, loss_start long, loss_end long")


class _Digest:
    """What is read back of one conversation so far."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_examples = 0

    def add(self, fresh: str, chars: int, start: int | None, end: int | None) -> None:
        found = parse_turns(fresh)
        for role, text in found:
            self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns += len(found)
        self.chars += chars
        if start is not None:
            target = unescape(fresh[start:end])
            self.loss.update(target.encode())
            self.loss_chars += len(target)
            self.n_examples += 1


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    own = _Digest()
    for batch in batches:
        rows = []
        for conv, fresh, chars, start, end, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "fresh", "chars", "loss_start", "loss_end", "last")), strict=True):
            own.add(fresh, chars, start, end)
            if last:
                rows.append((conv, own.n_turns, own.turns.hexdigest(), own.loss_chars, own.loss.hexdigest(), own.chars, own.n_examples))
                own = _Digest()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted rows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars (of all its rows), n_examples."""
    fresh = formatted.select("conv_id", "example", F.expr("substring(text, int(known) + 1)").alias("fresh"), F.char_length("text").cast("long").alias("chars"), (F.col("loss_start") - F.col("known")).alias("loss_start"), (F.col("loss_end") - F.col("known")).alias("loss_end"), F.col("loss_start").isNull().alias("last"))
    ordered = fresh.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return ordered.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


def round_trip(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """All conversations and one, numbered -1, that speaks in control strings: formatted, written, and read back."""
    odd = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, TRAINED, odd)], "conv_id long, turn long, role string, text string")
    return read_back(kept(examples(conversations.select("conv_id", "turn", "role", "text").unionByName(own)), "chat"))
