"""Messages from ordered deltas: a batch form, and a stateful stream that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelyard.functions.digests import canonical_json

FIELDS = ["message_id", "content", "reasoning", "finish_reason", "status", "reasoning_content", "refusal", "role", "native_finish_reason", "details"]
OUTPUT = ", ".join(f"{c} string" for c in FIELDS)
DONE = "[DONE]"
#: Fields of a delta whose texts are joined, fields of a reasoning detail whose texts are, and fields that a text
#: message never has.
_TEXTS, _DETAIL_TEXTS, _FOREIGN = ("content", "reasoning", "reasoning_content", "refusal"), ("text", "summary", "data", "signature"), ("tool_calls", "function_call")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parsed(data: str) -> dict | None:
    """The one delta of a data line, with the finish reasons of its choice; None for the line of an error.

    A line is a delta itself or has ``choices``, of which only number 0 may be there.  An error is text that isn't a JSON object, an
    ``error`` field, and a field of the wrong kind.
    """
    try:
        event = json.loads(data)
    except ValueError:
        return None
    if not isinstance(event, dict) or "error" in event:
        return None
    choices = event.get("choices", [event | {"delta": event}])
    delta: dict = {}
    if not isinstance(choices, list):
        return None
    for choice in choices:
        if not isinstance(choice, dict) or ("choices" in event and choice.get("index", 0) != 0) or not isinstance(choice.get("delta", {}), dict):
            return None
        own = {k: v for k, v in choice.get("delta", {}).items() if v is not None}
        details = own.get("reasoning_details", [])
        if any(not isinstance(own.get(c, ""), str) for c in _TEXTS) or any(c in own for c in _FOREIGN) or not isinstance(details, list) or not all(isinstance(d, dict) for d in details):
            return None
        for c in _TEXTS:
            if c in own:
                delta[c] = delta.get(c, "") + own[c]
        delta["reasoning_details"] = delta.get("reasoning_details", []) + details
        delta |= {c: own[c] for c in ("role",) if c in own} | {c: choice[c] for c in ("finish_reason", "native_finish_reason") if choice.get(c) is not None}
    return delta


def detail_key(detail: dict) -> tuple[str, str]:
    """What parts of one reasoning detail have in common: their index and type, as JSON."""
    return json.dumps(detail.get("index", 0)), json.dumps(detail.get("type"))


class Message:
    """A message that is put together from deltas in their order."""

    def __init__(self):
        self.texts: dict[str, list[str]] = {}
        self.last: dict[str, object] = {}
        self.details: dict[tuple[str, str], dict] = {}
        self.failed = self.done = False

    def add(self, delta: dict | None) -> None:
        if delta is None:
            self.failed = True
            return
        for c in _TEXTS:
            if c in delta:
                self.texts.setdefault(c, []).append(delta[c])
        self.last |= {c: delta[c] for c in ("role", "finish_reason", "native_finish_reason") if c in delta}
        for part in delta.get("reasoning_details", []):
            whole = self.details.setdefault(detail_key(part), {})
            for name, value in part.items():
                if name in _DETAIL_TEXTS and isinstance(value, str):
                    whole[name] = whole.get(name, "") + value if isinstance(whole.get(name, ""), str) else value
                elif value is not None:
                    whole[name] = value

    def row(self, message_id: str) -> tuple:
        text = lambda c, other=None: "".join(self.texts[c]) if c in self.texts else other
        last = lambda c: None if c not in self.last else str(self.last[c])
        finish = last("finish_reason")
        status = "error" if self.failed else "incomplete" if not self.done else "completed" if finish else "missing_finish_reason"
        details = canonical_json(list(self.details.values())) if self.details else None
        return message_id, text("content", ""), text("reasoning", ""), finish, status, text("reasoning_content"), text("refusal"), last("role"), last("native_finish_reason"), details


def _lines(events: DataFrame) -> DataFrame:
    return events.select(F.col("message_id").cast("string").alias("message_id"), F.col("seq").cast("long").alias("seq"), F.coalesce("data", F.lit("")).alias("data"))


def _done(data: str) -> bool:
    return data.strip() == DONE


def assembled(events: DataFrame) -> DataFrame:
    """events: message_id, seq, data.  One row for each message: FIELDS.

    Lines are taken in the order of their numbers; a number that comes again counts once, as the greater text.  Texts are joined,
    parts of a reasoning detail by index and type (texts joined, other fields replaced); details is a JSON array of them in the
    order in which they began.  status: error if any line is one, incomplete without the terminal mark, missing_finish_reason,
    or completed.  A message's lines are sorted in the shuffle and folded as they pass.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, message = None, None
        for pdf in batches:
            rows = []
            for message_id, data in pdf.itertuples(index=False):
                if message is None or message_id != current:
                    if message is not None:
                        rows.append(message.row(current))
                    current, message = message_id, Message()
                if _done(data):
                    message.done = True
                else:
                    message.add(parsed(data))
            yield pd.DataFrame(rows, columns=FIELDS)
        if message is not None:
            yield pd.DataFrame([message.row(current)], columns=FIELDS)

    once = _lines(events).groupBy("message_id", "seq").agg(F.max("data").alias("data"))
    return once.repartition("message_id").sortWithinPartitions("message_id", "seq").select("message_id", "data").mapInPandas(run, OUTPUT)


class _Assembler(StatefulProcessor):
    """A message's state: its lines by number and the parts of its reasoning details by index, type and number.  An arrival writes
    its own entries only; all are read once, when the message is given out."""

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "seq long", "data string, delta string")
        self.details = handle.getMapState("details", "first string, second string, seq long", "parts string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ended = False
        for pdf in rows:
            for seq, data in zip(pdf["seq"], pdf["data"], strict=True):
                seq = int(seq)
                if self.lines.containsKey((seq,)) and self.lines.getValue((seq,))[0] >= data:
                    continue
                ended |= _done(data)
                delta = None if _done(data) else parsed(data)
                by_key: dict[tuple[str, str], list[dict]] = {}
                for part in (delta or {}).pop("reasoning_details", []):
                    by_key.setdefault(detail_key(part), []).append(part)
                for (first, second), parts in by_key.items():
                    self.details.updateValue((first, second, seq), (json.dumps(parts),))
                self.lines.updateValue((seq,), (data, json.dumps(delta | {"keys": list(by_key)} if delta is not None else None)))
        if ended:
            yield self._out(key)
        elif self.timeout_ms is not None:
            self._drop_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._out(key)

    def _drop_timers(self) -> None:
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def _out(self, key) -> pd.DataFrame:
        message = Message()
        for (seq,), (data, delta) in sorted(self.lines.iterator(), key=lambda x: x[0][0]):
            if _done(data):
                message.done = True
                continue
            own = json.loads(delta)
            if own is not None:
                own["reasoning_details"] = [p for first, second in own.pop("keys") for p in json.loads(self.details.getValue((first, second, seq))[0])]
            message.add(own)
        self._drop_timers()
        self.lines.clear()
        self.details.clear()
        return pd.DataFrame([message.row(key[0])], columns=FIELDS)

    def close(self) -> None:
        pass


def assembled_stream(events: DataFrame, timeout: str | None = "10 minutes") -> DataFrame:
    """:func:`assembled` over a stream: a message is given out once its terminal mark has come, or as incomplete when nothing came for
    ``timeout`` of processing time (None: never); then its state goes.  Parts of one line's details keep their order by key.

    The session's state store becomes RocksDB, which such operators need.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    milliseconds = int(pd.Timedelta(timeout).total_seconds() * 1000) if timeout else None
    mode = "ProcessingTime" if timeout else "None"
    return _lines(events).groupBy("message_id").transformWithStateInPandas(_Assembler(milliseconds), OUTPUT, "Append", mode)


_FOLDED = ["message_id", "content", "reasoning", "finish_reason", "status"]


def fold_batch(events: DataFrame) -> DataFrame:
    """:func:`assembled` without details: message_id, content, reasoning, finish_reason, status."""
    return assembled(events).select(*_FOLDED)


def fold_stream(events: DataFrame, timeout: str | None = "10 minutes") -> DataFrame:
    """:func:`assembled_stream` without details."""
    return assembled_stream(events, timeout).select(*_FOLDED)
