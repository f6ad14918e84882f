"""Messages put together from deltas: by hand, and as a stream whose lines come in any order."""

import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from panelyard.streaming import messages

SCHEMA = "message_id string, seq long, data string"


def line(**delta):
    return json.dumps(delta)


def part(index, kind, **fields):
    return {"index": index, "type": kind} | fields


CASES = {
    "plain": [line(content="Hel", role="assistant"), line(content="lo", reasoning="r"), line(finish_reason="stop"), "[DONE]"],
    "chunks": [json.dumps({"choices": [{"index": 0, "delta": {"content": "a"}}]}), json.dumps({"choices": [{"delta": {"content": "b", "refusal": None}, "finish_reason": "length", "native_finish_reason": "max"}]}), json.dumps({"choices": []}), "[DONE]"],
    "details": [
        line(reasoning_details=[part(0, "text", text="One ", format="x"), part(1, "summary", summary="S")]), line(reasoning_details=[part(0, "text", text="two", signature="si", format="y")], reasoning_content="rc"),
        line(reasoning_details=[part(0, "encrypted", data="d1"), part(0, "text", signature="g", text=None), {"type": "text", "text": "!"}]), line(reasoning_details=[part(0, "encrypted", data="d2", id=None)], finish_reason="stop"), "[DONE]",
    ],
    "second_choice": [json.dumps({"choices": [{"index": 1, "delta": {"content": "a"}}]}), "[DONE]"],
    "tools": [line(content="x", finish_reason="stop"), line(tool_calls=[1]), "[DONE]"],
    "number": [line(content=5), "[DONE]"],
    "bad_details": [line(reasoning_details={"text": "x"}), line(reasoning_details=["x"]), "[DONE]"],
    "not_json": ["{", line(content="kept", finish_reason="stop"), "[DONE]"],
    "no_reason": [line(content="x"), " [DONE] "],
    "open": [line(content="y")],
}
EXPECTED = {
    "plain": ("Hello", "r", "stop", "completed", None, None, "assistant", None, None),
    "chunks": ("ab", "", "length", "completed", None, None, None, "max", None),
    "details": ("", "", "stop", "completed", "rc", None, None, None, '[{"format":"y","index":0,"signature":"sig","text":"One two!","type":"text"},{"index":1,"summary":"S","type":"summary"},{"data":"d1d2","index":0,"type":"encrypted"}]'),
    "second_choice": ("", "", None, "error", None, None, None, None, None),
    "tools": ("x", "", "stop", "error", None, None, None, None, None),
    "number": ("", "", None, "error", None, None, None, None, None),
    "bad_details": ("", "", None, "error", None, None, None, None, None),
    "not_json": ("kept", "", "stop", "error", None, None, None, None, None),
    "no_reason": ("x", "", None, "missing_finish_reason", None, None, None, None, None),
    "open": ("y", "", None, "incomplete", None, None, None, None, None),
}


def rows():
    return [(name, 10 * k, data) for name, lines in CASES.items() for k, data in enumerate(lines)]


def test_messages_by_hand(spark):
    every = rows() + rows()[:5]  # a repeated line counts once
    random.Random(1).shuffle(every)
    out = {r.message_id: tuple(r)[1:] for r in messages.assembled(spark.createDataFrame(every, SCHEMA).repartition(3)).collect()}
    assert out == EXPECTED
    assert messages.assembled(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_in_any_order(spark, tmp_path, seed):
    """Lines come file by file in any order, those that end a message last."""
    early = [r for r in rows() if "[DONE]" not in r[2]]
    random.Random(seed).shuffle(early)
    source = str(tmp_path / "in")
    for k, batch in enumerate([*(list(b) for b in itertools.batched(early, 5)), early[:3], [r for r in rows() if "[DONE]" in r[2]]]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.01 * k)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = messages.assembled_stream(stream, None).writeStream.format("memory").queryName(f"assembled{seed}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.message_id: tuple(r)[1:] for r in spark.table(f"assembled{seed}").collect()} == {k: v for k, v in EXPECTED.items() if k != "open"}


def test_silent_messages_are_given_out(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([r for r in rows() if r[0] in ("open", "plain")], SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    q = messages.assembled_stream(stream, "1 second").writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if spark.table("silent").count() == 2:
                break
    finally:
        q.stop()
    assert {r.message_id: r.status for r in spark.table("silent").select("message_id", F.col("status")).collect()} == {"open": "incomplete", "plain": "completed"}
