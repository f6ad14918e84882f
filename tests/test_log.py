"""The log and what hangs on it: writers that die at every step, replays, races, files that are not read."""

import os
import threading

import pytest

from panelyard.streaming.log import KeyedTable, Log, run_steps


class Killed(Exception):
    pass


def killer(at):
    def on_step(step):
        if step == at:
            raise Killed(step)

    return on_step


def frame(spark, keys, value):
    return spark.createDataFrame([(k, value) for k in keys], "k long, v string")


def contents(table):
    return sorted(tuple(r) for r in table.rows().select("k", "v").collect())


@pytest.mark.parametrize("at", ["read", "written", "logged"])
def test_killed_writers_and_replays(spark, tmp_path, at):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], files=3)
    assert table.rows() is None
    assert table.append(frame(spark, [1, 2, 2], "a"), 0)
    with pytest.raises(Killed):
        table.append(frame(spark, [2, 3], "b"), 1, on_step=killer(at))
    assert contents(table) == [(1, "a"), (2, "a")] + [(3, "b")] * (at == "logged")  # files that no entry names don't count
    assert table.append(frame(spark, [2, 3], "b"), 1) == (at != "logged")
    assert not table.append(frame(spark, [2, 3, 4], "c"), 1)  # a replay, whatever it brings
    assert table.append(frame(spark, [3, 4], "d"), 1, writer="other")
    assert contents(table) == [(1, "a"), (2, "a"), (3, "b"), (4, "d")]


def test_only_files_that_can_hold_the_keys_are_read(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], files=6)
    for epoch in range(3):
        table.append(frame(spark, range(100 * epoch, 100 * epoch + 100), "x"), epoch)
    entries = table.log.entries()
    files = [f["path"] for e in entries for f in e["files"]]
    assert len(files) == 18
    near = table.holding(entries, frame(spark, [5], "y"))
    assert 1 <= len(near) <= 3  # one range of each epoch
    gone = next(f for f in files if f not in near)
    os.remove(gone.removeprefix("file://").removeprefix("file:"))
    assert table.append(frame(spark, [5], "y"), 3)  # which would fail if it read that file
    assert table.append(frame(spark, [], "y"), 4)


def test_one_of_two_writers_wins(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log")
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append((k, log.append(0, {"k": k})))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(ok for _, ok in won) == 1
    assert [e["k"] for e in log.entries()] == [k for k, ok in won if ok]
    assert len(os.listdir(f"{tmp_path}/log")) <= 2  # the entry and its checksum


def test_a_lost_race_is_run_again(spark, tmp_path):
    table, other = (KeyedTable(spark, f"{tmp_path}/t", ["k"], files=2) for _ in range(2))
    met = []

    def interfere(step):
        if step == "written" and not met:
            met.append(step)
            other.append(frame(spark, [1], "first"), 0, writer="other")

    assert table.append(frame(spark, [1, 2], "second"), 0, on_step=interfere)
    assert contents(table) == [(1, "first"), (2, "second")]


def test_steps_survive_their_driver(spark, tmp_path):
    done = []

    def work(name, fail):
        def run():
            done.append(name)
            if fail:
                raise Killed(name)

        return name, run

    for k in range(3):
        with pytest.raises(Killed):
            run_steps(Log(spark, f"{tmp_path}/s"), [work(n, i == k) for i, n in enumerate("abc")])
    assert run_steps(Log(spark, f"{tmp_path}/s"), [work(n, False) for n in "abc"]) == ["c"]
    assert done == ["a", "a", "b", "b", "c", "c"]
    assert run_steps(Log(spark, f"{tmp_path}/s"), [work(n, False) for n in "abc"]) == []
    states = [(e["step"], e["state"]) for e in Log(spark, f"{tmp_path}/s").entries()]
    assert states == [("a", "started"), ("a", "started"), ("a", "ended"), ("b", "started"), ("b", "started"), ("b", "ended"), ("c", "started"), ("c", "started"), ("c", "ended")]
