"""Coordinates through edits: run-length maps from a sequence's positions to those of its edited form.

A map is an array of segments (start, stop, shift) in order: positions start to stop lie ``shift`` further on in the edited sequence.
Positions in no segment are gone, and edited positions that none comes to are new.  Maps of any sequence have a segment more
than they have edits, so looking up, turning round and composing do not depend on its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelyard.functions import sequence


def _segment(start: Column, stop: Column, shift: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), shift.cast("long").alias("shift"))


def _in_order(segments: Column) -> Column:
    return F.array_sort(F.filter(segments, lambda x: x["start"] <= x["stop"]))


def edit_map(length: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """The map of one edit of a sequence of this length (positions from 1); replaced bases keep their places one by one."""
    core = sequence.trimmed(ref, alt)
    start, a, b = pos + core["offset"], F.char_length(core["ref"]), F.char_length(core["alt"])
    head = start - 1 + F.least(a, b)
    whole = F.array(_segment(F.lit(1), length, F.lit(0)))
    return F.when(a == b, whole).otherwise(_in_order(F.array(_segment(F.lit(1), head, F.lit(0)), _segment(start + a, length, b - a))))


def mapped(segments: Column, at: Column) -> Column:
    """Where a position lies in the edited sequence; null if it is gone."""
    own = F.get(F.filter(segments, lambda x: (x["start"] <= at) & (at <= x["stop"])), F.lit(0))
    return at + own["shift"]


def turned(segments: Column) -> Column:
    """The map from the edited sequence back."""
    return F.transform(segments, lambda x: _segment(x["start"] + x["shift"], x["stop"] + x["shift"], -x["shift"]))


def composed(first: Column, second: Column) -> Column:
    """The map of both edits: ``second`` counts on the sequence that ``first`` leads to."""

    def meet(x: Column, y: Column) -> Column:
        shift = x["shift"]
        return _segment(F.greatest(x["start"], y["start"] - shift), F.least(x["stop"], y["stop"] - shift), shift + y["shift"])

    return _in_order(F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: meet(x, y)))))


def junctions(segments: Column) -> Column:
    """Positions that an edit has made neighbours: array of struct<left, right>, both on the original."""
    pairs = F.transform(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), lambda y, k: F.struct(F.get(segments, k).alias("x"), y.alias("y")))
    close = F.filter(pairs, lambda p: (p["x"]["stop"] + p["x"]["shift"] + 1 == p["y"]["start"] + p["y"]["shift"]) & (p["x"]["stop"] + 1 < p["y"]["start"]))
    return F.transform(close, lambda p: F.struct(p["x"]["stop"].alias("left"), p["y"]["start"].alias("right")))
