"""Joins that plain equality does not say: containment, overlap, ladders, fallbacks, upserts, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import scans


#: A level of the interval index has bins of 4**level positions.
_STEP = 2


def _indexed(spans: DataFrame, start: str, stop: str) -> DataFrame:
    """Spans (inclusive ends) under the bins of the lowest level that is as wide as they are: one or two rows each, of any length.
    Empty and null spans go."""
    size = F.col(stop).cast("long") - F.col(start).cast("long") + 1
    bits = F.char_length(F.bin(size - 1))  # 2**bits >= size
    level = F.when(size == 1, 0).otherwise(F.ceil(bits / _STEP)).cast("int")
    low, high = F.expr(f"shiftright(cast({start} as bigint), {_STEP} * _level)"), F.expr(f"shiftright(cast({stop} as bigint), {_STEP} * _level)")
    return spans.where(F.col(start) <= F.col(stop)).withColumn("_level", level).withColumn("_bin", F.explode(F.array_distinct(F.array(low, high))))


def containment_join(points: DataFrame, windows: DataFrame, key: list[str], at: str, length: str | None, start: str, stop: str) -> DataFrame:
    """Points (``at``, or spans of ``length`` from there) that lie wholly within a window of the same key, both ends inclusive.

    The join is an equality on key, level and bin of an index over the windows: a window stands in one or two bins whatever its
    length, a point probes one bin of each level that windows have (31 at most), so each pair is found once.
    """
    end = F.col(at) + (F.col(length) - 1 if length else F.lit(0))
    listed = _indexed(windows, start, stop)
    levels = sorted(r[0] for r in listed.select("_level").distinct().collect())
    probes = F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))
    probing = points.withColumn("_end", end).withColumn("_level", probes).withColumn("_bin", F.expr(f"shiftright(cast({at} as bigint), {_STEP} * _level)"))
    return probing.join(listed, [*key, "_level", "_bin"]).where((F.col(at) >= F.col(start)) & (F.col("_end") <= F.col(stop))).drop("_level", "_bin", "_end")


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of spans (inclusive ends) that share a point: the right one holds the left one's start, or begins within the left one
    after that.  Either is a containment of points, so a span of any length is one or two rows."""
    (a, b), (c, d) = left_span, right_span
    whole = left.where(F.col(a) <= F.col(b)), right.where(F.col(c) <= F.col(d))
    starts_inside = containment_join(whole[0], whole[1], key, a, None, c, d)
    begins_later = containment_join(whole[1], whole[0], key, c, None, a, b).where(F.col(c) > F.col(a))
    return starts_inside.unionByName(begins_later)


def overlapping_intervals(intervals: DataFrame, key: list[str], start: str, stop: str, ties: list[str] | None = None) -> DataFrame:
    """Intervals (inclusive ends) that an earlier one of the same key reaches into, with the greatest stop before them as reached.

    A sweep along the starts that carries the greatest stop, so overlaps are found that no point falls into.  Equal intervals
    go by ``ties``; without them any of these may be the earlier one.
    """
    swept = scans.scanned(intervals, key, [start, stop, *(ties or [])], before={"reached": F.col(stop)})
    return swept.where(F.col("reached") >= F.col(start))


def at_most_one_interval(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, stop: str, name: str, identity: list[str], other: str = "other") -> DataFrame:
    """Each point with its interval's name, or ``other``; n_matches over 1 breaks the rule that intervals are disjoint
    (:func:`overlapping_intervals` finds those that hold no point)."""
    found = containment_join(points.select(*key, *identity, at), intervals, key, at, None, start, stop).groupBy(*key, *identity).agg(F.min(name).alias("_name"), F.count("*").alias("_n"))
    out = points.join(found, [*key, *identity], "left")
    return out.withColumns({name: F.coalesce("_name", F.lit(other)), "n_matches": F.coalesce("_n", F.lit(0))}).drop("_name", "_n")


def coalesced_rule(df: DataFrame, specific: DataFrame, default: DataFrame, record: str, family: str, rule: str) -> DataFrame:
    """Each row's own rule, else its family's, else null; adds rule and rule_source (record, family, none)."""
    out = df.join(specific.select(record, F.col(rule).alias("_own")), record, "left").join(default.select(family, F.col(rule).alias("_all")), family, "left")
    return out.withColumns({rule: F.coalesce("_own", "_all"), "rule_source": F.when(F.col("_own").isNotNull(), "record").when(F.col("_all").isNotNull(), "family").otherwise("none")}).drop("_own", "_all")


def unused_rules(df: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Rules that no row falls under."""
    return rules.join(df.select(key), key, "left_anti")


def match_ladder(scores: DataFrame, entries: DataFrame, identity: str, level: str, excluded: Column) -> DataFrame:
    """External scores against configurations on (identity, level), and why a score has none: match_status.

    The ladder: excluded, no_identity, no_configuration, level_not_reported, no_exact_level, ambiguous, exact.
    """
    any_ = entries.groupBy(F.col(identity).alias("_id")).agg(F.count("*").alias("_any"))
    exact = entries.groupBy(F.col(identity).alias("_id"), F.col(level).alias("_level")).agg(F.count("*").alias("_exact"))
    out = scores.join(any_, F.col(identity) == F.col("_id"), "left").drop("_id").join(exact, (F.col(identity) == F.col("_id")) & (F.col(level) == F.col("_level")), "left").drop("_id", "_level")
    status = (
        F.when(excluded, "excluded").when(F.col(identity).isNull(), "no_identity").when(F.col("_any").isNull(), "no_configuration")
        .when(F.col(level).isNull(), "level_not_reported").when(F.col("_exact").isNull(), "no_exact_level").when(F.col("_exact") > 1, "ambiguous").otherwise("exact")
    )
    return out.withColumn("match_status", status).drop("_any", "_exact")


def upsert(original: DataFrame, replacement: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Original rows with the columns of their replacement where there is one; adds replaced.  Replacements have unique keys."""
    fresh = replacement.select(*key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_new"))
    out = original.join(fresh, key, "left")
    return out.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns} | {"replaced": F.coalesce("_new", F.lit(False))}).drop("_new", *(f"_{c}" for c in columns))


def attempts(failed: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """All failed attempts of a key as one array, in order."""
    return failed.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, *(f for f in fields if f not in order)))).alias("attempts"))


def attach_attempts(recovered: DataFrame, failed: DataFrame, key: list[str], order: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Recovered rows with all their failed attempts (an empty array for none), and the failed attempts that belong to no row."""
    held = attempts(failed, key, order, fields)
    kind = held.schema["attempts"].dataType.simpleString()
    out = recovered.join(held, key, "left").withColumn("attempts", F.coalesce("attempts", F.array().cast(kind)))
    return out, failed.join(recovered.select(*key), key, "left_anti")


def allele_scores(alleles: DataFrame, scores: DataFrame, routes: list[str], score: str, identity: str) -> DataFrame:
    """Selected alleles with their public score, found by the first of several keys (such as a trimmed allele, then its text) that
    has one: adds score, route and match (matched, ambiguous, missing).

    A key that stands on several score rows with different values is ambiguous: an error for the caller, without a score.
    Alleles bear a unique ``identity``; null keys match nothing.
    """
    found = None
    for k, route in enumerate(routes):
        of = scores.where(F.col(route).isNotNull()).groupBy(route).agg(F.min(score).alias("_score"), (F.count_distinct(score) > 1).alias("_many"))
        hit = alleles.select(identity, route).join(of, route).select(identity, F.struct(F.lit(k).alias("k"), F.lit(route).alias("route"), "_score", "_many").alias("_hit"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(identity).agg(F.min_by("_hit", F.col("_hit")["k"]).alias("_hit"))
    h = F.col("_hit")
    match = F.when(h.isNull(), "missing").when(h["_many"], "ambiguous").otherwise("matched")
    return alleles.join(best, identity, "left").withColumns({score: F.when(match == "matched", h["_score"]), "route": h["route"], "match": match}).drop("_hit")


def guarded_chain(df: DataFrame, steps: list[tuple[DataFrame, list[str], list[str], list[str]]]) -> DataFrame:
    """A row through several tables, each by its key and only where all its guards (digests, lengths) are equal: adds the columns of
    each step and problem, the first step that failed (missing_<n>, differs_<n>); null for a whole chain.

    steps: table (one row per key), key, guards (columns of the row so far and of the table alike), columns to add.
    """
    problem = F.lit(None).cast("string")
    for n, (right, key, guards, columns) in enumerate(steps):
        named = right.select(*key, *(F.col(g).alias(f"_g_{g}") for g in guards), *(F.col(c).alias(f"_c_{c}") for c in columns), F.lit(True).alias("_there"))
        same = F.lit(True)
        for g in guards:
            same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        df = df.join(named, key, "left")
        before = F.col("problem") if n else problem
        df = df.withColumn("problem", F.coalesce(before, F.when(F.col("_there").isNull(), f"missing_{n}").when(~same, f"differs_{n}")))
        df = df.withColumns({c: F.when(F.col("problem").isNull(), F.col(f"_c_{c}")) for c in columns}).drop("_there", *(f"_g_{g}" for g in guards), *(f"_c_{c}" for c in columns))
    return df


def positional_zip(left: DataFrame, right: DataFrame, key: str, values: str) -> DataFrame:
    """Two arrays of a key side by side: key, position from 0, left_value, right_value; the shorter is filled with nulls."""
    both = left.select(key, F.col(values).alias("_a")).join(right.select(key, F.col(values).alias("_b")), key)
    zipped = F.arrays_zip(F.col("_a").alias("left_value"), F.col("_b").alias("right_value"))
    return both.select(key, F.posexplode(zipped).alias("position", "_z")).select(key, "position", "_z.left_value", "_z.right_value")


def next_event(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds next_<column> of the following row within ``by``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def guarded_left(df: DataFrame, notes: DataFrame, key: list[str], guard: str, columns: list[str]) -> DataFrame:
    """Notes by key, kept only where the guard (a digest) is equal: adds the columns and note (current, stale, none).

    ``notes`` has one row per key; its guard column bears the name that ``df``'s has.
    """
    right = notes.select(*key, F.col(guard).alias("_guard"), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_there"))
    current = F.coalesce(F.col(guard) == F.col("_guard"), F.lit(False))
    note = F.when(F.col("_there").isNull(), "none").when(current, "current").otherwise("stale").alias("note")
    return df.join(right, key, "left").select(*df.columns, *(F.when(current, F.col(f"_{c}")).alias(c) for c in columns), note)


def of_selected(df: DataFrame, selected: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key was selected, each once however often the key stands there."""
    return df.join(selected.select(*key), key, "left_semi")
