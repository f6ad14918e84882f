"""Choosing one row per key: best, latest, by ordinal, by preference; and saying why the others were not chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import scans
from panelyard.sources.folders import new_folder


def best_per_group(df: DataFrame, by: list[str], order: list[Column], rank: str | None = None) -> DataFrame:
    """The first row of each group in ``order`` (which must be total); with ``rank``, all rows and their places."""
    placed = df.withColumn(rank or "_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return placed if rank else placed.where("_place = 1").drop("_place")


def winners_with_reasons(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """Best row of each group, groups ranked in the same order, the first ``most`` selected: adds selected_rank and reason.

    reason: not_group_winner, below_selection_cutoff, or null for selected rows; selected_rank is null for losers of a group.
    Only winners, one row per group, are ranked over all groups, and that by ranges.
    """
    placed = best_per_group(df, by, order, rank="_place")
    first = numbered(placed.where("_place = 1"), order, "selected_rank")
    ranks = first.select(*by, F.col("selected_rank").cast("int").alias("_rank"))
    both = placed.join(ranks, by).withColumn("selected_rank", F.when(F.col("_place") == 1, F.col("_rank")))
    reason = F.when(F.col("_place") > 1, "not_group_winner").when(F.col("selected_rank") > most, "below_selection_cutoff")
    return both.withColumn("reason", reason).drop("_place", "_rank")


def latest_complete(df: DataFrame, key: list[str], complete: Column, at: str, identity: str) -> DataFrame:
    """The latest complete row of each key; equal times go to the greatest identity."""
    return best_per_group(df.where(complete), key, [F.desc_nulls_last(at), F.desc(identity)])


def ordinal_position(value: Column, domain: list[str]) -> Column:
    """Place of the value in the domain from 1; an unknown value is an error."""
    place = F.array_position(F.array(*[F.lit(d) for d in domain]), value)
    return F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("unknown ordinal: "), F.coalesce(value, F.lit("null")))).cast("long"))


def highest_ordinal(df: DataFrame, key: list[str], ordinal: str, domain: list[str], at: str, identity: str) -> DataFrame:
    """Adds disposition: selected for the highest ordinal's newest row, superseded_same_effort for its others, else lower_effort."""
    placed = df.withColumn("_o", ordinal_position(F.col(ordinal), domain))
    w = Window.partitionBy(*key).orderBy(F.desc("_o"), F.desc_nulls_last(at), F.desc(identity))
    top = F.first("_o").over(w)
    label = F.when(F.row_number().over(w) == 1, "selected").when(F.col("_o") == top, "superseded_same_effort").otherwise("lower_effort")
    return placed.withColumn("disposition", label).drop("_o")


def preferred_latest(df: DataFrame, key: list[str], kind: str, preference: list[str], at: str, strict: bool = False) -> DataFrame:
    """The newest row of the most preferred kind for each key: adds tied (rows that share its time; over 1 breaks the rule).

    Kinds outside ``preference`` rank last.  With ``strict`` a tie and an unknown kind are errors, raised when the rows are read.
    """
    listed = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(kind))
    other = F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce(F.col(kind), F.lit("null")))).cast("long") if strict else F.lit(len(preference) + 1)
    placed = df.withColumn("_p", F.when(listed > 0, listed).otherwise(other))
    best = Window.partitionBy(*key)
    near = placed.withColumn("_best", F.min("_p").over(best)).where("_p = _best")
    near = near.withColumn("_at", F.max(at).over(best)).where(F.col(at) == F.col("_at"))
    tied = near.withColumn("tied", F.count("*").over(best)).drop("_p", "_best", "_at")
    return tied.withColumn("tied", F.when(F.col("tied") == 1, F.col("tied")).otherwise(F.raise_error(F.lit("equal times")).cast("long"))) if strict else tied


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place in a total order, from 1: ranges of the order are numbered in their tasks, and shifted by the counts of
    the ranges before them (one row a range)."""
    folder = new_folder(df.sparkSession, "numbered")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    dealt = df.sparkSession.read.parquet(folder)  # ranges are cut by a sample, so they must be cut once
    inside = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return inside.join(F.broadcast(shift), "_range").withColumn(name, F.col("_k") + F.col("_shift")).drop("_range", "_k", "_shift")


def sequential_ids(df: DataFrame, by: list[str], order: list[Column], prefix: str, width: int, name: str) -> DataFrame:
    """Adds ids such as V01 in display order within each group."""
    return df.withColumn(name, F.concat(F.lit(prefix), F.lpad(F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("string"), width, "0")))


def not_increasing(df: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """Rows whose key is not above the one before, with it as previous."""
    return scans.scanned(df, by, order, lags={"previous": F.col(key)}).where(F.col("previous") >= F.col(key))


def slice_rows(df: DataFrame, order: list[Column], offset: int, most: int) -> DataFrame:
    """Rows after ``offset`` in a total order, ``most`` of them."""
    return df.orderBy(*order).offset(offset).limit(most)


def pending(work: DataFrame, done: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """Work that is not done yet, its first ``most`` rows: the limit counts new work only."""
    return work.join(done.select(*key), key, "left_anti").orderBy(*order).limit(most)


def prefix_mismatches(expected: DataFrame, written: DataFrame, order: list[Column], key: str, written_order: list[Column]) -> DataFrame:
    """Places where the i-th written record is not the i-th expected one: place, expected, written.

    Fewer written records are fine (work resumes after them), more are not.
    """
    placed = lambda df, by, name: numbered(df, by, "place").select("place", F.col(key).alias(name))
    both = placed(written, written_order, "written").join(placed(expected, order, "expected"), "place", "left")
    return both.where(~F.col("written").eqNullSafe(F.col("expected"))).select("place", "expected", "written")
