"""Running values within groups of any size: ranges are scanned in their tasks, and what a group has before a range is carried in.

Rows are cut by ranges of (group, order), so a group of a third of all rows lies in many ranges.  A range holds at most one group
that began before it, so what is carried is one row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.sources.folders import as_table

#: Groups of up to this many rows may be one buffer or one window.
GROUP_ROWS = 1_000_000


def same(left: str, right: str, columns: list[str]) -> Column:
    """Whether aliased sides agree on the columns, null with null."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns), F.lit(True))


def scanned(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """Adds running values within ``by`` along ``order`` (ascending, nulls first; a total order, or ties come in any order).

    sums: the sum up to this row; lags: the value of the row before; before: the greatest value of the rows before.  Null where
    there is nothing yet.  Sums of doubles depend on where ranges are cut in their last bits; exact ones do not.
    """
    sums, lags, before = sums or {}, lags or {}, before or {}
    inputs = {f"_in_{k}": c for k, c in (sums | lags | before).items()}
    cut = [F.asc_nulls_first(c) for c in (*by, *order)]
    dealt = as_table(df.withColumns(inputs).repartitionByRange(*cut).withColumn("_part", F.spark_partition_id()), "scanned")
    run = Window.partitionBy("_part", *by).orderBy(*[F.asc_nulls_first(c) for c in order])
    upto, ahead = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({"_k": F.row_number().over(run)} | {f"_own_{k}": F.sum(f"_in_{k}").over(upto) for k in sums} | {f"_own_{k}": F.lag(f"_in_{k}").over(run) for k in lags} | {f"_own_{k}": F.max(f"_in_{k}").over(ahead) for k in before})

    place = F.struct(*order) if order else F.lit(0)
    ends = [F.sum(f"_in_{k}").alias(f"_end_{k}") for k in sums] + [F.max_by(f"_in_{k}", place).alias(f"_end_{k}") for k in lags] + [F.max(f"_in_{k}").alias(f"_end_{k}") for k in before]
    parts = dealt.groupBy("_part", *by).agg(F.count("*").alias("_n"), *ends)
    earlier = Window.partitionBy(*by).orderBy("_part")  # a row for each range that a group lies in
    past = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_end_{k}").over(past).alias(f"_carry_{k}") for k in sums] + [F.lag(f"_end_{k}").over(earlier).alias(f"_carry_{k}") for k in lags] + [F.max(f"_end_{k}").over(past).alias(f"_carry_{k}") for k in before]
    carry = parts.select("_part", *by, F.lag("_n").over(earlier).alias("_n"), *carried).where("_n is not null").drop("_n")

    joined = local.alias("l").join(F.broadcast(carry.alias("r")), (F.col("l._part") == F.col("r._part")) & same("l", "r", by), "left")
    own, past_ = (lambda k: F.col(f"l._own_{k}")), (lambda k: F.col(f"r._carry_{k}"))
    out = [F.coalesce(own(k) + past_(k), own(k), past_(k)).alias(k) for k in sums] + [F.when(F.col("l._k") > 1, own(k)).otherwise(past_(k)).alias(k) for k in lags] + [F.greatest(own(k), past_(k)).alias(k) for k in before]
    replaced = sums | lags | before
    return joined.select(*(F.col(f"l.`{c}`") for c in df.columns if c not in replaced), *out)


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the rank from 1 within ``by``, equal values sharing the mean of theirs; nulls rank first, as one value.

    Values are counted before they are ranked, so a value that many rows share is one row of the scan.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = scanned(counts, by, [value], sums={"_upto": F.col("_n")})
    ranks = upto.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    rest = [c for c in df.columns if c != name]
    return df.alias("l").join(ranks.alias("r"), same("l", "r", [*by, value])).select(*(F.col(f"l.`{c}`") for c in rest), F.col(f"r.{name}"))


def quantiles(df: DataFrame, by: list[str], value: str, points: list[float], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per group: n and q, exact quantiles by linear interpolation at (n - 1) p.  Nulls are left out; a group of nulls has n 0, q null.

    Groups are counted first.  If each has ``group_rows`` rows at most, a buffer holds a group's values; else order statistics
    are picked from running counts of the values, cut by ranges, and no group is in one task.
    """
    sizes = as_table(df.groupBy(*by).agg(F.count(value).alias("n")), "sizes")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= group_rows:
        return df.groupBy(*by).agg(F.count(value).alias("n"), F.percentile(F.col(value), F.array(*[F.lit(p) for p in points])).alias("q"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = scanned(counts, by, [value], sums={"_upto": F.col("_n")})
    at = F.transform(F.array(*[F.lit(float(p)) for p in points]), lambda p, k: F.struct(k.alias("k"), ((F.col("n") - 1) * p).alias("h")))
    wanted = sizes.where("n > 0").select(*by, F.explode(at).alias("t")).select(*by, F.col("t.k").alias("_k"), F.col("t.h").alias("_h"), F.floor("t.h").alias("_lo"), F.ceil("t.h").alias("_hi"))
    holds = lambda c: (F.col(f"l.{c}") >= F.col("r._upto") - F.col("r._n")) & (F.col(f"l.{c}") < F.col("r._upto"))  # noqa: E731  ranks from 0
    met = wanted.alias("l").join(upto.alias("r"), same("l", "r", by) & (holds("_lo") | holds("_hi")))
    v = F.col(f"r.`{value}`").cast("double")
    picked = met.groupBy(*(F.col(f"l.`{c}`").alias(c) for c in by), F.col("l._k").alias("_k"), F.col("l._h").alias("_h"), F.col("l._lo").alias("_lo"), F.col("l._hi").alias("_hi")).agg(F.max(F.when(holds("_lo"), v)).alias("_a"), F.max(F.when(holds("_hi"), v)).alias("_b"))
    between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.col("_hi") - F.col("_h")) * F.col("_a") + (F.col("_h") - F.col("_lo")) * F.col("_b"))
    q = picked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_k").alias("k"), between.alias("q")))), lambda x: x["q"]).alias("q"))  # an entry for each point
    return sizes.alias("l").join(q.alias("r"), same("l", "r", by), "left").select(*(F.col(f"l.`{c}`") for c in by), "l.n", "r.q")
