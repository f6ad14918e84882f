"""Robust spreads, score bins, capped even allocation and reproducible stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.scans import quantiles

BINS, PANEL = 5, 50


def robust_spread(df: DataFrame, by: list[str], value: str, least: int = PANEL) -> DataFrame:
    """Per group: n, p01, p05, p95, p99, spread (p95 - p05), status (insufficient, collapsed, eligible).  Nulls are left out."""
    g = quantiles(df, by, value, [0.01, 0.05, 0.95, 0.99])
    q = [F.col("q")[k] for k in range(4)]
    status = F.when(F.col("n") < least, "insufficient").when(q[0] >= q[3], "collapsed").otherwise("eligible")
    return g.select(*by, "n", *(c.alias(a) for c, a in zip(q, ("p01", "p05", "p95", "p99"), strict=True)), (q[2] - q[1]).alias("spread"), status.alias("status"))


def score_bins(df: DataFrame, by: list[str], value: str, bins: int = BINS) -> DataFrame:
    """Adds ``bin``: the number of cutpoints at or below the value.  Cutpoints lie evenly between the group's P01 and P99, so a
    value on a cutpoint goes right and tails stay in the outer bins.  Groups whose anchors collapse get null bins."""
    anchors = quantiles(df, by, value, [0.01, 0.99]).select(*by, F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    cuts = [(1 - k / bins) * F.col("_lo") + (k / bins) * F.col("_hi") for k in range(1, bins)]
    place = sum(((F.col(value) >= c).cast("int") for c in cuts), F.lit(0))
    return df.join(anchors, by).withColumn("bin", F.when(F.col("_lo") < F.col("_hi"), place)).drop("_lo", "_hi")


def sampling_digest(seed: str, question: Column, bin_: Column, key: Column) -> Column:
    """SHA-256 of the compact JSON array [seed, question, bin, key]; quotes, backslashes and control characters are escaped as JSON
    has it, other characters stand as they are."""
    quoted = lambda c: F.substring(F.to_json(F.array(c.cast("string"))), F.lit(2), F.char_length(F.to_json(F.array(c.cast("string")))) - 2)
    return F.sha2(F.concat(F.lit("["), quoted(F.lit(seed)), F.lit(","), quoted(question), F.lit(","), bin_.cast("string"), F.lit(","), quoted(key), F.lit("]")), 256)


def stratified_sample(df: DataFrame, by: list[str], key: str, value: str, seed: str, size: int = PANEL, bins: int = BINS) -> DataFrame:
    """``size`` rows of each group: bins share them round-robin as far as they have rows, rows within a bin come in digest order.

    Adds bin and slot (bin-major, from 1).  Groups with fewer rows than ``size`` or collapsed anchors give none.  Keys must be
    unique within a group; ties of digests go by key.
    """
    digest = sampling_digest(seed, F.concat_ws("/", *by), F.col("bin"), F.col(key))
    binned = score_bins(df, by, value, bins).where("bin is not null").withColumn("_digest", digest)
    inside = binned.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "bin").orderBy("_digest", key)))
    near = inside.where(F.col("_r") <= size)  # no bin gets more than the panel's size
    chosen = near.withColumns({"_slot": F.row_number().over(Window.partitionBy(*by).orderBy("_r", "bin")), "_have": F.count("*").over(Window.partitionBy(*by))})
    chosen = chosen.where((F.col("_slot") <= size) & (F.col("_have") >= size))
    return chosen.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy("bin", "_digest", key))).drop("_digest", "_r", "_slot", "_have")


def bin_allocation(df: DataFrame, by: list[str], value: str, size: int = PANEL, bins: int = BINS) -> DataFrame:
    """Per group and bin: n_rows and n_allocated, all bins from 0 on, empty ones with 0."""
    counts = score_bins(df, by, value, bins).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n_rows"))
    grid = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts, [*by, "bin"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    turns = full.select(*by, "bin", "n_rows", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_rows", F.lit(size))).cast("int"))).alias("r")).where("r <= n_rows")
    taken = turns.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy("r", "bin"))).where(F.col("slot") <= size).groupBy(*by, "bin").agg(F.count("*").alias("n_allocated"))
    return full.join(taken, [*by, "bin"], "left").withColumn("n_allocated", F.coalesce("n_allocated", F.lit(0)))


def allocation_violations(df: DataFrame, by: list[str], size: int = PANEL) -> DataFrame:
    """Rules that an allocation (n_rows, n_allocated by group and bin) breaks: by, rule, detail."""
    more = Window.partitionBy(*by)
    marked = df.withColumns({"_sum": F.sum("n_allocated").over(more), "_rows": F.sum("n_rows").over(more), "_most": F.max("n_allocated").over(more)})
    rules = [
        ("allocation_exceeds_rows", F.col("n_allocated") > F.col("n_rows")),
        ("total_differs", F.col("_sum") != F.least(F.col("_rows"), F.lit(size))),
        ("uneven", (F.col("n_allocated") < F.col("n_rows")) & (F.col("n_allocated") < F.col("_most") - 1)),
    ]
    return marked.select(*by, F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.concat(F.lit("bin "), F.col("bin").cast("string")).alias("detail"))) for r, c in rules]))).alias("v")).select(*by, "v.rule", "v.detail")
