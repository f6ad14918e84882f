"""Coverage plans over strata, rescoring on subsets, compositions and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_axes(df: DataFrame, key: list[str], axes: list[str]) -> DataFrame:
    """key, axis, category: one row for each axis; a null category is Unknown."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a).cast("string"), F.lit("Unknown")).alias("category")) for a in axes])
    return df.select(*key, F.explode(pairs).alias("_p")).select(*key, "_p.axis", "_p.category")


def coverage_plan(df: DataFrame, task: str, panel: str, axes: list[str], least_variants: int, least_panels: int) -> DataFrame:
    """Per task, axis and category: n_variants, n_panels (with any), n_eligible (with at least ``least_variants``), status.

    Every category of an axis stands under every task, with zeros where it has none.  status: eligible from ``least_panels``
    eligible panels on, absent without any variant, else insufficient.
    """
    long = unpivot_axes(df, [task, panel], axes)
    per_panel = long.groupBy(task, panel, "axis", "category").agg(F.count("*").alias("_n"))
    have = per_panel.groupBy(task, "axis", "category").agg(F.sum("_n").alias("n_variants"), F.count("*").alias("n_panels"), F.count_if(F.col("_n") >= least_variants).alias("n_eligible"))
    domain = per_panel.select("axis", "category").distinct()
    tasks = per_panel.select(task).distinct().withColumn("axis", F.explode(F.array(*[F.lit(a) for a in axes])))
    grid = tasks.join(domain, "axis").select(task, "axis", "category")  # tasks by categories, as the plan has it
    out = grid.join(have, [task, "axis", "category"], "left").na.fill(0, ["n_variants", "n_panels", "n_eligible"])
    status = F.when(F.col("n_variants") == 0, "absent").when(F.col("n_eligible") >= least_panels, "eligible").otherwise("insufficient")
    return out.withColumn("status", status)


def eligible_panels(df: DataFrame, task: str, panel: str, category: str, least_variants: int) -> DataFrame:
    """task, category, panel with at least ``least_variants`` rows."""
    return df.groupBy(task, category, panel).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_variants).drop("_n")


def stratum_means(df: DataFrame, by: list[str], score: str, valid: str) -> DataFrame:
    """Per stratum: n_panels, n_invalid and mean_score, in which an answer that is not valid counts with 0; null without a panel.

    df: one row for each eligible panel; a null ``valid`` is not valid, a null score of a valid one spoils the mean.
    """
    ok = F.coalesce(F.col(valid), F.lit(False))
    value = F.when(ok, F.col(score)).otherwise(F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("n_panels"), F.count_if(~ok).alias("n_invalid"), F.when(F.bool_and(value.isNotNull()), F.avg(value)).alias("mean_score"))


def composition(df: DataFrame, by: str, category: str, domain: list[str]) -> DataFrame:
    """by, category, n and proportion for every category of the domain; values outside it count as Unknown if that is in it."""
    known = F.when(F.col(category).isin(domain), F.col(category)).otherwise("Unknown")
    have = df.groupBy(by, known.alias("category")).agg(F.count("*").alias("n"))
    grid = df.select(by).distinct().withColumn("category", F.explode(F.array(*[F.lit(d) for d in domain])))
    total = have.groupBy(by).agg(F.sum("n").alias("_total"))
    out = grid.join(have, [by, "category"], "left").join(total, by)
    return out.select(by, "category", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("_total")).alias("proportion"))


def cohort_difference(df: DataFrame, by: list[str], relation: str, score: Column) -> DataFrame:
    """Means of the Before and After cohorts, their difference, and how many rows are Mixed or Unknown."""
    one = lambda r: F.col(relation) == r
    g = df.groupBy(*by).agg(*(F.count_if(one(r)).alias(f"n_{r.lower()}") for r in ("Before", "After", "Mixed", "Unknown")), F.avg(F.when(one("Before"), score)).alias("mean_before"), F.avg(F.when(one("After"), score)).alias("mean_after"))
    return g.withColumn("difference", F.col("mean_before") - F.col("mean_after"))


def planned_counts(df: DataFrame, by: list[str], plans: dict[str, Column]) -> DataFrame:
    """Rows per group and how many of them each condition plans, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in plans.items()))
