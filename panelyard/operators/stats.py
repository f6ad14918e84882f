"""Ranks, correlations, quantiles, intervals and exact tests within panels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.operators import checks, exact, scans
from panelyard.sources.folders import as_table


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 within ``by``; equal values share the mean of their ranks.  Nulls rank first, as one value.

    One window a group; :func:`scans.average_ranks` is for groups of any size.
    """
    order = Window.partitionBy(*by).orderBy(value)  # equal values are one range, so one sort serves both
    return F.rank().over(order) + (F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def pearson(x: np.ndarray, y: np.ndarray) -> float:
    """Pearson's r with exact sums: 0 where either side is constant or zero, within [-1, 1].  Values are scaled by their largest
    magnitude first, so products stay finite."""

    def centred(v: np.ndarray) -> np.ndarray:
        most = np.abs(v).max()
        v = v / most if most else v
        return v - math.fsum(v) / len(v)

    a, b = centred(x), centred(y)
    across = math.fsum(a * a), math.fsum(b * b)
    return max(-1.0, min(1.0, math.fsum(a * b) / math.sqrt(across[0] * across[1]))) if all(across) else 0.0


def mean_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal values share the mean of theirs."""
    _, place, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[place]


#: Rows of small panels that are scored together, about.
BATCH_ROWS = 20_000


def panel_correlations(df: DataFrame, by: list[str], prediction: str, reference: str, group_rows: int = scans.GROUP_ROWS) -> DataFrame:
    """Per panel: n, spearman_rho (Pearson over average ranks), pearson_r, with sums that are rounded once.

    Rows without a finite number on either side are left out.  Panels are counted first: up to ``group_rows`` rows a panel is one
    group in a task, larger ones go by :func:`spread_correlations`, which gives the same numbers.
    """
    rows = df.select(*by, checks.finite_text(F.col(prediction)).alias("p"), checks.finite_text(F.col(reference)).alias("r")).dropna(subset=["p", "r"])
    largest, total = rows.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) > group_rows:
        return spread_correlations(rows, by)
    fields = [rows.schema[c] for c in by]

    def run(held: pa.Table) -> pa.Table:
        number = held.select(by).to_pandas().groupby(by, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(number, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(number[order], prepend=-1)), len(order))
        p, r = (held[c].to_numpy()[order] for c in ("p", "r"))
        panels = [(p[a:z], r[a:z]) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        keys = held.select(by).take(pa.array(order[edges[:-1]]))
        own = {"n": pa.array(np.diff(edges)), "spearman_rho": pa.array([pearson(mean_ranks(x), mean_ranks(y)) for x, y in panels], pa.float64()), "pearson_r": pa.array([pearson(x, y) for x, y in panels], pa.float64())}
        return pa.table(dict(zip(by, keys.columns, strict=True)) | own)

    dealt = F.pmod(F.xxhash64(*by), F.lit(max(1, -(-(total or 0) // BATCH_ROWS))))  # several panels go together
    more = [T.StructField("n", T.LongType()), T.StructField("spearman_rho", T.DoubleType()), T.StructField("pearson_r", T.DoubleType())]
    return rows.groupBy(dealt).applyInArrow(run, T.StructType(fields + more))


def spread_correlations(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, spearman_rho and pearson_r of p and r for each ``by``, with no panel in one task: ranks by ranges, exact sums map side
    first, and a panel's means and scales joined back."""
    ranked = as_table(scans.average_ranks(scans.average_ranks(rows, by, "p", "rank_p"), by, "r", "rank_r"), "ranked")
    columns = ["p", "r", "rank_p", "rank_r"]
    most = ranked.groupBy(*by).agg(F.count("*").alias("n"), *(F.max(F.abs(c)).cast("double").alias(f"_{c}") for c in columns))
    scaled = exact.joined(ranked, by, most).select(*by, "n", *(F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}")).otherwise(F.lit(0.0)).alias(c) for c in columns))
    means = exact.exact_sums(scaled, by, {f"_{c}": F.col(c) for c in columns})
    centred = exact.joined(scaled, by, means).select(*by, "n", *((F.col(c) - F.col(f"_{c}") / F.col("n")).alias(c) for c in columns))
    product = lambda a, b: F.col(a) * F.col(b)
    sums = exact.exact_sums(centred, by, {f"{a}_{b}": product(a, b) for x, y in (("p", "r"), ("rank_p", "rank_r")) for a, b in ((x, x), (y, y), (x, y))})

    def r(x: str, y: str) -> Column:
        across = F.col(f"{x}_{x}") * F.col(f"{y}_{y}")
        constant = (F.col(f"{x}_{x}") == 0) | (F.col(f"{y}_{y}") == 0)
        return F.when(constant, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col(f"{x}_{y}"), F.sqrt(across)))))

    counted = exact.joined(most.select(*by, "n"), by, sums)
    return counted.select(*by, "n", r("rank_p", "rank_r").alias("spearman_rho"), r("p", "r").alias("pearson_r"))


def type7(value: str, *points: float) -> Column:
    """Exact quantiles by linear interpolation at (n - 1) p, as an array."""
    return F.percentile(F.col(value), F.array(*[F.lit(p) for p in points]))


def trend_line(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least squares of y on x: n, slope, intercept; null where x is constant."""
    steady = F.min(x) == F.max(x)
    return df.dropna(subset=[x, y]).groupBy(*by).agg(F.count("*").alias("n"), F.when(~steady, F.regr_slope(y, x)).alias("slope"), F.when(~steady, F.regr_intercept(y, x)).alias("intercept"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_cdf(t: float, df: float) -> float:
    """Distribution function of Student's t."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    tail = front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b
    return 1 - tail / 2 if t > 0 else tail / 2


@lru_cache(maxsize=100_000)
def t_quantile(p: float, df: int) -> float:
    """The t with t_cdf(t, df) = p, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
        if hi - lo <= 1e-15 * hi:
            break
    return (lo + hi) / 2


def t_interval(df: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean with its two-sided Student t interval, not clipped: n, mean, ci_low, ci_high, status.

    Nulls are left out.  status: insufficient (n < 2), constant_scores (no spread), estimated; only the last has bounds.
    """

    @F.pandas_udf("double")
    def quantile(freedom: pd.Series) -> pd.Series:
        return freedom.map(lambda d: t_quantile(0.5 + level / 2, int(d))).astype(float)

    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.min(value) == F.max(value)).alias("steady"))
    status = F.when(F.col("n") < 2, "insufficient").when(F.col("steady"), "constant_scores").otherwise("estimated")
    sizes = g.select("n").where("n > 1").distinct().withColumn("critical", quantile(F.col("n") - 1))  # once for each size
    half = F.when(status == "estimated", F.col("critical") * F.col("sd") / F.sqrt("n"))
    return g.join(sizes, "n", "left").select(*by, "n", "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"), status.alias("status"))


MOST_ALLOCATIONS = 200_000


def permutation_test(df: DataFrame, by: list[str], label: str, value: str, first: str, second: str) -> DataFrame:
    """Exact one-sided test of mean(first) - mean(second) > 0 over all allocations of the labels: difference, n_allocations, p_value.

    Skipped (null p_value) where a side has fewer than two rows or there are over 200,000 allocations; the count of allocations
    is known from the group's sizes, so no larger group is gathered in a task.
    """
    rows = df.where(F.col(label).isin(first, second)).dropna(subset=[value])
    sizes = rows.groupBy(*by).agg(F.count_if(F.col(label) == first).alias("n_first"), F.count_if(F.col(label) == second).alias("n_second"), F.avg(F.when(F.col(label) == first, F.col(value))).alias("mean_first"), F.avg(F.when(F.col(label) == second, F.col(value))).alias("mean_second"))
    n = F.col("n_first") + F.col("n_second")
    ways = F.aggregate(F.sequence(F.lit(1), F.least("n_first", "n_second", F.lit(64)).cast("int")), F.lit(1.0), lambda acc, k: F.least(F.lit(1e15), acc * (n - F.least("n_first", "n_second") + k) / k))
    sizes = sizes.withColumn("n_allocations", F.when((F.col("n_first") >= 2) & (F.col("n_second") >= 2), F.round(ways)).otherwise(F.lit(0.0)).cast("long"))
    feasible = sizes.where((F.col("n_allocations") > 0) & (F.col("n_allocations") <= MOST_ALLOCATIONS)).select(*by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in by)

    def exact(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values, k = pdf[value].astype(float).tolist(), int((pdf[label] == first).sum())
        total, m = math.fsum(values), len(values) - k
        observed = math.fsum(pdf.loc[pdf[label] == first, value]) / k - math.fsum(pdf.loc[pdf[label] == second, value]) / m
        sums = [sum(c) for c in combinations(values, k)]
        reach = sum(s / k - (total - s) / m >= observed - 1e-12 * max(1.0, abs(observed)) for s in sums)
        return pd.DataFrame([(*key, reach / len(sums))], columns=[*by, "p_value"])

    tested = rows.join(feasible, by, "left_semi").select(*by, label, value).groupBy(*by).applyInPandas(exact, f"{kinds}, p_value double")
    return sizes.join(tested, by, "left").select(*by, "n_first", "n_second", (F.col("mean_first") - F.col("mean_second")).alias("difference"), "n_allocations", "p_value")


def group_means(df: DataFrame, by: list[str], measured: str, baseline: str) -> DataFrame:
    """Means of measured and baseline values over the rows that have both: n, measured_mean, baseline_mean, shift."""
    both = F.col(measured).isNotNull() & F.col(baseline).isNotNull()
    out = df.groupBy(*by).agg(F.count_if(both).alias("n"), F.avg(F.when(both, F.col(measured))).alias("measured_mean"), F.avg(F.when(both, F.col(baseline))).alias("baseline_mean"))
    return out.withColumn("shift", F.col("measured_mean") - F.col("baseline_mean"))


def track_mean(tracks: Column, keep: Callable[[Column], Column]) -> Column:
    """Mean of an array's values that ``keep`` chooses; null without one."""
    held = F.filter(tracks, keep)
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(held))


def delta_mean(alt: Column, ref: Column) -> Column:
    """Mean of alternate minus reference over two aligned arrays; null if they are empty or differ in length."""
    deltas = F.zip_with(alt, ref, lambda a, r: (a - r).cast("double"))
    return F.when((F.size(alt) == F.size(ref)) & (F.size(alt) > 0), F.aggregate(deltas, F.lit(0.0), lambda a, x: a + x) / F.size(alt))
