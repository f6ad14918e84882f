"""Violations instead of exceptions: rules give rows, ``enforce`` raises.  Also duplicate policies, reasons, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators import scans


def violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """rule and key for each rule that a row breaks; a rule is the condition that must hold, null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def enforce(found: DataFrame, what: str) -> None:
    """Raises with the first few violations, if there are any."""
    some = found.limit(5).collect()
    if some:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in some))


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def finite(value: str) -> Column:
    """The column as a double that is a finite number, else null; texts that aren't numbers are null too."""
    return finite_text(F.col(value))


def finite_text(value: Column) -> Column:
    """:func:`finite` of any column."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def tri_state(value: Column, fail: list[str], known: list[str]) -> Column:
    """exclude for a failing value, keep for a passing one; any other value, null too, is an error where passing values are named."""
    bad = F.coalesce(value.isin(fail), F.lit(False))
    if not known:
        return F.when(bad, "exclude").otherwise("keep")
    unknown = F.raise_error(F.concat(F.lit("unknown quality value: "), F.coalesce(value, F.lit("null")))).cast("string")
    return F.when(bad, "exclude").when(F.coalesce(value.isin(known), F.lit(False)), "keep").otherwise(unknown)


def oriented(score: Column, direction: int) -> Column:
    """The score in the direction (1 or -1) in which larger means more effect."""
    if direction not in (1, -1):
        raise ValueError(f"not a direction: {direction}")
    return score * F.lit(direction)


def split_fields(df: DataFrame, key: list[str], private: list[str]) -> tuple[DataFrame, DataFrame]:
    """The public and the private part of a table, each under the key; the private part bears the public part's digest.

    No private column is in the public part, so nothing of it can leak from there.
    """
    shown = [c for c in df.columns if c not in private]
    digest = F.sha2(F.to_json(F.struct(*sorted(shown))), 256).alias("public_sha256")
    return df.select(*shown), df.select(*key, digest, *(c for c in private if c not in key))


def intersecting(left: Column, right: Column) -> Column:
    """Whether two arrays share an element; nulls match nothing, and a null array nothing at all."""
    return F.coalesce(F.arrays_overlap(F.array_compact(left), F.array_compact(right)), F.lit(False))


def reasons(cascade: list[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds, null if none does: an exclusion cascade."""
    out = None
    for name, condition in cascade:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out


def reason_counts(df: DataFrame, reason: str, kept: str = "kept") -> DataFrame:
    """reason and n_rows, with rows that have none under ``kept``; the counts add up to the rows."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit(kept)).alias("reason")).agg(F.count("*").alias("n_rows"))


def duplicated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand on several rows, with n_rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def exclude_all_duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Drops every row whose key is repeated; nulls are keys like any other.

    Counts first, so a key with a third of the rows is one partial count from each task; only its anti join moves rows.
    """
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return df.alias("a").join(duplicated_keys(df, key).alias("b"), condition, "left_anti")


def dependency_breaches(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Determinants with more than one dependent value: determinant, n_values."""
    return df.groupBy(determinant).agg(F.count_distinct(dependent).alias("n_values")).where("n_values > 1")


def reconcile(left: DataFrame, right: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Full outer comparison of one value by key: status is only_left, only_right, matched or differs, with the difference."""
    both = left.select(*key, F.col(value).alias("left_value"), F.lit(True).alias("_l")).join(right.select(*key, F.col(value).alias("right_value"), F.lit(True).alias("_r")), key, "full_outer")
    close = F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, F.col("left_value").isNull() & F.col("right_value").isNull())
    status = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(close, "matched").otherwise("differs")
    return both.withColumns({"difference": F.col("left_value") - F.col("right_value"), "status": status}).drop("_l", "_r")


def not_exactly_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys of the left side that have no row, or several, on the right: key, n_rows."""
    counts = right.groupBy(*key).agg(F.count("*").alias("n_rows"))
    return left.select(*key).distinct().join(counts, key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).where("n_rows <> 1")


def inventory_difference(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that are missing on the right, stale there, or carry another value: key, problem."""
    found = left.select(*key, F.col(value).alias("_a"), F.lit(1).alias("_l")).join(right.select(*key, F.col(value).alias("_b"), F.lit(1).alias("_r")), key, "full_outer")
    problem = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "stale").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return found.withColumn("problem", problem).where("problem is not null").select(*key, "problem")


def merge_chunks(chunks: list[DataFrame], key: str, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All chunks as one, and what is wrong with them: problem (duplicate, extra, missing) and key."""
    whole = chunks[0]
    for c in chunks[1:]:
        whole = whole.unionByName(c)
    have = whole.groupBy(key).agg(F.count("*").alias("_n"))
    sides = have.join(expected.select(key).distinct().withColumn("_e", F.lit(1)), key, "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_n") > 1, "duplicate")
    return whole, sides.select(F.col(key), problem.alias("problem")).where("problem is not null")


def chronology_bounds(df: DataFrame, bounds: DataFrame, by: list[str], at: str, first: str, last: str) -> DataFrame:
    """Attempts that don't lie after their original's time and up to their final one's: the attempt's columns and rule.

    bounds: one row for each key, with the original's time (``first``) and the final one's (``last``).  Rules: no_original,
    before_original, after_final; unknown times break before_original.
    """
    both = df.join(bounds.select(*by, F.col(first).alias("_first"), F.col(last).alias("_last"), F.lit(True).alias("_there")), by, "left")
    rule = F.when(F.col("_there").isNull(), "no_original").when(~F.coalesce(F.col(at) >= F.col("_first"), F.lit(False)), "before_original").when(F.col(at) > F.col("_last"), "after_final")
    return both.withColumn("rule", rule).where("rule is not null").drop("_first", "_last", "_there")


def chronology_breaches(df: DataFrame, by: list[str], at: str, order: str) -> DataFrame:
    """Rows whose time lies before that of the row in front, by ``order``: by, order, at, previous_at."""
    return scans.scanned(df, by, [order], lags={"previous_at": F.col(at)}).where(F.col("previous_at") > F.col(at)).select(*by, order, at, "previous_at")


def leaks(text: Column, forbidden: list[str], pattern: str | None = None) -> Column:
    """Whether visible text holds a forbidden part, as it is written, or a match of the pattern; null text leaks nothing."""
    found = F.lit(False)
    for part in forbidden:
        found = found | F.contains(text, F.lit(part))
    return F.coalesce(found | text.rlike(pattern) if pattern else found, F.lit(False))


def reported_breaches(df: DataFrame, reported: DataFrame, key: list[str], measures: dict[str, Column], tolerance: float = 0.0) -> DataFrame:
    """Keys and measures whose reported value isn't what the rows give: key, measure, reported, recomputed.

    Values are compared null-safely, numbers within the tolerance; a key on one side only breaches every measure it has.
    """
    own = df.groupBy(*key).agg(*(c.cast("double").alias(f"_{name}") for name, c in measures.items()))
    both = own.join(reported.select(*key, *(F.col(name).cast("double").alias(name) for name in measures)), key, "full_outer")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).alias("reported"), F.col(f"_{n}").alias("recomputed")) for n in measures)))
    same = F.col("reported").eqNullSafe(F.col("recomputed")) | F.coalesce(F.abs(F.col("reported") - F.col("recomputed")) <= tolerance, F.lit(False))
    return both.select(*key, pairs.alias("p")).select(*key, "p.*").where(~same)
