"""Runs, boards and their completeness gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators import selection


def macro_average(df: DataFrame, key: list[str], task: str, score: str, tasks: list[str]) -> DataFrame:
    """Unweighted mean over tasks per key: n_tasks and macro_score, null unless every task is there with a score.

    Each (key, task) must be one row.
    """
    known = df.where(F.col(task).isin(tasks))
    complete = (F.count_distinct(F.when(F.col(score).isNotNull(), F.col(task))) == len(tasks)) & F.bool_and(F.col(score).isNotNull())
    return known.groupBy(*key).agg(F.count_distinct(task).alias("n_tasks"), F.when(complete, F.avg(score)).alias("macro_score"))


def run_metrics(df: DataFrame, key: list[str], status: str, value: str, result_type: str, types: list[str]) -> DataFrame:
    """Coverage and scores per run: attempted, completed, api_errors, mean_score, valid_rate, complete, one count for each type.

    Means are over completed rows, invalid answers among them with their 0; errors only spoil completeness.
    """
    done = F.col(status) == "completed"
    valid = done & F.col(result_type).isin("correct", "incorrect")
    counts = [F.count_if(done & (F.col(result_type) == t)).alias(f"n_{t}") for t in types]
    out = df.groupBy(*key).agg(F.count("*").alias("attempted"), F.count_if(done).alias("completed"), F.avg(F.when(done, F.col(value))).alias("mean_score"), F.count_if(valid).alias("_valid"), *counts)
    return out.withColumns({"api_errors": F.col("attempted") - F.col("completed"), "valid_rate": F.try_divide("_valid", "completed"), "complete": F.col("attempted") == F.col("completed")}).drop("_valid")


def coverage(df: DataFrame, expected: DataFrame, key: list[str], item: str, status: str) -> DataFrame:
    """Runs against the items that were to be done: attempted, completed, api_errors, missing, unexpected, complete.

    expected: the items (one row each) of every run; a run is complete if each of them stands there once, completed, and
    nothing else does.
    """
    n = F.lit(expected.select(item).distinct().count())
    known = df.join(expected.select(item).distinct().withColumn("_known", F.lit(True)), item, "left")
    done = F.col(status) == "completed"
    out = known.groupBy(*key).agg(F.count("*").alias("attempted"), F.count_if(done).alias("completed"), F.count_distinct(F.when(F.col("_known"), F.col(item))).alias("_seen"), F.count_if(F.col("_known").isNull()).alias("unexpected"))
    full = (F.col("_seen") == n) & (F.col("attempted") == n) & (F.col("completed") == F.col("attempted"))
    return out.select(*key, "attempted", "completed", (F.col("attempted") - F.col("completed")).alias("api_errors"), (n - F.col("_seen")).alias("missing"), "unexpected", full.alias("complete"))


def leaderboard(df: DataFrame, score: str, names: list[str]) -> DataFrame:
    """Adds position: by score descending, nulls last, then names in binary order, numbered by ranges."""
    placed = selection.numbered(df, [F.desc_nulls_last(score), *(F.col(n) for n in names)], "position")
    return placed.withColumn("position", F.col("position").cast("int"))


def collapse(value: str, many: str = "multiple") -> Column:
    """A set's only value; null for none, ``many`` for several.  An aggregate that keeps two values at most."""
    return F.when(F.min(value) == F.max(value), F.min(value)).when(F.min(value).isNotNull(), F.lit(many))


def complete_divisors(df: DataFrame, key: list[str], part: str, required: list[str]) -> DataFrame:
    """Keys that have every required part: relational division."""
    return df.where(F.col(part).isin(required)).groupBy(*key).agg(F.count_distinct(part).alias("n_parts")).where(F.col("n_parts") == len(required)).select(*key)


def missing_expected(df: DataFrame, key: str, part: str, required: list[str]) -> DataFrame:
    """Expected (key, part) rows that are absent, for every key that has a row at all."""
    keys = df.select(key).distinct().withColumn(part, F.explode(F.array(*[F.lit(r) for r in required])))
    return keys.join(df.select(key, part).distinct(), [key, part], "left_anti")


def execution_summary(df: DataFrame, key: list[str], tokens: str, truncated: Column, limit: str) -> DataFrame:
    """Rates and limits across a key's rows; the maximum is null if any row's tokens are unknown."""
    return df.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.avg(truncated.cast("int")).alias("truncated_rate"),
        F.when(F.bool_and(F.col(tokens).isNotNull()), F.max(tokens)).alias("max_tokens"),
        F.array_join(F.array_sort(F.collect_set(F.col(limit).cast("string"))), ",").alias("limits"),
    )


def facet_filter(df: DataFrame, equals: dict[str, object], text: str, columns: list[str]) -> DataFrame:
    """Rows that have the chosen facets and hold the text, in any case, in one of the columns; None facets are open."""
    chosen = [F.col(c) == v for c, v in equals.items() if v is not None]
    if text:
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
        chosen.append(found)
    for c in chosen:
        df = df.where(c)
    return df


def span(df: DataFrame, key: list[str], at: str, kind: str, failed: Column) -> DataFrame:
    """Per key: started, finished, only_kind (null for none, ``multiple`` for several), any_failure."""
    return df.groupBy(*key).agg(F.min(at).alias("started"), F.max(at).alias("finished"), collapse(kind).alias("only_kind"), F.coalesce(F.bool_or(failed), F.lit(False)).alias("any_failure"))
