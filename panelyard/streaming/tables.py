"""Tables that streams bring up to date, work that resumes, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.streaming.log import KeyedTable


def latest_state(log: DataFrame, key: list[str], at: str) -> DataFrame:
    """Each key's last row of an append-only state log; equal times go to the row with the greater version."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc("version"))
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def illegal_transitions(log: DataFrame, key: list[str], order: list[str], state: str, allowed: dict[str | None, list[str]]) -> DataFrame:
    """Rows of a state log whose state may not follow the one before (adds previous; null before a key's first row).

    allowed: for a state, or None for the first row, the states that may come next; a state that is not listed is final.
    """
    previous = F.lag(state).over(Window.partitionBy(*key).orderBy(*order))
    marked = log.withColumn("previous", previous)
    fits = F.lit(False)
    for before, after in allowed.items():
        fits = fits | (F.col("previous").eqNullSafe(F.lit(before)) & F.coalesce(F.col(state).isin(after), F.lit(False)))
    return marked.where(~fits)


def resumable(run: Callable[[DataFrame], DataFrame], requests: DataFrame, cache: DataFrame, digest: str) -> DataFrame:
    """Answers of all requests: cached ones as they are, ``run`` is given each other distinct request once.

    A request that failed is simply not in the cache, so the next call tries it again and its finished siblings stay.
    """
    fresh = requests.dropDuplicates([digest]).join(cache.select(digest), digest, "left_anti")
    return cache.join(requests.select(digest).distinct(), digest, "left_semi").unionByName(run(fresh))


def append_new(batch: DataFrame, epoch: int, path: str, key: list[str], writer: str = "stream") -> None:
    """A foreachBatch sink that appends rows whose key is not there yet; a batch that is replayed adds nothing.

    :class:`log.KeyedTable` keeps the files that count; only those that can hold the batch's keys are read.
    """
    KeyedTable(batch.sparkSession, path, key).append(batch, epoch, writer)


def windowed_counts(events: DataFrame, at: str, by: list[str], size: str, late: str) -> DataFrame:
    """Counts and sums by event-time window, late rows up to ``late``: an addition for the events table."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def frozen_plan_changes(saved: DataFrame, computed: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose saved and recomputed plan rows differ, by the digest of all their columns."""
    digest = lambda df, name: df.select(*key, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias(name))
    return digest(saved, "saved_sha256").join(digest(computed, "computed_sha256"), key, "full_outer").where(~F.col("saved_sha256").eqNullSafe(F.col("computed_sha256")))
