"""Dates of day and month precision, kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_date(text: Column) -> Column:
    """Whether a text is a day YYYY-MM-DD that exists."""
    return F.coalesce(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def valid_month(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A\d{4}-(0[1-9]|1[0-2])\z"), F.lit(False))


def date_relation(date: Column, cutoff: Column) -> Column:
    """Before (on or before the cutoff), After, or Unknown: for invalid texts, and within the month of a cutoff that names no day."""
    month = F.substring(date, 1, 7)
    day = F.when(date <= cutoff, "Before").otherwise("After")
    of_month = F.when(month < cutoff, "Before").when(month > cutoff, "After").otherwise("Unknown")
    return F.when(~valid_date(date), "Unknown").when(valid_date(cutoff), day).when(valid_month(cutoff), of_month).otherwise("Unknown")


def cutoff_relation(date: Column, cutoff: Column, earlier: Column) -> Column:
    """With a date of partial earlier evidence (null: none): Before stays, After with earlier Before is Mixed, an unknown earlier
    relation makes it Unknown, else nothing changes."""
    main, first = date_relation(date, cutoff), date_relation(earlier, cutoff)
    return F.when(earlier.isNull() | (main != "After"), main).when(first == "Before", "Mixed").when(first == "Unknown", "Unknown").otherwise(main)


def epoch_or(seconds: Column, fallback: Column) -> Column:
    """A time from seconds since 1970, or from the fallback's where they are unknown."""
    return F.timestamp_seconds(F.coalesce(seconds, fallback))


def iso_utc(ts: Column) -> Column:
    """UTC ISO text with Z (the session's time zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
