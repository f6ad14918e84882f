"""Canonical JSON and identities made from it."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value: object) -> str:
    """Sorted keys, compact separators, UTF-8 as it is; NaN and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    """A JSON text in canonical form; null stays null, texts that aren't JSON raise."""
    return text.map(lambda t: None if t is None else canonical_json(json.loads(t)))


@F.pandas_udf(T.StringType())
def record_digest(text: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text's canonical form."""
    return text.map(lambda t: None if t is None else hashlib.sha256(canonical_json(json.loads(t)).encode()).hexdigest())


def configuration_key(**fields: Column) -> Column:
    """SHA-256 of the named fields as a JSON object with sorted keys; a null field stays as null, so it differs from an empty one
    and from a text that looks like one."""
    named = F.struct(*(c.cast("string").alias(n) for n, c in sorted(fields.items())))
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)
