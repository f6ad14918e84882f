"""Final answers, result types and payloads."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File names without folders.
PLAIN_FILE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
#: Fixed value: a whole line with a final id; only line feeds end lines.
FINAL_CHOICE = r"(?md)^FINAL:[ \t]*([A-Za-z0-9_.-]+)[ \t]*\r?$"


def last_choice(text: Column) -> Column:
    """The id on the last line of the form FINAL: id; null without one.  An unknown id is for the caller to reject."""
    found = F.regexp_extract_all(text, F.lit(FINAL_CHOICE), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


class _Rejected(ValueError):
    """What makes an answer invalid for good."""


def _pairs(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Rejected("duplicate id")
    return out


def _constant(name: str) -> float:
    raise _Rejected(f"not finite: {name}")


def parse_scores(text: str | None) -> tuple[dict[str, float] | None, str | None]:
    """Scores on the last line FINAL: {object}, or what is wrong.

    Lines are looked at from the last; one that is not JSON, or not an object, is passed over; duplicate ids or a constant
    that is not finite end the search.  Values must be numbers (not booleans) that are finite as doubles.
    """
    for line in reversed((text or "").splitlines()):
        body = line[6:].strip(" \t") if line.startswith("FINAL:") else ""
        if not (body.startswith("{") and body.endswith("}")):
            continue
        try:
            found = json.loads(body, object_pairs_hook=_pairs, parse_constant=_constant)
        except _Rejected as e:
            return None, str(e)
        except (ValueError, RecursionError):
            continue
        out = {}
        for name, value in found.items():
            try:
                number = float(value) if isinstance(value, int | float) and not isinstance(value, bool) else math.nan
            except OverflowError:
                number = math.nan
            if not math.isfinite(number):
                return None, f"not a finite number: {name}"
            out[name] = number
        return out, None
    return None, "no final line"


@F.pandas_udf(T.StructType([T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())), T.StructField("error", T.StringType())]))
def last_scores(text: pd.Series) -> pd.DataFrame:
    """:func:`parse_scores` over a column."""
    return pd.DataFrame([parse_scores(t) for t in text], columns=["scores", "error"])


def answer_error(scores: Column, error: Column, expected: Column) -> Column:
    """The parser's error, or missing or extra ids; null for a valid answer.  expected: array of candidate ids."""
    ids = F.map_keys(scores)
    missing, extra = F.array_sort(F.array_except(expected, ids)), F.array_sort(F.array_except(ids, expected))
    return F.when(error.isNotNull(), error).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ","))).when(F.size(extra) > 0, F.concat(F.lit("extra: "), F.array_join(extra, ",")))


def result_type(refused: Column, parsed: Column, correct: Column, finish: Column) -> Column:
    """refusal, then correct or incorrect for a parsed answer, then token_limit, else format_error."""
    no = F.lit(False)
    return F.when(F.coalesce(refused | (finish == "content_filter"), no), "refusal").when(F.coalesce(parsed, no), F.when(F.coalesce(correct, no), "correct").otherwise("incorrect")).when(F.coalesce(finish == "length", no), "token_limit").otherwise("format_error")


def occurs_once(text: Column, part: str) -> Column:
    """Whether ``part`` stands exactly once (occurrences counted without overlap)."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) == len(part)


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


#: The shapes of names.
NAMES = {"slug": r"[a-z0-9]+(-[a-z0-9]+)*", "id": r"[A-Za-z0-9][A-Za-z0-9._-]*", "version": r"v[0-9]+(\.[0-9]+)*", "bucket": r"[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]"}


def valid_name(text: Column, kind: str) -> Column:
    """Whether the whole text has the shape of NAMES; null has none."""
    return F.coalesce(text.rlike(rf"\A(?:{NAMES[kind]})\z"), F.lit(False))


def safe_path(text: Column) -> Column:
    """Whether a path stays below its root: relative, without empty, ``.`` or ``..`` parts or backslashes."""
    return F.coalesce((text != "") & ~text.rlike(r"\A/|//|/\z|(\A|/)\.{1,2}(/|\z)|[\\]"), F.lit(False))


def wrapped(text: Column, width: int = 80) -> Column:
    """Lines of a fixed width, without a line feed at the end."""
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")


def first_text(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])
