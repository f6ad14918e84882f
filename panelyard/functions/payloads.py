"""Payloads of service responses (JSON text), and values for display."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelyard.functions.digests import canonical_json


def _text(payload: Column, path: str) -> Column:
    """The value at a path as text; null where absent, blank, or the payload isn't JSON."""
    found = F.get_json_object(payload, path)
    return F.when(F.trim(found) != "", found)


def unwrap(payload: Column) -> Column:
    """The body of a batch item ($.response.body), else the payload itself."""
    return F.coalesce(_text(payload, "$.response.body"), payload)


def provider(payload: Column, metadata: str = "$.gateway_metadata") -> Column:
    """Who served the response: named by it, by its metadata, by the first selected endpoint, or by the first attempt."""
    return F.coalesce(_text(payload, "$.provider"), _text(payload, f"{metadata}.provider"), _text(payload, f"{metadata}.endpoints[0].provider"), _text(payload, f"{metadata}.attempts[0].provider"))


def reasoning(message: Column) -> Column:
    """Reasoning text: under either key, else the texts of its typed details joined by line feeds."""
    details = F.from_json(F.get_json_object(message, "$.reasoning_details"), "array<struct<type:string,text:string,summary:string>>")
    texts = F.filter(F.transform(details, lambda d: F.coalesce(d["text"], d["summary"])), lambda t: t.isNotNull())
    joined = F.array_join(texts, "\n")
    return F.coalesce(_text(message, "$.reasoning"), _text(message, "$.reasoning_content"), F.when(joined != "", joined))


def response_error(payload: Column) -> Column:
    """What is wrong with a response: its error's message or text, no_choices, no_finish_reason; null if nothing is."""
    body = unwrap(payload)
    told = F.coalesce(_text(body, "$.error.message"), _text(body, "$.error"))
    return F.when(told.isNotNull(), told).when(_text(body, "$.choices[0]").isNull(), "no_choices").when(_text(body, "$.choices[0].finish_reason").isNull(), "no_finish_reason")


def script_payloads(html: Column) -> Column:
    """The bodies of a page's JSON scripts (type application/json or ld+json), in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/(?:ld\+)?json[\"'][^>]*>(.*?)</script>"), F.lit(1))


def _nested(value: object, keys: frozenset[str]) -> Iterator[dict]:
    stack = [value]
    while stack:  # depth first, in the order of the text
        found = stack.pop()
        if isinstance(found, dict):
            if keys <= found.keys():
                yield found
            stack += list(found.values())[::-1]
        elif isinstance(found, list):
            stack += found[::-1]


def nested_objects(texts: Column, keys: list[str]) -> Column:
    """All objects, however deep, that have these keys, in an array of JSON texts: an array of canonical JSON texts in their order.

    A text that isn't JSON holds none; null gives an empty array.
    """
    wanted = frozenset(keys)

    def of(text: str) -> list[str]:
        try:
            return [canonical_json(x) for x in _nested(json.loads(text), wanted)]
        except (ValueError, RecursionError):
            return []

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda ts: [x for t in (ts if ts is not None else []) if t is not None for x in of(t)])

    return run(texts)


#: Fixed value: what stands for an unknown number or date.
UNKNOWN = "—"


def _fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, halves of its decimal digits rounded up, without separators of thousands."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double")))


def percent(value: Column) -> Column:
    """Such as 12.5%."""
    return F.coalesce(F.concat(_fixed(value * 100, 1), F.lit("%")), F.lit(UNKNOWN))


def dollars(value: Column) -> Column:
    """Such as $1,234.50; amounts between 0 and a cent with up to four decimals."""
    small = F.regexp_replace(_fixed(value, 4), "0{1,2}$", "")
    shown = F.when((value > 0) & (value < 0.01), F.concat(F.lit("$"), small)).when(value < 0, F.concat(F.lit("-$"), F.format_number(-value, 2))).otherwise(F.concat(F.lit("$"), F.format_number(value, 2)))
    return F.coalesce(shown, F.lit(UNKNOWN))


def display_date(text: Column) -> Column:
    """The day that a text begins with."""
    day = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.when(day != "", day), F.lit(UNKNOWN))


def display_correlation(value: Column) -> Column:
    """Three decimals of a finite number."""
    return F.coalesce(F.when(~F.isnan(value) & (F.abs(value) < float("inf")), _fixed(value, 3)), F.lit(UNKNOWN))


def display_cutoff(text: Column) -> Column:
    """A day as it is, a month by its name, ``Not disclosed`` for null."""
    month = F.date_format(F.try_to_timestamp(F.concat(text, F.lit("-01")), F.lit("yyyy-MM-dd")), "MMMM yyyy")
    return F.when(text.isNull(), "Not disclosed").when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), text).when(text.rlike(r"\A\d{4}-\d{2}\z"), F.coalesce(month, F.lit(UNKNOWN))).otherwise(UNKNOWN)


def display_score(value: Column) -> Column:
    """Clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def markdown_table(rows: Column, names: list[str]) -> Column:
    """An array of structs as the lines of a table, in order."""
    head = F.lit("| " + " | ".join(names) + " |\n|" + "---|" * len(names))
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", *[r[n].cast("string") for n in names]), F.lit(" |")))
    return F.concat_ws("\n", head, F.array_join(lines, "\n"))


def category_label(value: Column) -> Column:
    """A category's name for display: without ``_variant`` at its end, underscores as spaces, 3 and 5 prime as signs."""
    text = F.replace(F.regexp_replace(value, "_variant$", ""), F.lit("_"), F.lit(" "))
    return F.replace(F.replace(text, F.lit("3 prime"), F.lit("3′")), F.lit("5 prime"), F.lit("5′"))


def run_label(model: Column, effort: Column) -> Column:
    """The last part of a model's name, and its effort in brackets where it has one (not null nor empty)."""
    name = F.element_at(F.split(model, "/"), -1)
    return F.concat(name, F.coalesce(F.when(effort != "", F.concat(F.lit(" ("), effort, F.lit(")"))), F.lit("")))


def request_id(number: Column) -> Column:
    return F.format_string("request_%06d", number)


def public_date(registry: Column, published: Column, events: Column) -> Column:
    """The date a record became public: its own for a registry, else the first ``released`` event's (array of struct<kind, date>)."""
    released = F.array_sort(F.transform(F.filter(events, lambda e: e["kind"] == "released"), lambda e: e["date"]))
    return F.when(registry == "archive", published).otherwise(F.get(released, F.lit(0)))
