"""Rules of questions, of the sampling they came from and of the parameters they are asked with; rendering of their texts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions import parsing
from panelyard.operators import checks, stats


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template's text with its {placeholders} filled in; the placeholders must be exactly those of ``values``.

    ``{{`` and ``}}`` stand for braces; a null value makes the text null.
    """
    pieces = re.split(r"(\{\{|\}\}|\{[A-Za-z_][A-Za-z0-9_]*\})", template)
    names = {p[1:-1] for p in pieces if re.fullmatch(r"\{[A-Za-z_]\w*\}", p)}
    if names != set(values):
        raise ValueError(f"placeholders differ: {sorted(names ^ set(values))}")
    plain = "".join(p for p in pieces if p not in ("{{", "}}") and not re.fullmatch(r"\{\w+\}", p))
    if "{" in plain or "}" in plain:
        raise ValueError("a brace stands alone")
    return F.concat(*(values[p[1:-1]].cast("string") if p[1:-1] in names and p.startswith("{") else F.lit({"{{": "{", "}}": "}"}.get(p, p)) for p in pieces if p))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _stand_once(text: str | None, parts: list[str | None]) -> list[bool]:
    """Whether each part stands in the text exactly once, counted without overlap; nulls and empty parts don't.

    Parts of one length are looked up together: the text's windows of that length are hashed at once, and those that have the hash
    of a part are compared with it.  So the work grows with the text, once for each length, not with text times parts.
    """
    by_length: dict[int, set[str]] = {}
    for part in parts:
        if text and part:
            by_length.setdefault(len(part), set()).add(part)
    if not by_length:
        return [False] * len(parts)
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    power = lambda base, n: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
    powers, back = power(_BASE, len(text)), power(_INVERSE, len(text))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code(text) * powers[:-1])])
    seen: dict[str, tuple[int, int]] = {}  # how often, and where the last one ends
    for length, group in by_length.items():
        if length > len(text):
            continue
        windows = (upto[length:] - upto[:-length]) * back[: len(text) - length + 1]
        hashes = np.unique((np.stack([code(part) for part in group]) * powers[:length]).sum(axis=1, dtype=np.uint64))
        for at in np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, windows), len(hashes) - 1)] == windows).tolist():
            part = text[at : at + length]
            n, end = seen.get(part, (0, 0))
            if at >= end and part in group:
                seen[part] = n + 1, at + length
    return [part is not None and seen.get(part, (0, 0))[0] == 1 for part in parts]


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def stand_once(texts: pd.Series, parts: pd.Series) -> pd.Series:
    """For each of an array of parts whether it stands in the text exactly once (null array: null)."""
    return pd.Series([None if p is None else _stand_once(t, list(p)) for t, p in zip(texts, parts, strict=True)], dtype=object)


def choice_violations(questions: DataFrame) -> DataFrame:
    """Multiple-choice questions (question_id, prompt, choices: array<struct<choice_id, text>>, answer_choice_id): rule, key, path.

    Rules: two_choices, unique_choices, answer (exactly one choice), rendered (``id. text`` stands in the prompt exactly once,
    path names the choice).  Rows come in order of key and path when sorted by them.
    """
    ids = F.transform("choices", lambda c: c["choice_id"])
    whole = {"two_choices": F.size("choices") >= 2, "unique_choices": F.size(F.array_distinct(ids)) == F.size(ids), "answer": F.size(F.filter(ids, lambda i: i == F.col("answer_choice_id"))) == 1}
    lines = F.transform("choices", lambda c: F.concat(c["choice_id"], F.lit(". "), c["text"]))
    return _broken(questions.withColumn("_once", stand_once("prompt", lines)), whole, "choices", {"rendered": _is_once})


def candidate_violations(questions: DataFrame) -> DataFrame:
    """Ranking questions (question_id, prompt, candidates: array<struct<candidate_id, chrom, pos, ref, alt, reference_score>>):
    rule, key, path.

    Rules: unique_ids, unique_alleles, sorted (by chrom, pos, ref, alt), finite (each reference score), rendered (each row of the
    table, tab-separated, stands in the prompt exactly once).
    """
    allele = F.transform("candidates", lambda c: F.struct(c["chrom"].alias("chrom"), c["pos"].alias("pos"), c["ref"].alias("ref"), c["alt"].alias("alt")))
    ids = F.transform("candidates", lambda c: c["candidate_id"])
    inorder = F.sort_array(allele)
    twins = F.zip_with(inorder, F.slice(inorder, F.lit(2), F.size(inorder)), lambda a, b: a.eqNullSafe(b))  # distinct structs would be found pair by pair
    whole = {"unique_ids": F.size(F.array_distinct(ids)) == F.size(ids), "unique_alleles": ~F.exists(twins, lambda t: t), "sorted": inorder == allele}
    finite = lambda c, k: c["reference_score"].isNotNull() & ~F.isnan(c["reference_score"]) & (F.abs(c["reference_score"]) < float("inf"))
    row = lambda c: F.concat_ws("\t", c["chrom"], c["pos"].cast("string"), c["candidate_id"], c["ref"], c["alt"])
    return _broken(questions.withColumn("_once", stand_once("prompt", F.transform("candidates", row))), whole, "candidates", {"finite": finite, "rendered": _is_once})


def _is_once(_part: Column, k: Column) -> Column:
    return F.get("_once", k)


def _broken(df: DataFrame, whole: dict[str, Column], parts: str, each: dict) -> DataFrame:
    """Violations of whole records (path: the record) and of the elements of one of their arrays (path: parts.index)."""
    top = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit("<record>").alias("path"))) for rule, ok in whole.items()]

    def marked(rule: str, ok) -> Column:
        at = lambda k: F.concat(F.lit(f"{parts}."), k.cast("string")).alias("path")
        return F.transform(parts, lambda c, k: F.when(~F.coalesce(ok(c, k), F.lit(False)), F.struct(F.lit(rule).alias("rule"), at(k))))

    inner = [marked(rule, ok) for rule, ok in each.items()]
    found = F.array_compact(F.concat(F.array(*top), *inner))
    return df.select(F.col("question_id").alias("key"), F.explode(found).alias("v")).select("v.rule", "key", "v.path")


def provenance_violations(plans: DataFrame, selected: DataFrame, seed: str, algorithm: str, size: int, bins: int) -> DataFrame:
    """Sampling provenance against the rows that were selected: rule, key.

    plans: task, seed, algorithm, anchors (two doubles), cutpoints (bins - 1), population_counts and allocations (bins each);
    selected: task, score, bin.  Rules: convention (seed, algorithm), anchors (finite, in order), cutpoints (evenly between
    them), allocation (round by round from bin 0, as far as rows go), membership (a row's bin is the number of cutpoints at or
    below its score), selected_counts (rows by bin are the allocation).
    """
    lo, hi = F.get("anchors", F.lit(0)), F.get("anchors", F.lit(1))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    expected = F.array(*[(1 - k / bins) * lo + (k / bins) * hi for k in range(1, bins)])
    turns = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.get("population_counts", b), F.lit(size))).cast("int")), lambda r: F.struct(r.alias("r"), b.alias("b")))))
    real = F.filter(turns, lambda t: t["r"] <= F.get("population_counts", t["b"]))
    taken = F.slice(F.array_sort(real), 1, size)
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(taken, lambda t: t["b"] == b)).cast("long"))
    rows = selected.join(plans.select("task", F.col("cutpoints").alias("_cuts")), "task")
    place = F.size(F.filter("_cuts", lambda c: c <= F.col("score")))
    of_bin = rows.groupBy("task").agg(F.bool_and(F.coalesce((place == F.col("bin")) & finite(F.col("score")), F.lit(False))).alias("_members"), *(F.count_if(F.col("bin") == b).alias(f"_n{b}") for b in range(bins)))
    both = plans.join(of_bin, "task", "left")
    rules = {
        "convention": (F.col("seed") == seed) & (F.col("algorithm") == algorithm),
        "anchors": (F.size("anchors") == 2) & finite(lo) & finite(hi) & (lo < hi),
        "cutpoints": F.col("cutpoints") == expected,
        "allocation": (F.size("population_counts") == bins) & (F.transform("allocations", lambda a: a.cast("long")) == shares),
        "membership": F.coalesce("_members", F.lit(False)),
        "selected_counts": F.array(*[F.coalesce(f"_n{b}", F.lit(0)) for b in range(bins)]) == F.transform("allocations", lambda a: a.cast("long")),
    }
    return checks.violations(both, F.col("task"), rules)


def scored(answers: DataFrame) -> DataFrame:
    """Scores of answers by their question's type: id, metric, parsed, value, correct, spearman_rho, pearson_r, valid, parse_error.

    answers: id (unique), task_type (multiple_choice or ranking), status, content, choice_ids and answer_choice_id, or
    reference_scores (map of candidate to score).  An answer that is not completed has its metric and nulls.  A choice that is
    none of the question's is no answer (value 0); a ranking must score exactly the candidates, else it is not valid (value 0).
    """
    done, choice = F.col("status") == "completed", F.col("task_type") == "multiple_choice"
    told = parsing.last_choice(F.col("content"))
    rows = answers.withColumns({"_choice": F.when(done & choice & F.array_contains("choice_ids", told), told), "_p": F.when(done & ~choice, parsing.last_scores("content"))})
    error = parsing.answer_error(F.col("_p.scores"), F.col("_p.error"), F.map_keys("reference_scores"))
    rows = rows.withColumn("_error", F.when(done, F.when(choice, F.when(F.col("_choice").isNull(), "no valid final choice")).otherwise(error)))
    pairs = rows.where(done & ~choice & F.col("_error").isNull()).select("id", F.explode("reference_scores").alias("_c", "_r"), F.col("_p.scores").alias("_s"))
    panels = stats.panel_correlations(pairs.select("id", F.element_at("_s", F.col("_c")).alias("_q"), "_r"), ["id"], "_q", "_r").drop("n")
    out = rows.join(panels, "id", "left")
    ranked = done & ~choice
    value = F.when(done & choice, F.coalesce(F.col("_choice") == F.col("answer_choice_id"), F.lit(False)).cast("double")).when(ranked, F.coalesce("spearman_rho", F.lit(0.0)))
    parsed = F.when(choice, F.col("_choice")).when(F.col("_error").isNull(), F.to_json("_p.scores"))
    return out.select(
        "id",
        F.when(choice, "exact_match").otherwise("rank_correlation").alias("metric"),
        F.when(done, parsed).alias("parsed"),
        value.alias("value"),
        F.when(done & choice, value == 1.0).alias("correct"),
        "spearman_rho",
        "pearson_r",
        F.when(ranked, F.col("_error").isNull()).alias("valid"),
        F.col("_error").alias("parse_error"),
    )


#: What a request's parameters may not set.
RESERVED = ("messages", "model", "n", "stream")


def parameter_violations(df: DataFrame, key: Column, parameters: str) -> DataFrame:
    """Generation parameters (a JSON object as text) that may not be sent: rule, key.

    Rules: object, reserved (a field of RESERVED), max_tokens and max_completion_tokens (whole numbers from 1), temperature (a
    finite number), seed (a whole number).  Absent fields are fine, null ones are not.
    """
    p = F.col(parameters)
    kinds = F.from_json(p, "map<string, string>")
    there = lambda name: F.array_contains(F.map_keys(kinds), F.lit(name))
    told = lambda name: F.coalesce(F.regexp_extract(p, rf'"{name}"\s*:\s*("(?:[^"\\]|\\.)*"|[^,}}\s]+)', 1), F.lit(""))
    whole = lambda name: told(name).rlike(r"\A-?(0|[1-9][0-9]*)\z")
    positive = lambda name: ~there(name) | told(name).rlike(r"\A[1-9][0-9]*\z")
    number = told("temperature").rlike(r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z") & checks.finite_text(told("temperature")).isNotNull()
    rules = {
        "object": kinds.isNotNull() & F.startswith(F.ltrim(p), F.lit("{")),
        "reserved": ~checks.intersecting(F.map_keys(kinds), F.array(*[F.lit(r) for r in RESERVED])) | kinds.isNull(),
        "max_tokens": positive("max_tokens") | kinds.isNull(),
        "max_completion_tokens": positive("max_completion_tokens") | kinds.isNull(),
        "temperature": ~there("temperature") | number | kinds.isNull(),
        "seed": ~there("seed") | whole("seed") | kinds.isNull(),
    }
    return checks.violations(df, key, rules)
