"""Operators on small tables with known answers."""

import math
from itertools import combinations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelyard.functions import digests, parsing, sequence, temporal
from panelyard.operators import boards, checks, joins, sampling, selection, stats, strata, usage


def rows(df):
    return [tuple(r) for r in df.collect()]


def scores(spark, pairs):
    return spark.createDataFrame([("g", float(p), float(r)) for p, r in pairs], "g string, p double, r double")


@pytest.mark.parametrize(
    ("pairs", "rho", "r"),
    [
        ([(1, 1), (2, 2), (3, 3)], 1.0, 1.0),
        ([(3, 1), (2, 2), (1, 3)], -1.0, -1.0),
        ([(1, 1), (1, 2), (1, 3)], 0.0, 0.0),
        ([(1, 5), (2, 5)], 0.0, 0.0),
        ([(1e308, 1), (-1e308, -1)], 1.0, 1.0),
        ([(4, 2)], 0.0, 0.0),
        ([(1, 1), (2, 1), (2, 3), (4, 4)], 5 / 6, None),
    ],
)
def test_correlations(spark, pairs, rho, r):
    out = stats.panel_correlations(scores(spark, pairs), ["g"], "p", "r").first()
    assert out.spearman_rho == pytest.approx(rho)
    if r is not None:
        assert out.pearson_r == pytest.approx(r)


def test_correlation_leaves_nulls_out(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0), ("g", None, 9.0), ("g", 2.0, 2.0), ("g", 5.0, None)], "g string, p double, r double")
    assert rows(stats.panel_correlations(df, ["g"], "p", "r")) == [("g", 2, 1.0, 1.0)]
    assert rows(stats.panel_correlations(df.where("false"), ["g"], "p", "r")) == []


def test_type7(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 10, 20, 30)], "v double")
    assert df.agg(stats.type7("v", 0.05)).first()[0][0] == pytest.approx(1.5)


@pytest.mark.parametrize(("p", "df", "t"), [(0.975, 1, 12.7062047362), (0.975, 15, 2.1314495456), (0.975, 19, 2.0930240544), (0.95, 10, 1.8124611228), (0.975, 1000, 1.9623390808)])
def test_t_quantile(p, df, t):
    assert stats.t_quantile(p, df) == pytest.approx(t, abs=1e-9)
    assert stats.t_quantile(1 - p, df) == pytest.approx(-t, abs=1e-9)


def test_t_interval_statuses(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 1.0), ("c", 2.0), ("c", 2.0)], "g string, v double")
    out = {r.g: r for r in stats.t_interval(df, ["g"], "v").collect()}
    assert (out["b"].status, out["c"].status, out["a"].status) == ("insufficient", "constant_scores", "estimated")
    assert out["a"].ci_high - 2 == pytest.approx(4.3026527297 / math.sqrt(3))
    assert out["b"].ci_low is None


def test_permutation_test(spark):
    values = [("b", 5.0), ("b", 4.0), ("b", 3.5), ("a", 1.0), ("a", 3.0)]
    df = spark.createDataFrame([("g", *v) for v in values] + [("h", "b", 1.0), ("h", "a", 2.0)], "g string, l string, v double")
    out = {r.g: r for r in stats.permutation_test(df, ["g"], "l", "v", "b", "a").collect()}
    all_ = [v for _, v in values]
    observed = sum(all_[:3]) / 3 - sum(all_[3:]) / 2
    splits = [(sum(all_[k] for k in c) / 3 - (sum(all_) - sum(all_[k] for k in c)) / 2) for c in combinations(range(5), 3)]
    assert out["g"].p_value == pytest.approx(sum(s >= observed - 1e-12 for s in splits) / len(splits))
    assert out["g"].n_allocations == 10
    assert out["h"].p_value is None


@pytest.mark.parametrize(("counts", "expected"), [([400, 80, 12, 6, 6], [13, 13, 12, 6, 6]), ([400, 80, 12, 6, 2], [15, 15, 12, 6, 2])])
def test_allocation(spark, counts, expected):
    # values that keep the anchors at 0 and 5, so that each bin holds what it is given
    data = [("g", float(b) + 0.5) for b, n in enumerate(counts) for _ in range(n)]
    binned = spark.createDataFrame(data, "g string, v double").withColumn("bin", F.floor("v").cast("int"))
    import panelyard.operators.sampling as module

    keep = module.score_bins
    module.score_bins = lambda df, by, value, bins=5: binned
    try:
        out = sampling.bin_allocation(binned, ["g"], "v")
        assert [r.n_allocated for r in out.orderBy("bin").collect()] == expected
        assert sampling.allocation_violations(out, ["g"]).count() == 0
    finally:
        module.score_bins = keep


def test_bins_and_sample(spark):
    df = spark.createDataFrame([("g", k, float(v)) for k, v in enumerate([0] * 30 + [1] * 30 + [5] * 30)], "g string, k long, v double")
    out = sampling.bin_allocation(df, ["g"], "v").orderBy("bin").collect()
    assert [(r.n_rows, r.n_allocated) for r in out] == [(30, 17), (30, 17), (0, 0), (0, 0), (30, 16)]
    one = sampling.stratified_sample(df, ["g"], "k", "v", "s")
    two = sampling.stratified_sample(df.orderBy(F.desc("k")), ["g"], "k", "v", "s")
    assert one.count() == 50
    assert sorted(rows(one)) == sorted(rows(two))
    few = df.limit(49)
    assert sampling.stratified_sample(few, ["g"], "k", "v", "s").count() == 0
    same = df.withColumn("v", F.lit(1.0))
    assert sampling.stratified_sample(same, ["g"], "k", "v", "s").count() == 0


def test_allocation_violations(spark):
    df = spark.createDataFrame([("g", 0, 5, 6), ("g", 1, 60, 44)], "g string, bin int, n_rows long, n_allocated long")
    assert {r.rule for r in sampling.allocation_violations(df, ["g"]).collect()} == {"allocation_exceeds_rows"}


def test_selection(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 3.0), ("b", 3, 9.0), ("c", 4, 1.0)], "g string, k int, v double")
    out = {(r.g, r.k): (r.selected_rank, r.reason) for r in selection.winners_with_reasons(df, ["g"], [F.desc("v"), F.asc("k")], 2).collect()}
    assert out == {("a", 1): (2, None), ("a", 2): (None, "not_group_winner"), ("b", 3): (1, None), ("c", 4): (3, "below_selection_cutoff")}
    levels = spark.createDataFrame([("m", "low", 5, 1), ("m", "high", 1, 2), ("m", "high", 2, 3)], "m string, e string, at int, id int")
    out = {r.id: r.disposition for r in selection.highest_ordinal(levels, ["m"], "e", ["low", "high"], "at", "id").collect()}
    assert out == {1: "lower_effort", 2: "superseded_same_effort", 3: "selected"}
    with pytest.raises(Exception, match="unknown ordinal"):
        selection.highest_ordinal(levels.withColumn("e", F.lit("max")), ["m"], "e", ["low", "high"], "at", "id").collect()
    tied = spark.createDataFrame([("k", "x", 1), ("k", "x", 1), ("k", "y", 9)], "k string, h string, at int")
    assert [r.tied for r in selection.preferred_latest(tied, ["k"], "h", ["x"], "at").collect()] == [2, 2]


def test_checks(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n"), (None, "m")], "k int, v string")
    assert rows(checks.exclude_all_duplicates(df, ["k"])) == [(2, "z")]
    found = checks.violations(df, F.col("v"), {"has_key": F.col("k").isNotNull(), "one": F.col("k") == 1})
    assert sorted(rows(found)) == [("has_key", "m"), ("has_key", "n"), ("one", "m"), ("one", "n"), ("one", "z")]
    with pytest.raises(ValueError, match="keys: "):
        checks.enforce(found, "keys")
    checks.enforce(found.where("false"), "keys")
    with pytest.raises(ValueError, match="missing columns: w"):
        checks.require_columns(df, ["k", "w"])
    numbers = spark.createDataFrame([("1.5",), ("1e400",), ("NaN",), ("x",), (None,)], "t string")
    assert [r[0] for r in numbers.select(checks.finite("t")).collect()] == [1.5, None, None, None, None]
    assert sorted(rows(checks.not_exactly_one(df.where("k is not null"), df.where("k = 1"), ["k"]))) == [(1, 2), (2, 0)]


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(2, 2.004), (3, None), (4, 4.0)], "k int, v double")
    assert {r.k: r.status for r in checks.reconcile(a, b, ["k"], "v", 0.005).collect()} == {1: "only_left", 2: "matched", 3: "matched", 4: "only_right"}


def test_interval_joins(spark):
    points = spark.createDataFrame([("c", p, n) for p in range(1, 30) for n in (1, 4)], "k string, p long, n long")
    windows = spark.createDataFrame([("c", 5, 12, "w"), ("c", 10, 28, "x")], "k string, a long, b long, name string")
    out = sorted((r.p, r.n, r.name) for r in joins.containment_join(points, windows, ["k"], "p", "n", "a", "b").collect())
    assert out == sorted((p, n, w) for p in range(1, 30) for n in (1, 4) for w, a, b in (("w", 5, 12), ("x", 10, 28)) if p >= a and p + n - 1 <= b)
    spans = points.select("k", F.col("p").alias("s"), (F.col("p") + F.col("n")).alias("e"))
    out = sorted((r.s, r.e, r.name) for r in joins.overlap_join(spans, windows, ["k"], ("s", "e"), ("a", "b")).collect())
    assert out == sorted((p, p + n, w) for p in range(1, 30) for n in (1, 4) for w, a, b in (("w", 5, 12), ("x", 10, 28)) if p <= b and a <= p + n)


def test_ledgers(spark):
    df = spark.createDataFrame([("b", k, w, 10.0) for k, w in enumerate([1, 1, 1])] + [("z", 0, 0, 1.0), ("z", 1, 5, 1.0)], "b string, k int, w int, cost double")
    out = usage.allocate(df, ["b"], ["k"], "w", "cost")
    assert [r.share for r in out.where("b = 'z'").collect()] == [0.5, 0.5]
    assert usage.ledger_violations(out, ["b"], "share", "cost").count() == 0
    wrong = out.withColumn("share", F.when(F.col("k") == 0, F.lit(-1.0)).otherwise(F.col("share")))
    assert {r.rule for r in usage.ledger_violations(wrong, ["b"], "share", "cost").collect()} == {"negative_share", "total_differs"}
    fewer = usage.ledger_violations(out.where("k > 0"), ["b"], "share", "cost", df, "k")
    assert "members_differ" in {r.rule for r in fewer.collect()}
    some = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "g string, v int")
    assert sorted(rows(some.groupBy("g").agg(usage.complete_sum(F.col("v"))))) == [("a", None), ("b", 2)]
    assert rows(some.where("false").agg(usage.complete_sum(F.col("v")))) == [(None,)]


def test_macro_average_needs_every_task(spark):
    df = spark.createDataFrame([("m", "t", 1.0), ("m", "u", 3.0), ("n", "t", 5.0), ("o", "t", 1.0), ("o", "u", None)], "m string, task string, s double")
    assert {r.m: r.macro_score for r in boards.macro_average(df, ["m"], "task", "s", ["t", "u"]).collect()} == {"m": 2.0, "n": None, "o": None}


def test_coverage_plan_has_the_whole_domain(spark):
    df = spark.createDataFrame([("t", "p", "x")] * 2 + [("t", "q", "x")] * 2 + [("u", "r", "y")], "task string, panel string, kind string")
    out = {(r.task, r.category): (r.n_variants, r.n_eligible, r.status) for r in strata.coverage_plan(df, "task", "panel", ["kind"], 2, 2).collect()}
    assert out == {("t", "x"): (4, 2, "eligible"), ("t", "y"): (0, 0, "absent"), ("u", "x"): (0, 0, "absent"), ("u", "y"): (1, 0, "insufficient")}


@pytest.mark.parametrize(
    ("text", "scores", "valid"),
    [
        ('so\nFINAL: {"a": 1, "b": 2.5}', {"a": 1.0, "b": 2.5}, True),
        ('FINAL: {"a": 1}\nFINAL: {broken', {"a": 1.0}, True),
        ('FINAL: {"a": 1}\nFINAL: {"a": 1, "a": 2}', None, False),
        ('FINAL: {"a": NaN}', None, False),
        ('FINAL: {"a": true}', None, False),
        ('FINAL: {"a": "1"}', None, False),
        ('FINAL: {"a": 1e999}', None, False),
        ('FINAL: {"a": ' + "9" * 400 + "}", None, False),
        ("FINAL: [1]", None, False),
        ("", None, False),
        (None, None, False),
        ('x FINAL: {"a": 1}', {"a": 1.0}, True),
    ],
)
def test_parse_scores(text, scores, valid):
    found, error = parsing.parse_scores(text)
    assert (found, error is None) == (scores, valid)


def test_last_choice(spark):
    texts = ["FINAL: A\nFINAL: B", "FINAL: A\nFINAL: two words", "xFINAL: A", "FINAL: A\r\n", "a\rFINAL: B", None, "FINAL:\tC "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r[1] for r in df.select("k", parsing.last_choice(F.col("t"))).orderBy("k").collect()] == ["B", "A", None, "A", None, None, "C"]


@pytest.mark.parametrize(
    ("date", "cutoff", "earlier", "relation"),
    [
        ("2025-05-31", "2025-06", None, "Before"), ("2025-06-01", "2025-06", None, "Unknown"), ("2025-07-01", "2025-06", None, "After"), ("2025-06-15", "2025-06-15", None, "Before"),
        ("2025-06-16", "2025-06-15", None, "After"), ("2025-13-01", "2025-06", None, "Unknown"), ("2025-02-30", "2025-06-01", None, "Unknown"), (None, "2025-06", None, "Unknown"),
        ("2025-07-01", None, None, "Unknown"), ("2025-07-01", "2025-06", "2025-01-01", "Mixed"), ("2025-07-01", "2025-06", "2025-06-02", "Unknown"), ("2025-07-01", "2025-06", "2025-06-30", "Unknown"), ("2025-05-01", "2025-06", "bad", "Before"),
        ("2025-07-02", "2025-06", "2025-07-01", "After"),
    ],
)
def test_cutoff_relation(spark, date, cutoff, earlier, relation):
    df = spark.createDataFrame([(date, cutoff, earlier)], "d string, c string, e string")
    assert df.select(temporal.cutoff_relation(F.col("d"), F.col("c"), F.col("e"))).first()[0] == relation


@pytest.mark.parametrize(
    ("given_", "expected"),
    [
        (("CACACG", 4, "AC", ""), (1, "CAC", "C")), (("CAAAAG", 5, "A", ""), (1, "CA", "C")), (("CAAAAG", 5, "", "A"), (1, "C", "CA")), (("ACGT", 1, "A", ""), (1, "AC", "C")),
        (("ACGT", 1, "", "T"), (1, "A", "TA")), (("ACGT", 3, "GT", "CA"), (3, "GT", "CA")), (("GAC", 0, "TG", "T"), (1, "GA", "A")), (("ACGT", 2, "G", "A"), None), (("ACGT", 2, "C", "C"), None), (("ACGT", 2, None, "C"), None),
    ],
)
def test_normalise(given_, expected):
    assert sequence.normalise(*given_) == expected


@given(st.text("ACGT", min_size=1, max_size=12), st.integers(1, 12), st.integers(0, 4), st.text("ACGT", max_size=4))
def test_normalise_keeps_the_mutant(s, pos, n, alt):
    ref = s[pos - 1 : pos - 1 + n]
    found = sequence.normalise(s, pos, ref, alt)
    if found and pos <= len(s) + 1:
        p, r, a = found
        assert s[: p - 1] + a + s[p - 1 + len(r) :] == s[: pos - 1] + alt + s[pos - 1 + len(ref) :]
        assert sequence.normalise(s, p, r, a) == found


def test_canonical_json():
    assert digests.canonical_json({"b": 1, "a": ["é", 1.5, None]}) == '{"a":["é",1.5,null],"b":1}'
    with pytest.raises(ValueError):
        digests.canonical_json({"a": float("nan")})


def test_leaks_take_null_text_as_clean(spark):
    df = spark.createDataFrame([("a.b",), ("see REF",), (None,), ("x12",)], "t string")
    assert [r[0] for r in df.select(checks.leaks(F.col("t"), ["REF", "."], "[0-9]{2}")).collect()] == [True, True, False, True]
    assert [r[0] for r in df.select(checks.leaks(F.col("t"), ["REF"])).collect()] == [False, True, False, False]


def test_guarded_notes_tell_stale_from_missing(spark):
    df = spark.createDataFrame([(1, "d"), (2, "d"), (3, "d"), (4, None)], "k int, digest string")
    notes = spark.createDataFrame([(1, "d", "x"), (2, "e", "y"), (4, None, "z")], "k int, digest string, label string")
    assert {(r.k, r.label, r.note) for r in joins.guarded_left(df, notes, ["k"], "digest", ["label"]).collect()} == {(1, "x", "current"), (2, None, "stale"), (3, None, "none"), (4, None, "stale")}


def test_reported_figures_on_one_side_only(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, v double")
    reported = spark.createDataFrame([("a", 3.0000001), ("c", None)], "k string, total double")
    found = checks.reported_breaches(df, reported, ["k"], {"total": F.sum("v")}, 1e-6).collect()
    assert [tuple(r) for r in found] == [("b", "total", None, 5.0)]


def test_tracks_and_deltas(spark):
    df = spark.createDataFrame([([1, 5, 9], [1, 1, 1]), ([1], [1, 2]), ([], []), (None, None)], "a array<int>, b array<int>")
    out = df.select(stats.track_mean(F.col("a"), lambda x: x > 2).alias("m"), stats.delta_mean(F.col("a"), F.col("b")).alias("d")).collect()
    assert [tuple(r) for r in out] == [(7.0, 4.0), (None, None), (None, None), (None, None)]


def test_spans_and_runtimes_with_unknowns(spark):
    df = spark.createDataFrame([("a", 1, "x", 3), ("a", 2, "x", 4), ("b", 1, None, None), ("b", 1, None, None)], "k string, at int, kind string, s int")
    spans = {tuple(r) for r in boards.span(df, ["k"], "at", "kind", F.col("s") > 3).collect()}
    assert spans == {("a", 1, 2, "x", True), ("b", 1, 1, None, False)}
    assert {tuple(r) for r in usage.distinct_runtime(df, ["k"], "at", "s").collect()} == {("a", 2, 7), ("b", 1, None)}
