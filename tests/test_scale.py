"""Operators that must hold for groups of any size: exact sums, running values, ranks, quantiles, intervals."""

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import checks, exact, joins, scans, selection, stats, usage


@pytest.fixture
def narrow_ranges(spark):
    """Ranges are not put together again, so that groups lie in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def numbers(kind, rng):
    if kind == "wide":
        return [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(400)]
    if kind == "cancelling":
        own = [rng.random() * 10.0 ** rng.randint(-20, 20) for _ in range(200)]
        return own + [-x for x in own] + [1e-20] * 3
    if kind == "tiny":
        return [rng.randint(-9, 9) * 5e-324 for _ in range(300)] + [2.0**-1022, -(2.0**-1040)]
    if kind == "one bin":
        own = [rng.choice([-1, 1]) * rng.uniform(1.5, 2.0**31.5) for _ in range(500)]
        return own + [-x for x in own[: rng.choice([0, 499, 500])]]
    if kind == "borders":
        return [s * 2.0**k * f for k in range(-1000, 1000, 8) for s in (-1, 1) for f in (1.0, 1 - 2**-53, 1 + 2**-52)][: 3 * 249]
    return [0.1] * 1000 + [1e25, -0.0]


@pytest.mark.parametrize("kind", ["wide", "cancelling", "tiny", "borders", "plain", "one bin"])
@pytest.mark.parametrize("parts", [1, 7])
def test_exact_sums_equal_fsum(spark, kind, parts):
    values = {g: numbers(kind, random.Random(f"{kind}{g}")) for g in (1, 2, None)}
    df = spark.createDataFrame([(g, x) for g, v in values.items() for x in v], "g int, x double").repartition(parts)
    out = {r.g: (r.s, r.t) for r in exact.exact_sums(df, ["g"], {"s": F.col("x"), "t": -F.col("x")}).collect()}
    assert {g: (repr(a + 0.0), repr(b + 0.0)) for g, (a, b) in out.items()} == {g: (repr(math.fsum(v) + 0.0), repr(math.fsum([-x for x in v]) + 0.0)) for g, v in values.items()}


def test_exact_sums_of_odd_numbers(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", inf), ("c", 1.0), ("d", inf), ("d", -inf), ("e", nan), ("f", 1e308), ("f", 1e308), ("g", 1e308), ("g", 1e308), ("g", -1e308)], "g string, x double")
    out = {r.g: repr(r.s) for r in exact.exact_sums(df, ["g"], {"s": F.col("x")}).collect()}
    assert out == {"a": "1.0", "b": "None", "c": "inf", "d": "nan", "e": "nan", "f": "inf", "g": "1e+308"}
    assert {r.g: r.s for r in exact.exact_sums(df.where("g in ('a', 'b')"), ["g"], {"s": F.col("x")}, spoilt=True).collect()} == {"a": None, "b": None}
    assert [r.s for r in exact.exact_sums(df.where("false"), [], {"s": F.col("x")}).collect()] == [None]
    assert [r.s for r in exact.exact_sums(df.where("g = 'a'"), [], {"s": F.col("x")}).collect()] == [1.0]


def test_ledger_of_many_shares_is_within_one_place(spark):
    rng = random.Random(2)
    rows = [("big", k, rng.randint(1, 9), 7.13) for k in range(5000)] + [("one", 0, 4, 0.3)]
    shares = usage.allocate(spark.createDataFrame(rows, "b string, k int, w int, cost double").repartition(5), ["b"], ["k"], "w", "cost")
    whole = math.fsum(w for b, _, w, _ in rows if b == "big")
    expected = {("big", k): 7.13 * w / whole for b, k, w, _ in rows[:4999]} | {("one", 0): 0.3}
    expected["big", 4999] = 7.13 - math.fsum(x for (b, _), x in expected.items() if b == "big")
    assert {(r.b, r.k): r.share for r in shares.collect()} == expected
    assert usage.ledger_violations(shares, ["b"], "share", "cost").count() == 0
    off = shares.withColumn("share", F.when((F.col("k") == 7), F.col("share") + 4 * math.ulp(7.13)).otherwise(F.col("share")))
    assert [tuple(r) for r in usage.ledger_violations(off, ["b"], "share", "cost").collect()] == [("big", "total_differs")]


def test_ulp(spark):
    values = [1.0, 1.5, 2.0, 1 - 2**-53, 3e300, 5e-324, 2.0**-1022, 0.0, -8.0, 7.999999999999999, *(2.0**k for k in range(-900, 900, 37))]
    df = spark.createDataFrame([(x,) for x in values], "x double").select("x", usage.ulp(F.col("x")).alias("u"))
    assert [r.u for r in df.collect()] == [math.ulp(x) if abs(x) >= 2.0**-1022 else 2.0**-1074 for x in values]


@pytest.fixture(scope="module")
def crowded(spark):
    """One group holds nearly all rows; others are small, null among them."""
    rng = random.Random(4)
    rows = [("hot", k, rng.randint(0, 50)) for k in range(3000)] + [(g, k, rng.randint(0, 5)) for g in ("a", "z", None) for k in range(7)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, k int, v int").repartition(5), rows


def test_running_values_of_a_hot_group(crowded, narrow_ranges):
    df, rows = crowded
    out = scans.scanned(df, ["g"], ["k"], sums={"s": F.col("v")}, lags={"p": F.col("v")}, before={"m": F.col("v")})
    expected = []
    for g in ("hot", "a", "z", None):
        total, last, most = 0, None, None
        for _, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            total += v
            expected.append((g, k, v, total, last, most))
            last, most = v, v if most is None else max(most, v)
    assert sorted(map(repr, map(tuple, out.select("g", "k", "v", "s", "p", "m").collect()))) == sorted(map(repr, expected))
    assert scans.scanned(df.where("false"), ["g"], ["k"], sums={"s": F.col("v")}).count() == 0


def test_scans_on_hot_keys(crowded, narrow_ranges):
    df, rows = crowded
    hot = [v for _, k, v in sorted((r for r in rows if r[0] == "hot"), key=lambda r: r[1])]
    falls = [(k, hot[k], hot[k - 1]) for k in range(1, len(hot)) if hot[k - 1] >= hot[k]]
    out = selection.not_increasing(df, ["g"], ["k"], "v").where("g = 'hot'")
    assert sorted((r.k, r.v, r.previous) for r in out.collect()) == falls
    back = checks.chronology_breaches(df, ["g"], "v", "k").where("g = 'hot'")
    assert sorted((r.k, r.v, r.previous_at) for r in back.collect()) == [x for x in falls if x[2] > x[1]]
    spent = usage.budget_reserved(df, ["g"], ["k"], "v", 1000.0).where("g = 'hot'").orderBy("k").collect()
    assert [r.spent for r in spent] == np.cumsum(hot).tolist() and [r.within_budget for r in spent] == [s <= 1000 for s in np.cumsum(hot)]


def test_average_ranks_of_a_hot_group(crowded, narrow_ranges):
    df, rows = crowded
    df = df.withColumn("v", F.when(F.col("v") != 3, F.col("v")))
    key = lambda v: -1 if v in (3, None) else v
    out = scans.average_ranks(df, ["g"], "v", "rank").collect()
    for g in ("hot", "a", None):
        own = sorted(key(v) for h, _, v in rows if h == g)
        for r in out:
            if r.g == g:
                a, z = bisect.bisect_left(own, key(r.v)), bisect.bisect_right(own, key(r.v))
                assert r["rank"] == (a + 1 + z) / 2
    assert len(out) == len(rows)
    window = df.select("g", "k", stats.average_rank("v", ["g"]).alias("rank"))
    assert sorted(map(repr, map(tuple, window.collect()))) == sorted(repr((r.g, r.k, r["rank"])) for r in out)


@pytest.mark.parametrize("group_rows", [10, 1_000_000])
def test_quantiles_of_a_hot_group(spark, crowded, narrow_ranges, group_rows):
    rng = random.Random(8)
    values = {"hot": [rng.gauss(0, 1e6) for _ in range(2000)] + [7.5] * 500, "one": [2.0], "none": [], None: [1.0, 2.0, 4.0]}
    df = spark.createDataFrame([(g, x) for g, v in values.items() for x in [*v, None]], "g string, x double").repartition(4)
    points = [0.0, 0.01, 0.05, 0.5, 0.95, 1.0]
    out = {r.g: (r.n, r.q) for r in scans.quantiles(df, ["g"], "x", points, group_rows).collect()}
    assert {g: n for g, (n, _) in out.items()} == {g: len(v) for g, v in values.items()}
    for g, v in values.items():
        assert (out[g][1] is None) if not v else out[g][1] == pytest.approx(np.quantile(v, points).tolist(), rel=1e-13)


@pytest.mark.parametrize("group_rows", [1, 1_000_000])
def test_correlations_are_rounded_once(spark, narrow_ranges, group_rows):
    rng = random.Random(6)
    panels = {"a": [(rng.randint(0, 5) * 1e150, rng.random()) for _ in range(80)], "b": [(1.0, rng.random()) for _ in range(5)], "c": [(0.1 * k, 0.3 - 0.1 * k) for k in range(9)], "d": [(0.0, 0.0)]}
    df = spark.createDataFrame([(g, *x) for g, v in panels.items() for x in v] + [("a", float("nan"), 1.0), ("a", None, 2.0)], "g string, x double, y double").repartition(3)
    out = {r.g: (r.n, r.spearman_rho, r.pearson_r) for r in stats.panel_correlations(df, ["g"], "x", "y", group_rows).collect()}

    def ranks(v):
        own = sorted(v)
        return [(bisect.bisect_left(own, x) + 1 + bisect.bisect_right(own, x)) / 2 for x in v]

    def r(x, y):
        sides = []
        for v in (x, y):
            most = max(map(abs, v)) or 1.0
            mean = math.fsum(u / most for u in v) / len(v)
            sides.append([u / most - mean for u in v])
        xx, yy, xy = (math.fsum(a * b for a, b in zip(*pair, strict=True)) for pair in ((sides[0],) * 2, (sides[1],) * 2, sides))
        return max(-1.0, min(1.0, xy / math.sqrt(xx * yy))) if xx and yy else 0.0

    for g, v in panels.items():
        x, y = [a for a, _ in v], [b for _, b in v]
        assert out[g] == (len(v), r(ranks(x), ranks(y)), r(x, y))


def test_interval_index(spark):
    rng = random.Random(9)
    spans = [(rng.choice("pq"), a := rng.randint(-(10**9), 10**9), a + rng.choice([0, 1, 7, 10**3, 10**6, 10**9]), k) for k in range(120)] + [("p", 5, 4, 999), ("p", -3, 2, 500), ("q", 0, 0, 501)]
    at = [(rng.choice("pq"), rng.choice([rng.randint(-(10**9), 2 * 10**9), spans[k % 120][1], spans[k % 120][2]]), rng.choice([1, 5, 10**6]), k) for k in range(200)]
    windows = spark.createDataFrame(spans, "k string, a long, b long, w int")
    points = spark.createDataFrame(at, "k string, p long, n long, i int")
    out = sorted((r.i, r.w) for r in joins.containment_join(points, windows, ["k"], "p", "n", "a", "b").collect())
    assert out == sorted((i, w) for k, p, n, i in at for h, a, b, w in spans if h == k and a <= p and p + n - 1 <= b)
    others = points.select("k", F.col("p").alias("c"), (F.col("p") + F.col("n") - 1).alias("d"), "i")
    out = sorted((r.i, r.w) for r in joins.overlap_join(others, windows, ["k"], ("c", "d"), ("a", "b")).collect())
    assert out == sorted((i, w) for k, p, n, i in at for h, a, b, w in spans if h == k and a <= b and a <= p + n - 1 and p <= b)
    assert joins.containment_join(points, windows.where("false"), ["k"], "p", "n", "a", "b").count() == 0


def test_overlaps_without_points(spark, narrow_ranges):
    rng = random.Random(10)
    rows = [("hot", a := rng.randint(0, 10**6), a + rng.randint(0, 600), k) for k in range(800)] + [("b", 1, 9, 1), ("b", 10, 12, 2), ("b", 12, 13, 3), (None, 1, 5, 4), (None, 2, 3, 5)]
    df = spark.createDataFrame(rows, "k string, a long, b long, i int").repartition(4)
    expected = []
    for k in ("hot", "b", None):
        reached = None
        for _, a, b, i in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            if reached is not None and reached >= a:
                expected.append(i)
            reached = b if reached is None else max(reached, b)
    assert sorted(r.i for r in joins.overlapping_intervals(df, ["k"], "a", "b").collect()) == sorted(expected)


def test_sums_of_digits_are_rounded_once_or_not_told(spark):
    rng = random.Random(21)
    kinds = [lambda: rng.random() * 1e5, lambda: rng.gauss(0, 3), lambda: rng.random() / 4, lambda: rng.choice([1e9, -1e9, 0.1, -0.1]), lambda: float(rng.randint(-9, 9)), lambda: rng.choice([0.5, 2.0**-54, -0.5, 2.0]), lambda: rng.choice([1e300, 1e-300, 1.0]), lambda: rng.choice([float("nan"), None, 2.0])]
    groups = {g: [kinds[g % len(kinds)]() for _ in range(rng.randint(1, 30))] for g in range(400)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double")
    found = df.withColumns(exact.digits(F.col("v"), "_v")).groupBy("g").agg(*(c.alias(k) for k, c in exact.added("_v").items())).select("g", exact.told("_v").alias("s"))
    out = {r.g: r.s for r in found.collect()}
    assert all(out[g] is None or out[g] == math.fsum(v for v in vs if v is not None) for g, vs in groups.items())
    assert all(out[g] is not None for g in groups if g % len(kinds) in (0, 4))
    odd = {g for g, vs in groups.items() if any(v is not None and (v != v or abs(v) in (1e300, 1e-300)) for v in vs)}
    assert all(out[g] is None for g in odd)


def test_shares_are_the_same_in_windows_and_apart(spark, monkeypatch):
    rng = random.Random(22)
    weights = {0: lambda: float(rng.randint(1, 50)), 1: lambda: rng.choice([0.0, 1.0]), 2: lambda: rng.random() * 1e-30, 3: lambda: rng.choice([1e200, 3.0]), 4: lambda: rng.choice([None, 2.0]), 5: lambda: rng.random()}
    rows = [(g if g % 11 else None, k, weights[g % 6](), None if g == 13 else g * 97.31 + 0.07) for g in range(1, 60) for k in range(rng.randint(1, 9))]
    rows = [(*r[:3], 5.25 if r[0] is None else r[3]) for r in rows]
    rows = [(b, k, w, c) for k, (b, _, w, c) in enumerate(rows)]
    df = spark.createDataFrame(rows, "b int, k int, w double, cost double").repartition(3)
    out = {r.k: (r.b, r.share) for r in usage.allocate(df, ["b"], ["k"], "w", "cost").collect()}
    apart = {r.k: (r.b, r.share) for r in usage.allocate(df, ["b"], ["k"], "w", "cost", group_rows=1).collect()}
    assert len(out) == len(rows) and out == apart
    calls = []
    monkeypatch.setattr(exact, "exact_sums", lambda *a, **k: calls.append(a))
    plain = usage.allocate(df.where("b % 6 = 0"), ["b"], ["k"], "w", "cost")
    assert usage.ledger_violations(plain, ["b"], "share", "cost", df.where("b % 6 = 0"), "k").count() == 0
    assert calls == []  # sums of usual amounts are made in the batch's own window


def test_equal_intervals_go_by_their_ties(spark, tmp_path):
    from panelyard.plans import QUERIES

    day = "timestamp '1994-01-01'"
    # orders of one group and day whose keys agree modulo 100000 and 7: equal spans, the least key is the earlier one
    spark.range(40).selectExpr("(39 - id) * 700000 + 6 as o_orderkey", "3L as o_custkey", f"{day} as o_orderdate").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    out = {r.o_orderkey: r.reached for r in QUERIES["overlapping_intervals"](spark, str(tmp_path)).collect()}
    assert sorted(out) == [k * 700000 + 6 for k in range(1, 40)] and len(set(out.values())) == 1


def test_panels_from_sql_equal_those_of_dataframes(spark):
    from panelyard.functions import tables

    tables.register(spark)
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]), str(rng.randint(0, 9)), rng.random(), "x") for _ in range(200)] + [("c", "NaN", 1.0, "x"), ("a", "word", 1.0, "x"), ("a", None, 2.0, "x")]
    df = spark.createDataFrame(rows, "g string, p string, r double, n string")
    df.createOrReplaceTempView("panel_rows")
    out = spark.sql("select * from panel_scores(rows => table(panel_rows) partition by g, panel => 'g', prediction => 'p', reference => 'r')")
    assert out.schema.simpleString() == "struct<g:string,n:bigint,spearman_rho:double,pearson_r:double>"
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, map(tuple, stats.panel_correlations(df.select("g", "p", "r"), ["g"], "p", "r").collect())))
    with pytest.raises(Exception, match="not a column of the table"):
        spark.sql("select * from panel_scores(rows => table(panel_rows) partition by g, panel => 'h', prediction => 'p', reference => 'r')").collect()


def test_packed_panels_from_sql(spark):
    from panelyard.functions import tables

    tables.register(spark)
    rng = random.Random(13)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, float("nan"), float(rng.randint(0, 9))]), rng.choice([None, rng.random()])) for _ in range(300)] + [(3, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, p double, r double").repartition(3)
    call = "select * from panel_scores(rows => table({rows}) partition by g, panel => 'g', prediction => 'p', reference => 'r')"
    whole = sorted(map(repr, map(tuple, spark.sql(call, rows=df).collect())))
    for most in (1, 7, 1000):
        packs = tables.packed(df, "g", "p", "r", most)
        assert packs.selectExpr("max(size(p))").first()[0] <= most and packs.selectExpr("sum(size(p))").first()[0] == len(rows)
        assert sorted(map(repr, map(tuple, spark.sql(call, rows=packs).collect()))) == whole
