"""Ledgers, runs and boards, strata, cohorts, joins over intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions import temporal
from panelyard.operators import boards, joins, selection, stats, strata, usage
from panelyard.plans.panels import _CORRELATIONS
from panelyard.plans.registry import query, table


@query("""
with e as (select user_id, case when event_type <> 'error' then floor(value * 10)::bigint end as t, case when event_type <> 'error' then value end as c, event_type = 'view' as cut from events)
select user_id, count(*) as attempts, count(t) as known, case when count(t) = count(*) then sum(t) end::bigint as total_tokens, case when count(t) = count(*) then round(sum(c), 6) end as total_cost, coalesce(sum(t), 0)::bigint as known_tokens,
       case when count(t) = count(*) then max(t) end as max_tokens, count(*) filter (cut) as truncated from e group by user_id
""")
def null_poisoned_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("event_type") != "error"
    out = usage.execution_metrics(table(spark, sf_dir, "events"), ["user_id"], F.when(known, F.floor(F.col("value") * 10).cast("long")), F.when(known, F.col("value")), F.col("event_type") == "view")
    return out.withColumn("total_cost", F.round("total_cost", 6))


@query("""
with e as (select event_id, case when event_id % 3 = 0 then null else event_id % 50 end as total, case when event_id % 4 = 0 then null else event_id % 20 end as p, event_id % 10 - 1 as c from events)
select event_id, coalesce(total, case when c >= 0 then p + c end) as tokens from e
""")
def token_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", usage.total_tokens(F.when(k % 3 != 0, k % 50), F.when(k % 4 != 0, k % 20), k % 10 - 1).alias("tokens"))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    keyed = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "o_totalprice")
    return usage.allocate(keyed, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"], "l_quantity", "o_totalprice")


@query("""
with j as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, o_totalprice from lineitem join orders on o_orderkey = l_orderkey),
t as (select l_orderkey, sum(l_quantity) as q, count(*) as n from j group by 1),
w as (select j.*, row_number() over (partition by j.l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) = n as last, o_totalprice * l_quantity / q as s from j join t on t.l_orderkey = j.l_orderkey),
b as (select l_orderkey, sum(s) as others from w where not last group by 1)
select w.l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when last then o_totalprice - coalesce(others, 0) else s end + 0.000003, 4) as share from w left join b on b.l_orderkey = w.l_orderkey
""")
def proportional_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("share") + 0.000003, 4).alias("share"))


@query("""
with o as (select distinct l_orderkey as k from lineitem join orders on o_orderkey = l_orderkey)
select k as l_orderkey, rule from o join (values ('total_differs'), ('negative_share'), ('receipts_differ'), ('members_differ')) v(rule)
on (rule = 'total_differs' and k % 10 in (3, 4)) or (rule = 'negative_share' and k % 10 = 4) or (rule = 'receipts_differ' and k % 10 = 5 and k in (select l_orderkey from lineitem group by 1 having count(*) > 1 and count(distinct l_linenumber) > 1)) or (rule = 'members_differ' and k % 10 = 6)
""")
def ledger_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right shares break no rule; in some orders a share is too large or negative, receipts differ, or a member is missing."""
    shares, k = _shares(spark, sf_dir), F.col("l_orderkey") % 10
    least, most = (f("l_linenumber").over(Window.partitionBy("l_orderkey")) for f in (F.min, F.max))
    marked = shares.withColumns({"_least": least, "_most": most})
    first = F.col("l_linenumber") == F.col("_least")
    share = F.when((k == 3) & first, F.col("share") + 1).when((k == 4) & first, -F.col("o_totalprice")).otherwise(F.col("share"))
    receipt = F.when((k == 5) & first & (F.col("_least") < F.col("_most")), F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice"))
    # which of several equal receipts is compared with the sum is not the point here: the sum of such orders stays right
    wrong = marked.withColumns({"share": share, "o_totalprice": receipt})
    members = shares.select("l_orderkey", "l_linenumber").union(shares.where("l_orderkey % 10 = 6").groupBy("l_orderkey").agg(F.lit(99).alias("l_linenumber")))
    return usage.ledger_violations(wrong, ["l_orderkey"], "share", "o_totalprice", members, "l_linenumber")


@query("""
select o_custkey, o_orderkey, round(sum(o_totalprice) over w, 2) as spent, sum(o_totalprice) over w <= 500000 as within_budget from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)
""")
def budget_reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.budget_reserved(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 500_000.0)
    return out.select("o_custkey", "o_orderkey", F.round("spent", 2).alias("spent"), "within_budget")


@query("""
with e as (select user_id, event_type <> 'error' as done, value / 100 as v, case when event_type in ('click', 'purchase') then if(value > 50, 'correct', 'incorrect') else 'format_error' end as t from events)
select user_id, count(*) as attempted, count(*) filter (done) as completed, round(avg(v) filter (done), 6) as mean_score, count(*) filter (done and t = 'correct') as n_correct, count(*) filter (done and t = 'incorrect') as n_incorrect,
       count(*) filter (done and t = 'format_error') as n_format_error, count(*) filter (not done) as api_errors, round(count(*) filter (done and t <> 'format_error') / nullif(count(*) filter (done), 0), 6) as valid_rate, bool_and(done) as complete from e group by user_id
""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "purchase"), F.when(F.col("value") > 50, "correct").otherwise("incorrect")).otherwise("format_error")
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", "error").otherwise("completed").alias("status"), (F.col("value") / 100).alias("v"), kind.alias("t"))
    out = boards.run_metrics(rows, ["user_id"], "status", "v", "t", ["correct", "incorrect", "format_error"])
    return out.withColumns({"mean_score": F.round("mean_score", 6), "valid_rate": F.round("valid_rate", 6)})


@query("""
with p as (select c_nationkey, c_mktsegment, round(avg(c_acctbal), 6) as score from customer group by 1, 2), m as (select c_nationkey, count(*) as n_tasks, case when count(*) = 5 then round(avg(score), 6) end as macro_score from p group by 1)
select n_name, n_tasks, macro_score, row_number() over (order by macro_score desc nulls last, n_name)::int as position from m join nation on n_nationkey = c_nationkey
""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    customers = table(spark, sf_dir, "customer")
    per = customers.groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("score"))
    macro = boards.macro_average(per, ["c_nationkey"], "c_mktsegment", "score", segments).withColumn("macro_score", F.round("macro_score", 6))
    named = macro.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").drop("c_nationkey")
    return boards.leaderboard(named, "macro_score", ["n_name"])


@query("""
select l_suppkey, count(*) as n, round(avg((l_quantity > 45)::int), 6) as truncated_rate, case when count(l_tax) = count(*) then max(l_tax) end as max_tokens, string_agg(distinct l_returnflag, ',' order by l_returnflag) as limits from lineitem group by 1
""")
def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = boards.execution_summary(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_tax", F.col("l_quantity") > 45, "l_returnflag")
    return out.withColumn("truncated_rate", F.round("truncated_rate", 6))


_AXES = "select source, lang as language, case when n_chars < 500 then 'short' when n_chars < 5000 then 'middle' else 'long' end as length, doc_id % 10 as panel from documents"


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    return table(spark, sf_dir, "documents").select("source", F.col("lang").alias("language"), length.alias("length"), (F.col("doc_id") % 10).alias("panel"))


@query(f"""
with d as ({_AXES}), u as (select source, panel, 'language' as axis, language as category from d union all select source, panel, 'length', length from d),
p as (select source, panel, axis, category, count(*) as n from u group by all), h as (select source, axis, category, sum(n)::bigint as n_variants, count(*) as n_panels, count(*) filter (n >= 2) as n_eligible from p group by all),
g as (select * from (select distinct source, axis from p) join (select distinct axis, category from p) using (axis))
select g.source, g.axis, g.category, coalesce(n_variants, 0)::bigint as n_variants, coalesce(n_panels, 0)::bigint as n_panels, coalesce(n_eligible, 0)::bigint as n_eligible,
       case when coalesce(n_variants, 0) = 0 then 'absent' when n_eligible >= 3 then 'eligible' else 'insufficient' end as status from g left join h using (source, axis, category)
""")
def coverage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.coverage_plan(_axes(spark, sf_dir), "source", "panel", ["language", "length"], 2, 3)


@query(f"""
with d as ({_AXES}), n as (select source, lower(length) as category, count(*) as n from d group by all), k as (select source, if(category in ('short', 'middle'), category, 'Unknown') as category, sum(n) as n from n group by all),
g as (select * from (select distinct source from d) cross join (values ('short'), ('middle'), ('Unknown')) v(category))
select source, g.category, coalesce(n, 0)::bigint as n, round(coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by source), 6) as proportion from g left join k using (source, category)
""")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.composition(_axes(spark, sf_dir), "source", "length", ["short", "middle", "Unknown"]).withColumn("proportion", F.round("proportion", 6))


@query(f"""
with base as (select (l_suppkey, l_returnflag) as g, l_quantity as p, l_extendedprice as r from lineitem qualify count(*) over (partition by l_suppkey, l_returnflag) >= 120), {_CORRELATIONS}
select g[2] as l_returnflag, count(*) as n_panels, round(avg(spearman), 6) as mean_spearman from c group by 1
""")
def stratum_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice")
    panels = strata.eligible_panels(lines.withColumn("task", F.lit(1)), "task", "l_suppkey", "l_returnflag", 120).select("l_suppkey", "l_returnflag")
    chosen = lines.join(panels, ["l_suppkey", "l_returnflag"], "left_semi")
    per = stats.panel_correlations(chosen, ["l_suppkey", "l_returnflag"], "l_quantity", "l_extendedprice")
    return per.groupBy("l_returnflag").agg(F.count("*").alias("n_panels"), F.round(F.avg("spearman_rho"), 6).alias("mean_spearman"))


_RELATION = """
o as (select o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as d, case when o_custkey % 3 = 0 then '1998-06' when o_custkey % 3 = 1 then '1998-06-15' else '1998-13' end as cutoff, case when o_orderkey % 6 = 0 then '1996-01-01' when o_orderkey % 6 = 1 then 'soon' end as earlier from orders),
m as (select *, case when cutoff = '1998-13' then 'Unknown' when len(cutoff) = 10 then if(d <= cutoff, 'Before', 'After') when d[1:7] < cutoff then 'Before' when d[1:7] > cutoff then 'After' else 'Unknown' end as main from o),
r as (select *, case when earlier is null or main <> 'After' then main when earlier = 'soon' then 'Unknown' else 'Mixed' end as relation from m)
"""


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("o_custkey") % 3, F.col("o_orderkey") % 6
    cutoff = F.when(c == 0, "1998-06").when(c == 1, "1998-06-15").otherwise("1998-13")
    earlier = F.when(k == 0, "1996-01-01").when(k == 1, "soon")
    return table(spark, sf_dir, "orders").withColumn("relation", temporal.cutoff_relation(F.date_format("o_orderdate", "yyyy-MM-dd"), cutoff, earlier))


@query(f"with {_RELATION} select o_orderkey, relation from r")
def cutoff_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).select("o_orderkey", "relation")


@query(f"""
with {_RELATION}
select o_custkey, count(*) filter (relation = 'Before') as n_before, count(*) filter (relation = 'After') as n_after, count(*) filter (relation = 'Mixed') as n_mixed, count(*) filter (relation = 'Unknown') as n_unknown,
       round(avg(o_totalprice) filter (relation = 'Before'), 7) as mean_before, round(avg(o_totalprice) filter (relation = 'After'), 7) as mean_after,
       round(avg(o_totalprice) filter (relation = 'Before') - avg(o_totalprice) filter (relation = 'After'), 7) as difference from r group by o_custkey
""")
def cohort_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strata.cohort_difference(_relations(spark, sf_dir), ["o_custkey"], "relation", F.col("o_totalprice"))
    return out.withColumns({c: F.round(c, 7) for c in ("mean_before", "mean_after", "difference")})


def _seconds(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


@query("""
with e as (select event_id, user_id, epoch_us(ts) // 1000000 as s, event_type from events), w as (select event_id as window_id, user_id, s - 21600 as a, s + 21600 as b from e where event_type = 'purchase')
select event_id, window_id from e join w using (user_id) where s between a and b
""")
def containment_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", _seconds("ts").alias("s"), "event_type")
    windows = events.where("event_type = 'purchase'").select(F.col("event_id").alias("window_id"), "user_id", (F.col("s") - 21_600).alias("a"), (F.col("s") + 21_600).alias("b"))
    return joins.containment_join(events.drop("event_type"), windows, ["user_id"], "s", None, "a", "b").select("event_id", "window_id")


@query("""
with o as (select o_orderkey, o_custkey % 4 as k, datediff('day', date '1970-01-01', o_orderdate::date) as a, datediff('day', date '1970-01-01', o_orderdate::date) + o_orderkey % 60 as b from orders),
f as (select k, 'q' || q as feature, min(a) as c, max(a) as d from (select *, year(o_orderdate) * 4 + quarter(o_orderdate) as q from (select o_custkey % 4 as k, datediff('day', date '1970-01-01', o_orderdate::date) as a, o_orderdate from orders)) group by k, q)
select o_orderkey, string_agg(feature, ',' order by feature) as features from o join f using (k) where a <= d and c <= b group by 1
""")
def feature_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    quarter = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("k"), day.alias("a"), (day + F.col("o_orderkey") % 60).alias("b"), quarter.alias("q"))
    features = orders.groupBy("k", F.concat(F.lit("q"), "q").alias("feature")).agg(F.min("a").alias("c"), F.max("a").alias("d"))
    pairs = joins.overlap_join(orders.drop("q"), features, ["k"], ("a", "b"), ("c", "d"))
    return pairs.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("features"))


@query("""
with q as (select 'AUTOMOBILE' as seg, 0.0 as a, 1999.99 as b, 'low' as element union all select 'AUTOMOBILE', 4000, 6999.99, 'high' union all select 'BUILDING', -500, 500, 'mid')
select c_custkey, coalesce(element, 'other') as element, (element is not null)::bigint as n_matches from customer left join q on c_mktsegment = seg and c_acctbal between a and b
""")
def element_of_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    intervals = spark.createDataFrame([("AUTOMOBILE", 0.0, 1999.99, "low"), ("AUTOMOBILE", 4000.0, 6999.99, "high"), ("BUILDING", -500.0, 500.0, "mid")], "c_mktsegment string, a double, b double, element string")
    out = joins.at_most_one_interval(table(spark, sf_dir, "customer"), intervals, ["c_mktsegment"], "c_acctbal", "a", "b", "element", ["c_custkey"])
    return out.select("c_custkey", "element", F.col("n_matches").cast("long").alias("n_matches"))


@query("""
with s as (select c_nationkey, c_mktsegment, round(max(c_acctbal), 2) as v from customer group by 1, 2)
select c_nationkey, arg_min(c_mktsegment, (v, c_mktsegment)) as lowest, arg_max(c_mktsegment, (v, c_mktsegment)) as highest from s group by 1
""")
def composite_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.max("c_acctbal"), 2).alias("v"))
    key = F.struct("v", "c_mktsegment")
    return per.groupBy("c_nationkey").agg(F.min_by("c_mktsegment", key).alias("lowest"), F.max_by("c_mktsegment", key).alias("highest"))


@query("select o_orderkey, o_orderpriority from orders order by list_position(['2-HIGH', '1-URGENT'], o_orderpriority) nulls last, o_orderpriority, o_orderkey limit 40")
def custom_order_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.array_position(F.array(F.lit("2-HIGH"), F.lit("1-URGENT")), F.col("o_orderpriority"))
    return selection.slice_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), [F.when(place > 0, place).asc_nulls_last(), F.asc("o_orderpriority"), F.asc("o_orderkey")], 0, 40)


@query("""
select conv_id, count(*) as n_parts, sha256(string_agg(text, '' order by turn, role, text)) as text_sha256, sum(length(text))::bigint as n_chars, max(turn) = count(*) - 1 as whole from conversations group by conv_id
""")
def ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of a message folded in their order."""
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["text"]), "")
    last = F.element_at("p", -1)["turn"]
    return parts.select("conv_id", F.size("p").cast("long").alias("n_parts"), F.sha2(whole, 256).alias("text_sha256"), F.char_length(whole).cast("long").alias("n_chars"), (last == F.size("p") - 1).alias("whole"))




@query("""
with i as (select user_id, case when event_id % 6 <> 0 then floor(value)::bigint end as t, user_id * 40 as receipt, user_id % 5 = 0 as split from events),
g as (select user_id, coalesce(sum(t), 0)::bigint as known, count(t) = count(*) as every, max(receipt) as receipt, bool_or(split) as split from i group by 1),
s as (select *, case when every then 'items' when split then 'unknown' when receipt < known then 'inconsistent' else 'receipt' end as total_source from g)
select user_id, known, case total_source when 'items' then known when 'receipt' then receipt end as total_tokens, total_source from s
""")
def attempt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 6 != 0, F.floor("value").cast("long")).alias("t"), (F.col("user_id") * 40).alias("receipt"), (F.col("user_id") % 5 == 0).alias("split"))
    return usage.attempt_totals(items, "user_id", "t", "receipt", "split")


@query("""
select event_id, event_type from events where event_type in ('view', 'signup') and value > 60 and not (value > 90)
""")
def invalid_truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_type").isin("view", "signup") & (F.col("value") > 60), "length").otherwise("stop").alias("finish"), (F.col("value") > 90).alias("valid"))
    return usage.invalid_truncations(rows, "finish", "valid").select("event_id", "event_type")


@query("""
with e as (select row_number() over (order by s_nationkey, s_suppkey) as place, s_suppkey as expected from supplier), w as (select row_number() over (order by s_nationkey, s_suppkey) as place, s_suppkey + (s_nationkey = 4)::int as written from supplier where s_nationkey < 10)
select place::int as place, expected, written from w left join e using (place) where written is distinct from expected
""")
def prefix_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.asc("s_nationkey"), F.asc("_id")]
    suppliers = table(spark, sf_dir, "supplier").withColumn("_id", F.col("s_suppkey"))
    written = suppliers.where("s_nationkey < 10").withColumn("s_suppkey", F.col("s_suppkey") + (F.col("s_nationkey") == 4).cast("int"))
    return selection.prefix_mismatches(suppliers, written, order, "s_suppkey", order)


@query("""
with o as (select o_orderkey, o_custkey % 4 as k, datediff('day', date '1970-01-01', o_orderdate::date) as a, datediff('day', date '1970-01-01', o_orderdate::date) + o_orderkey % 60 as b, year(o_orderdate) * 12 + month(o_orderdate) as m from orders),
f as (select k, 'm' || m as feature, min(a) as c, max(a) as d from o group by k, m)
select o_orderkey, string_agg(feature, ',' order by feature) as features from o join f using (k) where a <= d and c <= b group by 1
""")
def feature_overlap_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders against the spans of all months: no feature is left out."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("k"), day.alias("a"), (day + F.col("o_orderkey") % 60).alias("b"), month.alias("m"))
    features = orders.groupBy("k", F.concat(F.lit("m"), "m").alias("feature")).agg(F.min("a").alias("c"), F.max("a").alias("d"))
    pairs = joins.overlap_join(orders.drop("m"), features, ["k"], ("a", "b"), ("c", "d"))
    return pairs.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("features"))
