"""Reports over runs: guarded notes, recomputed figures, spans, group means, plans and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators import boards, checks, joins, selection, stats, strata, usage
from panelyard.plans.registry import query, r6, table
from panelyard.streaming import tables


@query("""
select doc_id, coalesce(contains(text, 'http') or contains(text, '@') or regexp_matches(text, '[0-9]{3}-[0-9]{4}'), false) as leaks from documents
""")
def leaking_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", checks.leaks(F.col("text"), ["http", "@"], "[0-9]{3}-[0-9]{4}").alias("leaks"))


@query("""
with own as (select o_custkey, count(*)::double as n, sum(floor(o_totalprice))::double as total from orders group by 1),
said as (select o_custkey, count(*)::double as n, sum(floor(o_totalprice))::double as total from orders where o_orderstatus <> 'P' group by 1),
p as (select o_custkey, 'n' as measure, s.n as reported, o.n as recomputed from own o full join said s using (o_custkey) union all select o_custkey, 'total', s.total, o.total from own o full join said s using (o_custkey))
select * from p where reported is distinct from recomputed
""")
def reported_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = {"n": F.count("*"), "total": F.sum(F.floor("o_totalprice"))}
    orders = table(spark, sf_dir, "orders")
    reported = orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(*(c.alias(n) for n, c in measures.items()))
    return checks.reported_breaches(orders, reported, ["o_custkey"], measures)


@query("""
select l_orderkey, l_linenumber, l_partkey, l_quantity, case when l_linenumber % 3 = p_size % 3 then p_brand end as p_brand, case when p_partkey is null then 'none' when l_linenumber % 3 = p_size % 3 then 'current' else 'stale' end as note
from lineitem left join (select * from part where p_size > 10) on p_partkey = l_partkey
""")
def guarded_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_linenumber") % 3).alias("digest"))
    notes = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 3).alias("digest"), "p_brand")
    return joins.guarded_left(lines, notes, ["l_partkey"], "digest", ["p_brand"]).drop("digest")


@query("""
with best as (select o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1)
select l_orderkey, count(*) as n, round(sum(l_quantity), 6) as quantity from lineitem where l_orderkey in (select o_orderkey from best) group by 1
""")
def lines_of_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = selection.best_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    own = joins.of_selected(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), best.select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])
    return own.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")).withColumn("quantity", r6("quantity"))


@query("""
select user_id, epoch_us(min(ts)) as started, epoch_us(max(ts)) as finished, case when min(event_type) = max(event_type) then min(event_type) else 'multiple' end as only_kind, bool_or(event_type = 'error') as any_failure from events group by 1
""")
def run_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = boards.span(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_type", F.col("event_type") == "error")
    return out.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("started", "finished")})


@query("""
with f as (select l_returnflag, l_partkey, min(l_linenumber) as s from lineitem group by 1, 2) select l_returnflag, count(*) as n_files, sum(s)::bigint as runtime from f group by 1
""")
def distinct_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.distinct_runtime(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey", "l_linenumber")


@query("""
with e as (select l_shipdate, l_linestatus, l_returnflag, l_quantity as m, case when l_linenumber < 5 then l_linenumber * 5 end as b from lineitem),
g as (select l_returnflag, l_linestatus, count(b) as n, avg(m) filter (b is not null) as x, avg(b) as y from e group by 1, 2)
select l_returnflag, l_linestatus, n, round(x, 6) as measured_mean, round(y, 6) as baseline_mean, round(x - y, 6) as shift from g
""")
def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("baseline", F.when(F.col("l_linenumber") < 5, F.col("l_linenumber") * 5))
    return stats.group_means(lines, ["l_returnflag", "l_linestatus"], "l_quantity", "baseline").withColumns({c: r6(c) for c in ("measured_mean", "baseline_mean", "shift")})


@query("""
with w as (select doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) as n from documents where text is not null)
select doc_id, round(list_avg(list_filter(n, lambda x: x > 3)), 6) as track_mean, case when len(n) >= 2 then (n[1] + n[2]) / 2 - 2.0 end::double as delta_mean from w
""")
def track_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.transform(F.split("text", " "), F.char_length).alias("n"))
    delta = F.when(F.size("n") >= 2, stats.delta_mean(F.slice("n", 1, 2), F.array(F.lit(1), F.lit(3))))
    return sizes.select("doc_id", F.round(stats.track_mean(F.col("n"), lambda x: x > 3), 6).alias("track_mean"), delta.alias("delta_mean"))


@query("""
select o_orderpriority, count(*) as n, count(*) filter (o_orderstatus = 'O') as n_open, count(*) filter (o_totalprice > 200000 and o_orderstatus <> 'O') as n_large from orders group by 1
""")
def planned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_open = F.col("o_orderstatus") == "O"
    return strata.planned_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], {"n_open": is_open, "n_large": (F.col("o_totalprice") > 200_000) & ~is_open})


@query("""
select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2
""")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour", "10 minutes")
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("""
select user_id, event_id as version, event_type as state from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1
""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("version"), F.col("event_type").alias("state"))
    return tables.latest_state(log, ["user_id"], "ts").drop("ts")


@query("select o_orderkey from orders where o_orderkey % 97 = 0")
def frozen_plan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    computed = saved.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 97 == 0, "changed").otherwise(F.col("o_orderpriority")))
    return tables.frozen_plan_changes(saved, computed, ["o_orderkey"]).select("o_orderkey")
