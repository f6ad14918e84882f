"""Records: eligibility, duplicates, reconciliation, ladders, merges, resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import digests, parsing
from panelyard.operators import boards, checks, joins, selection
from panelyard.plans.registry import query, table
from panelyard.sources import writers


@query("""
with d as (select case when l.doc_id is null then 'unmeasured' when trim(coalesce(text, '')) = '' then 'missing_text' when lang <> 'en' then 'other_language' when n_chars < 200 then 'too_short' end as reason
           from documents left join labels l using (doc_id))
select coalesce(reason, 'kept') as reason, count(*) as n_rows from d group by 1
""")
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    cascade = [("unmeasured", F.col("quality").isNull()), ("missing_text", F.trim(F.coalesce("text", F.lit(""))) == ""), ("other_language", F.col("lang") != "en"), ("too_short", F.col("n_chars") < 200)]
    return checks.reason_counts(joined.withColumn("reason", checks.reasons(cascade)), "reason")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem qualify count(*) over (partition by l_orderkey, l_linenumber) = 1")
def exclude_all_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return checks.exclude_all_duplicates(lines, ["l_orderkey", "l_linenumber"])


@query("select sha256(text) as digest, count(*) as n_rows from documents group by 1 having count(*) > 1")
def duplicated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicated_keys(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")), ["digest"])


@query("select p_brand, count(distinct p_type) as n_values from part group by 1 having count(distinct p_type) > 1")
def dependency_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.dependency_breaches(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("""
with l as (select l_orderkey as k, round(sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)), 2) as v from lineitem group by 1), o as (select o_orderkey as k, o_totalprice as v from orders)
select k as o_orderkey, round(o.v, 2) as left_value, l.v as right_value, round(o.v - l.v, 2) as difference,
       case when l.k is null then 'only_left' when o.k is null then 'only_right' when abs(o.v - l.v) <= 1000 then 'matched' else 'differs' end as status
from o full join l using (k)
""")
def reconcile_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))), 2).alias("o_totalprice"))
    out = checks.reconcile(table(spark, sf_dir, "orders"), lines, ["o_orderkey"], "o_totalprice", 1000.0)
    return out.select("o_orderkey", F.round("left_value", 2).alias("left_value"), "right_value", F.round("difference", 2).alias("difference"), "status")


@query("""
with o as (select o_orderkey as k, round(o_totalprice, 2) as v from orders where o_orderkey % 7 <> 0), l as (select o_orderkey as k, round(o_totalprice, 2) + (o_orderkey % 5 = 0)::int as v from orders where o_orderkey % 11 <> 0)
select count(*) filter (o.k is not null and l.k is not null) as n_matched, count(*) filter (o.v = l.v) as n_exact, count(*) filter (abs(o.v - l.v) <= 1e-6) as n_close, count(*) filter (l.k is null) as n_only_left,
       count(*) filter (o.k is null) as n_only_right, round(max(abs(o.v - l.v)), 6) as max_difference from o full join l using (k)
""")
def score_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("v"))
    moved = orders.where("k % 11 <> 0").withColumn("v", F.col("v") + (F.col("k") % 5 == 0).cast("int"))
    both = checks.reconcile(orders.where("k % 7 <> 0"), moved, ["k"], "v", 1e-6)
    inside = F.col("status").isin("matched", "differs")
    return both.agg(F.count_if(inside).alias("n_matched"), F.count_if(inside & (F.col("left_value") == F.col("right_value"))).alias("n_exact"), F.count_if(F.col("status") == "matched").alias("n_close"), F.count_if(F.col("status") == "only_left").alias("n_only_left"), F.count_if(F.col("status") == "only_right").alias("n_only_right"), F.round(F.max(F.abs("difference")), 6).alias("max_difference"))


@query("""
with v as (select event_id, event_type, ts, value, user_id from events)
select rule, key from (
  select 'value_not_negative' as rule, event_id::varchar as key from v where not coalesce(value >= 0, false)
  union all select 'known_type', event_id::varchar from v where event_type not in ('signup', 'click', 'view', 'purchase')
  union all select 'even_user', event_id::varchar from v where not (user_id % 2 = 0))
""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"value_not_negative": F.col("value") >= 0, "known_type": F.col("event_type").isin("signup", "click", "view", "purchase"), "even_user": F.col("user_id") % 2 == 0}
    return checks.violations(table(spark, sf_dir, "events"), F.col("event_id"), rules)


@query("""
with n as (select c_nationkey as k, count(*) as v from customer group by 1), s as (select s_nationkey as k, count(*) * 15 as v from supplier where s_nationkey <> 3 group by 1)
select k as nation, case when s.k is null then 'missing' when n.k is null then 'stale' else 'changed' end as problem from n full join s using (k) where n.v is distinct from s.v
""")
def set_difference_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("v"))
    suppliers = table(spark, sf_dir, "supplier").where("s_nationkey <> 3").groupBy(F.col("s_nationkey").alias("nation")).agg((F.count("*") * 15).alias("v"))
    return checks.inventory_difference(customers, suppliers, ["nation"], "v")


@query("""
with c as (select o_orderkey from orders where o_orderstatus = 'F' union all select o_orderkey from orders where o_orderpriority = '1-URGENT' union all select o_orderkey + 10000000 from orders where o_orderkey % 1000 = 0),
n as (select o_orderkey, count(*) as n from c group by 1)
select coalesce(n.o_orderkey, o.o_orderkey) as o_orderkey, case when n is null then 'missing' when o.o_orderkey is null then 'extra' else 'duplicate' end as problem
from n full join orders o on n.o_orderkey = o.o_orderkey where n is null or o.o_orderkey is null or n > 1
""")
def merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    chunks = [orders.where("o_orderstatus = 'F'").select("o_orderkey"), orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey"), orders.where("o_orderkey % 1000 = 0").select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"))]
    return checks.merge_chunks(chunks, "o_orderkey", orders)[1]


@query("""
with w as (select o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as previous_at from orders)
select o_custkey, o_orderkey, o_orderdate, previous_at from w where previous_at > o_orderdate
""")
def chronology_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are older than the one before them by key."""
    return checks.chronology_breaches(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("""
with w as (select l_orderkey, l_partkey, l_linenumber, l_quantity, lag(l_linenumber) over (partition by l_orderkey order by l_shipdate, l_partkey, l_linenumber, l_quantity) as previous from lineitem)
select l_orderkey, l_linenumber, previous from w where previous >= l_linenumber
""")
def not_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_shipdate", "l_partkey", "l_linenumber", "l_quantity"]
    return selection.not_increasing(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, "l_linenumber").select("l_orderkey", "l_linenumber", "previous")


@query("""
with s as (select n_nationkey, 'own-' || n_nationkey as rule from nation where n_nationkey % 4 = 0), d as (select r_regionkey as n_regionkey, 'region-' || r_name as rule from region where r_regionkey <> 2)
select n_nationkey, n_name, coalesce(s.rule, d.rule) as rule, case when s.rule is not null then 'record' when d.rule is not null then 'family' else 'none' end as rule_source from nation left join s using (n_nationkey) left join d using (n_regionkey)
""")
def coalesced_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    own = nations.where("n_nationkey % 4 = 0").select("n_nationkey", F.concat(F.lit("own-"), F.col("n_nationkey").cast("string")).alias("rule"))
    default = table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("region-"), "r_name").alias("rule"))
    return joins.coalesced_rule(nations, own, default, "n_nationkey", "n_regionkey", "rule").select("n_nationkey", "n_name", "rule", "rule_source")


@query("select n_nationkey, n_name from nation where n_nationkey not in (select c_nationkey from customer where c_mktsegment = 'BUILDING' and c_acctbal < -900)")
def unused_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal < -900").select(F.col("c_nationkey").alias("n_nationkey"))
    return joins.unused_rules(poor, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("""
with s as (select c_custkey, case when c_custkey % 9 = 0 then null else c_nationkey end as nation, case when c_custkey % 8 = 0 then null else c_custkey % 5 end as level, c_acctbal < -900 as excluded from customer),
e as (select s_nationkey as nation, s_suppkey % 5 as level from supplier where s_nationkey <> 7),
a as (select nation, count(*) as n from e group by 1), x as (select nation, level, count(*) as n from e group by 1, 2)
select c_custkey, case when excluded then 'excluded' when s.nation is null then 'no_identity' when a.n is null then 'no_configuration' when s.level is null then 'level_not_reported' when x.n is null then 'no_exact_level'
       when x.n > 1 then 'ambiguous' else 'exact' end as match_status
from s left join a on a.nation = s.nation left join x on x.nation = s.nation and x.level = s.level
""")
def exact_match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey")).alias("nation"), F.when(F.col("c_custkey") % 8 != 0, F.col("c_custkey") % 5).alias("level"), (F.col("c_acctbal") < -900).alias("excluded"))
    entries = table(spark, sf_dir, "supplier").where("s_nationkey <> 7").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 5).alias("level"))
    return joins.match_ladder(scores, entries, "nation", "level", F.col("excluded")).select("c_custkey", "match_status")


@query("select o_custkey from orders where o_orderstatus in ('F', 'O', 'P') group by 1 having count(distinct o_orderstatus) = 3")
def completeness_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.complete_divisors(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


@query("""
select k.o_custkey, s.o_orderstatus from (select distinct o_custkey from orders) k cross join (values ('F'), ('O'), ('P')) s(o_orderstatus)
where not exists (from orders o where o.o_custkey = k.o_custkey and o.o_orderstatus = s.o_orderstatus)
""")
def missing_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.missing_expected(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("""
with n as (select *, lead(event_type) over w as next_type, lead(value) over w as next_value from events window w as (partition by user_id order by ts, event_id))
select event_id, case when event_type = 'error' and next_type <> 'error' then next_type else event_type end as event_type, round(case when event_type = 'error' and next_type <> 'error' then next_value else value end, 6) as value,
       coalesce(event_type = 'error' and next_type <> 'error', false) as replaced from n
""")
def retry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    after = joins.next_event(events, ["user_id"], ["ts", "event_id"], ["event_type", "value"])
    fresh = after.where("event_type = 'error' and next_event_type <> 'error'").select("event_id", F.col("next_event_type").alias("event_type"), F.col("next_value").alias("value"))
    return joins.upsert(events, fresh, ["event_id"], ["event_type", "value"]).select("event_id", "event_type", F.round("value", 6).alias("value"), "replaced")


@query("select user_id, count(*) as n_failed, string_agg(event_id, ',' order by ts, event_id) as event_ids from events where event_type = 'error' group by user_id")
def failed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").where("event_type = 'error'")
    found = joins.attempts(failed, ["user_id"], ["ts", "event_id"], ["value"])
    return found.select("user_id", F.size("attempts").cast("long").alias("n_failed"), F.array_join(F.transform("attempts", lambda a: a["event_id"].cast("string")), ",").alias("event_ids"))


@query("select o_orderkey, o_custkey, o_orderdate from orders where o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') order by o_orderdate, o_orderkey limit 500")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return selection.pending(orders.drop("o_orderstatus"), orders.where("o_orderstatus = 'F'"), ["o_orderkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 500)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.slice_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100, 50)


@query("""
select a.vec_id, unnest(range(0, 64)) as position, unnest(a.embedding) as left_value, unnest(b.embedding) as right_value from embeddings a join embeddings b on b.vec_id = a.vec_id + 1
""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    shifted = vectors.withColumn("vec_id", F.col("vec_id") - 1)
    return joins.positional_zip(vectors, shifted, "vec_id", "embedding").withColumn("position", F.col("position").cast("long"))


@query("""
select doc_id, lang, source from documents where lang = 'en' and (lower(source) like '%src1%' or lower(text) like '%src1%')
""")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.facet_filter(table(spark, sf_dir, "documents"), {"lang": "en", "source": None}, "SRC1", ["source", "text"]).select("doc_id", "lang", "source")


_ANSWERS = "text || chr(10) || 'FINAL: ' || role || chr(10) || 'final: no' || chr(10) || 'FINAL: ' || role || turn || '  ' || chr(13) || chr(10) || case when turn % 3 = 0 then 'FINAL: two words' else 'end' end"


@query(rf"select conv_id, turn, list_extract(regexp_extract_all({_ANSWERS}, '(?m)^FINAL:[ \t]*([A-Za-z0-9_.-]+)[ \t]*\r?$', 1), -1) as answer from conversations")
def final_line_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit("\nFINAL: "), "role", F.lit("\nfinal: no\nFINAL: "), "role", F.col("turn").cast("string"), F.lit("  \r\n"), F.when(F.col("turn") % 3 == 0, "FINAL: two words").otherwise("end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.last_choice(text).alias("answer"))


@query("""
with e as (select event_id, round(value, 3) as v, case when event_id % 7 = 0 then 'duplicate id' when event_id % 5 = 0 then 'not finite: NaN' when event_id % 3 = 0 then 'missing: b' end as parse_error from events)
select event_id, parse_error is null as valid, case when parse_error is null then v else 0.0 end as value, parse_error from e
""")
def final_line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict final objects built from events: some with a duplicate id, a missing id, or a constant that isn't finite."""
    value = F.round("value", 3).cast("string")
    body = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"a":1,"a":'), value, F.lit("}"))).when(F.col("event_id") % 5 == 0, F.lit('{"a":NaN,"b":1}')).when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a":'), value, F.lit("}"))).otherwise(F.concat(F.lit('{"a":'), value, F.lit(',"b":2}')))
    parsed = table(spark, sf_dir, "events").select("event_id", parsing.last_scores(F.concat(F.lit("so\nFINAL: "), body, F.lit("\nFINAL: {broken"))).alias("p"))
    error = parsing.answer_error(F.col("p.scores"), F.col("p.error"), F.array(F.lit("a"), F.lit("b")))
    return parsed.select("event_id", error.isNull().alias("valid"), F.when(error.isNull(), F.col("p.scores")["a"]).otherwise(0.0).alias("value"), error.alias("parse_error"))


@query("""
with t as (select case when event_type = 'error' or value > 95 then 'refusal' when event_type in ('click', 'purchase') then case when value > 50 then 'correct' else 'incorrect' end when event_type = 'signup' then 'token_limit' else 'format_error' end as result_type, user_id from events)
select user_id, result_type, count(*) as n from t group by 1, 2
""")
def result_type_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    finish = F.when(F.col("value") > 95, "content_filter").when(F.col("event_type") == "signup", "length").otherwise("stop")
    kind = parsing.result_type(F.col("event_type") == "error", F.col("event_type").isin("click", "purchase"), F.col("value") > 50, finish)
    return events.groupBy("user_id", kind.alias("result_type")).agg(F.count("*").alias("n"))


@query("""
select o_custkey, sha256('{"profile":"' || string_agg(distinct o_orderstatus, ',' order by o_orderstatus) || '","provider":"' || case when min(o_orderpriority) = max(o_orderpriority) then min(o_orderpriority) else 'multiple' end || '","run":"' || o_custkey || '"}') as configuration_key,
       string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as profile, case when min(o_orderpriority) = max(o_orderpriority) then min(o_orderpriority) else 'multiple' end as provider from orders group by o_custkey
""")
def config_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("profile"), boards.collapse("o_orderpriority").alias("provider"))
    return runs.select("o_custkey", digests.configuration_key(run=F.col("o_custkey"), profile=F.col("profile"), provider=F.col("provider")).alias("configuration_key"), "profile", "provider")


@query("""
select event_id, sha256('{"id":' || event_id || ',"k":' || (props->>'$.k') || ',"seen":{"by":' || case when event_id % 4 = 1 then 'null' else '"u' || (event_id % 9) || '"' end || ',"share":' || case event_id % 3 when 0 then 'null' when 1 then '0.5' else '-2.0' end || '},"type":"' || event_type || '"}') as digest from events
""")
def canonical_record_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with null fields at two depths."""
    k = F.col("event_id")
    seen = F.struct(F.when(k % 3 == 1, F.lit(0.5)).when(k % 3 == 2, F.lit(-2.0)).alias("share"), F.when(k % 4 != 1, F.concat(F.lit("u"), (k % 9).cast("string"))).alias("by"))
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("long").alias("k"), k.alias("id"), seen.alias("seen"))
    return writers.canonical_lines(events, "id").select(F.col("key").alias("event_id"), F.sha2("line", 256).alias("digest"))
