"""Payloads, displays, assemblies, and joins that must meet exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import parsing, payloads, sequence
from panelyard.operators import checks, selection, stats
from panelyard.plans.registry import query, table


@query("""
select event_id, case when event_type = 'error' then 'failed ' || event_id when event_id % 5 = 0 then 'no_choices' when event_id % 7 = 0 then 'no_finish_reason' end as error,
       case event_id % 4 when 0 then 'direct' when 1 then 'meta' when 2 then 'endpoint' end as provider, case event_id % 3 when 0 then 'why' when 1 then 'one' || chr(10) || 'two' end as reasoning from events
""")
def response_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses built from events: some direct, some as batch items, with the fields in different places."""
    k, t = F.col("event_id"), F.col("event_id").cast("string")
    error = F.when(F.col("event_type") == "error", F.concat(F.lit('"error":{"message":"failed '), t, F.lit('"}')))
    choices = F.when(k % 5 == 0, F.lit('"choices":[]')).when(k % 7 == 0, F.lit('"choices":[{"text":"x"}]')).otherwise(F.lit('"choices":[{"finish_reason":"stop"}]'))
    who = F.when(k % 4 == 0, F.lit('"provider":"direct"')).when(k % 4 == 1, F.lit('"gateway_metadata":{"provider":"meta"}')).when(k % 4 == 2, F.lit('"gateway_metadata":{"endpoints":[{"provider":"endpoint"}]}'))
    body = F.concat(F.lit("{"), F.concat_ws(",", error, choices, who), F.lit("}"))
    payload = F.when(k % 2 == 0, F.concat(F.lit('{"response":{"body":'), body, F.lit("}}"))).otherwise(body)
    message = F.when(k % 3 == 0, F.lit('{"reasoning":"why"}')).when(k % 3 == 1, F.lit('{"reasoning":" ","reasoning_details":[{"type":"a","text":"one"},{"type":"b","summary":"two"},{"type":"c"}]}')).otherwise(F.lit("{}"))
    return table(spark, sf_dir, "events").select("event_id", payloads.response_error(payload).alias("error"), payloads.provider(payloads.unwrap(payload)).alias("provider"), payloads.reasoning(message).alias("reasoning"))


@query("""
with g as (select s_nationkey, string_agg('| ' || s_suppkey || ' | ' || s_nationkey || ' |', chr(10) order by s_suppkey) as body, count(*) as n from supplier group by 1)
select s_nationkey, 'request_' || lpad(s_nationkey::varchar, 6, '0') as request_id, '| supplier | nation |' || chr(10) || '|---|---|' || chr(10) || body as segment_table, greatest(0.0, least(1.0, n / 4 - 0.5))::double as shown from g
""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"))))
    g = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(rows.alias("rows"))
    return g.select("s_nationkey", payloads.request_id(F.col("s_nationkey")).alias("request_id"), payloads.markdown_table(F.col("rows"), ["supplier", "nation"]).alias("segment_table"), payloads.display_score(F.size("rows") / 4 - 0.5).alias("shown"))


_DNA = "translate(sha256(doc_id::varchar), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"""
with d as (select doc_id, {_DNA} as s from documents), a as (select doc_id, s, substr(s, 1, 10) || substr(s, 31, (doc_id % 20)::int) || 'TT' as seq from d)
select doc_id, seq as sequence, 11::int as insert_start, (10 + doc_id % 20)::int as insert_stop, substr(s, 8, 5) || substr(s, 21, 10) || substr(s, 41, (doc_id % 9 + 1)::int) as coding,
       case when doc_id % 3 = 0 then 'missense' when doc_id % 3 = 1 then 'Ambiguous' else 'Unknown' end as consequence from a
""")
def assembled_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flank, an insert of varying length and a tail; coding bases over three exons; consequence terms reduced."""
    k, s = F.col("doc_id"), F.col("s")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.translate(F.sha2(k.cast("string"), 256), "0123456789abcdef", "ACGTACGTACGTACGT").alias("s"))
    whole = sequence.assembled(("flank", F.substring(s, 1, 10)), ("insert", F.substring(s, F.lit(31), (k % 20).cast("int"))), ("tail", F.lit("TT")))
    exons = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop")) for a, b in ((41, 60), (3, 12), (21, 30))])
    terms = F.when(k % 3 == 0, F.array(F.lit("missense"), F.lit("missense"))).when(k % 3 == 1, F.array(F.lit("missense"), F.lit("stop")))
    out = rows.withColumn("w", whole)
    return out.select("doc_id", F.col("w.sequence").alias("sequence"), F.col("w.segments")[1]["start"].alias("insert_start"), F.col("w.segments")[1]["stop"].alias("insert_stop"), sequence.spliced(s, exons, F.lit(8), 41 + k % 9).alias("coding"), sequence.consequence(terms).alias("consequence"))


@query("""
with n as (select s_nationkey as nation, count(*) as n from supplier group by 1)
select n_nationkey as nation, coalesce(n, 0)::bigint as n_rows from nation left join n on nation = n_nationkey where coalesce(n, 0) <> 1
""")
def not_exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return checks.not_exactly_one(nations, suppliers, ["nation"])


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 3")
def nth_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third order of each customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return selection.best_per_group(orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], rank="repeat").where("repeat = 3").select("o_custkey", "o_orderkey")


@query("""
select c_custkey, arg_min(o_orderkey, (if(o_orderstatus = 'O', 0, 1), o_orderdate, o_orderkey)) as o_orderkey from customer left join orders on o_custkey = c_custkey group by c_custkey
""")
def default_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first open order, else the first of all, null without any."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_orderstatus")
    order = [F.when(F.col("o_orderstatus") == "O", 0).otherwise(1), F.asc("o_orderdate"), F.asc("o_orderkey")]
    return table(spark, sf_dir, "customer").select("c_custkey").join(selection.best_per_group(orders, ["c_custkey"], order).select("c_custkey", "o_orderkey"), "c_custkey", "left")


@query("""
with r as (select p_brand, p_type, rank() over (partition by p_brand order by round(p_retailprice, 0)) + (count(*) over (partition by p_brand, round(p_retailprice, 0)) - 1) / 2.0 as rank, p_partkey from part)
select p_partkey, rank as average_rank from r
""")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.round("p_retailprice", 0).alias("v"))
    return parts.select("p_partkey", stats.average_rank("v", ["p_brand"]).alias("average_rank"))


@query("""
select o_custkey, count(distinct o_orderpriority) as n_models, count(*) as n_points, count(*) filter (isfinite(o_totalprice)) as n_finite, min(o_orderdate) as started_at, max(o_orderdate) as completed_at,
       strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') as completed_text from orders group by 1
""")
def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.functions.temporal import iso_utc

    finite = checks.finite("o_totalprice").isNotNull()
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n_models"), F.count("*").alias("n_points"), F.count_if(finite).alias("n_finite"), F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("completed_at"))
    return g.withColumn("completed_text", iso_utc(F.col("completed_at")))


@query("""
with n as (select s_nationkey as nation, count(*) as n from supplier group by 1)
select n_nationkey as nation, coalesce(n, 0)::bigint as n_rows from nation left join n on nation = n_nationkey where coalesce(n, 0) <> 1
""")
def not_exactly_one_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    return checks.not_exactly_one(nations, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), ["nation"])


@query(r"""
with p as (select page_id, url, if(page_id % 3 <> 0, regexp_extract(html, '(?s)<title>(.*?)</title>', 1), null) as t, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) as h from pages)
select page_id, coalesce(if(trim(t) <> '', t, null), if(trim(h) <> '', h, null), if(trim(url) <> '', url, null)) as label from p
""")
def nested_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label: its title where one is known, else its heading, else its address."""
    between = lambda tag: F.regexp_extract("html", f"(?s)<{tag}>(.*?)</{tag}>", 1)
    title = F.when(F.col("page_id") % 3 != 0, between("title"))
    return table(spark, sf_dir, "pages").select("page_id", parsing.first_text(title, between("h1"), F.col("url")).alias("label"))
