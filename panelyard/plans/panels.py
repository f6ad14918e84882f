"""Panels: correlations, spreads, sampling, selection, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import tables
from panelyard.operators import boards, sampling, selection, stats
from panelyard.plans.registry import query, r6, table

_CORRELATIONS = """
x as (select *, rank() over (partition by g order by p) + (count(*) over (partition by g, p) - 1) / 2.0 as rp, rank() over (partition by g order by r) + (count(*) over (partition by g, r) - 1) / 2.0 as rr from base),
c as (select g, count(*) as n, case when min(p) = max(p) or min(r) = max(r) then 0.0 else covar_pop(rp, rr) / (stddev_pop(rp) * stddev_pop(rr)) end as spearman,
      case when min(p) = max(p) or min(r) = max(r) then 0.0 else covar_pop(p, r) / (stddev_pop(p) * stddev_pop(r)) end as pearson from x group by g)
"""


@query(f"""
with base as (select l_suppkey as g, l_quantity as p, l_extendedprice as r from lineitem), {_CORRELATIONS}
select g as l_suppkey, n, round(spearman, 6) as spearman_rho, round(pearson, 6) as pearson_r from c
""")
def panel_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.panel_correlations(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return out.select("l_suppkey", "n", r6("spearman_rho"), r6("pearson_r"))


@query(f"""
with base as (select l_partkey as g, l_quantity as p, l_discount as r from lineitem), {_CORRELATIONS}
select g as l_partkey, n, round(spearman, 6) as spearman_rho, round(pearson, 6) as pearson_r from c
""")
def panel_scores_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels scored from SQL, by the table function, which takes many lines of a panel in one row."""
    tables.register(spark)
    rows = tables.packed(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", "l_discount")
    found = spark.sql("select * from panel_scores(rows => table({rows}) partition by l_partkey, panel => 'l_partkey', prediction => 'l_quantity', reference => 'l_discount')", rows=rows)
    return found.select("l_partkey", "n", r6("spearman_rho"), r6("pearson_r"))


@query(f"""
with base as (select (l_suppkey, l_returnflag) as g, l_quantity as p, l_extendedprice as r from lineitem), {_CORRELATIONS},
s as (select g[1] as k, count(*) as n_tasks, avg(spearman) as m from c group by 1)
select s_nationkey, count(*) as n_runs, count(*) filter (n_tasks = 3) as n_complete, round(avg(m) filter (n_tasks = 3), 6) as macro_score from s join supplier on s_suppkey = k group by s_nationkey
""")
def panel_macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = stats.panel_correlations(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity", "l_extendedprice")
    whole = boards.macro_average(per, ["l_suppkey"], "l_returnflag", "spearman_rho", ["A", "N", "R"])
    runs = whole.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return runs.groupBy("s_nationkey").agg(F.count("*").alias("n_runs"), F.count("macro_score").alias("n_complete"), F.round(F.avg("macro_score"), 6).alias("macro_score"))


@query("""
with g as (select o_orderpriority, o_orderstatus, count(*) as n, quantile_cont(o_totalprice, [0.01, 0.05, 0.95, 0.99]) as q from orders group by 1, 2)
select o_orderpriority, o_orderstatus, n, round(q[1], 6) as p01, round(q[2], 6) as p05, round(q[3], 6) as p95, round(q[4], 6) as p99, round(q[3] - q[2], 6) as spread,
       case when n < 50 then 'insufficient' when q[1] >= q[4] then 'collapsed' else 'eligible' end as status from g
""")
def robust_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.robust_spread(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return out.select("o_orderpriority", "o_orderstatus", "n", *map(r6, ("p01", "p05", "p95", "p99", "spread")), "status")


@query("""
with g as (select p_brand, p_type, count(*) as n, quantile_cont(p_retailprice, 0.95) - quantile_cont(p_retailprice, 0.05) as spread from part group by 1, 2),
s as (select p_brand, p_type, n, round(spread, 6) as spread from g),
k as (select *, row_number() over (partition by p_brand order by spread desc, n desc, p_type) as place from s),
w as (select p_brand, row_number() over (order by spread desc, n desc, p_type, p_brand) as r from k where place = 1)
select p_brand, p_type, n, spread, case when place = 1 then r end::int as selected_rank, case when place > 1 then 'not_group_winner' when r > 20 then 'below_selection_cutoff' end as reason from k join w using (p_brand)
""")
def best_window_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = sampling.robust_spread(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_retailprice").select("p_brand", "p_type", "n", r6("spread"))
    return selection.winners_with_reasons(spread, ["p_brand"], [F.desc("spread"), F.desc("n"), F.asc("p_type"), F.asc("p_brand")], 20)


_BINNED = """
a as (select c_mktsegment, quantile_cont(c_acctbal, 0.01) as lo, quantile_cont(c_acctbal, 0.99) as hi from customer group by 1),
b as (select customer.*, (c_acctbal >= (1 - 1/5.0::double) * lo + (1/5.0::double) * hi)::int + (c_acctbal >= (1 - 2/5.0::double) * lo + (2/5.0::double) * hi)::int
      + (c_acctbal >= (1 - 3/5.0::double) * lo + (3/5.0::double) * hi)::int + (c_acctbal >= (1 - 4/5.0::double) * lo + (4/5.0::double) * hi)::int as bin from customer join a using (c_mktsegment) where lo < hi)
"""


@query(f"""
with {_BINNED},
d as (select *, sha256('["panel-1","' || c_mktsegment || '",' || bin || ',"' || c_custkey || '"]') as digest from b),
r as (select *, row_number() over (partition by c_mktsegment, bin order by digest, c_custkey) as r from d),
s as (select *, row_number() over (partition by c_mktsegment order by r, bin) as slot, count(*) over (partition by c_mktsegment) as have from r where r <= 50)
select c_mktsegment, c_custkey, c_acctbal, bin, row_number() over (partition by c_mktsegment order by bin, digest, c_custkey)::int as slot from s where slot <= 50 and have >= 50
""")
def score_space_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return sampling.stratified_sample(keyed, ["c_mktsegment"], "c_custkey", "c_acctbal", "panel-1")


@query(f"""
with {_BINNED},
c as (select c_mktsegment, bin, count(*) as n_rows from b group by 1, 2),
g as (select c_mktsegment, unnest(range(0, 5)) as bin from (select distinct c_mktsegment from c)),
f as (select c_mktsegment, bin::int as bin, coalesce(n_rows, 0)::bigint as n_rows from g left join c using (c_mktsegment, bin)),
t as (select c_mktsegment, bin, unnest(range(1, least(n_rows, 50) + 1)) as r from f),
s as (select *, row_number() over (partition by c_mktsegment order by r, bin) as slot from t)
select f.c_mktsegment, f.bin, n_rows, count(slot)::bigint as n_allocated from f left join s on s.c_mktsegment = f.c_mktsegment and s.bin = f.bin and slot <= 50 group by 1, 2, 3
""")
def bin_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bin_allocation(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")


@query(f"""
with {_BINNED},
c as (select c_mktsegment, bin, count(*) as n_rows from b group by 1, 2),
g as (select c_mktsegment, unnest(range(0, 5)) as bin from (select distinct c_mktsegment from c)),
f as (select c_mktsegment, bin::int as bin, coalesce(n_rows, 0)::bigint as n_rows from g left join c using (c_mktsegment, bin)),
t as (select c_mktsegment, bin, unnest(range(1, least(n_rows, 50) + 1)) as r from f),
s as (select *, row_number() over (partition by c_mktsegment order by r, bin) as slot from t),
al as (select f.c_mktsegment, f.bin, n_rows, count(slot)::bigint as n from f left join s on s.c_mktsegment = f.c_mktsegment and s.bin = f.bin and slot <= 50 group by 1, 2, 3),
w as (select c_mktsegment, bin, n_rows, case when c_mktsegment = 'BUILDING' and bin = 1 then n_rows + 1 when c_mktsegment = 'MACHINERY' and bin = 2 then n - 3 else n end as n from al),
m as (select *, sum(n) over (partition by c_mktsegment) as total, sum(n_rows) over (partition by c_mktsegment) as rows_, max(n) over (partition by c_mktsegment) as most from w)
select c_mktsegment, rule, 'bin ' || bin as detail from m join (values ('allocation_exceeds_rows'), ('total_differs'), ('uneven')) v(rule)
on (rule = 'allocation_exceeds_rows' and n > n_rows) or (rule = 'total_differs' and total <> least(rows_, 50)) or (rule = 'uneven' and n < n_rows and n < most - 1)
""")
def allocation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right allocation breaks no rule; in one segment a bin has too many rows, in another too few."""
    wrong = F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("bin") == 1), F.col("n_rows") + 1).when((F.col("c_mktsegment") == "MACHINERY") & (F.col("bin") == 2), F.col("n_allocated") - 3).otherwise(F.col("n_allocated"))
    return sampling.allocation_violations(bin_allocation(spark, sf_dir).withColumn("n_allocated", wrong), ["c_mktsegment"])


@query("select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, max(o_orderdate) as o_orderdate from orders where o_orderstatus = 'F' group by o_custkey")
def latest_complete_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return selection.latest_complete(orders, ["o_custkey"], F.col("o_orderstatus") == "F", "o_orderdate", "o_orderkey").drop("o_orderstatus")


_EFFORTS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(f"""
with e as (select o_custkey, o_orderkey, o_orderpriority, o_orderdate, list_position({_EFFORTS}, o_orderpriority) as o from orders),
w as (select *, row_number() over k as r, first_value(o) over k as top from e window k as (partition by o_custkey order by o desc, o_orderdate desc, o_orderkey desc))
select o_custkey, o_orderkey, o_orderpriority, case when r = 1 then 'selected' when o = top then 'superseded_same_effort' else 'lower_effort' end as disposition from w
""")
def ordinal_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return selection.highest_ordinal(orders, ["o_custkey"], "o_orderpriority", _EFFORTS, "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("""
with p as (select *, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as p from orders),
b as (select *, min(p) over (partition by o_custkey) as best from p),
a as (select *, max(o_orderdate) over (partition by o_custkey) as newest from b where p = best)
select o_custkey, o_orderkey, o_orderstatus, o_orderdate, count(*) over (partition by o_custkey) as tied from a where o_orderdate = newest
""")
def preferred_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return selection.preferred_latest(orders, ["o_custkey"], "o_orderstatus", ["F", "O"], "o_orderdate")


#: The share within +-t of Student's distribution, of x = atan(t / sqrt(nu)), as the finite sums for whole nu.
_T_SHARE = """case when nu % 2 = 0 then sin(x) * (1 + coalesce(list_sum(list_transform(range(1, (nu - 2) // 2 + 1), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5)) * power(cos(x), 2 * j))), 0))
     when nu = 1 then 2 * x / pi()
     else 2 / pi() * (x + sin(x) * cos(x) * (1 + coalesce(list_sum(list_transform(range(1, (nu - 3) // 2 + 1), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * power(cos(x), 2 * j))), 0))) end"""


@query(f"""
with recursive t as (select s_nationkey, count(*) as n, avg(s_acctbal) as mean, stddev_samp(s_acctbal) as sd, min(s_acctbal) = max(s_acctbal) as steady from supplier group by 1),
b as (select distinct n - 1 as nu, 0.0::double as lo, pi() / 2 as hi, 0 as k from t where n > 1
      union all select nu, if(share < 0.95, x, lo), if(share < 0.95, hi, x), k + 1 from (select *, {_T_SHARE} as share from (select *, (lo + hi) / 2 as x from b where k < 70))),
r as (select nu, lo, hi, k from b where k = 70),
c as (select nu as df, sqrt(nu) * tan((lo + hi) / 2) as t from r)
select s_nationkey, n, round(mean, 7) as mean, case when n >= 2 and not steady then round(mean - t * sd / sqrt(n), 7) end as ci_low, case when n >= 2 and not steady then round(mean + t * sd / sqrt(n), 7) end as ci_high,
       case when n < 2 then 'insufficient' when steady then 'constant_scores' else 'estimated' end as status
from t left join c on df = n - 1
""")
def t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.t_interval(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal")
    return out.select("s_nationkey", "n", *(F.round(c, 7).alias(c) for c in ("mean", "ci_low", "ci_high")), "status")


@query("""
with recursive s as (select s_nationkey as g, s_suppkey % 2 = 0 as first, s_acctbal as v, row_number() over (partition by s_nationkey order by s_suppkey) as i from supplier),
z as (select g, count(*) filter (first) as n1, count(*) filter (not first) as n2, avg(v) filter (first) - avg(v) filter (not first) as d, list(v order by i) as vs, sum(v) as total from s group by g),
c as (select g, round(product((n1 + n2 - least(n1, n2) + k) / k)) as ways from (select g, n1, n2, unnest(range(1, least(n1, n2) + 1)) as k from z) group by g),
f as (select z.*, case when n1 >= 2 and n2 >= 2 then ways else 0 end::bigint as n_allocations from z left join c using (g)),
m as (select g, least(n1, n2) as k, 0 as j, 0::bigint as last, 0.0::double as part from f where n_allocations between 1 and 200000
      union all select g, k, j + 1, i, part + vs[i] from (select m.*, vs, unnest(range(last + 1, len(vs) - (k - j - 1) + 1)) as i from m join f using (g) where j < k)),
x as (select g, n1, n2, d, if(n1 <= n2, part, total - part) as part, total from m join f using (g) where j = k),
p as (select g, count(*) filter (part / n1 - (total - part) / n2 >= d - 1e-12 * greatest(1, abs(d))) / count(*) as p from x group by g)
select g as s_nationkey, n1 as n_first, n2 as n_second, round(d, 7) as difference, n_allocations, round(p, 7) as p_value from f left join p using (g)
""")
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of suppliers with even against odd keys, nation by nation."""
    rows = table(spark, sf_dir, "supplier").withColumn("side", F.when(F.col("s_suppkey") % 2 == 0, "before").otherwise("after"))
    out = stats.permutation_test(rows, ["s_nationkey"], "side", "s_acctbal", "before", "after")
    return out.withColumns({c: F.round(c, 7) for c in ("difference", "p_value")})


@query("""
select p_brand, count(*) as n, round(regr_slope(p_retailprice, p_size), 6) as slope, round(regr_intercept(p_retailprice, p_size), 6) as intercept from part group by p_brand
""")
def trend_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.trend_line(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice")
    return out.select("p_brand", "n", r6("slope"), r6("intercept"))


@query("""
select o_custkey, o_orderkey, 'V' || lpad(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::varchar, 2, '0') as candidate_id from orders
""")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return selection.sequential_ids(orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "V", 2, "candidate_id").drop("o_orderdate")
