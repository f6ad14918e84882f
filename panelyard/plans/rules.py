"""Rules of questions, sampling, parameters, coverage, chronology, alleles and digests, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import parsing, payloads, sequence, temporal
from panelyard.operators import boards, checks, joins, questions, sampling, selection, stats, usage
from panelyard.plans.registry import query, table
from panelyard.streaming import tables


@query("""
with o as (select o_orderkey as k, o_orderkey % 12 as m from orders)
select rule, 'q' || k as key, path from o join (values ('two_choices', '<record>', 1), ('unique_choices', '<record>', 2), ('answer', '<record>', 2), ('answer', '<record>', 3), ('rendered', 'choices.1', 4), ('rendered', 'choices.0', 5), ('rendered', 'choices.0', 2), ('rendered', 'choices.1', 2)) v(rule, path, place) on m = place
""")
def choice_question_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with too few or repeated choices, an answer that is none of them, and choices that the prompt lacks or repeats."""
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 12
    choice = lambda i, t: F.struct(F.lit(i).alias("choice_id"), F.lit(t).alias("text"))
    choices = F.when(m == 1, F.array(choice("A", "gain"))).when(m == 2, F.array(choice("A", "gain"), choice("A", "gain"))).otherwise(F.array(choice("A", "gain"), choice("B", "loss")))
    prompt = F.when(m == 4, "Which?\nA. gain\nB.  loss").when(m == 5, "Which?\nA. gain\nB. loss\nor A. gain").when(m == 2, "Which?\nA. gain\nA. gain").otherwise("Which?\nA. gain\nB. loss")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("q"), k.cast("string")).alias("question_id"), prompt.alias("prompt"), choices.alias("choices"), F.when(m == 3, "C").otherwise("A").alias("answer_choice_id"))
    return questions.choice_violations(rows)


@query("""
with l as (select l_suppkey as k, count(distinct l_partkey) as n from lineitem group by 1)
select rule, 'q' || k as key, path from l join (values ('sorted', '<record>', 1), ('finite', 'candidates.0', 2), ('rendered', 'candidates.0', 3), ('unique_ids', '<record>', 4)) v(rule, path, place) on k % 6 = place and (rule not in ('sorted', 'unique_ids') or n > 1)
""")
def ranking_question_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking question for each supplier with its parts as candidates; some are unsorted, unscored, unnamed or not in the prompt."""
    k = F.col("l_suppkey")
    each = F.struct(F.lit("chr1").alias("chrom"), F.col("l_partkey").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.col("score").alias("reference_score"))
    parts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("score"))
    listed = parts.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(each)).alias("c"))
    name = lambda p: F.when(k % 6 == 4, "V").otherwise(F.concat(F.lit("V"), p.cast("string")))
    ordered = F.when(k % 6 == 1, F.reverse("c")).otherwise(F.col("c"))
    candidates = F.transform(ordered, lambda c, i: F.struct(name(c["pos"]).alias("candidate_id"), c["chrom"].alias("chrom"), c["pos"].alias("pos"), c["ref"].alias("ref"), c["alt"].alias("alt"), F.when((k % 6 == 2) & (i == 0), float("nan")).otherwise(c["reference_score"]).alias("reference_score")))
    rows = listed.select(F.concat(F.lit("q"), k.cast("string")).alias("question_id"), (k % 6).alias("m"), candidates.alias("candidates"))
    lines = F.transform("candidates", lambda c, i: F.when((F.col("m") == 3) & (i == 0), "gone").otherwise(F.concat_ws("\t", c["chrom"], c["pos"].cast("string"), c["candidate_id"], c["ref"], c["alt"])))
    return questions.candidate_violations(rows.withColumn("prompt", F.concat(F.lit("Rank:\n"), F.array_join(lines, ";\n"), F.lit(";"))))


@query("""
with c as (select c_mktsegment as task from customer group by 1)
select rule, task as key from c join (values ('convention', 'AUTOMOBILE'), ('anchors', 'BUILDING'), ('cutpoints', 'BUILDING'), ('membership', 'BUILDING'), ('allocation', 'FURNITURE'), ('selected_counts', 'FURNITURE'), ('membership', 'MACHINERY'), ('selected_counts', 'MACHINERY')) v(rule, place) on task = place
""")
def sampling_provenance_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of the balance samples of each segment: right for one, and wrong in its seed, anchors, allocation or members for others."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("task"), "c_custkey", F.col("c_acctbal").alias("score"))
    q = stats.type7("score", 0.01, 0.99)
    anchors = customers.groupBy("task").agg(q.alias("anchors"))
    cuts = F.array(*[(1 - k / 5) * F.col("anchors")[0] + (k / 5) * F.col("anchors")[1] for k in range(1, 5)])
    chosen = sampling.stratified_sample(customers, ["task"], "c_custkey", "score", "seed-1", 12)
    of_bins = sampling.bin_allocation(customers, ["task"], "score", 12).groupBy("task").agg(F.sort_array(F.collect_list(F.struct("bin", "n_rows", "n_allocated"))).alias("b"))
    plans = anchors.join(of_bins, "task").select("task", F.when(F.col("task") == "AUTOMOBILE", "seed-2").otherwise("seed-1").alias("seed"), F.lit("bins-v1").alias("algorithm"), F.when(F.col("task") == "BUILDING", F.reverse("anchors")).otherwise(F.col("anchors")).alias("anchors"), cuts.alias("cutpoints"), F.transform("b", lambda x: x["n_rows"]).alias("population_counts"), F.transform("b", lambda x: x["n_allocated"] + F.when((F.col("task") == "FURNITURE") & (x["bin"] == 0), 1).otherwise(0)).alias("allocations"))
    plans = plans.withColumn("cutpoints", F.when(F.col("task") == "BUILDING", F.transform("cutpoints", lambda c: c + 1e6)).otherwise(F.col("cutpoints")))
    selected = chosen.select("task", "score", F.when((F.col("task") == "MACHINERY") & (F.col("slot") == 1), 4).otherwise(F.col("bin")).alias("bin"))
    return questions.provenance_violations(plans, selected, "seed-1", "bins-v1", 12, 5)


_PARAMETERS = {
    0: '{"temperature": 0.5, "seed": 7}', 1: '{"messages": [], "max_tokens": 5}', 2: '{"max_tokens": 0}', 3: '{"max_tokens": true, "temperature": "hot"}', 4: '{"max_completion_tokens": 2.5}',
    5: '{"temperature": 1e400}', 6: '{"seed": 1.5, "n": 2, "stream": false}', 7: "[1]", 8: '{"max_tokens": 12, "top_p": 0.1}', 9: '{"temperature": null}',
}


@query("""
select rule, event_id::varchar as key from events join (values (1, 'reserved'), (2, 'max_tokens'), (3, 'max_tokens'), (3, 'temperature'), (4, 'max_completion_tokens'), (5, 'temperature'), (6, 'seed'), (6, 'reserved'), (7, 'object'), (9, 'temperature')) v(place, rule) on event_id % 10 = place
""")
def generation_parameter_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.element_at(F.create_map(*[x for k, v in _PARAMETERS.items() for x in (F.lit(k), F.lit(v))]), (F.col("event_id") % 10).cast("int"))
    return questions.parameter_violations(table(spark, sf_dir, "events").select("event_id", given.alias("p")), F.col("event_id"), "p")


@query("""
select o_orderkey, 'Order {' || o_orderkey || '} of ' || c_name || ': ' || o_orderpriority || '.' as prompt from orders join customer on c_custkey = o_custkey
""")
def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", questions.rendered("Order {{{number}}} of {name}: {priority}.", {"number": F.col("o_orderkey"), "name": F.col("c_name"), "priority": F.col("o_orderpriority")}).alias("prompt"))


@query("""
with r as (select l_suppkey as run, p_brand as item, count(*) as n, bool_and(l_returnflag <> 'R') as done from lineitem join part on p_partkey = l_partkey group by 1, 2),
x as (select run, case when run % 9 = 0 and item = (select min(p_brand) from part) then 'Brand#?' else item end as item, done from r), e as (select distinct p_brand as item from part)
select run, count(*) as attempted, count(*) filter (done) as completed, count(*) filter (not done) as api_errors, (select count(*) from e) - count(distinct item) filter (item in (select item from e)) as missing,
       count(*) filter (item not in (select item from e)) as unexpected, count(*) filter (done) = count(*) and count(*) = (select count(*) from e) and count(distinct item) filter (item in (select item from e)) = (select count(*) from e) as complete from x group by run
""")
def run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's run over all brands: which of them it missed, and items that nobody asked for."""
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item"))
    least = brands.agg(F.min("item")).first()[0]
    lines = table(spark, sf_dir, "lineitem").join(brands, F.col("p_partkey") == F.col("l_partkey"))
    rows = lines.groupBy(F.col("l_suppkey").alias("run"), "item").agg(F.when(F.bool_and(F.col("l_returnflag") != "R"), "completed").otherwise("error").alias("status"))
    odd = rows.withColumn("item", F.when((F.col("run") % 9 == 0) & (F.col("item") == least), "Brand#?").otherwise(F.col("item")))
    return boards.coverage(odd, brands.select("item").distinct(), ["run"], "item", "status")


@query("""
with b as (select o_custkey as c, min(o_orderdate) as a, max(o_orderdate) as z from orders where o_orderstatus = 'F' group by 1)
select o_custkey, o_orderkey, case when c is null then 'no_original' when o_orderdate < a then 'before_original' when o_orderdate > z then 'after_final' end as rule from orders left join b on c = o_custkey where c is null or o_orderdate < a or o_orderdate > z
""")
def attempt_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders outside the time from a customer's first finished order to the last."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    bounds = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    return checks.chronology_bounds(orders, bounds, ["o_custkey"], "o_orderdate", "a", "z").select("o_custkey", "o_orderkey", "rule")


@query("""
select 'row' as kind, c_custkey as key, count(event_id) as n, coalesce(string_agg(event_id::varchar, ',' order by event_id), '') as events from customer left join events on user_id = c_custkey and event_type = 'error' group by c_custkey
union all select 'left over', user_id, count(*), string_agg(event_id::varchar, ',' order by event_id) from events where event_type = 'error' and user_id not in (select c_custkey from customer) group by user_id
""")
def attached_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with all their failed events, and failed events that belong to no customer."""
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("key"), "event_id")
    recovered = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    out, left_over = joins.attach_attempts(recovered, failed, ["key"], ["event_id"], ["event_id"])
    ids = lambda c: F.array_join(F.transform(c, lambda a: a["event_id"].cast("string")), ",")
    rest = joins.attempts(left_over, ["key"], ["event_id"], ["event_id"])
    shown = [df.select(F.lit(kind).alias("kind"), "key", F.size("attempts").cast("long").alias("n"), ids("attempts").alias("events")) for kind, df in (("row", out), ("left over", rest))]
    return shown[0].unionByName(shown[1])


@query("""
with a as (select p_partkey as id, case when p_partkey % 7 = 0 then null else 'k' || p_size end as trimmed, 't' || p_brand as text from part),
s as (select case when l_suppkey % 4 = 0 then null else 'k' || (l_suppkey % 40) end as trimmed, 't' || 'Brand#' || (l_suppkey % 30) as text, case when l_suppkey % 40 in (3, 5) then l_suppkey % 2 + l_linenumber % 2 else 1 end as score from lineitem),
x as (select trimmed as k, min(score) as v, count(distinct score) > 1 as many from s where trimmed is not null group by 1), y as (select text as k, min(score) as v, count(distinct score) > 1 as many from s group by 1)
select id, case when x.k is not null then if(x.many, null, x.v) when y.k is not null then if(y.many, null, y.v) end::bigint as score, case when x.k is not null then 'trimmed' when y.k is not null then 'text' end as route,
       case when x.k is not null then if(x.many, 'ambiguous', 'matched') when y.k is not null then if(y.many, 'ambiguous', 'matched') else 'missing' end as match from a left join x on x.k = trimmed left join y on y.k = a.text
""")
def allele_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a first key, else a second; keys with several values are ambiguous."""
    alleles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("k"), F.col("p_size").cast("string"))).alias("trimmed"), F.concat(F.lit("t"), "p_brand").alias("text"))
    k = F.col("l_suppkey")
    score = F.when((k % 40).isin(3, 5), k % 2 + F.col("l_linenumber") % 2).otherwise(1).cast("long")
    scores = table(spark, sf_dir, "lineitem").select(F.when(k % 4 != 0, F.concat(F.lit("k"), (k % 40).cast("string"))).alias("trimmed"), F.concat(F.lit("tBrand#"), (k % 30).cast("string")).alias("text"), score.alias("score"))
    return joins.allele_scores(alleles, scores, ["trimmed", "text"], "score", "id").select("id", "score", "route", "match")


@query("""
with c as (select c_custkey, md5(c_name) as name_md5, c_nationkey from customer where c_custkey % 20 <> 0), n as (select n_nationkey, n_name, n_regionkey, md5(if(n_nationkey % 5 = 2, 'old', n_name)) as d from nation),
o as (select o_orderkey, o_custkey, md5(case when o_orderkey % 10 = 1 then 'stale' else c_name end) as name_md5 from orders left join customer on c_custkey = o_custkey),
j as (select o_orderkey, c.c_custkey, c.c_nationkey, o.name_md5 is not distinct from c.name_md5 as same, n_name, n_regionkey, n_nationkey % 5 <> 2 as current from o left join c on c.c_custkey = o_custkey left join n on n_nationkey = c.c_nationkey)
select o_orderkey, case when c_custkey is not null and same then c_nationkey end as nation, case when c_custkey is not null and same and current then n_regionkey end as region,
       case when c_custkey is null then 'missing_0' when not same then 'differs_0' when not current then 'differs_1' end as problem from j
""")
def guarded_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through customer and nation, each only where the digest that the order or the chain bears is still right."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.md5("c_name").alias("name_md5"), F.col("c_nationkey").alias("nation"), "c_name")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.lit(True).alias("fresh"), F.col("n_regionkey").alias("region"))
    stale = nations.withColumn("fresh", F.col("nation") % 5 != 2)
    names = customers.select("o_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(names, "o_custkey", "left")
    orders = orders.select("o_orderkey", "o_custkey", F.md5(F.when(F.col("o_orderkey") % 10 == 1, "stale").otherwise(F.col("c_name"))).alias("name_md5"), F.lit(True).alias("fresh"))
    kept = customers.where("o_custkey % 20 <> 0")
    out = joins.guarded_chain(orders, [(kept, ["o_custkey"], ["name_md5"], ["nation"]), (stale, ["nation"], ["fresh"], ["region"])])
    return out.select("o_orderkey", "nation", "region", "problem")


@query("""
select c_custkey, c_name, md5('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') <> '' as bound, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') as public_sha256, c_acctbal from customer
""")
def public_and_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without their balance, and the balances apart, bound to the public rows by a digest."""
    public, private = checks.split_fields(table(spark, sf_dir, "customer").drop("c_nationkey"), ["c_custkey"], ["c_acctbal"])
    return public.join(private, "c_custkey").select("c_custkey", "c_name", F.col("public_sha256").isNotNull().alias("bound"), "public_sha256", "c_acctbal")


@query("""
with s as (select o_custkey, list(distinct o_orderpriority) as p from orders group by 1) select o_custkey, list_has_any(p, ['1-URGENT', '2-HIGH']) as urgent from s
""")
def intersecting_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return per.select("o_custkey", checks.intersecting(F.col("p"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit(None).cast("string"))).alias("urgent"))


@query(r"""
with u as (select page_id, url, regexp_replace(url, '^https?://', '') as path from pages)
select page_id, regexp_full_match(lower(regexp_replace(path, '[^A-Za-z0-9]+', '-', 'g')), '[a-z0-9]+(-[a-z0-9]+)*') as slug, regexp_full_match(path, '[A-Za-z0-9][A-Za-z0-9._-]*') as id,
       regexp_full_match('v' || page_id, 'v[0-9]+([.][0-9]+)*') as version, not (path like '/%' or path like '%//%' or regexp_matches(path, '(^|/)[.]{1,2}(/|$)') or contains(path, chr(92))) and path <> '' and not path like '%/' as safe_path from u
""")
def name_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", parsing.valid_name(F.lower(F.regexp_replace(path, "[^A-Za-z0-9]+", "-")), "slug").alias("slug"), parsing.valid_name(path, "id").alias("id"), parsing.valid_name(F.concat(F.lit("v"), F.col("page_id").cast("string")), "version").alias("version"), parsing.safe_path(path).alias("safe_path"))


@query("select l_suppkey, sum(l_extendedprice::decimal(38, 6))::double as total, sum(l_tax::decimal(38, 6))::double as tax from lineitem group by 1")
def exact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that are rounded once, whatever the order of rows."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(usage.exact_sum(F.col("l_extendedprice")).alias("total"), usage.exact_sum(F.col("l_tax")).alias("tax"))


@query("""
select p_partkey, case p_partkey % 3 when 0 then '3′ UTR' when 1 then 'splice region' else 'a variant of ' || p_brand end as label, p_brand || if(p_size % 2 = 0, ' (' || p_size || ')', '') as run_label,
       case when p_size % 3 = 0 then strftime(to_timestamp(p_partkey * 1000)::timestamp, '%Y-%m-%dT%H:%M:%SZ') else '1970-01-01T00:00:00Z' end as finished from part
""")
def labels_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category labels, run labels, and times of which some are missing."""
    epoch = F.when(F.col("p_size") % 3 == 0, F.col("p_partkey") * 1000)
    label = payloads.category_label(F.when(F.col("p_partkey") % 3 == 0, "3_prime_UTR_variant").when(F.col("p_partkey") % 3 == 1, "splice_region_variant").otherwise(F.concat(F.lit("a_variant_of_"), "p_brand")))
    effort = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 0, "")
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), payloads.run_label(F.concat(F.lit("org/"), "p_brand"), effort).alias("run_label"), temporal.iso_utc(temporal.epoch_or(epoch, F.lit(0).cast("long"))).alias("finished"))


@query("""
with d as (select doc_id, translate(sha256(doc_id::varchar), '0123456789abcdef', 'ACGTACGTACGTACGT') as s, doc_id % 40 + 5 as p from documents)
select doc_id, case when doc_id % 3 <> 2 then p end::bigint as pos, case doc_id % 3 when 0 then s[p] when 1 then s[p:p + 1] end as ref, case doc_id % 3 when 0 then if(s[p] = 'A', 'C', 'A') when 1 then '' end as alt from d
""")
def minus_strand_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes told on the other strand, as edits of the sequence: substitutions, deletions, and ones whose base is not there."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.translate(F.sha2(k.cast("string"), 256), "0123456789abcdef", "ACGTACGTACGTACGT").alias("s"), (k % 40 + 5).cast("int").alias("p"))
    back = lambda at: (F.char_length("s") - at + 1).cast("string")
    base = F.substring("s", F.col("p"), F.lit(1))
    other = F.when(base == "A", "C").otherwise("A")
    flip = lambda c: F.translate(c, "ACGT", "TGCA")
    sub = F.concat(F.lit("x:n."), back(F.col("p")), flip(base), F.lit(">"), flip(other))
    gone = F.concat(F.lit("x:n."), back(F.col("p") + 1), F.lit("_"), back(F.col("p")), F.lit("del"))
    wrong = F.concat(F.lit("x:n."), back(F.col("p")), flip(other), F.lit(">"), flip(base))
    text = F.when(k % 3 == 0, sub).when(k % 3 == 1, gone).otherwise(wrong)
    a = sequence.hgvs_allele_on(F.col("s"), text, F.lit("-"))
    return rows.select("doc_id", a["pos"].alias("pos"), a["ref"].alias("ref"), a["alt"].alias("alt"))


@query("select row_number() over (order by o_orderdate, o_orderkey) as place, o_orderkey from orders")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a total order over the whole table, numbered range by range."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return selection.numbered(orders, [F.asc("o_orderdate"), F.asc("o_orderkey")], "place").select("place", "o_orderkey")


@query("""
with e as (select event_id as id, event_id % 2 = 0 as choice, event_type <> 'error' as done, event_id % 5 as a, event_id % 7 as b, event_id % 3 as c from events),
v as (select id, unnest([a, b, c]) as p, unnest([1, 2, 3]) as r from e where not choice and done and b <> 6),
x as (select *, rank() over (partition by id order by p) + (count(*) over (partition by id, p) - 1) / 2.0 as rp from v),
k as (select id, case when min(p) = max(p) then 0.0 else corr(rp, r) end as rho, case when min(p) = max(p) then 0.0 else corr(p, r) end as r from x group by id)
select e.id, if(choice, 'exact_match', 'rank_correlation') as metric, case when done and choice and a < 4 then 'C' || (a % 2) end as choice, case when not done then null when choice then if(a < 4 and a % 2 = 0, 1.0, 0.0) else coalesce(round(rho, 6), 0.0) end as value,
       case when done and choice then a < 4 and a % 2 = 0 end as correct, round(rho, 6) as spearman_rho, round(r, 6) as pearson_r, case when done and not choice then b <> 6 end as valid,
       case when done and choice and a = 4 then 'no valid final choice' when done and not choice and b = 6 then 'missing: z' end as parse_error from e left join k using (id)
""")
def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to questions of both kinds, scored by their kind; failed requests have no score."""
    k = F.col("event_id")
    number = lambda n: (k % n).cast("string")
    choice = F.concat(F.lit("so\nFINAL: C"), F.when(k % 5 < 4, k % 5 % 2).otherwise(9).cast("string"))
    ranking = F.concat(F.lit('so\nFINAL: {"x": '), number(5), F.lit(', "y": '), number(7), F.when(k % 7 == 6, "}").otherwise(F.concat(F.lit(', "z": '), number(3), F.lit("}"))))
    rows = table(spark, sf_dir, "events").select(
        k.alias("id"), F.when(k % 2 == 0, "multiple_choice").otherwise("ranking").alias("task_type"), F.when(F.col("event_type") == "error", "error").otherwise("completed").alias("status"),
        F.when(k % 2 == 0, choice).otherwise(ranking).alias("content"), F.array(F.lit("C0"), F.lit("C1")).alias("choice_ids"), F.lit("C0").alias("answer_choice_id"),
        F.create_map(F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(2.0), F.lit("z"), F.lit(3.0)).alias("reference_scores"),
    )
    out = questions.scored(rows)
    return out.select("id", "metric", F.when(F.col("metric") == "exact_match", F.col("parsed")).alias("choice"), F.round("value", 6).alias("value"), "correct", F.round("spearman_rho", 6).alias("spearman_rho"), F.round("pearson_r", 6).alias("pearson_r"), "valid", "parse_error")


@query("""
select event_id, event_id % 4 as n_found, case when event_id % 4 > 0 then '{"id":' || event_id || ',"k":0}' end as first from events
""")
def embedded_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose scripts hold JSON: the objects that have an id and a k, at any depth, beside broken and foreign scripts."""
    k = F.col("event_id")
    item = F.concat(F.lit('{"k": 0, "id": '), k.cast("string"), F.lit("}"))
    nested = F.when(k % 4 == 0, '{"id": 1}').when(k % 4 == 1, F.concat(F.lit('{"a": [['), item, F.lit("]]}"))).when(k % 4 == 2, F.concat(F.lit('{"a": '), item, F.lit(', "b": {"c": '), item, F.lit("}}"))).otherwise(F.concat(F.lit("["), F.concat_ws(", ", item, item, item), F.lit("]")))
    page = F.concat(F.lit('<script>{"id": 1, "k": 2}</script><script type="application/json">{broken</script><p><script id="x" type="application/json">'), nested, F.lit("</script>"))
    found = payloads.nested_objects(payloads.script_payloads(page), ["id", "k"])
    return table(spark, sf_dir, "events").select("event_id", found.alias("f")).select("event_id", F.size("f").cast("long").alias("n_found"), F.get("f", F.lit(0)).alias("first"))


@query("""
with e as (select event_id as k, case when event_id % 7 = 0 then null else value end as v, strftime(ts, '%Y-%m-%d') as d from events)
select k as event_id, coalesce(printf('%.1f', v * 100) || '%', '—') as percent, case when v is null then '—' when k % 5 = 0 then '$0.0025' when k % 5 = 1 then '$0.00' else '$1,2' || (10 + k % 80) || '.00' end as cost,
       case when k % 3 = 0 then '—' else d end as day, case when k % 4 = 0 then '—' else printf('%.3f', k % 997 / 1000) end as correlation, case k % 4 when 0 then 'Not disclosed' when 1 then d when 2 then strftime(d::date, '%B %Y') else '—' end as cutoff from e
""")
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages, costs, dates, correlations and cutoffs as they are shown, unknown ones among them."""
    k = F.col("event_id")
    v, d = F.when(k % 7 != 0, F.col("value")), F.date_format("ts", "yyyy-MM-dd")
    cost = F.when(v.isNotNull(), F.when(k % 5 == 0, 0.0025).when(k % 5 == 1, 0.0).otherwise((1210 + k % 80).cast("double")))
    cutoff = F.when(k % 4 == 1, d).when(k % 4 == 2, F.substring(d, 1, 7)).when(k % 4 == 3, "soon")
    return table(spark, sf_dir, "events").select(
        "event_id", payloads.percent(v).alias("percent"), payloads.dollars(cost).alias("cost"), payloads.display_date(F.when(k % 3 != 0, F.concat(d, F.lit("T10")))).alias("day"),
        payloads.display_correlation(F.when(k % 4 == 0, float("nan")).otherwise(k % 997 / 1000)).alias("correlation"), payloads.display_cutoff(cutoff).alias("cutoff"),
    )


@query("""
with l as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
select user_id, event_id, before as previous, event_type as state from l where (before is null and event_type <> 'view') or (before = 'view' and event_type not in ('click', 'error')) or (before = 'click' and event_type not in ('purchase', 'view')) or (before in ('purchase', 'error')) or (before = 'signup')
""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of users' events that may not follow the one before."""
    allowed = {None: ["view"], "view": ["click", "error"], "click": ["purchase", "view"]}
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("state"))
    return tables.illegal_transitions(log, ["user_id"], ["ts", "event_id"], "state", allowed).select("user_id", "event_id", "previous", "state")
