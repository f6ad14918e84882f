"""DNA texts made from digests, variants on them, and payloads within pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import parsing, sequence
from panelyard.plans.registry import query, table

_DNA = "translate(sha256(doc_id::varchar), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_SHARED = "len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda k: {a}[1:k] = {b}[1:k]))"


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(F.sha2(F.col("doc_id").cast("string"), 256), "0123456789abcdef", "ACGTACGTACGTACGT").alias("s"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position, reference and alternative allele for each sequence."""
    d, k = _dna(spark, sf_dir), F.col("doc_id")
    pos = (k % 40 + 1).cast("int")
    rows = d.select("doc_id", "s", pos.alias("pos"), F.substring("s", pos, (k % 3 + 1).cast("int")).alias("ref"), F.substring("s", (k % 30 + 7).cast("int"), (k % 4 + 1).cast("int")).alias("alt"))
    return rows


_VARIANTS = f"""
d as (select doc_id, {_DNA} as s from documents),
v as (select doc_id, s, (doc_id % 40 + 1)::int as pos, substr(s, (doc_id % 40 + 1)::int, (doc_id % 3 + 1)::int) as ref, substr(s, (doc_id % 30 + 7)::int, (doc_id % 4 + 1)::int) as alt from d),
h as (select *, {_SHARED.format(a="ref", b="alt")} as head from v),
c as (select *, substr(ref, head + 1) as ra, substr(alt, head + 1) as aa from h),
t as (select *, {_SHARED.format(a="reverse(ra)", b="reverse(aa)")} as tail from c),
e as (select *, substr(ra, 1, len(ra) - tail) as r, substr(aa, 1, len(aa) - tail) as a from t)
"""


@query(f"""
with {_VARIANTS}
select doc_id, reverse(translate(s, 'ACGT', 'TGCA')) as reverse_complement, case when ref = alt then 'Unknown' when len(r) = 1 and len(a) = 1 then 'SNV' when len(r) = len(a) then 'MBS' else 'Indel' end as shape,
       case when ref = alt then 'Unknown' when len(r) = 1 and len(a) = 1 then 'SNV' when len(r) = 0 then 'Insertion' when len(a) = 0 then 'Deletion' else 'Other' end as allele_type,
       concat_ws(':', 'chr1', pos + head, r, a) as allele_key, substr(s, 1, pos - 1) || alt || substr(s, pos + len(ref)) as mutant, substr(s, 1, 20) || chr(10) || substr(s, 21, 20) || chr(10) || substr(s, 41, 20) || chr(10) || substr(s, 61) as wrapped
from e
""")
def sequence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, pos, ref, alt = (F.col(c) for c in ("s", "pos", "ref", "alt"))
    return _variants(spark, sf_dir).select("doc_id", sequence.reverse_complement(s).alias("reverse_complement"), sequence.variant_shape(ref, alt).alias("shape"), sequence.allele_type(ref, alt).alias("allele_type"), sequence.allele_key(F.lit("chr1"), pos, ref, alt).alias("allele_key"), sequence.edited(s, pos, ref, alt).alias("mutant"), parsing.wrapped(s, 20).alias("wrapped"))


@query("""
with """ + _VARIANTS.split("h as")[0].strip().rstrip(",") + """,
w as (select *, case when ref <> alt and len(ref) > 0 and pos - 1 + len(ref) <= len(s) then substr(s, 1, pos - 1) || alt || substr(s, pos + len(ref)) end as mutant from v),
t as (select *, len(list_filter(range(1, least(len(s), len(mutant)) + 1), lambda k: substr(s, (len(s) - k + 1)::int) = substr(mutant, (len(mutant) - k + 1)::int))) as tail from w),
c as (select *, substr(s, 1, len(s) - tail) as old, substr(mutant, 1, len(mutant) - tail) as new from t),
h as (select *, len(list_filter(range(1, least(len(old), len(new)) + 1), lambda k: old[1:k] = new[1:k])) as head from c),
r as (select *, substr(old, head + 1) as a, substr(new, head + 1) as b from h)
select doc_id, case when mutant is null then null when a <> '' and b <> '' then head + 1 when head > 0 then head else 1 end::bigint as norm_pos,
       case when mutant is null then null when a <> '' and b <> '' then a when head > 0 then s[head] || a else a || substr(s, len(a)::int + 1, 1) end as norm_ref,
       case when mutant is null then null when a <> '' and b <> '' then b when head > 0 then s[head] || b else b || substr(s, len(a)::int + 1, 1) end as norm_alt,
       case when mutant is not null then true end as mutant_unchanged, true as idempotent from r
""")
def allele_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left-most forms; the edit they make is the edit that was given, and normalising again changes nothing."""
    n = sequence.normalised("s", "pos", "ref", "alt")
    once = _variants(spark, sf_dir).withColumn("n", n)
    again = once.withColumn("m", sequence.normalised("s", F.col("n.pos"), F.col("n.ref"), F.col("n.alt")))
    same = sequence.edited(F.col("s"), F.col("n.pos").cast("int"), F.col("n.ref"), F.col("n.alt")) == sequence.edited(F.col("s"), F.col("pos"), F.col("ref"), F.col("alt"))
    return again.select("doc_id", F.col("n.pos").alias("norm_pos"), F.col("n.ref").alias("norm_ref"), F.col("n.alt").alias("norm_alt"), same.alias("mutant_unchanged"), F.col("n").eqNullSafe(F.col("m")).alias("idempotent"))


@query(f"""
with {_VARIANTS}, p as (select doc_id, s, pos, r, a, pos + head as b, pos + head + len(r) as f from e)
select doc_id, case when 20 < b then 20 when 20 >= f then 20 + len(a) - len(r) when 20 < b + len(a) then 20 end::int as alternate_position, (64 - pos)::int as minus_start from p
""")
def coordinate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, ref, alt = (F.col(c) for c in ("pos", "ref", "alt"))
    span = sequence.minus_span(pos, pos + 1, F.lit(64))
    return _variants(spark, sf_dir).select("doc_id", sequence.alternate_position(F.lit(20), pos, ref, alt).alias("alternate_position"), span["start"].alias("minus_start"))


@query(f"""
with d as (select doc_id, {_DNA} as s, (doc_id % 40 + 1) as p from documents),
h as (select *, case doc_id % 5 when 0 then 'n.' || p || substr(s, p::int, 1) || '>' || if(substr(s, p::int, 1) = 'A', 'C', 'A') when 1 then 'x:n.' || p || '_' || (p + 2) || 'del' when 2 then 'n.' || p || '_' || (p + 1) || 'insTT' when 3 then 'n.' || p || 'dup' else 'p.Val' || p || 'Gly' end as hgvs from d)
select doc_id, hgvs, case doc_id % 5 when 4 then null when 2 then p + 1 else p end as pos, case doc_id % 5 when 1 then substr(s, p::int, 3) when 2 then '' when 4 then null else substr(s, p::int, 1) end as ref,
       case doc_id % 5 when 0 then if(substr(s, p::int, 1) = 'A', 'C', 'A') when 1 then '' when 2 then 'TT' when 3 then substr(s, p::int, 1) || substr(s, p::int, 1) end as alt from h
""")
def hgvs_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("doc_id") % 5, F.col("doc_id") % 40 + 1
    base = F.substring("s", p.cast("int"), F.lit(1))
    t = lambda c: c.cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("n."), t(p), base, F.lit(">"), F.when(base == "A", "C").otherwise("A")))
        .when(k == 1, F.concat(F.lit("x:n."), t(p), F.lit("_"), t(p + 2), F.lit("del")))
        .when(k == 2, F.concat(F.lit("n."), t(p), F.lit("_"), t(p + 1), F.lit("insTT")))
        .when(k == 3, F.concat(F.lit("n."), t(p), F.lit("dup")))
        .otherwise(F.concat(F.lit("p.Val"), t(p), F.lit("Gly")))
    )
    rows = _dna(spark, sf_dir).withColumn("hgvs", text).withColumn("g", sequence.hgvs_allele(F.col("s"), F.col("hgvs")))
    return rows.select("doc_id", "hgvs", "g.pos", "g.ref", "g.alt")


@query(r"""
select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::bigint as n_links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1))), ',') as tags,
       array_to_string(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), '|') as scripts from pages
""")
def html_payload_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = lambda pattern, group: F.regexp_extract_all("html", F.lit(pattern), F.lit(group))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.size(every('href="([^"]*)"', 1)).cast("long").alias("n_links"),
        F.array_join(F.array_sort(F.array_distinct(every("<([a-z0-9]+)[ >]", 1))), ",").alias("tags"),
        F.array_join(every("(?s)<script[^>]*>(.*?)</script>", 1), "|").alias("scripts"),
    )


@query(r"""
with l as (select page_id, unnest(range(1, len(string_split(html, chr(10))) + 1)) as line, unnest(string_split(html, chr(10))) as text from pages), w as (select *, lead(text) over (partition by page_id order by line) as next_line from l)
select page_id, line::bigint as line, coalesce(next_line, '') as next_line from w where text like '<h%' or text like '%<p%'
""")
def line_offset_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line after each marked line; lines of one page stay in one array, so nothing is shuffled."""
    lines = F.split("html", "\n")
    cut = table(spark, sf_dir, "pages").select("page_id", lines.alias("l")).select("page_id", "l", F.posexplode("l").alias("k", "text"))
    marked = cut.where(F.col("text").startswith("<h") | F.contains(F.col("text"), F.lit("<p")))
    return marked.select("page_id", (F.col("k") + 1).cast("long").alias("line"), F.coalesce(F.get("l", F.col("k") + 1), F.lit("")).alias("next_line"))


@query(r"select doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')) as slug_md5, (len(text) - len(replace(text, 'the ', ''))) = 4 as once from documents")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(parsing.slug(F.col("text"))).alias("slug_md5"), parsing.occurs_once(F.col("text"), "the ").alias("once"))


@query(r"select doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')) as slug_sha256, (len(text) - len(replace(text, 'the ', ''))) = 4 as once from documents")
def text_helpers_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of whole texts, as digests."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(parsing.slug(F.col("text")), 256).alias("slug_sha256"), parsing.occurs_once(F.col("text"), "the ").alias("once"))
