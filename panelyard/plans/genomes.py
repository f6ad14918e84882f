"""Changes of transcripts on a genome in chunks, edits moved left, coordinates through edits, intervals that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import coordinates
from panelyard.operators import genome, joins
from panelyard.plans.files import _GENOME, _text_files
from panelyard.plans.registry import query, table
from panelyard.plans.sequences import _VARIANTS, _variants
from panelyard.sources import readers, writers
from panelyard.sources.folders import as_table, new_folder

_CHROM = "case when n_nationkey < 22 then 'chr' || (n_nationkey + 1) when n_nationkey = 22 then 'chrX' when n_nationkey = 23 then 'chrY' end"


def _chunks(spark: SparkSession, sf_dir: str, chunk: int) -> DataFrame:
    """A contig of 2560 bases for each nation, in lines of a FASTA file, as chunks: 64 bases that stand there 40 times."""
    n = F.col("n_nationkey")
    name = F.when(n < 22, F.concat(F.lit("chr"), (n + 1).cast("string"))).when(n == 22, "chrX").when(n == 23, "chrY").otherwise("other")
    bases = F.repeat(F.translate(F.sha2("n_name", 256), "0123456789abcdef", "ACGTACGTACGTACGT"), 40)
    path = new_folder(spark, "genome")
    lines = F.split(F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(bases, "(.{60})", "$1\n")), "\n")
    _text_files(table(spark, sf_dir, "nation").coalesce(2), path, lines)
    return as_table(readers.read_fasta_chunks(spark, path, chunk), "chunks")


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five exons for each nation, coding from within the first to within the last, from JSON documents."""
    n = F.col("n_nationkey")
    start = lambda j: j * 400 + 100 + n % 7
    exons = F.array(*[F.array(start(j), start(j) + 60 + 10 * j) for j in range(5)])
    body = F.struct(F.format_string("NC_%06d.1", n + 1).alias("contig"), F.when(n % 2 == 0, "+").otherwise("-").alias("strand"), exons.alias("exons"), (start(0) + 20).alias("cds_start"), (start(4) + 30).alias("cds_end"))
    text = F.to_json(F.struct(F.format_string("T%03d.1", n).alias("id"), F.format_string("G%d", n).alias("gene"), F.lit("1").alias("version"), body.alias("assembly")))
    path = new_folder(spark, "transcripts")
    writers.write_files(table(spark, sf_dir, "nation").select(F.format_string("t-%d.json", n).alias("name"), text.alias("content")), path).count()
    schema = "id string, gene string, version string, assembly struct<contig: string, strand: string, exons: array<array<bigint>>, cds_start: bigint, cds_end: bigint>"
    return readers.transcripts(readers.read_json_documents(spark, path, schema))[0]


#: What an insertion or deletion of bases ``d`` in front of position ``p`` of ``s`` looks like with its base.
_ANCHORED = """
case when p > 1 then p - 1 else 1 end::bigint as pos,
case when p > 1 then s[p - 1] || if(gone, d, '') else if(gone, d, '') || s[if(gone, len(d) + 1, 1)] end as ref,
case when p > 1 then s[p - 1] || if(gone, '', d) else if(gone, '', d) || s[if(gone, len(d) + 1, 1)] end as alt
"""


@query(f"""
with g as (select n_nationkey as n, {_CHROM} as chrom, {_GENOME} as s, n_nationkey % 2 = 0 as plus, 120 + n_nationkey % 7 as cs, 1730 + n_nationkey % 7 as ce from nation),
ex as (select n, plus, cs, ce, j, 101 + 400 * j + n % 7 as a, 160 + 410 * j + n % 7 as b from g, (select unnest(range(5)) as j)),
ix as (select *, sum(b - a + 1) over (partition by n order by if(plus, j, -j)) as t_last from ex),
dims as (select n, sum(greatest(0, least(b, ce) - greatest(a - 1, cs))) as coding, if(any_value(plus), sum(greatest(0, least(b, cs) - a + 1)), sum(greatest(0, b - greatest(a - 1, ce)))) as utr5, sum(b - a + 1) as size, min(a) as low, max(b) as high from ex group by n),
c as (select c_custkey, c_nationkey as n, c_custkey % 330 + 1 as q, c_custkey % 8 as k from customer),
ends as (select c_custkey, n, q, k, unnest(case k when 1 then [q, q + 2] when 3 then [-(q % 40 + 1)] when 4 then [q % 50 + 1, q % 50 + 2] when 6 then [q + 90, q + 91] else [q] end) as num from c where k < 7),
t as (select *, utr5 + case when k = 4 then coding + num when num > 0 then num else num + 1 end as t, if(k = 2, q % 5 + 1, 0) as off from ends join dims using (n)),
loc as (select t.c_custkey, t.k, t.n, case when t.k = 6 then num
        when g.plus then case when t < 1 then low - 1 + t when t > size then high + t - size + off else a + t - (t_last - (b - a)) + off end
        else case when t < 1 then high + 1 - t when t > size then low - (t - size) - off else b - (t - (t_last - (b - a))) - off end end as place
        from t join g using (n) left join ix on ix.n = t.n and t.t between ix.t_last - (ix.b - ix.a) and ix.t_last),
sp as (select c_custkey, k, n, min(place)::int as lo, max(place)::int as hi from loc group by 1, 2, 3),
x as (select sp.*, s, chrom, plus or k = 6 as fwd, s[lo : hi] as span from sp join g using (n) where lo >= 1 and hi <= 2560 and chrom is not null),
pure as (
    select c_custkey, chrom, s, k in (1, 2) as gone, lo - r as p, s[lo - r : hi - r] as d from (select *, coalesce(list_position(list_transform(range(0, lo - 1), lambda i: s[(lo - 1 - i)::int] = s[(hi - i)::int]), false) - 1, lo - 1)::int as r from x where k in (1, 2, 3, 6))
    union all
    select c_custkey, chrom, s, false, hi - r, if(r % 2 = 1, w[2] || w[1], w) from (select *, coalesce(list_position(list_transform(range(0, hi - 1), lambda i: s[(hi - 1 - i)::int] = w[(2 - i % 2)::int]), false) - 1, hi - 1)::int as r from (select *, if(fwd, 'GA', 'TC') as w from x where k = 4 and hi = lo + 1))
    union all
    select c_custkey, chrom, s, false, lo - r, span from (select *, coalesce(list_position(list_transform(range(0, lo - 1), lambda i: s[(lo - 1 - i)::int] = span), false) - 1, lo - 1)::int as r from x where k = 5 and span = if(fwd, 'T', 'A'))),
plain as (
    select c_custkey, chrom, lo::bigint as pos, span as ref, if(fwd, 'C', 'G') as alt from x where k = 0 and span = if(fwd, 'A', 'T')
    union all
    select c_custkey, chrom, lo::bigint, span, w from (select *, if(fwd, 'TT', 'AA') as w from x where k = 5) where span <> w[1]),
told as (select c_custkey, chrom, pos, ref, alt from plain union all select c_custkey, chrom, {_ANCHORED} from pure)
select customer.c_custkey, chrom, pos, ref, alt from customer left join told on told.c_custkey = customer.c_custkey
""")
def transcript_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of every kind told by a transcript or contig, as left-most edits of the genome."""
    k, q = F.col("c_custkey") % 8, F.col("c_custkey") % 330 + 1
    t = lambda c: c.cast("string")
    cut = F.when(k == 0, F.concat(t(q), F.lit("A>C"))).when(k == 1, F.concat(t(q), F.lit("_"), t(q + 2), F.lit("del"))).when(k == 2, F.concat(t(q), F.lit("+"), t(q % 5 + 1), F.lit("del")))
    cut = cut.when(k == 3, F.concat(F.lit("-"), t(q % 40 + 1), F.lit("dup"))).when(k == 4, F.concat(F.lit("*"), t(q % 50 + 1), F.lit("_*"), t(q % 50 + 2), F.lit("insGA"))).when(k == 5, F.concat(t(q), F.lit("delinsTT")))
    own = F.concat(F.format_string("T%03d.1:c.", F.col("c_nationkey")), cut)
    text = F.when(k == 6, F.concat(F.format_string("NC_%06d.1:g.", F.col("c_nationkey") + 1), t(q + 90), F.lit("_"), t(q + 91), F.lit("dup"))).when(k == 7, "p.Val5Gly").otherwise(own)
    changes = table(spark, sf_dir, "customer").select("c_custkey", text.alias("hgvs"))
    return genome.transcript_alleles(changes, "hgvs", _transcripts(spark, sf_dir), _chunks(spark, sf_dir, 400), 400).select("c_custkey", "chrom", "pos", "ref", "alt")


@query(f"""
with g as (select n_nationkey as n, {_CHROM} as chrom, {_GENOME} as s from nation),
e as (select s_suppkey, chrom, s, s_suppkey % 2 = 0 as gone, s_suppkey * 53 % 2400 + 1 as lo, case s_suppkey % 3 when 0 then 64 else s_suppkey % 5 + 1 end as m from supplier join g on n = s_nationkey where chrom is not null),
r as (select *, coalesce(list_position(list_transform(range(0, lo - 1), lambda i: s[(lo - 1 - i)::int] = s[(lo + m - 1 - i)::int]), false) - 1, lo - 1)::int as r from e),
pure as (select s_suppkey, chrom, s, gone, (lo - r)::int as p, s[(lo - r)::int : (lo - r + m - 1)::int] as d from r)
select s_suppkey, chrom, {_ANCHORED} from pure
""")
def left_aligned_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions and repeats of some bases or of a whole period, which move left over many chunks to the contig's start."""
    k = F.col("s_suppkey")
    chunks = _chunks(spark, sf_dir, 400)
    at, size = k * 53 % 2400 + 1, F.when(k % 3 == 0, 64).otherwise(k % 5 + 1)
    n = F.col("s_nationkey")
    name = F.when(n < 22, F.concat(F.lit("chr"), (n + 1).cast("string"))).when(n == 22, "chrX").when(n == 23, "chrY")
    spans = table(spark, sf_dir, "supplier").select(k.alias("id"), name.alias("chrom"), (at - 1).alias("start"), (at - 1 + size).alias("stop")).where("chrom is not null")
    found = readers.fetch_intervals(spans, chunks, 400)
    alt = F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.concat("seq", "seq"))
    edits = found.select(F.col("id").alias("s_suppkey"), "chrom", (F.col("start") + 1).alias("pos"), F.col("seq").alias("ref"), alt.alias("alt"))
    return genome.left_aligned(edits, ["s_suppkey"], chunks, 400)


@query(f"""
with {_VARIANTS},
m as (select doc_id, doc_id % 64 + 1 as p, pos + head as start, len(r) as x, len(a) as y from e),
o as (select *, case when x = y or p < start + least(x, y) then p when p >= start + x then p + y - x end as there, y < x and start - 1 + y >= 1 and start + x <= 64 as cut from m)
select doc_id, there::bigint as there, case when there < 6 then there when there > 6 then there - 1 end::bigint as twice, case when cut then start - 1 + y end::bigint as left_end, case when cut then start + x end::bigint as right_end from o
""")
def edit_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position through one edit and through a second one on its result, and the neighbours that a deletion makes."""
    at = (F.col("doc_id") % 64 + 1).cast("long")
    maps = _variants(spark, sf_dir).withColumn("m", coordinates.edit_map(F.char_length("s"), F.col("pos"), F.col("ref"), F.col("alt")))
    longer = F.char_length("s") + F.char_length("alt") - F.char_length("ref")
    both = coordinates.composed(F.col("m"), coordinates.edit_map(longer, F.lit(5), F.lit("GT"), F.lit("G")))
    new = F.get(coordinates.junctions(F.col("m")), F.lit(0))
    return maps.select("doc_id", coordinates.mapped(F.col("m"), at).alias("there"), coordinates.mapped(both, at).alias("twice"), new["left"].alias("left_end"), new["right"].alias("right_end"))


@query("""
with s as (select o_orderkey, o_custkey % 3 as k, datediff('day', date '1970-01-01', o_orderdate::date) * 100000 + o_orderkey % 100000 as a, o_orderkey % 7 * 40 as w from orders),
r as (select *, max(a + w) over (partition by k order by a, a + w rows between unbounded preceding and 1 preceding) as reached from s)
select o_orderkey, reached from r where reached >= a
""")
def overlapping_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of orders that an earlier span of their group reaches into, three groups over the whole table; equal spans go by order."""
    a = F.unix_date(F.to_date("o_orderdate")).cast("long") * 100_000 + F.col("o_orderkey") % 100_000
    spans = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("k"), a.alias("a"), (a + F.col("o_orderkey") % 7 * 40).alias("b"))
    return joins.overlapping_intervals(spans, ["k"], "a", "b", ["o_orderkey"]).select("o_orderkey", "reached")
