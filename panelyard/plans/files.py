"""Tables written to files in the shared folder, read back by the sources, and compared with the tables they came from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import sequence
from panelyard.operators import checks
from panelyard.plans.registry import query, table
from panelyard.sources import readers, writers
from panelyard.sources.folders import new_folder, opened
from panelyard.streaming import tables
from panelyard.streaming.log import KeyedTable


def _text_files(df: DataFrame, folder: str, lines: Column) -> str:
    """A folder of text files with an array's lines for each row."""
    df.select(F.explode(lines).alias("value")).write.text(folder)
    return folder


@query("select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with blank lines between them."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = _text_files(customers, new_folder(spark, "jsonl"), F.array(F.to_json(F.struct("*")), F.lit("")))
    return readers.read_jsonl(spark, path, customers.schema)


@query("""
select codec, o_orderkey, o_orderstatus, o_orderpriority, o_custkey from orders, (values ('gzip'), ('zstd')) v(codec)
""")
def packed_jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON lines packed either way, read back line by line."""
    orders, out = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"), []
    for codec in ("gzip", "zstd"):
        manifest = writers.write_jsonl(orders, "o_orderkey", new_folder(spark, f"packed-{codec}"), 1_000_000, codec)
        own = F.from_json("line", orders.schema).alias("r")
        out.append(readers.read_packed_lines(manifest).select(F.lit(codec).alias("codec"), own).select("codec", "r.*"))
    return out[0].unionByName(out[1])


@query("""
select codec, rule, (select count(*) from customer) as n_records from (values ('gzip'), ('zstd')) v(codec), (values ('records'), ('content_sha256'), ('artifact_bytes')) r(rule)
""")
def packed_artifact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors as written break no rule; with three fields changed each file breaks those three."""
    customers, out = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), []
    for codec in ("gzip", "zstd"):
        manifest = writers.write_jsonl(customers, "c_custkey", new_folder(spark, f"artifacts-{codec}"), 1_000_000, codec)
        wrong = manifest.withColumns({"records": F.col("records") + 1, "content_sha256": F.sha2("content_sha256", 256), "artifact_bytes": F.col("artifact_bytes") - 1})
        broken = readers.verify_packed(manifest).union(readers.verify_packed(wrong))
        sized = broken.join(manifest.select(F.col("path").alias("key"), "records"), "key")
        out.append(sized.groupBy("rule").agg(F.sum("records").alias("n_records")).select(F.lit(codec).alias("codec"), "rule", "n_records"))
    return out[0].unionByName(out[1])


@query("select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem")
def gzip_tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, path = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"], new_folder(spark, "tsv")
    table(spark, sf_dir, "lineitem").select(*columns, "l_tax").write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    rows = readers.read_delimited(spark, path, columns, "\t")
    types = ("bigint", "int", "double", "string")
    lines = table(spark, sf_dir, "lineitem").schema
    return rows.select(*(F.col(c).cast(lines[c].dataType if t != "string" else t).alias(c) for c, t in zip(columns, types, strict=True)))


_SCORES = """
s as (select o_orderkey, 'urn:set:' || o_custkey % 3 || '#' || o_orderkey as accession,
        case o_orderkey % 7 when 0 then 'NC_000002.12:g.' || (o_orderkey % 90 + 1) || 'A>T' when 1 then 'NC_000002.12:g.' || (o_orderkey % 90 + 1) || 'A>A' when 2 then 'c.5del' when 3 then '' else 'NC_000007.14:g.' || (o_orderkey % 500 + 1) || 'C>G' end as hgvs,
        case when o_orderkey % 11 = 0 then 'NaN' when o_orderkey % 13 = 0 then '' else (o_orderkey % 1000 / 8.0)::double::varchar end as score,
        case o_orderpriority when '1-URGENT' then 'fail' else 'pass' end as qc from orders)
"""


def _score_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_delimited(spark, _score_folder(spark, sf_dir), ["accession", "hgvs_nt", "score", "qc"])


def _score_folder(spark: SparkSession, sf_dir: str) -> str:
    """Scores of allele texts in CSV with a byte order mark."""
    k = F.col("o_orderkey")
    hgvs = F.when(k % 7 == 0, F.concat(F.lit("NC_000002.12:g."), (k % 90 + 1).cast("string"), F.lit("A>T"))).when(k % 7 == 1, F.concat(F.lit("NC_000002.12:g."), (k % 90 + 1).cast("string"), F.lit("A>A"))).when(k % 7 == 2, "c.5del").when(k % 7 == 3, "").otherwise(F.concat(F.lit("NC_000007.14:g."), (k % 500 + 1).cast("string"), F.lit("C>G")))
    score = F.when(k % 11 == 0, "NaN").when(k % 13 == 0, "").otherwise((k % 1000 / 8.0).cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("urn:set:"), (F.col("o_custkey") % 3).cast("string"), F.lit("#"), k.cast("string")).alias("﻿accession"), hgvs.alias("hgvs_nt"), score.alias("score"), F.when(F.col("o_orderpriority") == "1-URGENT", "fail").otherwise("pass").alias("qc"))
    path = new_folder(spark, "scores")
    rows.write.option("header", True).option("emptyValue", "").csv(path)
    return path


@query(f"""
with {_SCORES},
m as (select *, try_cast(score as double) as x, regexp_extract(hgvs, '^(NC_0*([0-9]+))\\.[0-9]+:g\\.([0-9]+)([ACGT])>([ACGT])$', 2) as n, regexp_extract(hgvs, ':g\\.([0-9]+)', 1) as pos, regexp_extract(hgvs, '([ACGT])>([ACGT])$', 1) as ref, regexp_extract(hgvs, '([ACGT])>([ACGT])$', 2) as alt from s),
r as (select *, case when x is null or not isfinite(x) then 'non_finite_score' when qc = 'fail' then 'source_qc_failure' when n = '' then 'unsupported_or_unmapped_variant' when n <> '7' then 'unexpected_chromosome' when ref = alt then 'invalid_allele' end as reason,
       case when n <> '' then 'chr' || n || ':' || pos || ':' || ref || ':' || alt end as key from m)
select accession, case when reason is null then key end as key, case when reason is null then -x end as oriented, coalesce(reason, if(count(*) filter (reason is null) over (partition by key) > 1, 'duplicate_variant', 'kept')) as outcome from r
""")
def score_csv_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of a score file: the key of its genomic allele and its oriented score, or why it is left out."""
    rows = _score_file(spark, sf_dir)
    parts = sequence.hgvs_parts(F.col("hgvs_nt"))
    rows = rows.withColumns({"x": checks.finite("score"), "mode": sequence.coordinate_mode(F.col("hgvs_nt")), "p": parts, "contig": F.regexp_extract("hgvs_nt", "^([^:]+):", 1)})
    rows = rows.withColumn("chrom", readers.contig_name("contig"))
    mapped = (F.col("mode") == "genomic") & (F.col("p")["kind"] == ">") & F.col("chrom").isNotNull()
    qc = checks.tri_state(F.col("qc"), ["fail"], ["pass"])
    reason = checks.reasons([
        ("non_finite_score", F.col("x").isNull()),
        ("source_qc_failure", qc == "exclude"),
        ("unsupported_or_unmapped_variant", ~F.coalesce(mapped, F.lit(False))),
        ("unexpected_chromosome", F.col("chrom") != "chr7"),
        ("invalid_allele", ~sequence.valid_allele(F.col("p")["start"], F.col("p")["ref"], F.col("p")["alt"])),
    ])
    key = F.concat_ws(":", "chrom", F.col("p")["start"].cast("string"), F.col("p")["ref"], F.col("p")["alt"])
    judged = rows.withColumn("reason", reason).withColumn("key", F.when(F.col("reason").isNull(), key))
    twice = checks.duplicated_keys(judged.where("key is not null").select("key"), ["key"]).select("key", F.lit(True).alias("_twice"))
    outcome = F.coalesce("reason", F.when(F.col("_twice"), "duplicate_variant"), F.lit("kept"))
    return judged.join(twice, "key", "left").select("accession", "key", F.when(F.col("reason").isNull(), checks.oriented(F.col("x"), -1)).alias("oriented"), outcome.alias("outcome"))


@query(f"""
with {_SCORES} select 'accession' as rule, accession as key from s where accession not like 'urn:set:1#%'
""")
def score_accession_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other score sets in one set's file."""
    _, broken = readers.read_scores(spark, _score_folder(spark, sf_dir), "urn:set:1", "qc")
    return broken


@query(f"""
with {_SCORES} select accession, 'NC_000007.14:' || regexp_extract(hgvs, ':g\\.([0-9]+)', 1) || ':C:G' as key from s where hgvs like 'NC_000007.14:g.%' and o_orderkey % 7 > 3
""")
def hgvs_csv_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys derived from the allele texts of a CSV file, for one reference sequence."""
    rows = _score_file(spark, sf_dir).where(F.startswith(F.col("hgvs_nt"), F.lit("NC_000007.14:g."))).withColumn("p", sequence.hgvs_parts(F.col("hgvs_nt")))
    return rows.select("accession", F.concat_ws(":", F.lit("NC_000007.14"), F.col("p")["start"].cast("string"), F.col("p")["ref"], F.col("p")["alt"]).alias("key"))


def _vcf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    fields = [F.concat(F.lit("chr"), (k % 22 + 1).cast("string")), F.when(k % 40 == 0, "x").otherwise((k + 10).cast("string")), F.concat(F.lit("v"), k.cast("string")), F.lit("A"), F.when(k % 2 == 0, "G").otherwise("T"), F.lit("."), F.when(k % 3 == 0, "SIGN").when(k % 3 == 1, "MIN").otherwise("LOW"), F.concat(F.lit("EL=E"), (k % 5).cast("string"), F.lit(";SC="), F.col("c_nationkey").cast("string"))]
    line = F.concat_ws("\t", *fields)
    short = F.when(k % 50 == 7, F.concat(F.lit("chr1\t"), k.cast("string"), F.lit("\tshort"))).otherwise(line)
    path = new_folder(spark, "vcf")
    customers = table(spark, sf_dir, "customer")
    customers.select(F.explode(F.array_compact(F.array(F.when(k % 100 == 1, "##comment"), short, F.when(k % 60 == 11, line)))).alias("value")).write.option("compression", "gzip").text(path)
    return readers.read_vcf(spark, path, ["SIGN", "MIN", "LOW"])


_VCF = """
v as (select c_custkey as k, 'chr' || (c_custkey % 22 + 1) as chrom, if(c_custkey % 40 = 0, 'x', (c_custkey + 10)::varchar) as pos, 'v' || c_custkey as id, if(c_custkey % 2 = 0, 'G', 'T') as alt, case c_custkey % 3 when 0 then 'SIGN' when 1 then 'MIN' else 'LOW' end as filter, 'E' || (c_custkey % 5) as element, c_nationkey::varchar as score, c_custkey % 50 = 7 as short, c_custkey % 60 = 11 as again from customer)
"""


@query(f"""
with {_VCF}, r as (select * from v where not short union all select * from v where again)
select chrom, try_cast(pos as bigint) as pos, id, alt, filter, element, score from r where filter in ('SIGN', 'MIN')
""")
def vcf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of packed VCF files that pass a filter of their filters."""
    good, _ = _vcf(spark, sf_dir)
    return good.where(F.col("filter").isin("SIGN", "MIN")).select("chrom", "pos", "id", "alt", "filter", F.col("info")["EL"].alias("element"), F.col("info")["SC"].alias("score"))


@query(f"""
with {_VCF}
select 'eight_columns' as rule, count(*) as n from v where short union all select 'filter_domain', count(*) from v where short
union all select 'position', (select count(*) from v where pos = 'x' and not short) + (select count(*) from v where pos = 'x' and again)
union all select 'unique_key', count(*) from v where again and not short and pos <> 'x'
""")
def vcf_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, broken = _vcf(spark, sf_dir)
    counted = broken.groupBy("rule").agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(r,) for r in ("eight_columns", "filter_domain", "position", "unique_key")], "rule string")
    return rules.join(counted, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


def _workbooks(df: DataFrame, by: str, columns: list[str], folder: str) -> DataFrame:
    """A workbook for each value of ``by``: a title row, then the header, then the rows; texts are shared or inline strings."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def write(key: tuple, held: pa.Table) -> pa.Table:
        rows = held.select(columns).to_pylist()
        shared = sorted({str(r[columns[0]]) for r in rows})

        def cell(k: int, n: int, value: object) -> str:
            at = f'r="{chr(65 + k)}{n}"'
            if k == 0 and n > 2:
                return f'<c {at} t="s"><v>{shared.index(str(value))}</v></c>'
            return f"<c {at}><v>{value}</v></c>" if isinstance(value, int | float) else f'<c {at} t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'

        lines = [["title"], columns, *([r[c] for c in columns] for r in rows)]
        sheet = "".join(f'<row r="{n}">' + "".join(cell(k, n, v) for k, v in enumerate(line)) + "</row>" for n, line in enumerate(lines, 1))
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
            book.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
        store, at = opened(folder)
        store.create_dir(at, recursive=True)
        path = f"book-{key[0].as_py()}.xlsx"
        with store.open_output_stream(f"{at}/{path}", compression=None) as out:
            out.write(packed.getvalue())
        return pa.table({"path": pa.array([f"{folder}/{path}"])})

    return df.select(by, *columns).groupBy(by).applyInArrow(write, "path string")


@query("select n_name as label, n_nationkey::varchar as number, '<&> ' || n_name as note from nation")
def xlsx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worksheets of one workbook for each region, under new names."""
    nations = table(spark, sf_dir, "nation").withColumn("n_note", F.concat(F.lit("<&> "), "n_name"))
    books = _workbooks(nations, "n_regionkey", ["n_name", "n_nationkey", "n_note"], new_folder(spark, "xlsx"))
    paths = ",".join(sorted(r.path for r in books.collect()))  # a workbook for each region
    return readers.read_renamed(spark, paths, {"n_name": "label", "n_nationkey": "number", "n_note": "note"}, header_row=2)


@query("""
select 'tsv' as kind, s_name as label, s_suppkey::varchar as number from supplier union all select 'csv', c_name, c_custkey::varchar from customer union all select 'xlsx', n_name, n_nationkey::varchar from nation
""")
def table_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of files read by one reader that goes by their suffix."""
    tsv, csv = f"{new_folder(spark, 'tables')}.tsv.gz", f"{new_folder(spark, 'tables')}.csv"
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(tsv)
    table(spark, sf_dir, "customer").select("c_name", "c_custkey").write.option("header", True).csv(csv)
    books = _workbooks(table(spark, sf_dir, "nation"), "n_regionkey", ["n_name", "n_nationkey"], new_folder(spark, "xlsx"))
    xlsx = ",".join(sorted(r.path for r in books.collect()))
    parts = [readers.read_renamed(spark, path, {name: "label", key: "number"}, header_row=2).select(F.lit(kind).alias("kind"), "label", "number") for kind, path, name, key in (("tsv", tsv, "s_name", "s_suppkey"), ("csv", csv, "c_name", "c_custkey"), ("xlsx", xlsx, "n_name", "n_nationkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _transcripts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A document of several lines for each nation, with an exon for each of its suppliers."""
    k = F.col("s_suppkey")
    exons = F.sort_array(F.collect_list(F.array(k * 100, k * 100 + F.when(k % 17 == 0, 0).otherwise(k % 50 + 1), k)))
    per = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(exons.alias("exons"), F.min(k).alias("least"))
    n = F.col("s_nationkey")
    body = F.struct(F.format_string("NC_%06d.1", n + 1).alias("contig"), F.when(n % 7 == 3, "?").when(n % 2 == 0, "+").otherwise("-").alias("strand"), "exons", (F.col("least") * 100).alias("cds_start"), F.lit(None).cast("long").alias("cds_end"))
    text = F.to_json(F.struct(F.format_string("T%03d", n).alias("id"), F.format_string("G%d", n).alias("gene"), F.lit("1").alias("version"), body.alias("assembly")))
    path = new_folder(spark, "transcripts")
    files = per.select(F.format_string("t-%d.json", n).alias("name"), F.regexp_replace(text, ",", ",\n").alias("content"))
    writers.write_files(files, path).count()
    schema = "id string, gene string, version string, assembly struct<contig: string, strand: string, exons: array<array<bigint>>, cds_start: bigint, cds_end: bigint>"
    return readers.transcripts(readers.read_json_documents(spark, path, schema))


@query("""
select printf('T%03d', s_nationkey) as id, case when s_nationkey + 1 <= 22 then 'chr' || (s_nationkey + 1) when s_nationkey = 22 then 'chrX' when s_nationkey = 23 then 'chrY' end as chrom,
       count(*) as n_exons, min(s_suppkey * 100 + 1)::bigint as first_start, max(s_suppkey * 100 + if(s_suppkey % 17 = 0, 0, s_suppkey % 50 + 1))::bigint as last_stop from supplier group by s_nationkey
""")
def transcript_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _transcripts(spark, sf_dir)
    return rows.select("id", "chrom", F.size("exons").cast("long").alias("n_exons"), F.array_min("exons")["start"].alias("first_start"), F.array_max(F.transform("exons", lambda e: e["stop"])).alias("last_stop"))


@query("""
with n as (select s_nationkey, bool_or(s_suppkey % 17 = 0) as bad from supplier group by 1)
select rule, printf('T%03d', s_nationkey) as key from n join (values ('contig'), ('strand'), ('exon')) v(rule) on (rule = 'contig' and s_nationkey + 1 > 24) or (rule = 'strand' and s_nationkey % 7 = 3) or (rule = 'exon' and bad)
""")
def transcript_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, broken = _transcripts(spark, sf_dir)
    return broken


@query("""
select 'urn:' || s_suppkey as urn, s_name as title, case when s_suppkey % 10 = 0 and s_suppkey % 20 = 0 then 'excluded' when s_suppkey % 10 = 0 then 'selected' else 'excluded' end as decision,
       case when s_suppkey % 20 = 0 then 'target_mismatch' when s_suppkey % 10 = 0 then 'reviewed' when s_nationkey in (select s_nationkey from supplier where s_suppkey % 10 = 0 and s_suppkey % 20 <> 0) then 'noncanonical' else 'outside_catalogue' end as reason from supplier
""")
def catalogue_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue document for each nation; every tenth supplier was reviewed, half of them under a gene that it lacks."""
    k = F.col("s_suppkey")
    entry = F.struct(F.concat(F.lit("urn:"), k.cast("string")).alias("urn"), F.col("s_name").alias("title"), F.array(F.struct(F.when(k % 2 == 0, F.concat(F.lit("G"), F.col("s_nationkey").cast("string"))).alias("mapped"), F.concat(F.lit("G"), F.col("s_nationkey").cast("string")).alias("name"))).alias("targets"))
    suppliers = table(spark, sf_dir, "supplier")
    documents = suppliers.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("content"))
    path = new_folder(spark, "catalogue")
    writers.write_files(documents.select(F.format_string("c-%d.json", "s_nationkey").alias("name"), "content"), path).count()
    catalogue = readers.read_json_documents(spark, path, "entries array<struct<urn: string, title: string, targets: array<struct<mapped: string, name: string>>>>")
    chosen = suppliers.where(k % 10 == 0).select(F.concat(F.lit("urn:"), k.cast("string")).alias("urn"), F.when(k % 20 == 0, "G?").otherwise(F.concat(F.lit("G"), F.col("s_nationkey").cast("string"))).alias("gene"))
    return readers.catalogue_decisions(catalogue, chosen).drop("genes")


_EXONS = """
e as (select p_partkey as k, if(p_partkey % 70 = 5, '', 'E' || (p_partkey // (1 + (p_partkey % 90 = 1)::int))) as exon_id, case when p_partkey % 31 = 0 then 0 when p_partkey % 2 = 0 then 1 else -1 end as strand, p_partkey as start, p_partkey + p_size - 1 as stop, p_size + (p_partkey % 45 = 2)::int as length,
        repeat('ACGT', 20) || if(p_partkey % 41 = 3, 'N', 'u') as sequence from part)
"""


def _exons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 70 == 5, "").otherwise(F.concat(F.lit("E"), F.floor(k / F.when(k % 90 == 1, 2).otherwise(1)).cast("string")))
    rows = table(spark, sf_dir, "part").select(name.alias("exon_id"), F.when(k % 31 == 0, 0).when(k % 2 == 0, 1).otherwise(-1).alias("strand"), k.alias("start"), (k + size - 1).alias("stop"), (size + F.when(k % 45 == 2, 1).otherwise(0)).alias("length"), F.concat(F.lit("ACGT" * 20), F.when(k % 41 == 3, "N").otherwise("u")).alias("sequence"))
    path = new_folder(spark, "exons")
    rows.write.option("header", True).option("sep", "\t").option("emptyValue", " ").csv(path)
    return readers.exon_rows(readers.read_delimited(spark, path, ["exon_id", "strand", "start", "stop", "length", "sequence"], "\t"), 20)


@query(f"""
with {_EXONS} select exon_id, strand::bigint as strand, start::bigint as start, stop::bigint as stop, length::bigint as length, replace(upper(sequence), 'U', 'T') as sequence, (81 - length - 20)::bigint as upstream from e
""")
def exon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _exons(spark, sf_dir)
    return rows.select(F.coalesce("exon_id", F.lit("")).alias("exon_id"), "strand", "start", "stop", "length", "sequence", F.col("upstream").cast("long").alias("upstream"))


@query(f"""
with {_EXONS}
select 'exon_id' as rule, exon_id as key from e where exon_id = '' union all select 'strand', exon_id from e where strand = 0 union all select 'geometry', exon_id from e where stop - start + 1 <> length or start < 1
union all select 'sequence', exon_id from e where sequence like '%N' union all select 'insert', exon_id from e where 81 - length - 20 < 1 union all select 'unique', exon_id from e group by exon_id having count(*) > 1
""")
def exon_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, broken = _exons(spark, sf_dir)
    return broken.select("rule", F.coalesce("key", F.lit("")).alias("key"))


_GENOME = "repeat(translate(sha256(n_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 40)"


@query(f"""
with g as (select n_nationkey, 'c' || n_nationkey as chrom, {_GENOME} as s from nation), i as (select s_suppkey as id, 'c' || s_nationkey as chrom, (s_suppkey * 37) % 2600 - 20 as a, (s_suppkey * 37) % 2600 - 20 + s_suppkey % 300 as b from supplier)
select id, case when a >= 0 and b <= 2560 then substr(s, a::int + 1, (b - a)::int) end as seq,
       repeat('N', greatest(0, least(-a, b - a))::int) || case when b > 0 and a < 2560 then substr(s, greatest(a, 0)::int + 1, (least(b, 2560) - greatest(a, 0))::int) else '' end || repeat('N', greatest(0, least(b - 2560, b - a))::int) as padded
from i join g using (chrom)
""")
def fasta_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of sequences that lie in FASTA files in lines of 60 bases: strict, and padded with N."""
    bases = F.repeat(F.translate(F.sha2("n_name", 256), "0123456789abcdef", "ACGTACGTACGTACGT"), 40)
    path = new_folder(spark, "fasta")
    lines = F.split(F.concat(F.concat(F.lit(">c"), F.col("n_nationkey").cast("string"), F.lit(" of "), F.col("n_name")), F.lit("\n"), F.regexp_replace(bases, "(.{60})", "$1\n")), "\n")
    _text_files(table(spark, sf_dir, "nation").coalesce(2), path, lines)
    chunks = readers.read_fasta_chunks(spark, path, 100)
    k = F.col("s_suppkey")
    start = k * 37 % 2600 - 20
    intervals = table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("chrom"), start.alias("start"), (start + k % 300).alias("stop"))
    strict, padded = (readers.fetch_intervals(intervals, chunks, 100, p) for p in (False, True))
    return strict.select("id", "seq").join(padded.select("id", F.col("seq").alias("padded")), "id")


@query("""
select rule, 'n-' || n_nationkey || '.txt' as key from nation join (values ('bytes'), ('sha256'), ('md5'), ('present')) v(rule)
on (n_nationkey % 5 = 1 and rule = 'bytes') or (n_nationkey % 5 = 2 and rule = 'sha256') or (n_nationkey % 5 = 3 and rule = 'md5') or (n_nationkey % 5 = 4 and rule in ('present', 'bytes', 'sha256', 'md5'))
""")
def pinned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for most nations against pins of which some are wrong."""
    n, path = F.col("n_nationkey"), new_folder(spark, "pinned")
    rows = table(spark, sf_dir, "nation").select(F.format_string("n-%d.txt", n).alias("name"), F.col("n_name").alias("content"), n.alias("n"))
    writers.write_files(rows.where("n % 5 <> 4"), path).count()
    wrong = F.lit("0")
    pins = rows.select("name", (F.length("content") + F.when(F.col("n") % 5 == 1, 1).otherwise(0)).cast("long").alias("bytes"), F.when(F.col("n") % 5 == 2, wrong).otherwise(F.sha2("content", 256)).alias("sha256"), F.when(F.col("n") % 5 == 3, wrong).when(F.col("n") % 5 == 0, F.lit(None)).otherwise(F.md5("content")).alias("md5"))
    return readers.verify_files(spark, path, pins)


@query("""
select n_name as name, length(n_name || ', "quoted"' || chr(10))::bigint as bytes, sha256(n_name || ', "quoted"' || chr(10)) as sha256 from nation
""")
def files_written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are there already with the same content may be written again, and are replaced only where that is asked for."""
    path = new_folder(spark, "once")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat("n_name", F.lit(', "quoted"\n')).alias("content"))
    writers.write_files(rows.withColumn("content", F.lit("old")), path).count()
    return writers.write_files(rows, path, replace=True)


@query("select c_custkey::varchar as c_custkey, c_name || ', \"' || c_mktsegment || '\"' as note from customer")
def quoted_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with commas and quotes within values, written in order and read back."""
    path = new_folder(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("note")), ["c_custkey"], path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("select 'r1-' || l_returnflag as run_id, 'r1' as source_run_id, l_returnflag, count(*) as n, sum(l_linenumber)::bigint as total from lineitem group by l_returnflag")
def split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run split by ship mode: each part is a run of its own and keeps where it came from."""
    path = new_folder(spark, "split")
    writers.write_split(table(spark, sf_dir, "lineitem").select(F.lit("r1").alias("run_id"), "l_returnflag", "l_orderkey", "l_linenumber"), "l_returnflag", path, "run_id", tasks=4)
    return spark.read.parquet(path).groupBy("run_id", "source_run_id", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))


@query("""
with f as (select 'v2/' || p_type || '/' || p_brand || '.jsonl' as path, sha256(p_brand) as sha256, count(*) as records from part group by p_type, p_brand),
r as (select 'v2/version.json' as path, sha256(string_agg(sha256 || ' ' || path, chr(10) order by sha256 || ' ' || path)) as sha256, sum(records)::bigint as records from f)
select replace(path, 'v2/', 'public/latest/') as path, sha256, records from (select * from f union all select * from r)
""")
def promoted_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a version with its own digest, promoted to another tree."""
    files = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("family"), "p_brand").agg(F.count("*").alias("records")).select("family", F.concat("p_brand", F.lit(".jsonl")).alias("name"), F.sha2("p_brand", 256).alias("sha256"), "records")
    return writers.promoted(writers.version_tree(files, "v2"), "path", "v2", "public/latest")


@query("select n_nationkey, n_name from nation")
def cached_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A processed table read back under the identity of what it was made from."""
    path = new_folder(spark, "cache")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nations.write.parquet(path)
    found = writers.tree_digest(nations, "n_nationkey").first().asDict()
    again = writers.tree_digest(spark.read.parquet(path), "n_nationkey").first().asDict()
    return readers.load_cache(spark, path, found, again)


@query("select user_id, count(*) as n, round(sum(value), 6) as total from events group by user_id")
def resumed_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into a table twice over: rows that are there already are not appended again."""
    source, target = new_folder(spark, "events"), new_folder(spark, "appended")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    events.write.parquet(source)
    for k in range(2):
        stream = spark.readStream.schema(events.schema).parquet(source)
        append = lambda batch, epoch, k=k: tables.append_new(batch, epoch, target, ["event_id"], f"run-{k}")
        run = stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{target}-log-{k}").trigger(availableNow=True).start()
        run.awaitTermination()
    return KeyedTable(spark, target, ["event_id"]).rows().groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""
with m as (select p_brand as model, min(p_partkey) as k from part group by p_brand), f as (select *, k % 8 as m from m)
select 'row' as kind, model as key, 'Family ' || (k % 3) as detail from f
union all select rule, model, '' from f join (values ('version', 1), ('fields', 1), ('fields', 2), ('release_date', 2), ('release_date', 3), ('cutoff_pair', 5), ('fields', 5), ('cutoff', 6), ('cutoff_url', 7)) v(rule, place) on place = m
""")
def model_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue document for each brand, of either version; some lack a field or have a date that does not exist."""
    k, m = F.col("k"), F.col("k") % 8
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model")).agg(F.min("p_partkey").alias("k"))
    fields = {
        "family": F.concat(F.lit("Family "), (k % 3).cast("string"), F.when(m == 4, " ").otherwise("")),
        "release_date": F.when(m == 3, "2024-02-30").when(m != 2, "2024-02-29"),
        "knowledge_cutoff": F.when(m == 6, "2023-13").when(m != 4, "2023-10"),
        "knowledge_cutoff_url": F.when(m == 7, "http://x").when(~m.isin(4, 5), "https://x"),
    }
    entry = F.map_filter(F.create_map(*[x for n, c in fields.items() for x in (F.lit(n), c)]), lambda n, v: v.isNotNull())
    text = F.to_json(F.struct(F.when(m == 1, "2.0").when(m == 4, "1.0").otherwise("1.1").alias("schema_version"), F.create_map("model", entry).alias("models")))
    path = new_folder(spark, "models")
    writers.write_files(brands.select(F.format_string("m-%d.json", "k").alias("name"), text.alias("content")), path).count()
    rows, broken = readers.model_catalogue(readers.read_json_documents(spark, path, "schema_version string, models map<string, map<string, string>>"))
    return rows.select(F.lit("row").alias("kind"), F.col("model").alias("key"), F.col("family").alias("detail")).unionByName(broken.select(F.col("rule").alias("kind"), "key", F.lit("").alias("detail")))
