"""Readers that fail closed: fixed schemas, required columns, no inference."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelyard.functions import sequence, temporal
from panelyard.functions.digests import canonical_json
from panelyard.operators import checks
from panelyard.sources.folders import opened


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, allow_empty: bool = False) -> DataFrame:
    """JSON lines (also .gz) under a fixed schema; blank lines are passed over, anything but an object of the schema fails.

    An input without a record fails too, unless ``allow_empty``.
    """
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not allow_empty and df.isEmpty():
        raise ValueError(f"no records: {path}")
    return df


def read_delimited(spark: SparkSession, path: str, required: list[str], sep: str = ",", header_prefix: str | None = None) -> DataFrame:
    """CSV or TSV (also .gz) with a header: all columns as text, extra ones welcome, required ones there, none twice, no ragged row.

    A byte order mark before the header is dropped.  ``header_prefix`` marks comment lines to pass over.  A .gz file can't be
    split, so its rows are dealt anew.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST").option("enforceSchema", False)
    reader = reader.option("comment", header_prefix) if header_prefix else reader
    first = reader.option("header", False).option("inferSchema", False).csv(path).limit(1).collect()  # the header as it is written; as column names, repeated ones are renamed
    names = [(v or "").lstrip("﻿").strip() for v in first[0]] if first else []
    if len(set(names)) != len(names):
        raise ValueError(f"a column stands twice: {names}")
    df = reader.option("header", True).csv(path).toDF(*names)
    checks.require_columns(df, required)
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def read_scores(spark: SparkSession, path: str, urn: str, qc: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a score set's CSV (accession, hgvs_nt, score, the QC column if one is named), and its violations: rule, key.

    An accession is the set's URN, a # and the row's own part; rows of another set break the rule accession.
    """
    rows = read_delimited(spark, path, ["accession", "hgvs_nt", "score", *([qc] if qc else [])])
    return rows, checks.violations(rows, F.col("accession"), {"accession": F.startswith(F.col("accession"), F.lit(f"{urn}#"))})


def read_vcf(spark: SparkSession, path: str, filters: list[str]) -> tuple[DataFrame, DataFrame]:
    """Variants of a VCF (also .gz) and its violations: chrom, pos, id, ref, alt, filter, info (map); rule, key.

    Comment lines start with #.  Violations: fewer than eight columns, a filter outside ``filters``, a position that is no
    number, a repeated (chrom, pos, ref, alt).
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    p = F.split("value", "\t")
    rows = lines.select("value", F.size(p).alias("n"), *(F.get(p, F.lit(k)).alias(c) for k, c in enumerate(("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"))))
    rules = {"eight_columns": F.col("n") >= 8, "filter_domain": F.col("filter").isin(filters), "position": F.col("pos").rlike(r"\A[1-9][0-9]*\z")}
    broken = checks.violations(rows, F.col("value"), rules)
    fields = F.expr("str_to_map(info, ';', '=')")
    good = rows.where("n >= 8").select("chrom", F.expr("try_cast(pos as bigint)").alias("pos"), "id", "ref", "alt", "filter", fields.alias("info"))
    key = F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt")
    twice = checks.duplicated_keys(good.where("pos is not null").select(key.alias("key")), ["key"]).select(F.lit("unique_key").alias("rule"), "key")
    return good, broken.union(twice)


def read_packed_lines(manifest: DataFrame) -> DataFrame:
    """Lines of packed files (.gz, .zst) by a manifest's ``path``: path, number (from 1), line.  Files are read as streams."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                done = 0
                for lines, _ in _unpacked(path):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(range(done + 1, done + len(lines) + 1), pa.int64()), pa.array([x.decode() for x in lines], pa.string())], names=["path", "number", "line"])
                    done += len(lines)

    return _one_each(manifest, "path").mapInArrow(read, "path string, number long, line string")


def verify_packed(manifest: DataFrame) -> DataFrame:
    """Packed JSON-lines files against their descriptors: violations (rule, key is the path).

    Rules: artifact_bytes, artifact_sha256, content_bytes, content_sha256, records; line_feed (the last line has one, no line
    a carriage return), canonical (every line is an object in canonical form).  A file is gone through once, as a stream.
    """
    names = ["records", "content_sha256", "content_bytes", "artifact_sha256", "artifact_bytes"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for told in batch.to_pylist():
                content, n, size, ended, canonical = hashlib.sha256(), 0, 0, True, True
                packed = _Digested(told["path"])
                for lines, whole in _unpacked(told["path"], packed):
                    content.update(whole)
                    size, n, ended = size + len(whole), n + len(lines), whole.endswith(b"\n") and b"\r" not in whole
                    canonical = canonical and all(map(_is_canonical, lines))
                found = dict(zip(names, (n, content.hexdigest(), size, packed.digest.hexdigest(), packed.size), strict=True))
                broken = [c for c in names if told[c] != found[c]] + ["line_feed"] * (not ended) + ["canonical"] * (not canonical)
                rows += [{"rule": r, "key": told["path"]} for r in broken]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("rule", pa.string()), ("key", pa.string())]))

    return _one_each(manifest, "path", *names).mapInArrow(check, "rule string, key string")


def _one_each(manifest: DataFrame, *columns: str) -> DataFrame:
    return manifest.select(*columns).repartition(max(1, min(manifest.count(), 10_000)))


class _Digested:
    """A file's bytes on their way to the unpacker."""

    def __init__(self, path: str):
        store, at = opened(path)
        self.source, self.digest, self.size = store.open_input_stream(at, compression=None), hashlib.sha256(), 0

    def read(self, size: int = -1) -> bytes:
        got = self.source.read(size if size > 0 else 1 << 20)
        self.digest.update(got)
        self.size += len(got)
        return got


def _unpacked(path: str, source: _Digested | None = None, step: int = 1 << 22) -> Iterator[tuple[list[bytes], bytes]]:
    """Whole lines of a packed file, some megabytes at a time, and the bytes that they were."""
    source = source or _Digested(path)
    reader = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True) if path.endswith(".zst") else gzip.GzipFile(fileobj=source)
    rest = b""
    while got := reader.read(step):
        cut = (rest + got).rfind(b"\n") + 1
        whole, rest = (rest + got)[:cut], (rest + got)[cut:]
        if whole:
            yield whole[:-1].split(b"\n"), whole
    while source.read():
        pass  # what follows the packed content belongs to the file's digest too
    if rest:
        yield [rest], rest


def _is_canonical(line: bytes) -> bool:
    try:
        found = json.loads(line)
        return isinstance(found, dict) and canonical_json(found).encode() == line
    except ValueError:
        return False


def read_json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole JSON documents, one a file, under a fixed schema; a file that holds something else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def transcripts(documents: DataFrame, build: str = "assembly") -> tuple[DataFrame, DataFrame]:
    """Transcripts of documents (id, gene, version, <build>: contig, strand, exons as arrays of numbers, cds_start, cds_end) and
    their violations: id, gene, chrom, strand, exons (1-based, sorted), cds_start, cds_end; rule, key.

    An exon is half open from 0 in its document.  Rules: contig, strand, exon (two whole numbers, 0 <= start < stop),
    duplicate_exon, cds (within the exons' span).
    """
    b = F.col(build)
    raw = F.coalesce(b["exons"], F.array().cast("array<array<bigint>>"))
    fits = F.forall(raw, lambda e: F.coalesce((F.size(e) >= 2) & (F.get(e, F.lit(0)) >= 0) & (F.get(e, F.lit(1)) > F.get(e, F.lit(0))), F.lit(False)))
    exons = F.array_sort(F.transform(raw, lambda e: F.struct((F.get(e, F.lit(0)) + 1).alias("start"), F.get(e, F.lit(1)).alias("stop"))))
    rows = documents.select("id", "gene", b["contig"].alias("contig"), contig_name(f"{build}.contig").alias("chrom"), b["strand"].alias("strand"), exons.alias("exons"), b["cds_start"].alias("cds_start"), b["cds_end"].alias("cds_end"), fits.alias("_fits"))
    inside = lambda c: F.col(c).isNull() | ((F.col(c) >= F.array_min("exons")["start"] - 1) & (F.col(c) <= F.array_max(F.transform("exons", lambda e: e["stop"]))))
    rules = {"contig": F.col("chrom").isNotNull(), "strand": F.col("strand").isin("+", "-"), "exon": F.col("_fits") & (F.size("exons") > 0), "duplicate_exon": F.size(F.array_distinct("exons")) == F.size("exons"), "cds": inside("cds_start") & inside("cds_end")}
    return rows.drop("_fits", "contig"), checks.violations(rows, F.col("id"), rules)


def catalogue_decisions(catalogue: DataFrame, chosen: DataFrame, entries: str = "entries") -> DataFrame:
    """A catalogue's entries (array of struct<urn, title, targets: array<struct<mapped, name>>>) with their decision.

    urn, title, genes (mapped names or else names, sorted, distinct), decision, reason.  ``chosen`` (urn, gene) are the reviewed
    entries: selected; another entry of a chosen gene is excluded as noncanonical, any other as outside the catalogue, a
    chosen one whose gene is not among its targets is a target_mismatch.
    """
    each = catalogue.select(F.explode(entries).alias("e")).select("e.urn", "e.title", F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce("e.targets", F.array()), lambda t: F.coalesce(t["mapped"], t["name"]))))).alias("genes"))
    listed = each.join(chosen.select("urn", F.col("gene").alias("_gene")), "urn", "left")
    of_gene = each.select("urn", F.explode("genes").alias("gene")).join(chosen.select("gene").distinct(), "gene", "left_semi").select("urn").distinct().withColumn("_known", F.lit(True))
    out = listed.join(of_gene, "urn", "left")
    own = F.col("_gene").isNotNull()
    reason = F.when(own & F.array_contains("genes", F.col("_gene")), "reviewed").when(own, "target_mismatch").when(F.col("_known"), "noncanonical").otherwise("outside_catalogue")
    return out.select("urn", "title", "genes", F.when(reason == "reviewed", "selected").otherwise("excluded").alias("decision"), reason.alias("reason"))


def read_mapping(text: str) -> dict[str, object]:
    """A configuration's mapping, from JSON (or YAML, where the yaml package is there): a key that stands twice at any depth, a
    constant that is not finite, or anything but a mapping is an error."""

    def unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
        twice = [k for k, n in Counter(k for k, _ in pairs).items() if n > 1]
        if twice:
            raise ValueError(f"a key stands twice: {twice[0]!r}")
        return dict(pairs)

    try:
        found = json.loads(text, object_pairs_hook=unique)
    except json.JSONDecodeError:
        found = _yaml(text, unique)
    if not isinstance(found, dict):
        raise ValueError("not a mapping")
    return json.loads(canonical_json(found))


def _yaml(text: str, unique) -> object:
    try:
        import yaml
    except ImportError:
        raise ValueError("not JSON, and there is no yaml package") from None

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("tag:yaml.org,2002:map", lambda loader, node: unique([(loader.construct_object(k, True), loader.construct_object(v, True)) for k, v in node.value]))
    return yaml.load(text, Loader=Loader)


def model_catalogue(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models of catalogue documents (schema_version, models: map of model to a map of fields), and their violations:
    model, family, release_date, knowledge_cutoff, knowledge_cutoff_url; rule, key.

    Version 1.0 has family and release_date, 1.1 the cutoff and its address too.  Rules: version, fields (exactly the version's),
    family (not blank), release_date (a day that exists), cutoff_pair (both or neither), cutoff (a day or month), cutoff_url
    (https).
    """
    base, more = ["family", "release_date"], ["knowledge_cutoff", "knowledge_cutoff_url"]
    each = documents.select("schema_version", F.explode("models").alias("model", "f"))
    rows = each.select("schema_version", "model", F.array_sort(F.map_keys("f")).alias("_keys"), *(F.element_at("f", c).alias(c) for c in base + more))
    fields = F.when(F.col("schema_version") == "1.0", F.array(*map(F.lit, sorted(base)))).when(F.col("schema_version") == "1.1", F.array(*map(F.lit, sorted(base + more))))
    cutoff, url = F.col("knowledge_cutoff"), F.col("knowledge_cutoff_url")
    rules = {
        "version": F.col("schema_version").isin("1.0", "1.1"),
        "fields": F.col("_keys") == fields,
        "family": F.trim("family") != "",
        "release_date": temporal.valid_date(F.col("release_date")),
        "cutoff_pair": cutoff.isNull() == url.isNull(),
        "cutoff": cutoff.isNull() | temporal.valid_date(cutoff) | temporal.valid_month(cutoff),
        "cutoff_url": url.isNull() | F.startswith(url, F.lit("https://")),
    }
    return rows.select("model", F.trim("family").alias("family"), "release_date", *more), checks.violations(rows, F.col("model"), rules)


def exon_rows(table: DataFrame, flank: int) -> tuple[DataFrame, DataFrame]:
    """Exons of a metadata table read as text, and its violations: exon_id, strand, start, stop, length, sequence, upstream; rule, key.

    upstream is the insert before the exon: the sequence's length without the exon and the ``flank`` after it.  Rules: exon_id
    (not empty), strand (-1 or 1), geometry (stop - start + 1 is the length, all positive), sequence (DNA), insert (at least one
    base upstream), unique.
    """
    number = lambda c: F.expr(f"case when trim({c}) rlike '^-?[0-9]+(\\.0+)?$' then cast(cast(trim({c}) as decimal(20, 2)) as bigint) end")
    dna = sequence.normal_dna(F.col("sequence"))
    rows = table.select(F.trim("exon_id").alias("exon_id"), *(number(c).alias(c) for c in ("strand", "start", "stop", "length")), dna.alias("sequence"))
    rows = rows.withColumn("upstream", F.char_length("sequence") - F.col("length") - F.lit(flank))
    rules = {
        "exon_id": F.col("exon_id") != "",
        "strand": F.col("strand").isin(-1, 1),
        "geometry": (F.col("start") >= 1) & (F.col("length") >= 1) & (F.col("stop") - F.col("start") + 1 == F.col("length")),
        "sequence": sequence.is_dna(F.col("sequence")),
        "insert": F.col("upstream") >= 1,
    }
    twice = checks.duplicated_keys(rows.select("exon_id"), ["exon_id"]).select(F.lit("unique").alias("rule"), F.col("exon_id").alias("key"))
    return rows, checks.violations(rows, F.col("exon_id"), rules).union(twice)


def read_renamed(spark: SparkSession, path: str, renames: dict[str, str], sheet: int = 1, header_row: int = 1) -> DataFrame:
    """A table whose kind its suffix tells (.xlsx, .tsv, .tsv.gz, .csv, .csv.gz; a folder of such files bears the suffix), with
    the columns of ``renames`` under their new names, as text."""
    kinds = {".xlsx": None, ".tsv": "\t", ".tsv.gz": "\t", ".csv": ",", ".csv.gz": ","}
    found = [k for k in kinds if path.endswith(k)]
    if not found:
        raise ValueError(f"unknown kind of table: {path}")
    if found[0] == ".xlsx":
        spark.dataSource.register(XlsxDataSource)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in renames])
        df = spark.read.format("xlsx").schema(schema).option("path", path).option("sheet", sheet).option("header_row", header_row).load()
    else:
        df = read_delimited(spark, path, list(renames), kinds[found[0]])
    return df.select(*(F.col(f"`{old}`").alias(new) for old, new in renames.items()))


def load_cache(spark: SparkSession, path: str, identity: dict[str, object], found: dict[str, object]) -> DataFrame:
    """A processed table, if what it was made from (``found``, of its manifest) is what is asked for; else an error names the
    fields that differ."""
    differ = sorted(k for k in identity.keys() | found.keys() if identity.get(k) != found.get(k))
    if differ:
        raise ValueError(f"the cache is of another identity: {', '.join(differ)}")
    return spark.read.parquet(path)


def read_fasta_chunks(spark: SparkSession, path: str, chunk: int = 10_000) -> DataFrame:
    """A FASTA file as chrom, chunk_start (0-based), seq: pieces of ``chunk`` bases, so that intervals join on equality.

    Lines are numbered by their file and place in it; a record's lines lie between its header and the next.  Every line knows
    how many bases of its record come before it from counts by partition, so no record is ever one row.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.trim("value").alias("value")).where("value <> ''")
    # within a block rows are in order, and blocks of a file are too
    marked = lines.withColumns({"head": F.startswith(F.col("value"), F.lit(">")), "n": F.when(F.startswith(F.col("value"), F.lit(">")), 0).otherwise(F.char_length("value"))})
    inside = Window.partitionBy("file", "block").orderBy("k")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(F.col("head"), F.regexp_extract("value", r"^>\s*(\S+)", 1))
    placed = marked.withColumns({"own": F.last(named, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "sum": F.coalesce(F.sum("n").over(upto), F.lit(0))})
    placed = placed.withColumn("since", F.last(F.when(F.col("head"), F.col("sum")), True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # what a block leaves to the next: its last record's name and that record's bases so far
    ends = marked.groupBy("file", "block").agg(F.max_by(named, F.when(F.col("head"), F.col("k"))).alias("name"), F.sum("n").alias("bases"))
    after = placed.where("head").groupBy("file", "block").agg(F.max("sum").alias("at"))
    blocks = ends.join(after, ["file", "block"], "left").withColumn("left_over", F.when(F.col("at").isNull(), F.col("bases")).otherwise(F.col("bases") - F.col("at")))
    order = Window.partitionBy("file").orderBy("block")  # a row for each block of a file
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    run = F.sum(F.when(F.col("name").isNotNull(), 1).otherwise(0)).over(order)
    blocks = blocks.withColumns({"given": F.last("name", True).over(before), "run": run}).withColumn("prior", F.coalesce(F.sum("left_over").over(Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("total", F.col("prior") + F.col("left_over")).withColumn("carry", F.when(F.col("name").isNull(), F.col("prior")).otherwise(F.coalesce(F.lag("total").over(order), F.lit(0))))
    carried = blocks.select("file", "block", "given", "carry")
    whole = placed.where("not head").join(carried, ["file", "block"])
    start = F.when(F.col("own").isNotNull(), F.col("sum") - F.col("since")).otherwise(F.col("sum") + F.col("carry"))
    based = whole.select(F.coalesce("own", "given").alias("chrom"), start.alias("at"), F.upper("value").alias("s"))
    first, last = F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.char_length("s") - 1) / chunk)
    cut = based.select("chrom", "at", "s", F.explode(F.sequence(first, last)).alias("c"))
    a = F.greatest(F.col("c") * chunk - F.col("at"), F.lit(0))
    piece = F.substring("s", (a + 1).cast("int"), (F.least((F.col("c") + 1) * chunk - F.col("at"), F.char_length("s")) - a).cast("int"))
    parts = cut.select("chrom", (F.col("c") * chunk).cast("long").alias("chunk_start"), "at", piece.alias("p"))
    return parts.groupBy("chrom", "chunk_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]), "").alias("seq"))


def fetch_intervals(intervals: DataFrame, chunks: DataFrame, chunk: int = 10_000, padded: bool = False) -> DataFrame:
    """Adds seq to intervals (id, chrom, start, stop; 0-based, half open): their bases, by an equality join on chunk.

    Bases outside the sequence make seq null, or are N where ``padded``.
    """
    first, last = F.floor(F.greatest(F.col("start"), F.lit(0)) / chunk), F.floor((F.greatest(F.col("stop"), F.col("start") + 1, F.lit(1)) - 1) / chunk)
    touched = F.transform(F.sequence(first.cast("long"), last.cast("long")), lambda k: k * chunk)
    listed = intervals.withColumn("chunk_start", F.explode(touched))
    met = listed.join(chunks, ["chrom", "chunk_start"])
    a = F.greatest(F.col("start") - F.col("chunk_start"), F.lit(0)).cast("int")
    piece = F.substring("seq", a + 1, F.greatest(F.least(F.col("stop") - F.col("chunk_start"), F.lit(chunk)) - a, F.lit(0)).cast("int"))
    parts = met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_start", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    out = intervals.join(parts, "id", "left").withColumn("seq", F.coalesce("seq", F.lit("")))
    size = (F.col("stop") - F.col("start")).cast("int")
    if padded:
        before = F.repeat(F.lit("N"), F.least(F.greatest(-F.col("start"), F.lit(0)), size).cast("int"))
        return out.withColumn("seq", F.rpad(F.concat(before, "seq"), size, "N"))
    return out.withColumn("seq", F.when((F.char_length("seq") == size) & (F.col("start") >= 0), F.col("seq")))


def contig_name(accession: str) -> Column:
    """chr1 to chr22, chrX, chrY for an NC accession column; null for others."""
    n = F.expr(f"try_cast(regexp_extract({accession}, '^NC_0*([0-9]+)', 1) as int)")
    return F.when(n.between(1, 22), F.concat(F.lit("chr"), n.cast("string"))).when(n == 23, "chrX").when(n == 24, "chrY")


class XlsxDataSource(DataSource):
    """A worksheet as text columns: format("xlsx"), options path, sheet (1 is the first), header_row (1-based), schema required.

    Shared strings, inline strings and numbers are read; a workbook is one partition, each of several paths (comma-separated)
    another.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        raise ValueError("xlsx needs a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _XlsxReader(schema, dict(self.options))


class _Path(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _XlsxReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names, self.options = schema.names, options

    def partitions(self) -> list[InputPartition]:
        return [_Path(p.strip()) for p in self.options["path"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = xlsx_rows(partition.path, int(self.options.get("sheet", 1)))
        header: dict[str, int] | None = None
        for number, row in rows:
            if number == int(self.options.get("header_row", 1)):
                header = {v: k for k, v in row.items() if v is not None}
                missing = set(self.names) - set(header)
                if missing:
                    raise ValueError(f"missing columns: {sorted(missing)}")
            elif header is not None:
                yield tuple(row.get(header[n]) for n in self.names)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_rows(path: str, sheet: int = 1) -> Iterator[tuple[int, dict[int, str | None]]]:
    """Row numbers and cells by column number, read through the archive without loading the sheet."""
    store, at = opened(path) if "://" in path else opened(f"file://{path.removeprefix('file:')}")
    with store.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in root.iter(f"{_NS}si")]
        with archive.open(f"xl/worksheets/sheet{sheet}.xml") as source:
            for _, node in ElementTree.iterparse(source):
                if node.tag != f"{_NS}row":
                    continue
                cells: dict[int, str | None] = {}
                for cell in node.iter(f"{_NS}c"):
                    letters = re.match(r"[A-Z]+", cell.get("r", "A"))[0]
                    column = 0
                    for c in letters:
                        column = column * 26 + ord(c) - 64
                    value = cell.findtext(f"{_NS}v")
                    if cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    cells[column] = value
                yield int(node.get("r", 0)), cells
                node.clear()


def verify_files(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """Files against their pins (name, bytes, sha256, md5 or null): violations (rule, key).  Files of any size, read as streams."""
    listed = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, name in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist(), strict=True):
                store, at = opened("file://" + path.removeprefix("file:") if path.startswith("file:/") and "://" not in path else path)
                sha, md5, n = hashlib.sha256(), hashlib.md5(), 0
                with store.open_input_stream(at, compression=None) as source:
                    while got := source.read(1 << 20):
                        sha.update(got)
                        md5.update(got)
                        n += len(got)
                rows.append({"name": name, "_n": n, "_sha": sha.hexdigest(), "_md5": md5.hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("_n", pa.int64()), ("_sha", pa.string()), ("_md5", pa.string())]))

    files = listed.mapInArrow(digest, "name string, _n long, _sha string, _md5 string")
    both = pins.join(files, "name", "left")
    rules = {"present": F.col("_n").isNotNull(), "bytes": F.col("bytes") == F.col("_n"), "sha256": F.col("sha256") == F.col("_sha"), "md5": F.col("md5").isNull() | (F.col("md5") == F.col("_md5"))}
    return checks.violations(both, F.col("name"), rules)
