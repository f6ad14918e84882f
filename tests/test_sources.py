"""Readers and writers on files made here."""

import gzip
import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from panelyard.sources import readers, writers
from panelyard.streaming import messages, tables


def test_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(good), "a long").count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n[1]\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|corrupt"):
        readers.read_jsonl(spark, str(bad), "a long").collect()
    empty = tmp_path / "empty.jsonl"
    empty.write_text("\n")
    with pytest.raises(ValueError, match="no records"):
        readers.read_jsonl(spark, str(empty), "a long")


def test_delimited(spark, tmp_path):
    path = tmp_path / "t.tsv.gz"
    path.write_bytes(gzip.compress("﻿id\tscore\textra\nx\t1\ty\n".encode()))
    df = readers.read_delimited(spark, str(path), ["id", "score"], "\t")
    assert [r.asDict() for r in df.collect()] == [{"id": "x", "score": "1", "extra": "y"}]
    with pytest.raises(ValueError, match="missing columns: other"):
        readers.read_delimited(spark, str(path), ["other"], "\t")


def test_vcf(spark, tmp_path):
    path = tmp_path / "v.vcf.gz"
    lines = ["##x", "#CHROM", "1\t5\t.\tA\tC\t.\tSIGN\tEF=0.5;PV=1", "1\t5\t.\tA\tC\t.\tMIN\tEF=1", "1\tx\t.\tA\tC\t.\tSIGN\tEF=1", "1\t6\tshort"]
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    rows, broken = readers.read_vcf(spark, str(path), ["SIGN", "MIN"])
    assert rows.where("pos = 5 and filter = 'SIGN'").first().info == {"EF": "0.5", "PV": "1"}
    assert sorted({r.rule for r in broken.collect()}) == ["eight_columns", "filter_domain", "position", "unique_key"]


def test_fasta(spark, tmp_path):
    path = tmp_path / "g.fa"
    text = "ACGTACGTTTGACA"
    path.write_text(f">c1 first\n{text[:8]}\n{text[8:]}\n>c2\nGG\n")
    chunks = readers.read_fasta_chunks(spark, str(path), 4)
    spans = spark.createDataFrame([(1, "c1", 2, 11), (2, "c1", -2, 3), (3, "c1", 12, 16), (4, "c2", 0, 2)], "id int, chrom string, start long, stop long")
    plain = {r.id: r.seq for r in readers.fetch_intervals(spans, chunks, 4).collect()}
    assert plain == {1: text[2:11], 2: None, 3: None, 4: "GG"}
    padded = {r.id: r.seq for r in readers.fetch_intervals(spans, chunks, 4, padded=True).collect()}
    assert padded == {1: text[2:11], 2: "NN" + text[:3], 3: text[12:] + "NN", 4: "GG"}


def test_xlsx(spark, tmp_path):
    path = tmp_path / "s.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>score</t></si><si><r><t>x</t></r><r><t>y</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>note</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>1.5</v></c></row></sheetData></worksheet>')
    spark.dataSource.register(readers.XlsxDataSource)
    df = spark.read.format("xlsx").schema("score string, id string").option("header_row", "2").load(str(path))
    assert [tuple(r) for r in df.collect()] == [("1.5", "xy")]


def test_pins(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    pins = spark.createDataFrame([("a.bin", 3, hashlib.sha256(b"abc").hexdigest(), hashlib.md5(b"abc").hexdigest()), ("b.bin", 1, "", None)], "name string, bytes long, sha256 string, md5 string")
    assert {(r.rule, r.key) for r in readers.verify_files(spark, str(tmp_path), pins).collect()} == {("present", "b.bin"), ("bytes", "b.bin"), ("sha256", "b.bin")}


def test_written_lines_are_canonical(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.5, None), ("a", 1.0, "é")], "id string, v double, w string")
    folder = f"file://{tmp_path}/out"
    one, two = (writers.write_jsonl(d, "id", folder).collect() for d in (df, df.orderBy(F.desc("id"))))
    assert one == two
    text = gzip.decompress(open(one[0].path.removeprefix("file://"), "rb").read()).decode()
    assert text == '{"id":"a","v":1.0,"w":"é"}\n{"id":"b","v":2.5,"w":null}\n'
    assert one[0].content_sha256 == hashlib.sha256(text.encode()).hexdigest()
    digests = [hashlib.sha256(line.encode()).hexdigest() for line in text.splitlines()]
    assert writers.set_digest(df, "id").first().set_sha256 == hashlib.sha256("\n".join(digests).encode()).hexdigest()


EVENTS = [
    ("m1", 0, '{"content": "Hel"}'), ("m1", 1, '{"content": "lo", "reasoning": "r"}'), ("m1", 2, '{"finish_reason": "stop"}'), ("m1", 3, "[DONE]"),
    ("m2", 0, '{"content": "x"}'), ("m2", 1, "[DONE]"), ("m3", 0, '{"error": 1}'), ("m3", 1, "[DONE]"),
]
FOLDED = {("m1", "Hello", "r", "stop", "completed"), ("m2", "x", "", None, "missing_finish_reason"), ("m3", "", "", None, "error")}


def test_fold_batch(spark):
    df = spark.createDataFrame([*EVENTS[::-1], ("m4", 0, '{"content": "y"}'), ("m5", 0, None)], "message_id string, seq long, data string")
    out = {tuple(r) for r in messages.fold_batch(df).collect()}
    assert out == FOLDED | {("m4", "y", "", None, "incomplete"), ("m5", "", "", None, "error")}


def test_fold_stream_equals_batch(spark, tmp_path):
    source, sink = str(tmp_path / "in"), "folded"
    spark.createDataFrame(EVENTS[:3], "message_id string, seq long, data string").coalesce(1).write.parquet(source)
    spark.createDataFrame(EVENTS[3:], "message_id string, seq long, data string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("message_id string, seq long, data string").option("maxFilesPerTrigger", 1).parquet(source)
    q = messages.fold_stream(stream, timeout=None).writeStream.format("memory").queryName(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {tuple(r) for r in spark.table(sink).collect()} == FOLDED


def test_tables(spark, tmp_path):
    requests = spark.createDataFrame([("a",), ("b",), ("a",)], "digest string")
    cache = spark.createDataFrame([("a", 1), ("z", 9)], "digest string, answer int")
    out = tables.resumable(lambda new: new.withColumn("answer", F.lit(7)), requests, cache, "digest")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1), ("b", 7)]
    log = spark.createDataFrame([("k", 1, 1, "new"), ("k", 2, 1, "old"), ("k", 2, 2, "end")], "k string, at int, version int, state string")
    assert tables.latest_state(log, ["k"], "at").first().state == "end"
    path = str(tmp_path / "t")
    for epoch in (0, 0, 1):
        tables.append_new(requests, epoch, path, ["digest"])
    assert spark.read.parquet(path).count() == 2
    assert tables.frozen_plan_changes(cache, cache.withColumn("answer", F.col("answer") % 9), ["digest"]).first().digest == "z"


def test_csv_keeps_quotes_and_order(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "hi", you'), (1, "a,b"), (3, None)], "k int, v string")
    writers.write_csv(df, ["k"], f"{tmp_path}/out")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out")
    assert {(r.k, r.v) for r in back.collect()} == {("1", "a,b"), ("2", 'say "hi", you'), ("3", None)}


def test_a_column_that_stands_twice(spark, tmp_path):
    (tmp_path / "twice.csv").write_text('a,"b",a\n1,2,3\n')
    with pytest.raises(ValueError, match="stands twice"):
        readers.read_delimited(spark, f"{tmp_path}/twice.csv", ["a"])
    (tmp_path / "once.csv").write_text("﻿a,b\n1,2\n")
    assert readers.read_delimited(spark, f"{tmp_path}/once.csv", ["a", "b"]).first().asDict() == {"a": "1", "b": "2"}


def test_accessions_of_another_set(spark, tmp_path):
    (tmp_path / "scores.csv").write_text("accession,hgvs_nt,score\nurn:x#1,c.1A>T,0.5\nurn:xy#2,c.1A>T,0.5\nurn:x,c.1A>T,1\n,c.1A>T,1\n")
    rows, broken = readers.read_scores(spark, f"{tmp_path}/scores.csv", "urn:x")
    assert rows.count() == 4
    assert sorted((r.rule, r.key) for r in broken.where("key is not null").collect()) == [("accession", "urn:x"), ("accession", "urn:xy#2")] and broken.count() == 3


def test_folders_of_an_application_are_cleared(spark, monkeypatch):
    from panelyard.sources import folders

    top = f"{folders.shared_dir(spark)}/panelyard"
    kept, gone = f"{top}/kept-application", f"{top}/gone-application"
    for own in (kept, gone):
        monkeypatch.setattr(folders, "_own_dir", lambda session, own=own: own)
        spark.range(1).write.parquet(f"{folders.new_folder(spark, 'table')}")
    folders.clear(spark)
    there = lambda path: folders.hadoop_path(spark, path)[1].exists(folders.hadoop_path(spark, path)[0])
    assert there(kept) and not there(gone)
