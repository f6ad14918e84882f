"""Rules, errors and files beyond what the registered queries show."""

import gzip
import json
import random
import time

import pytest
import zstandard
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelyard.functions import parsing, sequence
from panelyard.operators import boards, checks, joins, questions, selection, usage
from panelyard.sources import readers, writers
from panelyard.sources.folders import new_folder


def test_unknown_quality_is_an_error(spark):
    df = spark.createDataFrame([("bad",), ("ok",), ("new",), (None,)], "q string")
    state = lambda known: checks.tri_state(F.col("q"), ["bad"], known)
    assert [r[0] for r in df.select(state([])).collect()] == ["exclude", "keep", "keep", "keep"]
    assert [r[0] for r in df.where("q in ('bad', 'ok')").select(state(["ok"])).collect()] == ["exclude", "keep"]
    for rest in ("q = 'new'", "q is null"):
        with pytest.raises(PySparkException, match="unknown quality value"):
            df.where(rest).select(state(["ok"])).collect()
    with pytest.raises(ValueError):
        checks.oriented(F.lit(1.0), 2)


def test_ties_and_unknown_kinds_are_errors_if_strict(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 4), (1, "b", 9), (2, "a", 5), (2, "a", 5), (3, "c", 1)], "k long, kind string, at long")
    pick = lambda rows: selection.preferred_latest(df.where(rows), ["k"], "kind", ["a", "b"], "at", strict=True).collect()
    assert [(r.k, r.kind, r["at"], r.tied) for r in pick("k = 1")] == [(1, "a", 5, 1)]
    for rows, message in (("k = 2", "equal times"), ("k = 3", "unknown kind")):
        with pytest.raises(PySparkException, match=message):
            pick(rows)


def test_templates(spark):
    df = spark.createDataFrame([("x", 1), (None, 2)], "a string, b int")
    out = df.select(questions.rendered("{{{a}}} is {b}", {"a": F.col("a"), "b": F.col("b")}).alias("t")).collect()
    assert [r.t for r in out] == ["{x} is 1", None]
    for template in ("{a}", "{a} {b} {c}", "{a} {b} }", "plain"):
        with pytest.raises(ValueError):
            questions.rendered(template, {"a": F.col("a"), "b": F.col("b")})


def test_parameters(spark):
    given = ['{"max_tokens": 5, "seed": -3, "temperature": -0.5e1}', "nonsense", None, '{"temperature": "1"}', '{"max_tokens": 5.0}', '{"seed": "1"}', "{}"]
    df = spark.createDataFrame(list(enumerate(given)), "k int, p string")
    out = {(r.rule, r.key) for r in questions.parameter_violations(df, F.col("k"), "p").collect()}
    assert out == {("object", "1"), ("object", "2"), ("temperature", "3"), ("max_tokens", "4"), ("seed", "5")}


def test_coverage(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "item string")
    rows = spark.createDataFrame([(1, "a", "completed"), (1, "b", "completed"), (2, "a", "error"), (3, "a", "completed"), (3, "z", "completed"), (4, "a", "completed"), (4, "a", "completed"), (4, "b", "completed")], "run int, item string, status string")
    out = {r.run: (r.attempted, r.completed, r.api_errors, r.missing, r.unexpected, r.complete) for r in boards.coverage(rows, expected, ["run"], "item", "status").collect()}
    assert out == {1: (2, 2, 0, 0, 0, True), 2: (1, 0, 1, 1, 0, False), 3: (2, 2, 0, 1, 1, False), 4: (3, 3, 0, 0, 0, False)}


def test_attempts_without_a_row_are_told(spark):
    recovered = spark.createDataFrame([(1,), (2,)], "k int")
    failed = spark.createDataFrame([(1, 2), (1, 1), (3, 1)], "k int, n int")
    out, rest = joins.attach_attempts(recovered, failed, ["k"], ["n"], ["n"])
    assert {r.k: [a.n for a in r.attempts] for r in out.collect()} == {1: [1, 2], 2: []}
    assert [(r.k, r.n) for r in rest.collect()] == [(3, 1)]


def test_alleles_on_either_strand(spark):
    df = spark.createDataFrame([("ACGTT", "x:n.1A>G", "-"), ("ACGTT", "x:n.1C>G", "-"), ("ACGTT", "x:n.1_2insC", "-"), ("ACGTT", "x:n.2C>A", "+"), ("ACGTT", "x:n.2C>A", "?")], "s string, t string, d string")
    out = [r[0] and tuple(r[0]) for r in df.select(sequence.hgvs_allele_on(F.col("s"), F.col("t"), F.col("d"))).collect()]
    assert out == [(5, "T", "C"), None, (5, "", "G"), (2, "C", "A"), None]


def test_normalised_edits_by_hand():
    import itertools

    for text in ("ACACG", "GGGTG", "CTTTT"):
        for pos, ref, alt in itertools.product(range(-1, 8), ["", "A", "G", "T", "TT", "GG", "CA"], ["", "A", "G", "TT", "GGG", "CACA"]):
            found = sequence.normalise(text, pos, ref, alt)
            padded = {k: c for k, c in enumerate(text, 1)}
            a, b, p = ref, alt, pos  # shared bases outside go, one by one
            while a and b and p < 1 and a[0] == b[0]:
                a, b, p = a[1:], b[1:], p + 1
            while a and b and p + len(a) - 1 > len(text) and a[-1] == b[-1]:
                a, b = a[:-1], b[:-1]
            fits = p >= 1 and p <= len(text) + 1 and all(padded.get(p + k) == c for k, c in enumerate(a)) and a != b
            assert (found is not None) == fits
            if fits:
                q, r, s = found
                assert text[: p - 1] + b + text[p - 1 + len(a) :] == text[: q - 1] + s + text[q - 1 + len(r) :]
                assert sequence.normalise(text, q, r, s) == found


def test_names_and_paths(spark):
    given = ["a-b", "a--b", "A.b", "v1.2", "../x", "a/./b", "a//b", "/a", "a/", "a\\b", "a\n", "", None]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    out = df.select(parsing.valid_name(F.col("t"), "slug").alias("slug"), parsing.valid_name(F.col("t"), "id").alias("id"), parsing.safe_path(F.col("t")).alias("path")).collect()
    assert [t for t, r in zip(given, out, strict=True) if r.slug] == ["a-b"]
    assert [t for t, r in zip(given, out, strict=True) if r.id] == ["a-b", "a--b", "A.b", "v1.2"]
    assert [t for t, r in zip(given, out, strict=True) if r.path] == ["a-b", "a--b", "A.b", "v1.2", "a\n"]


def test_packed_files_that_are_not_canonical(spark, tmp_path):
    contents = {"good.gz": b'{"a":1}\n', "spaces.zst": b'{"a": 1}\n', "order.gz": b'{"b":1,"a":2}\n', "array.zst": b"[1]\n", "crlf.gz": b'{"a":1}\r\n', "open.zst": b'{"a":1}'}
    rows = []
    for name, content in contents.items():
        packed = gzip.compress(content) if name.endswith(".gz") else zstandard.compress(content)
        (tmp_path / name).write_bytes(packed)
        import hashlib

        rows.append((f"file://{tmp_path}/{name}", 1, hashlib.sha256(content).hexdigest(), len(content), hashlib.sha256(packed).hexdigest(), len(packed)))
    manifest = spark.createDataFrame(rows, "path string, records long, content_sha256 string, content_bytes long, artifact_sha256 string, artifact_bytes long")
    found = sorted((r.key.rsplit("/", 1)[1], r.rule) for r in readers.verify_packed(manifest).collect())
    assert found == [("array.zst", "canonical"), ("crlf.gz", "canonical"), ("crlf.gz", "line_feed"), ("open.zst", "line_feed"), ("order.gz", "canonical"), ("spaces.zst", "canonical")]
    lines = {r.path.rsplit("/", 1)[1]: r.line for r in readers.read_packed_lines(manifest).collect()}
    assert lines["open.zst"] == '{"a":1}' and len(lines) == 6


@pytest.mark.parametrize("codec", ["gzip", "zstd"])
def test_artifacts_are_the_same_each_time(spark, codec):
    df = spark.range(500).select(F.col("id").alias("k"), F.lit("é\"").alias("t"))
    first, second = (writers.write_jsonl(df.repartition(n), "k", new_folder(spark, "same"), 200, codec).drop("path").collect() for n in (2, 5))
    assert sorted(map(tuple, first)) == sorted(map(tuple, second)) and sum(r.records for r in first) == 500
    for digest in (writers.set_digest, lambda d, k: writers.tree_digest(d, k, 7)):
        assert digest(df.repartition(3), "k").first() == digest(df, "k").first()
        assert digest(df.where("k > 0"), "k").first() != digest(df, "k").first()
        assert digest(df.where("k < 0"), "k").first().records == 0


def test_files_are_created_once(spark):
    folder = new_folder(spark, "once")
    one = lambda text: spark.createDataFrame([("a.txt", text)], "name string, content string")
    assert writers.write_files(one("x"), folder).collect() == writers.write_files(one("x"), folder).collect()
    with pytest.raises(PySparkException, match="FileExistsError"):
        writers.write_files(one("y"), folder).collect()
    assert writers.write_files(one("y"), folder, replace=True).first().bytes == 1
    with pytest.raises(PySparkException, match="plain file name"):
        writers.write_files(spark.createDataFrame([("../a", "")], "name string, content string"), folder).collect()


def test_promotion_and_cache(spark):
    df = spark.createDataFrame([("v1/a",), ("v12/b",)], "path string")
    assert writers.promoted(spark.createDataFrame([("v1/a",)], "path string"), "path", "v1", "top/now").first().path == "top/now/a"
    with pytest.raises(PySparkException, match="outside the version"):
        writers.promoted(df, "path", "v1", "now").collect()
    path = new_folder(spark, "cache")
    df.write.parquet(path)
    assert readers.load_cache(spark, path, {"sha": 1}, {"sha": 1}).count() == 2
    with pytest.raises(ValueError, match="genome, sha"):
        readers.load_cache(spark, path, {"sha": 1, "genome": 2}, {"sha": 3})


def test_fasta_over_several_splits(spark, tmp_path):
    import random

    rng = random.Random(1)
    genome = {f"c{k}": "".join(rng.choices("acgt", k=n)) for k, n in enumerate((0, 1, 59, 60, 61, 5000, 12_345, 7))}
    text = "".join(f">{name} of something\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for name, s in genome.items())
    (tmp_path / "g.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = {}
        for r in sorted(readers.read_fasta_chunks(spark, str(tmp_path / "g.fa"), 100).collect()):
            assert r.chunk_start == len(found.get(r.chrom, ""))
            found[r.chrom] = found.get(r.chrom, "") + r.seq
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert found == {k: s.upper() for k, s in genome.items() if s}


def test_mappings_reject_repeated_keys():
    assert readers.read_mapping('{"b": {"x": 1}, "a": [1, null]}') == {"a": [1, None], "b": {"x": 1}}
    for text in ('{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 1}}', "[1]", '{"a": NaN}', ""):
        with pytest.raises(ValueError):
            readers.read_mapping(text)


def test_exact_sums(spark):
    rows = [(0.1,)] * 10 + [(1e9,), (-1e9,), (0.7,)]
    df = spark.createDataFrame(rows, "x double").repartition(5)
    assert df.agg(usage.exact_sum(F.col("x"))).first()[0] == 1.7
    assert df.where("false").agg(usage.exact_sum(F.col("x"))).first()[0] is None


def test_sampling_digest_of_odd_keys(spark):
    import hashlib

    from panelyard.operators.sampling import sampling_digest

    for key in ('a"b', "back\\slash", "tab\t", "é", "plain"):
        expected = hashlib.sha256(json.dumps(["s", "q", 3, key], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        assert spark.range(1).select(sampling_digest("s", F.lit("q"), F.lit(3), F.lit(key))).first()[0] == expected


def test_rows_of_tables_are_found_in_one_pass(spark):
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.choice(["ab", "a", "aé\U0001f600", "ab\t"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        parts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 5))) for _ in range(6)] + [None, text]
        assert questions._stand_once(text, parts) == [bool(p) and text.count(p) == 1 for p in parts]
    n = 20_000  # text times rows is 10**10 here
    rows = [f"chr1\t{k}\tV{k}\tA\tC" for k in range(n)]
    candidates = [("V%d" % k, "chr1", k, "A", "C", 1.0) for k in range(n)]
    candidates[7] = candidates[6][:1] + candidates[6][1:5] + (float("nan"),)
    df = spark.createDataFrame([("q", ";\n".join(rows) + ";", candidates)], "question_id string, prompt string, candidates array<struct<candidate_id string, chrom string, pos long, ref string, alt string, reference_score double>>")
    began = time.monotonic()
    found = sorted((r.rule, r.path) for r in questions.candidate_violations(df).collect())
    assert found == [("finite", "candidates.7"), ("unique_alleles", "<record>"), ("unique_ids", "<record>")]
    assert time.monotonic() - began < 60
    none = df.select("question_id", F.lit(None).cast("string").alias("prompt"), F.slice("candidates", 1, 2).alias("candidates"))
    assert sorted((r.rule, r.path) for r in questions.candidate_violations(none).collect()) == [("rendered", "candidates.0"), ("rendered", "candidates.1")]
