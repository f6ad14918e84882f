"""Files that are written with a commit, and canonical records."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from panelyard.sources import committed, writers


def listing(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, dirs, files in os.walk(folder) for f in [*files, *(x for x in dirs if not os.listdir(os.path.join(d, x)))])


def test_failed_tasks_leave_nothing(spark, tmp_path):
    """Some tasks end well before another one fails."""

    @F.udf(StringType())
    def line(k):
        if k == 399:
            raise ValueError("no such row")
        return "x" * 50

    good = spark.range(0, 400, 1, 8).select(F.lit("y").alias("line"))
    bad = spark.range(0, 400, 1, 8).select(line("id").alias("line"))
    folder = f"{tmp_path}/out"
    os.makedirs(folder)
    with pytest.raises(PySparkException, match="no such row"):
        committed.write_committed(bad, f"file://{folder}", "path string", codec="gzip")
    assert listing(folder) == []
    rows = committed.write_committed(good, f"file://{folder}", "path string, records long", codec="zstd").collect()
    assert sum(r.records for r in rows) == 400
    left = [f for f in listing(folder) if not f.startswith("_manifest-")]
    assert left == sorted({os.path.basename(r.path) for r in rows})  # parts of the same content are one file


def test_refused_files_leave_nothing(spark, tmp_path):
    folder = f"{tmp_path}/files"
    make = lambda *rows: spark.createDataFrame(rows, "name string, content string").repartition(3)
    writers.write_files(make(("a", "1"), ("b", "2")), f"file://{folder}")
    before = [f for f in listing(folder) if not f.startswith("_manifest")]
    with pytest.raises(PySparkException, match="FileExistsError"):
        writers.write_files(make(("c", "3"), ("a", "other")), f"file://{folder}")
    with pytest.raises(PySparkException, match="written twice"):
        writers.write_files(make(("d", "3"), ("d", "4")), f"file://{folder}")
    assert [f for f in listing(folder) if not f.startswith("_manifest")] == before == ["a", "b"]
    assert sum(f.startswith("_manifest") for f in listing(folder)) == 1


def test_records_keep_nulls_and_refuse_what_is_not_a_number(spark):
    df = spark.createDataFrame([(1, None, (None, [1.0, None]), {"a": None})], "k int, v double, s struct<t: string, u: array<double>>, m map<string, float>")
    assert writers.canonical_lines(df, "k").first().line == '{"k":1,"m":{"a":null},"s":{"t":null,"u":[1.0,null]},"v":null}'
    odd = [("v", "double('NaN')"), ("v", "double('-Infinity')"), ("s", "named_struct('t', 'x', 'u', array(1D, double('Infinity')))"), ("m", "map('a', float('NaN'))")]
    for column, value in odd:
        with pytest.raises(PySparkException, match=f"not a finite number in {column}"):
            writers.canonical_lines(df.withColumn(column, F.expr(value)), "k").collect()
    other = spark.createDataFrame([(1, "NaN")], "k int, v string")
    assert writers.canonical_lines(other, "k").first().line == '{"k":1,"v":"NaN"}'
