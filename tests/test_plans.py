"""Every registered query against its SQL, and the driver's entry points."""

import pytest

import __spark_entry__
from panelyard.plans import ORACLE, QUERIES
from tests.parity import SF, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_allele_normalise_keeps_mutants(spark):
    out = QUERIES["allele_normalise"](spark, SF).where("norm_pos is not null")
    assert out.count() > 0
    assert out.where("not mutant_unchanged or not idempotent").count() == 0


def test_whole_tables_enter(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    out = QUERIES["feature_overlap_whole"](spark, SF)
    assert out.count() == orders.count()  # each order overlaps at least its own month
    assert out.selectExpr("explode(split(features, ','))").distinct().count() == orders.selectExpr("year(o_orderdate) * 12 + month(o_orderdate)").distinct().count()


def test_slugs_read_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 60 + " one"), (2, "x" * 60 + " two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len({r.slug_sha256 for r in QUERIES["text_helpers_whole"](spark, str(tmp_path)).collect()}) == 2
