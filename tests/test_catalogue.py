import pytest

from evidra.plans import catalogue

from .conftest import check_against


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    check_against(duck, catalogue.QUERIES[name](spark, sf_dir), catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.SQL.keys()))
def test_query_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_filters_reach_the_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_custkey") == 5).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,5)" in plan and "o_totalprice" not in plan
