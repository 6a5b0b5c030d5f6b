"""Every registered query beside its SQL at the smallest scale."""

import os

import pytest
from compare import difference, duck, duck_table, spark_table

import __spark_entry__ as entry
from propweave.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = list(QUERIES)  # the subpackage's own queries are tested beside it

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not there")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = spark_table(entry.queries()[name](spark, SF))
    sql = entry.oracle_sql().get(name)
    if sql:
        assert difference(got, duck_table(con, sql)) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["random_contexts", "sample_per_group", "property_index", "cooccurrence", "split_80_10_10"])
def test_result_does_not_depend_on_partitioning(spark, name):
    first = spark_table(entry.queries()[name](spark, SF))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert spark_table(entry.queries()[name](spark, SF)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pipeline(spark):
    assert entry.queries()["pipeline_end_to_end"](spark, "/root/testdata/sf0.01").count() > 0
