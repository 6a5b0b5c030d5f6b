"""Functions in SQL beside the column functions of the same meaning."""

from conftest import rows
from pyspark.sql import functions as F

from propweave import sql
from propweave.functions.symbols import bracketed, split_symbols
from propweave.operators import metrics, reports


def test_functions_equal_the_operators(spark):
    assert set(sql.register(spark)) == set(sql.FUNCTIONS)
    df = spark.createDataFrame([("[C][=O]N", 0.05, 1), ("", 0.65, 0), (None, None, None), ("a]b", 0.9, 2)], "t string, p double, v int")
    df.createOrReplaceTempView("t")
    got = spark.sql("SELECT symbols_of(t) AS s, bracketed(t) AS b, heat_code(p) AS h, rebalanced(p, 0.1D) AS r, sigmoid(p) AS g FROM t WHERE p IS NOT NULL")
    want = df.filter("p is not null").select(split_symbols("t").alias("s"), bracketed("t").alias("b"), reports.heat_code(F.col("p")).alias("h"),
                                             reports.rebalance(F.col("p")).alias("r"), metrics.sigmoid(F.col("p")).alias("g"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert rows(spark.sql("SELECT value_code(v) AS c FROM t")) == [("negative",), ("positive",), ("unknown",), ("unknown",)]
    assert spark.sql("SELECT pair_list(array(named_struct('assay_index', 3L, 'value', 1)))").first()[0] == "3=1"
    assert "python" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_the_catalogue_by_name(spark, tmp_path):
    tables = {"activity": "SELECT 1L AS property_id, 2L AS source_id, 'x' AS inchi, 1 AS binary_value",
              "source": "SELECT 2L AS source_id, 's' AS source", "property": "SELECT 1L AS property_id, 9L AS property_token",
              "property_category": "SELECT 1L AS property_id, 5L AS category_id, 0.5D AS strength", "category": "SELECT 5L AS category_id, 'c' AS category"}
    for name, text in tables.items():
        spark.sql(text).write.parquet(str(tmp_path / name))
    sql.catalog_views(spark, {n: str(tmp_path / n) for n in tables})
    assert rows(spark.sql("SELECT * FROM known_values('x')")) == [("s", "x", 9, "c", 0.5, 1)]
    assert spark.sql("SELECT * FROM known_values('y')").count() == 0
