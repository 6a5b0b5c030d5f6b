"""Layouts: what lookups read, and joins that move nothing."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from propweave.sources import layout


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows has one substance; texts follow the substance."""
    df = spark.range(40000).select(F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") * 7919) % 5000).alias("sid"),
                                   ((F.col("id") * 104729) % 300).alias("token"), F.col("id").alias("v"))
    return df.withColumn("text", F.sha2(F.col("sid").cast("string"), 256)).withColumn("_z", F.lit(1))


def test_any_of_the_columns_reads_a_small_share(spark, facts, tmp_path):
    path = layout.write_z_ordered(facts, str(tmp_path / "t"), ["sid", "token"], bloom=["text"], files=64)
    assert spark.read.parquet(path).columns == facts.columns
    n = facts.count()
    for column, value, share in (("sid", 1234, 0.3), ("token", 17, 0.3), ("text", None, 0.3), ("sid", 7, 0.75)):
        value = facts.filter("sid = 1234").first()["text"] if value is None else value
        found = layout.lookup(spark, path, column, [value])
        assert rows(found) == rows(facts.filter(F.col(column) == value)) != []
        assert layout.rows_read(layout.lookup(spark, path, column, [value])) <= share * n, column
    assert layout.lookup(spark, path, "text", ["nothing"]).count() == 0
    assert layout.rows_read(layout.lookup(spark, path, "text", ["nothing"])) <= 0.1 * n


def test_the_key_mixes_the_bits_of_both_ranges(spark):
    df = spark.createDataFrame([(a, b) for a in range(100) for b in range(100)], "a int, b int")
    got = df.withColumn("z", layout.z_key(df, ["a", "b"], 2))
    ends = {(r["a"], r["b"]): r["z"] for r in got.filter("a in (0, 99) and b in (0, 99)").collect()}
    assert ends == {(0, 0): 0, (0, 99): 0b0101, (99, 0): 0b1010, (99, 99): 0b1111}
    same = df.filter("a = 1 and b = 2")
    assert same.withColumn("z", layout.z_key(same, ["a", "b"])).first()["z"] == 0


def test_empty_and_null_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, "x"), (1, None)], "a int, t string")
    back = spark.read.parquet(layout.write_z_ordered(df, str(tmp_path / "n"), ["a"], bloom=["t"]))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert spark.read.schema(df.schema).parquet(layout.write_z_ordered(df.limit(0), str(tmp_path / "e"), ["a"])).count() == 0


def test_buckets_need_no_exchange(spark, facts):
    a = layout.write_bucketed(facts.select("sid", "token", "v"), "a", "sid", 8)
    b = layout.write_bucketed(facts.select("sid", "text").distinct(), "b", "sid", 8)
    nested = a.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    joined = a.hint("merge").join(b, "sid")
    both = a.hint("merge").join(a.select("sid", F.col("v").alias("w")).filter("w < 5"), "sid")
    for df in (nested, joined, both):
        assert layout.exchanges(df) == 0
    assert layout.exchanges(facts.groupBy("sid").count()) == 1
    assert rows(nested) == rows(facts.groupBy("sid").agg(F.count(F.lit(1)).alias("n")))
    assert joined.count() == facts.count()
    files = {r["f"] for r in a.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) == 8
