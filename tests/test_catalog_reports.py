import pytest
from conftest import rows
from pyspark.sql import functions as F

from propweave.operators import catalog as c, reports as r


def structures(spark):
    return spark.createDataFrame([("a", "I=CC", "CC"), ("b", "I=N", "N"), ("c", None, "O")], "sid string, inchi string, smiles string")


@pytest.fixture(scope="module")
def dims(spark):
    prop = spark.createDataFrame([(1, "p1", 11, "s2", "{}"), (2, "p2", 12, "s1", "{}"), (3, "p3", 13, "s1", "{}")],
                                 "property_id int, title string, property_token int, source string, data string")
    cat = spark.createDataFrame([(1, "x", "r", 9.0), (1, "y", "r", 3.0), (2, "x", "r", 5.0)],
                                "property_id int, category string, reason string, strength double")
    act = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 3, 1)], "sid string, property_id int, value int")
    return prop, cat, act


def test_surrogate_ids_in_name_order(spark, dims):
    tables = c.build_catalog(*dims, structures(spark), 10)
    assert rows(tables["source"]) == [("s1", 0), ("s2", 1)] and rows(tables["category"]) == [("x", 0), ("y", 1)]


def test_activity_by_structure(spark, dims):
    t = c.build_catalog(*dims, structures(spark), 10)
    assert sorted(r["activity_id"] for r in t["activity"].collect()) == [0, 1, 2]
    got = c.activities_of(t["activity"], spark.createDataFrame([("CC",), ("CC",)], "smiles string")).collect()
    assert got and all(r["sid"] == "a" and r["value_token"] == 10 + r["binary_value"] and r["inchi"] == "I=CC" for r in got)


def test_catalog_round_trip(spark, dims, tmp_path):
    paths = c.write_catalog(c.build_catalog(*dims, structures(spark), 10), str(tmp_path))
    assert {n: spark.read.parquet(p).count() for n, p in paths.items()} == {
        "category": 2, "source": 2, "property_category": 3, "property": 3, "activity": 3}


def test_property_without_category_stays(spark, dims):
    t = c.build_catalog(*dims, structures(spark), 10)
    got = {x["property_token"]: len(x["categories"]) for x in c.property_catalog(t["property"], dims[1], t["source"]).collect()}
    assert got == {11: 2, 12: 1, 13: 0}


def test_known_properties(spark, dims):
    prop, cat, act = dims
    t = c.build_catalog(prop, cat, act, structures(spark), 10)
    req = spark.createDataFrame([("a",), ("a",)], "sid string")
    got = c.known_properties(req, act.withColumnRenamed("property_id", "assay"), t["property"], cat, t["source"], "x")
    assert rows(got.select("property_token", "value")) == [(11, 1), (12, 0)]
    everyone = spark.createDataFrame([("a",), ("b",)], "sid string")
    got = c.known_properties(everyone, act.withColumnRenamed("property_id", "assay"), t["property"], cat, t["source"]).collect()
    assert {x["property_token"]: len(x["categories"]) for x in got} == {11: 2, 12: 1, 13: 0} and len(got) == 3


def test_histogram_top_edge(spark):
    df = spark.createDataFrame([(0, x / 10) for x in range(11)] + [(1, 0.5)], "nprops int, auc double")
    got = rows(r.auc_histogram(df, bins=5).select("nprops", "bin", "n"))
    assert sum(n for p, _, n in got if p == 0) == 11 and (0, 4, 3) in got and (1, 0, 1) in got


def test_log_reports(spark):
    log = spark.createDataFrame([("t", i, v) for i, v in enumerate([5.0, 3.0, 4.0, 3.0, 2.0, 6.0])],
                                "type string, batch bigint, loss double")
    got = {x["batch"]: (x["best"], x["since_best"]) for x in r.early_stop(log).collect()}
    assert got == {0: (5.0, 0), 1: (3.0, 0), 2: (3.0, 1), 3: (3.0, 2), 4: (2.0, 0), 5: (2.0, 1)}
    tail = r.log_tail_min(log, n=2, skip=1)
    assert rows(tail.select("batch", "is_min")) == [(4, 1), (5, 0)]
    assert rows(r.loss_every(log, 4).select("step", "n")) == [(0, 4), (1, 2)]


def test_pivot_mean_over_present_cells(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 1, 5.0)], "k string, p int, v double")
    got = {x["k"]: (x["cells"], x["mean"]) for x in r.pivot_metric(df, "k", "p", "v").collect()}
    assert got == {"a": ({0: 1.0, 1: 3.0}, 2.0), "b": ({1: 5.0}, 5.0)}


def test_pivot_has_every_category_of_the_dimension(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "new", 3.0), ("b", "x", 5.0)], "k string, c string, v double")
    names = r.dimension(df, "c")
    assert names == ["new", "x"]
    assert rows(r.pivot_mean(df, "k", "c", names, "v")) == [("a", 3.0, 1.0), ("b", 0.0, 5.0)]


def test_rebalance_and_heat(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,)], "p double")
    assert [x[0] for x in df.select(r.rebalance(F.col("p"))).collect()] == [0.0, 0.5, 1.0]
    assert [x[0] for x in df.select(r.heat_code(F.col("p") + 0.6)).collect()] == [0, 1, 2]


def test_distinct_rows_of_a_join_are_dealt_to_many_tasks(spark):
    """Names of candidates may be null and rows repeated; one task makes all rows, and none may hold them all."""
    rows = [(s, t, c, n, p, 9.0) for s, t, c, n, p in [("a", "x", "k", "1", 0.5), ("a", "x", "k", "2", 0.75), ("a", "x", "l", None, 0.25), ("b", "y", "k", "1", 1.0)]]
    df = spark.createDataFrame(rows * 3 + [("a", "x", "k", "9", 1.0, 1.0)], "source string, property_title string, category string, name string, prediction double, strength double").coalesce(1)
    prevalent, hazards = r.property_prevalence(df, 2), r.hazard_counts(df, ["k", "l"], cut=0.6)
    assert {tuple(r) for r in prevalent.collect()} == {("a", "x", "k", 0.625, 1), ("a", "x", "l", 0.125, 0), ("b", "y", "k", 0.5, 1)}
    assert {tuple(r) for r in hazards.collect()} == {("1", 1), ("2", 1), (None, 0)}
    for out in (prevalent, hazards):
        assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
