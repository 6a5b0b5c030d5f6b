import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from propweave.operators import ordering as o


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds most rows, as does one order value's neighbourhood."""
    rnd = random.Random(3)
    data = [("hot", i, rnd.random()) for i in range(300)] + [(f"g{i % 7}", 1000 + i, rnd.random()) for i in range(60)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "g string, i bigint, x double")


def test_position_same_with_and_without_buckets(spark, hot, small_sample):
    got = rows(o.ordered_position(hot, ["i"], "n", group=["g"]).select("g", "i", "n"))
    want, seen = [], {}
    for g, i, _ in sorted(tuple(r) for r in hot.collect()):
        seen[g] = seen.get(g, 0) + 1
        want.append((g, i, seen[g]))
    assert got == sorted(want)
    assert len(o.order_cuts(hot, ["i"])) > 1


def test_global_position_over_strings(spark, small_sample):
    names = [f"n{i:03d}" for i in range(200)] + ["é", "a", "Z", "ß"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = rows(o.ordered_position(df, ["s"], "p", start=0))
    assert got == [(n, i) for i, n in enumerate(sorted(names))]


def test_running_minimum(spark, hot, small_sample):
    got = rows(o.prefix_scan(hot, ["i"], mins={"m": "x"}, group=["g"]).select("g", "i", "m"))
    want, low = [], {}
    for g, i, x in sorted((r["g"], r["i"], r["x"]) for r in hot.collect()):
        low[g] = min(low.get(g, 9), x)
        want.append((g, i, low[g]))
    assert got == sorted(want)


def test_multi_column_order(spark, small_sample):
    df = spark.createDataFrame([(i % 3, f"k{i:02d}") for i in range(60)], "a int, b string")
    got = rows(o.ordered_position(df, ["a", "b"], "p").select("a", "b", "p"))
    assert [p for _, _, p in got] == list(range(1, 61))


def test_exact_median(spark, hot, small_sample):
    import statistics

    got = {r["g"]: (r["m"], r["n"]) for r in o.exact_median(hot, ["g"], "x", "m").collect()}
    by = {}
    for r in hot.collect():
        by.setdefault(r["g"], []).append(r["x"])
    assert got == {g: (pytest.approx(statistics.median(v)), len(v)) for g, v in by.items()}


def test_top_n_is_exact(spark, hot):
    got = rows(o.top_n(hot, ["g"], [F.desc("x")], 5, salts=4).select("g", "rank", "x"))
    by = {}
    for r in hot.collect():
        by.setdefault(r["g"], []).append(r["x"])
    want = [(g, i + 1, x) for g, v in by.items() for i, x in enumerate(sorted(v, reverse=True)[:5])]
    assert got == sorted(want)


def test_null_order_values(spark, small_sample):
    df = spark.createDataFrame([(None,)] + [(i,) for i in range(40)], "i int")
    got = {r["i"]: r["p"] for r in o.ordered_position(df, ["i"], "p").collect()}
    assert got[None] == 1 and got[0] == 2 and got[39] == 41
