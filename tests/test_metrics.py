import math
import random

import pytest
from pyspark.sql import functions as F

from propweave.operators import metrics as m


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(1)
    out = [("hot", rnd.randint(0, 1), rnd.random(), i) for i in range(240)]
    out += [(f"g{i % 3}", rnd.randint(0, 1), rnd.randint(0, 9) / 10, i) for i in range(150)]
    return out


@pytest.mark.parametrize("bucketed", [False, True])
def test_auc_with_ties_equals_brute_force(spark, data, bucketed, request):
    if bucketed:
        request.getfixturevalue("small_sample")
    df = spark.createDataFrame(data, "g string, y int, s double, item int")
    got = {r["g"]: r["auc"] for r in m.safe_auc(df, ["g"], "y", "s").collect()}
    for g in got:
        assert got[g] == pytest.approx(brute_auc([(y, s) for k, y, s, _ in data if k == g]))
    turned = {r["g"]: r["auc"] for r in m.safe_auc(df.withColumn("s", -F.col("s")), ["g"], "y", "s").collect()}
    assert all(got[g] + turned[g] == pytest.approx(1) for g in got)


def test_binary_metrics_against_python(spark, data):
    df = spark.createDataFrame(data, "g string, y int, s double, item int")
    for r in m.binary_metrics(df, ["g"], "y", "s", "item").collect():
        rows = [(y, s) for k, y, s, _ in data if k == r["g"]]
        n1, n0 = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
        tp = sum(y == 1 and s > 0.5 for y, s in rows)
        tn = sum(y == 0 and s <= 0.5 for y, s in rows)
        clip = lambda s: min(max(s, 1e-15), 1 - 1e-15)
        ce = -sum(math.log(clip(s)) if y else math.log(1 - clip(s)) for y, s in rows) / len(rows)
        assert r["acc"] == pytest.approx((tp + tn) / len(rows))
        assert r["bac"] == pytest.approx((tp / n1 + tn / n0) / 2)
        assert r["cross_entropy_loss"] == pytest.approx(ce)
        assert (r["num_pos"], r["num_neg"]) == (n1, n0)


def test_one_class_group_is_null_or_left_out(spark):
    df = spark.createDataFrame([("a", 1, 0.2, i) for i in range(40)], "g string, y int, s double, item int")
    assert m.safe_auc(df, ["g"], "y", "s").first()["auc"] is None
    assert m.binary_metrics(df, ["g"], "y", "s", "item").count() == 0
    assert m.confusion_by_group(df, ["g"], "y", "s").count() == 0


def test_threshold_side_is_a_parameter(spark):
    df = spark.createDataFrame([("a", i % 2, 0.5, i) for i in range(60)], "g string, y int, s double, item int")
    strict = m.binary_metrics(df, ["g"], "y", "s").first()
    loose = m.confusion_by_group(df, ["g"], "y", "s").first()
    assert strict["acc"] == 0.5 and loose["tp"] == 30 and loose["tn"] == 0


def test_null_scores_are_dropped_but_counted(spark):
    data = [("a", i % 2, None if i < 10 else 0.1 * (i % 2)) for i in range(50)]
    r = m.confusion_by_group(spark.createDataFrame(data, "g string, y int, s double"), ["g"], "y", "s").first()
    assert (r["n"], r["groupsize"]) == (40, 50)


def test_softmax_and_sequences(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1, 2, 3], [1, 0, 3])], "p array<double>, a array<int>, b array<int>")
    r = m.sequence_accuracy(df.withColumn("p", m.softmax("p")), "a", "b").first()
    assert r["p"] == [0.5, 0.5] and r["pct"] == pytest.approx(200 / 3)


def test_balanced_accuracy_multi(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, h string")
    assert m.balanced_accuracy_multi(df, [], "y", "h").first()["bac"] == pytest.approx((0.5 + 1 + 0) / 3)
