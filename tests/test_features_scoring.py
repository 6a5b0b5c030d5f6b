import math
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from propweave.operators import features as f, scoring as s


@pytest.fixture(scope="module")
def obs():
    rnd = random.Random(5)
    data = {(sid, a): rnd.randint(0, 1) for sid in range(60) for a in range(8) if rnd.random() < 0.6}
    for sid in range(100, 190):  # copies of one profile: half of all substances
        data.update({(sid, 0): 1, (sid, 1): 0, (sid, 2): 1})
    return data


@pytest.fixture(scope="module")
def cons(spark, obs):
    return spark.createDataFrame([(i, a, v) for (i, a), v in obs.items()], "sid bigint, assay bigint, value int")


def brute_pairs(obs):
    by = {}
    for (i, a), v in obs.items():
        by.setdefault(i, []).append((a, v))
    return Counter((x, vx, y, vy) for l in by.values() for x, vx in l for y, vy in l)


def test_pair_counts_equal_brute_force(spark, cons, obs):
    got = {(r["x"], vx, r["y"], vy): r[f"n{vx}{vy}"] for r in f.pair_counts(cons).collect()
           for vx in (0, 1) for vy in (0, 1) if r[f"n{vx}{vy}"]}
    assert got == dict(brute_pairs(obs))
    assert f.profiles(cons).filter("weight >= 90").count() == 1


def test_entropy_bounds_and_support(spark, cons, obs):
    n = Counter()
    for (x, _, y, _), c in brute_pairs(obs).items():
        n[x, y] += c
    got = f.pair_entropy(cons, min_count=30).collect()
    assert {(r["target"], r["feature"]) for r in got} == {k for k, c in n.items() if c > 30}
    assert all(0 <= r["entropy"] <= 1 and r["n"] == n[r["target"], r["feature"]] for r in got)
    assert all(r["target"] != r["feature"] for r in f.pair_entropy(cons, 30, exclude_self=True).collect())


def test_useful_features_bounds(spark, cons):
    assert all(0.025 < r["entropy"] <= 0.9 for r in f.useful_features(cons, 10).collect())


def test_information_gain_of_a_copy_is_its_entropy(spark):
    data = [(i, a, i % 2) for i in range(50) for a in (1, 2)] + [(i, 3, 1) for i in range(50)]
    df = spark.createDataFrame(data, "sid bigint, assay bigint, value int")
    got = {(r["target"], r["feature"]): r["gain"] for r in f.information_gain(df).collect()}
    assert got[1, 2] == pytest.approx(1) and got[1, 3] == pytest.approx(0)


def test_conditional_table_and_scores(spark, cons, obs):
    cond = {(r["target"], r["feature"], r["fvalue"]): r for r in f.conditional_table(cons).collect()}
    pc = brute_pairs(obs)
    r = cond[1, 0, 1]
    n1, n = pc[1, 1, 0, 1], pc[1, 1, 0, 1] + pc[1, 0, 0, 1]
    assert (r["support"], r["n1"]) == (n, n1) and r["p1"] == pytest.approx((n1 + 1) / (n + 2))
    req = spark.createDataFrame([(0, 1), (0, 2), (9999, 3)], "sid bigint, target bigint")
    got = {(x["sid"], x["target"]): x["prob"] for x in
           s.predict_property(req, cons, f.conditional_table(cons), f.priors(cons), k=20, r=3).collect()}
    known = {a: v for (i, a), v in obs.items() if i == 0}
    pri = {x["target"]: x["prior"] for x in f.priors(cons).collect()}
    for t in (1, 2):
        z = math.log(pri[t] / (1 - pri[t])) + sum(cond[t, a, v]["llr"] for a, v in known.items()
                                                  if a != t and (t, a, v) in cond)
        assert got[0, t] == pytest.approx(1 / (1 + math.exp(-z)))
    assert got[9999, 3] == pytest.approx(pri[3])  # nothing known: the prior


def test_context_never_holds_the_target(spark, cons):
    req = cons.selectExpr("sid", "assay as target").filter("sid < 60")
    ctx = s.random_contexts(req, cons, k=4, r=6).collect()
    assert all(p["assay_index"] != r["target"] for r in ctx for p in r["pairs"])
    keys = [(r["sid"], r["target"], tuple(p["assay_index"] for p in r["pairs"])) for r in ctx]
    assert len(keys) == len(set(keys))
    known = s.known_context(req, cons).collect()
    assert all(p["assay_index"] != r["target"] for r in known for p in r["context"])


def test_grid_is_complete(spark):
    c = spark.createDataFrame([(f"c{i}",) for i in range(7)], "name string")
    p = spark.createDataFrame([(i,) for i in range(30)], "property_id bigint")
    got = s.candidate_x_property(c, p)
    assert got.count() == 210 and got.distinct().count() == 210


def test_product_is_spread_over_tasks_whatever_its_input(spark):
    c = spark.range(0, 300, 1, 1).selectExpr("cast(id as string) as name")
    p = spark.range(0, 200, 1, 1).selectExpr("id as property_id")
    got = s.candidate_x_property(c, p).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in got) == 60_000 and max(r["count"] for r in got) < 30_000  # one task had all, as it read all


def test_score_all_is_predict_property_of_all_pairs(spark, cons):
    """Also for large ids, an unknown and a null substance and a property without a conditional table; the pairs are not shuffled."""
    big = 1 << 60
    known = cons.select("sid", (F.col("assay") + F.lit(big)).alias("assay"), "value")
    cond = f.conditional_table(known)
    prior = f.priors(known).select("target", "prior").unionByName(spark.createDataFrame([(big - 1, 0.25), (None, 0.5)], "target bigint, prior double"))
    sub = cons.select("sid").distinct().limit(9)
    sub = sub.unionByName(sub.limit(3)).unionByName(spark.createDataFrame([(987654321,), (None,)], "sid bigint").select(F.col("sid").cast(sub.schema["sid"].dataType)))
    out = s.score_all(sub, known, cond, prior, k=4, r=5)
    want = s.predict_property(s.candidate_x_property(sub, prior.select("target")), known, cond, prior, 4, 5, distinct=True)
    key = lambda r: (str(r["sid"]), r["target"])
    got, want = sorted(out.collect(), key=key), sorted(want.collect(), key=key)
    assert [(*key(r), r["n_contexts"]) for r in got] == [(*key(r), r["n_contexts"]) for r in want]
    assert all(abs(a["prob"] - b["prob"]) < 1e-12 for a, b in zip(got, want))
    assert "collect_set" not in out._jdf.queryExecution().toString()


def test_score_all_covers_every_property(spark, cons):
    sub = cons.filter("sid < 5").select("sid").distinct()
    out = s.score_all(sub, cons, f.conditional_table(cons), f.priors(cons), k=4, r=5)
    assert out.count() == sub.count() * 8 and out.filter("prob <= 0 or prob >= 1").count() == 0


def test_batch_requests_errors(spark, cons):
    req = spark.createDataFrame([(1, 0, 101), (2, None, 101), (3, 0, 999), (4, 0, None)],
                                "request_id int, sid bigint, property_token int")
    tok = spark.createDataFrame([(100 + a, a) for a in range(8)], "property_token int, target bigint")
    out = {r["request_id"]: r for r in s.batch_requests(req, cons, tok, f.conditional_table(cons), f.priors(cons)).collect()}
    assert out[1]["error"] is None and 0 < out[1]["value"] < 1
    assert out[2]["error"] == out[4]["error"] == "missing argument" and out[3]["error"] == "unknown property token"


def test_eval_by_nprops_positions(spark, cons):
    m = s.eval_by_nprops(cons, cons, max_known=2, min_pos=3, min_neg=3, min_items=5)
    assert {r["nprops"] for r in m.collect()} == {0, 1, 2}


def test_a_long_profile_is_counted_by_many_tasks(spark):
    """One substance with a third of all rows: its pairs are dealt out in blocks."""
    hot = [(0, a, a % 2) for a in range(400)]
    data = hot + [(i, a, (a + i) % 2) for i in range(1, 41) for a in range(20)]
    df = spark.createDataFrame(data, "sid bigint, assay bigint, value int")
    got = f.pair_counts(df)
    assert got.filter("x = 399 and y = 398 and n10 = 1").count() == 1
    assert got.count() == 400 * 400
    blocks = -(-400 // f.PAIR_BLOCK)
    assert blocks * (blocks + 1) // 2 > 20


def test_learned_scores_on_unseen_rows(spark):
    rows = [(i, i % 5, int((i // 5) % 2), [f"s{(i // 5) % 2}"], [f"t{i % 5}"]) for i in range(400)]
    df = spark.createDataFrame(rows, "sid bigint, assay bigint, value int, symbols array<string>, known_tokens array<string>")
    out = s.learned_scores(df.filter("sid < 300"), df.filter("sid >= 300"), features=64).collect()
    assert len(out) == 100 and all((r["prob"] > 0.5) == (r["value"] == 1) for r in out)


def test_all_draws_or_the_different_ones(spark, cons):
    req = cons.selectExpr("sid", "assay as target").filter("sid < 20")
    all_draws = s.random_contexts(req, cons, k=20, r=6, distinct=False)
    assert all_draws.count() > s.random_contexts(req, cons, k=20, r=6).count()


def test_feature_benchmark_ranks_a_copy_right(spark):
    import random

    rnd = random.Random(1)
    data = []
    for i in range(600):
        v = rnd.random() < 0.2  # rare enough for the entropy bound of useful features
        data += [(i, 1, int(v)), (i, 2, int(v)), (i, 3, int(rnd.random() < 0.2))]
    df = spark.createDataFrame(data, "sid bigint, assay bigint, value int")
    src = spark.createDataFrame([(1, "copy"), (3, "noise")], "assay bigint, source string")
    got = {r["source"]: r["auc"] for r in s.feature_benchmark(df.filter("sid < 300"), df.filter("sid >= 300"), src).collect()}
    assert got["copy"] == 1.0 and 0.2 < got["noise"] < 0.8


def test_other_values_are_refused(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 0)], "sid bigint, assay bigint, value int")
    with pytest.raises(Exception, match="must be 0 or 1"):
        f.pair_counts(df).collect()


def test_a_choice_without_its_target_is_the_draw(spark):
    """Targets inside and outside a draw, a NULL property and a NULL target."""
    known = spark.createDataFrame([("a", p, p % 2) for p in range(8)] + [("a", None, 1), ("b", 1, 1)], "sid string, assay bigint, value int")
    asked = spark.createDataFrame([("a", t) for t in range(10)] + [("a", None), ("b", 1), ("c", 1)], "sid string, target bigint")
    draws = {r["sid"]: r["draws"] for r in s.drawn_orders(known, 4, 5).collect()}
    out = s.random_contexts(asked, known, 3, 5, distinct=False).collect()
    for sid, target in {(r["sid"], r["target"]) for r in out}:
        got = [[tuple(p) for p in r["pairs"]] for r in sorted(out, key=lambda r: r["ctx"]) if (r["sid"], r["target"]) == (sid, target)]
        left = [sorted([tuple(p) for p in d if target is not None and p["assay_index"] not in (None, target)][:3]) for d in draws.get(sid, [])]
        assert got == ([c for c in left if c] or [[]])


def test_pair_counts_of_two_buckets_stay_in_one_task(spark, cons):
    """The counts are complete where they are made: the aggregate needs no shuffle by property pair."""
    plan = f.pair_counts(cons)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(x#" not in plan.replace("hashpartitioning(bx", "")
    assert "REPARTITION_BY_NUM" in plan


def test_parts_of_pair_counts_grow_with_the_rows(spark, cons, obs, monkeypatch):
    """More rows are nested and counted by more tasks, and a profile of half the substances is not one task's."""
    monkeypatch.setattr(f, "NEST_ROWS", 10)
    dealt = f.dealt_profiles(cons, len(obs), "sid", "assay", "value")
    many = -(-len(obs) // 10)
    assert many > 16 and dealt.rdd.getNumPartitions() == many
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sid#" in plan and plan.count(f", {many})") >= 2
    got = Counter()
    for r in dealt.collect():
        got[tuple(map(tuple, r["assay_val_pairs"]))] += r["weight"]
    assert got == {tuple(map(tuple, r["assay_val_pairs"])): r["weight"] for r in f.profiles(cons).collect()}
    assert max(r["weight"] for r in dealt.collect()) < 45
    test_pair_counts_equal_brute_force(spark, cons, obs)


def test_pair_counts_of_lists_longer_than_a_block(spark):
    rows_ = [(sid, a, (sid * a) % 2) for sid in range(3) for a in range(700)]
    got = {(r["x"], r["y"]): [r[c] for c in f.CELLS] for r in
           f.pair_counts(spark.createDataFrame(rows_, "sid int, assay int, value int")).filter("x < 40 and y % 50 = 7").collect()}
    assert len(got) == 40 * 14
    for (x, y), cells in got.items():
        want = [0] * 4
        for sid in range(3):
            want[(sid * x) % 2 * 2 + (sid * y) % 2] += 1
        assert cells == want


def test_joint_text_is_the_joint_ids(spark):
    from propweave.operators import dataset, vocab

    df = spark.createDataFrame([(1, [1, 5, 2, 0], [(0, 1), (2, 0)]), (2, [1, 2], [(1, 1)] * 9), (3, [0, 0], []), (4, None, [(0, 0)])],
                               "sid int, encoded array<bigint>, assay_val_pairs array<struct<assay_index:bigint, value:int>>")
    meta = vocab.id_space(6, 3, 2)
    ids = {r["sid"]: r["joint"] for r in dataset.encode_joint(df, meta).collect()}
    for r in dataset.joint_text(df, meta).collect():
        assert r["joint"] == (None if ids[r["sid"]] is None else " ".join(map(str, ids[r["sid"]])))
    assert "array_repeat" not in dataset.joint_text(df, meta)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("distinct", [False, True])
def test_predictions_equal_the_steps_one_after_the_other(spark, distinct, monkeypatch):
    """Scored in blocks as from rows of contexts: small substances, one without values, one unknown, a NULL property."""
    import random

    rnd = random.Random(3)
    known = [(f"s{i}", a, rnd.randint(0, 1)) for i in range(60) for a in range(9) if rnd.random() < 0.1 + i % 5 / 5] + [("s3", None, 1)]
    known = spark.createDataFrame(known, "sid string, assay bigint, value int")
    cond, prior = f.conditional_table(known, min_count=3), f.priors(known)
    asked = spark.createDataFrame([(f"s{i}", t) for i in range(62) for t in range(9)] + [(None, 1), ("s1", 77)], "sid string, target bigint")
    want = s.ensemble_mean(s.score_contexts(s.random_contexts(asked, known, 3, 6, distinct=distinct), cond, prior)).collect()
    monkeypatch.setattr(s, "REQUESTS_AT_ONCE", 5)
    out = s.predict_property(asked, known, cond, prior, 3, 6, distinct=distinct)
    got = {(r["sid"], r["target"]): (r["prob"], r["n_contexts"]) for r in out.collect()}
    assert len(got) == len(want) > 500
    for r in want:
        prob, n = got[r["sid"], r["target"]]
        assert prob == pytest.approx(r["prob"], abs=1e-12) and n == r["n_contexts"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ctx#" not in plan  # contexts are no rows


def test_candidate_grid_holds_every_family(spark, tmp_path):
    """Families without a part of size 1 are candidates too."""
    from propweave.plans import q_tables  # noqa: F401
    from propweave.plans.registry import QUERIES

    tables = {"lineitem": ("l_partkey bigint, l_suppkey bigint, l_returnflag string, l_quantity double", [(p, 1, "R", 1.0) for p in (3, 20, 40)]),
              "part": ("p_partkey bigint, p_size int", [(3, 1), (20, 5), (40, 7)]),
              "supplier": ("s_suppkey bigint, s_name string, s_nationkey int", [(1, "x", 0), (2, "y", 1)])}
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {tuple(r) for r in QUERIES["candidate_x_property"](spark, str(tmp_path)).select("name", "property_id").collect()}
    assert got == {(f"F{i}", p) for i in range(3) for p in (1, 2)}


def test_pairs_are_no_rows_of_the_plan(spark, cons):
    """Pairs are formed and counted in the tasks' arrays; the table of priors meets them without a shuffle of theirs."""
    assert "Generate" not in f.pair_counts(cons)._jdf.queryExecution().executedPlan().toString()
    plan = f.conditional_table(cons)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(target#" not in plan and "hashpartitioning(x#" not in plan


@pytest.mark.parametrize("dense", [1 << 20, 0])
@pytest.mark.parametrize("name", [int, str])
@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("heavy", [1, 1 << 55])
def test_packed_lists_are_counted_exactly(monkeypatch, dense, name, exclude_self, heavy):
    """In one array or sorted and merged, numbers or names, weights too large to share a number with their key."""
    import pyarrow as pa

    monkeypatch.setattr(f, "DENSE_KEYS", dense)
    monkeypatch.setattr(f, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(f, "ENTRIES_AT_ONCE", 20)
    monkeypatch.setattr(f, "PAIR_BLOCK", 3)
    rnd = random.Random(4)
    lists = [[(name(a), rnd.randint(0, 1)) for a in range(10, 23) if rnd.random() < 0.5] for _ in range(25)] + [[]]
    weights = [1 if dense else heavy if i == 3 else rnd.randint(1, 5) for i in range(26)]
    kind = pa.int64() if name is int else pa.string()
    batch = pa.RecordBatch.from_arrays([pa.array([[{"assay_index": a, "value": v} for a, v in x] for x in lists], pa.list_(pa.struct(
        [("assay_index", kind), ("value", pa.int32())]))), pa.array(weights)], names=["assay_val_pairs", "weight"])
    groups = {}
    for out in f._dealt_pairs(3)(iter([batch.slice(0, 9), batch.slice(9)])):
        for i in range(len(out)):
            groups.setdefault((out["bx"][i].as_py(), out["by"][i].as_py()), []).append(out.slice(i, 1))
    got = {}
    for group in groups.values():
        for out in f._pair_counter(exclude_self, 4, kind)(iter(group)):
            for r in out.to_pylist():
                assert (r["x"], r["y"]) not in got
                got[r["x"], r["y"]] = [r[c] for c in f.CELLS]
    want = {}
    for x, w in zip(lists, weights):
        for a, v in x:
            for b, u in x:
                if a != b or not exclude_self:
                    want.setdefault((a, b), [0] * 4)[2 * v + u] += w
    assert got == {k: v for k, v in want.items() if sum(v) > 4}


@pytest.mark.parametrize("distinct", [False, True])
def test_contexts_of_all_values_leave_nothing_out(spark, distinct):
    """Without k each context holds every known value but the target's; as by the steps with a k above all numbers of values."""
    rnd = random.Random(8)
    known = [(f"s{i}", a, rnd.randint(0, 1)) for i in range(50) for a in range(12) if rnd.random() < 0.2 + i % 5 / 6] + [("s3", None, 1), ("only", 4, 1)]
    known = spark.createDataFrame(known, "sid string, assay bigint, value int")
    cond, prior = f.conditional_table(known, min_count=3), f.priors(known)
    asked = spark.createDataFrame([(f"s{i}", t) for i in range(52) for t in range(12)] + [(None, 1), ("s1", 77), ("s1", None), ("only", 4), ("only", 5)],
                                  "sid string, target int")
    got = {(r["sid"], r["target"]): (r["prob"], r["n_contexts"]) for r in s.predict_property(asked, known, cond, prior, r=5, distinct=distinct).collect()}
    want = s.ensemble_mean(s.score_contexts(s.random_contexts(asked, known, 40, 5, distinct=distinct), cond, prior)).collect()
    assert len(got) == len(want) > 500
    for r in want:
        prob, n = got[r["sid"], r["target"]]
        assert prob == pytest.approx(r["prob"], abs=1e-12) and n == r["n_contexts"]
    assert got["only", 4][1] == 1 and got["only", 5][1] == (1 if distinct else 5)


def test_values_meet_the_blocks_packed(spark, cons):
    """Lists of many substances are a few rows, however many blocks they are sent to, and no row of the table is shuffled alone."""
    cond, prior = f.conditional_table(cons), f.priors(cons)
    asked = cons.selectExpr("sid", "assay as target")
    for out in (s.predict_property(asked, cons, cond, prior, 4, 5), s.predict_property(asked, cons, cond, prior), s.score_all(asked.select("sid"), cons, cond, prior)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInPandas" not in plan and "hashpartitioning(target#" not in plan and plan.count("MapInArrow") >= 3
