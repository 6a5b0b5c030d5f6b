"""Classifiers and language-model scores: held-out accuracy, exact base scores, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from propweave.llm import bytetext, quality, toxicity

DOCS = "doc_id bigint, text string, score double, label string, rare string, n_known string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 9.0, "x", "r", "k") for i, t in rows], DOCS)


def words(rng, n, junk=False):
    out = ["".join(rng.choice(["an", "the", "er", "ion", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.upper() + "!!" if junk else w for w in out)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(20, 120), junk=i % 3 == 0)) for i in range(600)]
    return rows, spark.createDataFrame([(i, int(i % 3 != 0)) for i, _ in rows], "doc_id bigint, label int")


def test_quality_on_held_out_rows(spark, labelled):
    rows, labels = labelled
    all_docs = docs(spark, rows + [(1000, None), (1001, ""), (1002, "a " * 50000), (5, rows[5][1]), (None, "x")])
    model = quality.fit(all_docs, labels.filter("doc_id < 400"))
    got = quality.score(all_docs, model).collect()
    assert len(got) == 605 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and 400 <= r["doc_id"] < 600]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in held]) > 0.97
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert got[0]["label"] == "x"


def test_quality_without_examples(spark, labelled):
    rows, labels = labelled
    some = docs(spark, rows[:4])
    for few in (labels.limit(0), labels.filter("label = 1").limit(3)):
        assert quality.score(some, quality.fit(some, few)).count() == 4
    assert quality.score(some.limit(0), quality.fit(some.limit(0), labels)).count() == 0


def test_labels_are_never_broadcast(spark, labelled):
    rows, labels = labelled
    found = quality.labelled(docs(spark, [*rows, (5, rows[5][1]), (None, "x"), (7, None)]), labels.distinct())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(map(tuple, found.collect())) == sorted([*((i, t, int(i % 3 != 0)) for i, t in rows), (7, "", 1)])


def test_quality_learns_from_every_labelled_row(spark):
    """More text than one dictionary is built from at once: all of it counts, in dictionaries and calibration."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"{'bad' if i % 2 else 'good'}{rng.randrange(300)}" for _ in range(200)), i % 2) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = quality.fit(d, d.select("doc_id", (1 - F.col("label")).alias("label")), budget=10_000)
    at = {r["doc_id"]: r["score"] for r in quality.score(d, model).collect()}
    assert all((at[i] >= 0.5) == (label == 0) for i, _, label in rows)
    # a draw's end and no bound in bytes: the share counts all 400 rows, and a text beyond the budget builds as well
    assert model.share == 201 / 402
    assert quality.fit(d.filter("doc_id < 8"), d.filter("doc_id < 8").select("doc_id", "label"), budget=10).sizes is not None


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        t = words(rng, 60).split()
        if i % 8 == 0:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["vile", "grim"]) + rng.choice(["", "", "ish", "ly"]))
        rows.append((i, " ".join(t)))
    all_docs = docs(spark, rows + [(2000, None), (2001, ""), (2002, "and " * 40000), (8, rows[8][1]), (None, "vile grim vile")])
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(600)] + [(601, None)], "doc_id bigint, label int")
    model = toxicity.fit(all_docs, labels, all_docs.filter("doc_id < 600"))
    got = toxicity.score(all_docs, model).collect()
    held = [r for r in got if r["doc_id"] is not None and 600 <= r["doc_id"] < 900]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 8 == 0) for r in held]) > 0.97
    assert all(r["score"] < 0.5 for r in got if r["doc_id"] in (2000, 2001, 2002))
    assert [r["score"] > 0.5 for r in got if r["doc_id"] is None] == [True]
    none = toxicity.fit(all_docs, labels.filter("label = 0"), all_docs)
    assert all(r["score"] < 0.01 for r in toxicity.score(all_docs, none).collect())
    assert toxicity.score(all_docs.limit(0), model).count() == 0


def test_samples_are_bounded_in_rows(spark):
    """One drawn key in very many rows: equal rows count once, others up to the bound."""
    from propweave.llm.samples import texts_of

    many = spark.range(5000).selectExpr("1L as doc_id", "concat('text ', id % 900) as text").unionAll(spark.sql("select 2L, 'own'"))
    sample = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, label int")
    assert texts_of(many, sample, 10000).count() == 901 and texts_of(many, sample, 50).count() == 50
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, label int")
    assert 0 < quality.score(many.limit(3), quality.fit(many, labels, rows=20)).first()["score"] < 1
    assert toxicity.fit(many, labels, many, positives=20, others=30).raw is not None


def test_negative_part_of_the_risk_is_not_followed_below_zero():
    """Positives that can be told apart by heart: without the clamp the weights run away."""
    pos, unl = [np.array([i]) for i in range(20)], [np.array([i]) for i in range(40)]
    w, b = toxicity.train(pos, unl, 40, 0.4)
    f = np.array([w[u].sum() + b for u in unl])
    p = np.array([w[u].sum() + b for u in pos])
    assert np.logaddexp(0, f).mean() - 0.4 * np.logaddexp(0, p).mean() > -0.05


def test_words_and_shingles_of_bytes():
    texts = ["Hello  World\n", None, "", "a b c d e f", "é x\x0by"]
    _, data, at = next(bytetext.pieces(pa.RecordBatch.from_pydict({"text": texts})))
    w = bytetext.Words(data, at)
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)] == ["hello", "world", *"abcdef", "é", "x", "y"]
    assert w.counts().tolist() == [2, 0, 0, 6, 3]
    s, run = bytetext.shingles(w.hashes(), w.word_at, 5)
    assert np.diff(run).tolist() == [1, 0, 0, 2, 1] and len(set(s.tolist())) == 4
