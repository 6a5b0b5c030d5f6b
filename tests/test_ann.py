"""The trained index beside the exact search: recall, work, storage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from propweave.operators import ann, similarity


def vectors(spark, n, width=12, seed=1, groups=15):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, width)) * 2
    x = centres[rng.integers(0, groups, n)] + rng.standard_normal((n, width))
    x[n // 2 : n // 2 + n // 3] = x[0] + rng.standard_normal((n // 3, width)) * 0.2  # a third of the rows lies together
    return spark.createDataFrame([(i, v.tolist(), float(i % 2)) for i, v in enumerate(x)], "id bigint, vec array<double>, value double")


@pytest.fixture(scope="module")
def built(spark):
    df = vectors(spark, 3000)
    return df, ann.fit(df), similarity.neighbours(df.filter("id % 20 = 0"), df, k=5, metric="l2", exclude_self=True)


def test_recall_grows_with_the_visits(built):
    df, index, exact = built
    q = df.filter("id % 20 = 0")
    found = {v: similarity.recall(ann.search(q, index, 5, v, exclude_self=True), exact).first()["recall"] for v in (1, 4, 16)}
    assert found[1] <= found[4] + 0.02 and found[4] <= found[16] + 0.02 and found[16] >= 0.95, found
    every = similarity.recall(ann.search(q, index, 5, 10**6, rerank=3000, exclude_self=True), exact).first()["recall"]
    assert every == 1.0


def test_work_grows_slower_than_the_corpus(spark, built):
    large, index, _ = built
    small = vectors(spark, 750)
    few, many = (ann.comparisons(d.filter("id % 20 = 0"), i, 2).first()["per_query"] for d, i in ((small, ann.fit(small)), (large, index)))
    assert many < 3 * few and many < 0.5 * 3000
    assert index.sizes.agg(F.sum("n")).first()[0] == 3000 and index.lists.select("id").distinct().count() == 3000


def test_stored_and_read_back(spark, built, tmp_path):
    df, index, _ = built
    q = df.filter("id < 10")
    index.save(str(tmp_path / "index"))
    again = ann.Index.load(spark, str(tmp_path / "index"))
    get = lambda i: [(r["qid"], r["cid"], r["rank"], r["value"]) for r in ann.search(q, i, 3, 4).orderBy("qid", "rank").collect()]
    assert get(again) == get(index) and len(get(index)) == 30
    assert all(r["qid"] == r["cid"] for r in ann.search(q, again, 1, 4).collect())


def test_few_rows(spark):
    assert ann.fit(vectors(spark, 3).limit(0)) is None
    one = spark.createDataFrame([(7, [1.0, 2.0, 3.0])], "id bigint, vec array<double>")
    assert [(r["qid"], r["cid"], r["score"]) for r in ann.search(one, ann.fit(one), 5).collect()] == [(7, 7, 0.0)]
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(40)], "id bigint, vec array<double>")
    assert ann.search(same.filter("id = 3"), ann.fit(same), 5).count() == 5


def test_a_query_is_sent_once_to_a_group_of_lists(spark):
    """Not once for each list it visits; the lists that it visits come along."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)], "id bigint, vec array<double>")
    index = ann.fit(rows, lists=20, rounds=2)
    sent = ann._visits(rows, index, ann.MOST_LISTS, 3).collect()
    assert len(sent) == 3 * 300 and all(int(c) % 3 == int(r["_cell"]) for r in sent for c in r["cells"])
    assert sum(len(r["cells"]) for r in sent) == 20 * 300
    all_ = [(r["qid"], r["cid"], r["rank"]) for r in ann.search(rows, index, 5, ann.MOST_LISTS, rerank=300).collect()]
    vec = {r["id"]: np.array(r["vec"]) for r in rows.collect()}
    for q in (0, 17, 299):
        want = sorted(vec, key=lambda c: (((vec[q] - vec[c]) ** 2).sum(), c))[:5]
        assert [c for a, c, _ in sorted(all_, key=lambda x: x[2]) if a == q] == want
