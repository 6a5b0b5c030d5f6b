import numpy as np
import pytest
from conftest import rows

from propweave.operators import similarity as s


@pytest.fixture(scope="module")
def vecs():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(120, 6))
    x[40:80] = x[40] + 0.01 * rnd.normal(size=(40, 6))  # a hot spot: a third of all rows
    return x


@pytest.fixture(scope="module")
def emb(spark, vecs):
    return spark.createDataFrame([(i, v.tolist(), i % 2, i % 3) for i, v in enumerate(vecs)],
                                 "id bigint, vec array<double>, value int, block int")


def brute(x, k, metric, bound=None, block=None):
    out = []
    for q in range(len(x)):
        sc = x @ x[q] if metric == "ip" else ((x - x[q]) ** 2).sum(1)
        sc = np.round(sc, 6)
        c = [j for j in range(len(x)) if j != q and (block is None or j % block == q % block)]
        if bound is not None:
            c = [j for j in c if (sc[j] > bound if metric == "ip" else sc[j] < bound)]
        c.sort(key=lambda j: (-sc[j] if metric == "ip" else sc[j], j))
        out += [(q, j, r + 1) for r, j in enumerate(c[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric,bound", [("ip", None), ("ip", 2.0), ("l2", None), ("l2", 1.5)])
@pytest.mark.parametrize("cells,chunk", [(1, 2048), (7, 16)])
def test_neighbours_are_exact(spark, emb, vecs, metric, bound, cells, chunk, monkeypatch):
    monkeypatch.setattr(s.block_join, "__defaults__", ("id", chunk, False))
    got = s.neighbours(emb, emb, 4, metric, bound, exclude_self=True, cells=cells)
    assert rows(got.select("qid", "cid", "rank")) == brute(vecs, 4, metric, bound)


def test_blocked(spark, emb, vecs):
    got = s.neighbours(emb, emb, 3, block="block", exclude_self=True, cells=1)
    assert rows(got.select("qid", "cid", "rank")) == brute(vecs, 3, "ip", block=3)


def test_zero_distance_neighbour_counts(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "id bigint, vec array<double>")
    c = spark.createDataFrame([(5, [0.0, 0.0], 1), (6, [1.0, 0.0], 0)], "id bigint, vec array<double>, value int")
    r = s.knn_dist_predict(q, c, k=2, maxdist=4.0).first()
    assert r["prediction"] == 0.5 and r["n_neighbours"] == 2


def test_no_neighbour_gives_null(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, vec array<double>")
    c = spark.createDataFrame([(5, [0.0, 1.0], 1)], "id bigint, vec array<double>, value int")
    r = s.knn_predict(q, c).first()
    assert r["prediction"] is None and r["n_neighbours"] == 0


def test_triplets(spark, emb, vecs):
    found = s.triplets(emb.withColumnRenamed("value", "cls"), label="block", k=2, anchors=10).collect()
    assert all(r["qid"] != r["cid"] and r["qid"] % 3 == r["cid"] % 3 == r["block"] for r in found)
    assert all((r["kind"] == "positive") == (r["qid"] % 2 == r["cid"] % 2) for r in found)
    assert len({r["qid"] for r in found}) == 30


def test_fingerprint_and_tanimoto(spark):
    text = ["a b c d e f g h i j k", "a b c d e f g h i j z", "x y", "a b c d e f g h i j k", "q w e r t y u i o p a"]
    fp = s.fingerprint(spark.createDataFrame(list(enumerate(text)), "doc bigint, t string"), "t").cache()
    bits = {r["doc"]: set(r["bits"]) for r in fp.collect()}
    assert len(bits[2]) == 1 and bits[0] == bits[3]
    got = s.tanimoto_pairs(fp, "doc", 0.3).collect()
    want = len(bits[0] & bits[1]) / len(bits[0] | bits[1])
    assert len(got) == 1 and got[0]["tanimoto"] == pytest.approx(want, abs=1e-6)
    assert {got[0]["copies_a"], got[0]["copies_b"]} == {1, 2}
    folded = s.fingerprint(fp.drop("bits"), "t", n_bits=2048)
    assert sum(r["n_pairs"] for r in s.tanimoto_diversity(folded, "doc").collect()) == 10
    n, mean = s.set_diversity(fp).first()
    pairs = [len(bits[i] & bits[j]) / (len(bits[i]) * len(bits[j])) ** 0.5 for i in bits for j in bits if i < j]
    assert n == 5 and mean == pytest.approx(sum(pairs) / 10)


def test_entries_cross_the_shuffle_in_lists(spark):
    rnd = __import__("random").Random(6)
    sets = {f"d{i}": sorted(rnd.sample(range(300), rnd.randint(0, 40))) for i in range(50)}
    df = spark.createDataFrame([*sets.items(), ("none", None)], "id string, bits array<bigint>")
    packed = s.dealt_entries(df.coalesce(1), "id", "bits", 8)
    assert packed.count() == 8 and packed.selectExpr("sum(size(entries))").first()[0] == sum(map(len, sets.values()))
    n = __import__("collections").Counter(b for x in sets.values() for b in x)
    want = {(i, b, n[b]) for i, x in sets.items() for b in x if n[b] > 1}
    got = [tuple(r) for r in s.shared_entries(df).select("id", "bit", "often").collect()]
    assert set(got) == want and len(got) == len(want)


def test_unrelated_long_texts_share_nothing(spark):
    import random

    rnd = random.Random(5)
    long = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(6000)) for _ in range(4)]
    fp = s.fingerprint(spark.createDataFrame(list(enumerate(long)), "doc bigint, t string"), "t")
    assert s.tanimoto_pairs(fp, "doc", 0.05).count() == 0


def test_tanimoto_pairs_equal_brute_force(spark):
    import random

    rnd = random.Random(4)
    sets = [sorted(rnd.sample(range(40), rnd.randint(3, 30))) for _ in range(80)]
    sets = [list(x) for x in {tuple(x) for x in sets}]
    df = spark.createDataFrame(list(enumerate(sets)), "doc bigint, bits array<int>")
    got = {frozenset((r["a"], r["b"])) for r in s.tanimoto_pairs(df, "doc", 0.4).collect()}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i)
            if round(len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])), 6) >= 0.4}
    assert got == want and len(want) > 5


@pytest.mark.parametrize("cells", [1, 20, 40])
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_near_copies_keep_their_ties(spark, cells, metric):
    """Distances that differ less than they are rounded to, whatever the number of cells."""
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(120, 6))
    x[60:] = x[:60] + 3e-4 * rnd.normal(size=(60, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    got = s.neighbours(df, df, 4, metric, exclude_self=True, cells=cells)
    assert rows(got.select("qid", "cid", "rank")) == brute(x, 4, metric)


def test_cosine_neighbours(spark, emb, vecs):
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    got = s.cosine_neighbours(emb.select("id", "vec"), 3)
    assert rows(got.select("qid", "cid", "rank")) == brute(unit, 3, "ip")


def test_lsh_recall(spark, emb, vecs):
    unit = emb.select("id", s.unit("vec").alias("vec"), "value")
    exact = s.neighbours(unit, unit, 4, exclude_self=True, cells=1)
    found = s.knn_lsh(unit, unit, 4, exclude_self=True)
    assert s.recall(found, exact).first()["recall"] >= 0.9
    assert s.recall(s.knn_lsh(unit, unit, 4, tables=1, bits=8, exclude_self=True), exact).first()["recall"] < 0.9


def test_blocks_with_pivot_cells(spark, emb, vecs):
    """A block column that is worked out, and more than one pivot cell, with a bound and without."""
    told = emb.select("id", "vec", "value", (s.F.col("id") % 3).alias("block"))
    for bound in (None, 0.5):
        got = s.neighbours(told, told, 3, bound=bound, block="block", exclude_self=True, cells=4)
        assert rows(got.select("qid", "cid", "rank")) == brute(vecs, 3, "ip", bound, block=3)


def test_a_large_side_is_sent_a_fixed_number_of_times(spark):
    import pandas as pd

    def kernel(key, lp, rp):
        return pd.DataFrame({"n": [len(lp)], "m": [len(rp)]})
    side = spark.range(4000).withColumn("_cell", s.F.lit(""))
    got = s.block_join(side, side, kernel, "n bigint, m bigint", rows=16, most=1000).collect()
    assert sum(r["n"] * r["m"] for r in got) == 4000 * 4000
    assert sum(r["n"] + r["m"] for r in got) <= 2 * 4000 * s.CHUNKS
    bounded = s.block_join(side, side, kernel, "n bigint, m bigint", rows=16, most=100).collect()
    assert max(r["n"] for r in bounded) < 200 and sum(r["n"] * r["m"] for r in bounded) == 4000 * 4000


def test_a_chunk_of_many_steps(spark, emb, vecs, monkeypatch):
    q = np.arange(len(vecs))
    for step in (7, 32):
        monkeypatch.setattr(s, "ROWS_PER_CHUNK", step)
        for metric, bound in (("ip", None), ("ip", 2.0), ("l2", None), ("l2", 1.5)):
            row, col, _ = s._k_best(vecs, vecs, q, q, 4, metric, bound, True)
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            assert sorted(zip(row.tolist(), col.tolist(), (place + 1).tolist())) == brute(vecs, 4, metric, bound)


def test_diversity_counts_every_pair_over_several_chunks(spark):
    import random

    rnd = random.Random(8)
    sets = [tuple(sorted(rnd.sample(range(60), rnd.randint(1, 40)))) for _ in range(90)] + [(1, 2, 3)] * 4
    df = spark.createDataFrame([(i, list(b)) for i, b in enumerate(sets)], "doc bigint, bits array<int>")
    got = {r["bin"]: r["n_pairs"] for r in s.tanimoto_diversity(df, "doc", n_bits=60).collect()}
    want = {}
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            at = min(int(round(len(a & b) / len(a | b), 6) * 20 + 1e-9), 19)
            want[at] = want.get(at, 0) + 1
    assert got == want


def test_equally_near_rows_are_cut_to_the_first(monkeypatch):
    """Many equal vectors: the same k best as by sorting all, and not every equal one is sorted."""
    import numpy as np

    from propweave.operators import similarity

    monkeypatch.setattr(similarity, "ROWS_PER_CHUNK", 64)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (300, 3)).astype(float)
    ids = np.arange(300) * 3
    sorted_ = []
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or lexsort(keys))
    for metric in ("ip", "l2"):
        for bound in (None, 1.5):
            row, col, score = similarity._k_best(x, x, ids, ids, 4, metric, bound, True)
            got = {}
            for r, c, v in zip(row, col, score):
                got.setdefault(r, []).append((c, round(v, 6)))
            for r in range(300):
                cost = ((x[r] - x) ** 2).sum(1) if metric == "l2" else -(x @ x[r])
                limit = np.inf if bound is None else bound if metric == "l2" else -bound
                want = sorted((v, c) for c, v in enumerate(cost) if c != r and v < limit)[:4]
                assert got.get(r, []) == [(c, v if metric == "l2" else -v) for v, c in want]
    assert max(sorted_) <= 64 * 4 * 6
