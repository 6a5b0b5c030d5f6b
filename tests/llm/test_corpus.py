"""Near duplicates, decontamination and mixing against brute force; the pipeline as a whole."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from propweave.llm import chosen_path, components, decontaminate, mixing

DOCS = "doc_id bigint, text string, source string, lang string, size string, rep string, mix_epoch string, matches string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "l", "x", "r", "m", "q") for i, t, s in rows], DOCS)


def prose(rng, n, vocab=5000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    classes = collections.defaultdict(list)
    for i in range(len(rows)):
        classes[root(i)].append(i)
    return links, list(classes.values())


def near_rows(copies=40, blocks=12):
    rng = random.Random(4)
    rows, i = [], 0
    for _ in range(blocks):
        base = prose(rng, rng.choice([30, 80, 200]))
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = "edit%d" % rng.randrange(10**6)
            rows.append((i, " ".join(t), "s"))
            i += 1
    base = prose(rng, 150)
    for _ in range(copies):  # one group larger than a block
        t = list(base)
        t[rng.randrange(len(t))] = "edit%d" % rng.randrange(10**6)
        rows.append((i, " ".join(t), "s"))
        i += 1
    odd = [None, "", "  \n", "one two", "One  Two", "one two three", " ".join(prose(rng, 20000))]
    rows += [(i + j, t, "s") for j, t in enumerate(odd)]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize("block", [256, 16])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    monkeypatch.setattr(chosen_path, "SET_BLOCK", block)
    monkeypatch.setattr(chosen_path, "LEAF", block)
    rows = near_rows()
    got = chosen_path.jaccard_classes(docs(spark, rows)).collect()
    links, classes = brute_classes(rows)
    assert len(got) == len(rows)
    want = collections.Counter()
    for c in classes:
        for i in c:
            want[rows[i][0], min(rows[j][0] for j in c), len(c), links[i]] += 1
    assert collections.Counter((r["doc_id"], r["class_id"], r["class_size"], r["n_links"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(classes)
    assert chosen_path.deduplicated(docs(spark, rows)).count() == len(classes)


def edited(rng, base, most):
    t = list(base)
    for _ in range(rng.randint(0, most)):
        t[rng.randrange(len(t))] = "edit%d" % rng.randrange(10**6)
    return " ".join(t)


@pytest.mark.parametrize("block,numbers,most", [(2048, 1 << 21, 12), (7, 1 << 21, 12), (50, 300, 12), (7, 1 << 21, 1)])
def test_large_groups_are_verified_against_a_leader(spark, monkeypatch, block, numbers, most):
    """Members near the leader, far from it and unlike it; blocks by members and by the size of differences."""
    monkeypatch.setattr(chosen_path, "SET_BLOCK", 10)
    monkeypatch.setattr(chosen_path, "DELTA_BLOCK", block)
    monkeypatch.setattr(chosen_path, "DELTA_NUMBERS", numbers)
    rng = random.Random(block + most)
    base = prose(rng, 150)
    texts = sorted({edited(rng, base, most) for _ in range(60)}) + [" ".join(prose(rng, 50)) for _ in range(3)]
    sets = [np.unique(np.array([hash(x) & (2**64 - 1) for x in shingle_set(t)], np.uint64)) for t in texts]
    rows = [(5, i, len(sets), sum(map(len, sets)), i % 3 + 1, s.tobytes()) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "g bigint, rep bigint, n bigint, total bigint, copies bigint, shingles binary")
    got = collections.defaultdict(lambda: [0, 0])
    tied = collections.defaultdict(set)
    for r in chosen_path.verified(members).collect():
        got[r["rep"]][0] += r["links"]
        got[r["rep"]][1] += r["texts"]
        tied[r["rep"]].add(r["root"])
        tied[r["root"]].add(r["rep"])
    linked = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    near = {i: {j for j in range(len(sets)) if j != i and linked(sets[i], sets[j])} for i in range(len(sets))}
    assert {i: got[i] for i in near} == {i: [sum(j % 3 + 1 for j in near[i]), len(near[i])] for i in near}

    def reach(graph, i):
        seen, todo = {i}, [i]
        while todo:
            for j in graph[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return seen
    assert all(reach(tied, i) == reach(near, i) for i in near)
    told = chosen_path.differences(members).collect()
    assert {r["ball"] for r in told} == {True, False}


def test_columns_named_like_helpers_stay(spark):
    rows = [(i, " ".join(prose(random.Random(i % 2), 30)), i, i, i) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, _a bigint, _key bigint, _h1 bigint")
    got = chosen_path.deduplicated(d)
    assert got.columns == d.columns and sorted(r["_a"] for r in got.collect()) == [0, 1]


def test_no_documents_and_null_keys(spark):
    assert chosen_path.jaccard_classes(docs(spark, [])).count() == 0
    t = " ".join(prose(random.Random(5), 40))
    got = chosen_path.jaccard_classes(docs(spark, [(None, t, "s"), (None, t, "s"), (9, t + " more", "s"), (None, "other", "s")])).collect()
    assert sorted((str(r["class_id"]), r["class_size"], r["n_links"]) for r in got) == [("9", 3, 2)] * 3 + [("None", 1, 0)]
    assert sum(r["kept"] for r in got) == 2


def test_recall_of_pairs_at_the_threshold():
    """Sets of similarity 0.8, by the sketch alone: the runs asked for meet nearly all of them."""
    rng = np.random.default_rng(6)
    bar = 2**64 / (chosen_path.THRESHOLD * chosen_path.TOKENS)
    draw = chosen_path._token_keys(chosen_path._splitmix(chosen_path.runs_for(), 109))
    chosen = [k for _, k in zip(*np.nonzero(draw < np.uint64(int(bar))))]
    met = 0
    for _ in range(300):
        both, a, b = rng.integers(0, 2**63, 800, dtype=np.uint64), *rng.integers(0, 2**63, (2, 100), dtype=np.uint64)
        m = chosen_path.minhashes([np.concatenate([both, a]), np.concatenate([both, b])])
        met += bool((m[0, chosen] == m[1, chosen]).any())
    assert met >= 298


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(8)
    items = [(i, " ".join(prose(rng, rng.randint(15, 50), 3000))) for i in range(60)] + [(60, None), (61, ""), (None, "a b c")]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


def test_decontamination_finds_passages_and_paraphrases(spark, bench):
    items, table = bench
    rng = random.Random(9)
    rows, truth = [], set()
    for i in range(400):
        t = prose(rng, rng.randint(30, 400), 3000)
        if i % 10 == 0:
            item, text = items[rng.randrange(60)]
            part = text.upper().split() if i % 20 else [w if rng.random() > 0.2 else "para" for w in text.split()]
            at = rng.randrange(len(t))
            t[at:at] = part
            truth.add((i, item))
        rows.append((i, " ".join(t), "s"))
    rows += [(400, None, "s"), (401, "", "s"), (402, items[0][1], "s"), (402, items[0][1], "s"), (None, items[1][1], "s")]
    d = docs(spark, rows)
    index = decontaminate.fit(d, table)
    got = decontaminate.search(d, index)
    pairs = got.select("doc_id", F.inline("matches")).collect()
    assert got.count() == len(rows)
    found = collections.Counter((r["doc_id"], r["item_id"]) for r in pairs)
    assert len(truth - set(found)) <= 2
    assert set(found) - truth == {(402, 0), (None, 1)} and found[402, 0] == 2
    assert decontaminate.search(d.limit(0), index).count() == 0
    empty = decontaminate.fit(d, table.limit(0))
    assert decontaminate.search(d, empty).filter(F.size("matches") > 0).count() == 0


def test_items_of_common_words_and_copies_of_items(spark):
    """Thirty items under one text, items of common words only, text ids, and columns named like helpers."""
    rng = random.Random(21)
    common = ["the", "of", "and", "to", "in", "is", "it", "on"]
    fill = lambda n: [w for x in prose(rng, n, 4000) for w in (x, rng.choice(common))]
    copied = " ".join(fill(12))
    plain = "to the of in and it is on the in to of"
    items = [(f"copy{i}", copied) for i in range(30)] + [(f"own{i}", " ".join(fill(15))) for i in range(40)] + [("plain", plain)]
    table = spark.createDataFrame(items, "item_id string, text string")
    index = decontaminate.vocabulary([(i, t) for i, t in items])
    assert all(len(x) >= 12 for x in index.items[:70]) and index.strict.tolist() == [False] * 70 + [True] and len(index.items[70]) == 12
    rows = [(i, " ".join(fill(60)), 1, 2) for i in range(60)]
    rows += [(100, " ".join(fill(20)) + " " + copied + " " + " ".join(fill(20)), 1, 2), (101, plain, 1, 2)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, _hits int, _searched int")
    for most in (1 << 16, 20):
        index = decontaminate.fit(d, table)
        decontaminate.BLOCK_ITEMS, before = most, decontaminate.BLOCK_ITEMS
        try:
            got = decontaminate.search(d, index)
            found = {(r["doc_id"], r["item_id"]) for r in got.select("doc_id", F.inline("matches")).collect()}
        finally:
            decontaminate.BLOCK_ITEMS = before
        assert found == {(100, f"copy{i}") for i in range(30)} | {(101, "plain")}
        assert got.columns == ["doc_id", "text", "_hits", "_searched", "matches"]


def test_no_number_of_items_is_refused(spark, bench, monkeypatch):
    """Items in several blocks, sums in several column blocks: the results of one block."""
    assert len(decontaminate.vocabulary([(i, f"w{i} v{i} u{i % 7}") for i in range(50_001)]).items) == 50_001
    items, table = bench
    rng = random.Random(13)
    rows = [(i, " ".join(prose(rng, 40, 3000) + (items[i][1].split() if i < 60 else [])), "s") for i in range(80)]
    rows += [(400, None, "s"), (402, items[0][1] + " " + items[59][1], "s"), (402, items[0][1] + " " + items[59][1], "s")]
    d = docs(spark, rows)
    got = lambda: sorted((r["doc_id"], r["source"], [m["item_id"] for m in r["matches"]]) for r in
                         decontaminate.search(d, decontaminate.fit(d, table)).collect())
    whole = got()
    assert sum(len(x[2]) for x in whole) >= 60 and len(whole) == len(rows)
    for name, n in (("BLOCK_ITEMS", 7), ("BLOCK_COSINES", 3), ("SUM_NUMBERS", 40_000)):
        monkeypatch.setattr(decontaminate, name, n)
    assert got() == whole


def test_lcs_by_bits():
    rng = random.Random(10)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(len(b)), lambda left, j: max(left, row[j + 1], row[j] + (x == b[j])), initial=0))
        assert decontaminate.lcs_length(decontaminate._masks(a), len(a), b) == row[-1]


def test_word_pairs_cover_every_passage(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["", None, "b", *(" ".join(rng.choice("abcdexyz") for _ in range(rng.randrange(1, 120))) for _ in range(40))]
    index = decontaminate.vocabulary([(1, "a b c d e")])
    index.idf = np.arange(1, 6, dtype=np.float32)
    number = {w: int(decontaminate.lookup(index.words, decontaminate.words_of([w])[0])[0][0]) for w in "abcde"}
    want = np.zeros((5, 5))
    for words in ((t or "").split() for t in texts):
        for a in range(0, len(words), decontaminate.STEP):
            seen = [number[w] for w in words[a : a + 2 * decontaminate.STEP] if w in number]
            n = np.bincount(seen, minlength=5)
            if len(seen):
                want += np.outer(n, n) / (n @ index.idf.astype(float) ** 2)
    rows = decontaminate.word_pairs(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), index).collect()
    pair, weight = np.array([r["pair"] for r in rows]), np.array([r["weight"] for r in rows])
    assert np.allclose(decontaminate.pair_products(np.zeros((5, 5)), pair, weight, np.eye(5)), want)
    # for many words the sums are passed on in parts
    monkeypatch.setattr(decontaminate, "SUM_NUMBERS", 4)
    monkeypatch.setattr(decontaminate, "HELD_PAIRS", 50)
    i, j = np.triu_indices(5)
    sums = decontaminate.PairSums(5)
    parts = [p for _ in range(9) for p in sums.add(i, j, i + 10.0 * j)] + list(sums.take())
    pair, weight = (np.concatenate(x) for x in zip(*parts))
    assert len(parts) > 1
    assert np.allclose(decontaminate.pair_products(np.zeros((5, 5)), pair, weight, np.eye(5)), 9 * (np.minimum.outer(range(5), range(5)) + 10.0 * np.maximum.outer(range(5), range(5))))


def test_pair_sums_leave_a_part_at_a_time():
    import tracemalloc

    n = 1500
    sums = decontaminate.PairSums(n)
    i, j = np.triu_indices(n)
    assert not list(sums.add(i, j, np.arange(1.0, len(i) + 1)))
    tracemalloc.start()
    seen = 0
    for pair, weight in sums.take():
        assert (pair == i[seen : seen + len(pair)] * n + j[seen : seen + len(pair)]).all()
        assert (weight == np.arange(seen + 1, seen + len(pair) + 1)).all()
        seen += len(pair)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(i) and most < sums.table.nbytes * 1.5  # all at once took five times the table


def test_pair_sums_take_bounded_memory():
    import tracemalloc

    n, rng = 5000, np.random.default_rng(1)
    common = rng.permutation(n)
    tracemalloc.start()
    sums, want, rare = decontaminate.PairSums(n, common), np.zeros((n, 50)), 0.0
    got = np.zeros((n, n), np.float32)
    base = tracemalloc.get_traced_memory()[0] - sums.table.nbytes
    tracemalloc.reset_peak()
    for _ in range(100):
        i, j = common[(n * rng.random((2, 20_000)) ** 6).astype(int)]  # some words are far more frequent
        i, j = np.minimum(i, j), np.maximum(i, j)
        np.add.at(want, (i, i % 50), 1.0)
        for pair, weight in sums.add(i, j, np.ones(len(i))):
            np.add.at(got, (pair // n, pair % n), weight)
            rare += weight.sum()
    for pair, weight in sums.take():
        assert (pair // n <= pair % n).all()
        np.add.at(got, (pair // n, pair % n), weight)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got.sum(axis=1), want.sum(axis=1)) and got.sum() == 2_000_000 and 0 < rare < 1_000_000
    assert most - base < 64e6  # a table of all pairs alone took 100 MB


def test_singular_vectors_are_those_of_the_matrix(spark, bench):
    """The randomised basis holds as much of the matrix as numpy's."""
    rng = random.Random(11)
    rows = [(i, " ".join(prose(rng, 60, 40)), "s") for i in range(50)]
    table = spark.createDataFrame([(i, " ".join(prose(rng, 20, 40))) for i in range(5)], "item_id bigint, text string")
    index = decontaminate.fit(docs(spark, rows), table)
    assert index.project.shape[0] == len(index.words) and np.isfinite(index.project).all()
    assert np.allclose(np.linalg.norm(index.latent, axis=1), 1, atol=1e-3)


def mix_rows(big=0.4, n=1500):
    rng = random.Random(12)
    return [(i, " ".join(["t"] * rng.randint(1, 30)), "big" if rng.random() < big else f"s{rng.randrange(6)}") for i in range(n)]


def test_mixing_meets_the_target(spark):
    rows = mix_rows() + [(5000, None, "empty"), (5001, "", "empty"), (5002, "x y", None), (7, "t t", "s1"), (7, "t t", "s1")]
    got = mixing.mix(docs(spark, rows), entropy=0.97, passes=1e6, block_tokens=200).collect()
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s or ""] += len((t or "").split())
    weight = {(r["source"] or ""): r["mix_weight"] for r in got}
    live = {s: n for s, n in tokens.items() if n}
    share = {s: n / sum(live.values()) for s, n in live.items()}
    lo, hi = 0.0, 1.0
    for _ in range(60):
        a = (lo + hi) / 2
        z = sum(p**a for p in share.values())
        h = -sum(p**a / z * math.log(p**a / z) for p in share.values()) / math.log(len(share))
        lo, hi = (a, hi) if h >= 0.97 else (lo, a)
    z = sum(p**lo for p in share.values())
    for s, p in share.items():
        assert weight[s] == pytest.approx(p**lo / z, rel=1e-4)
    assert weight["empty"] == 0
    out = collections.Counter()
    for r in got:
        out[r["source"] or ""] += r["mix_tokens"]
    budget = max(n / weight[s] for s, n in live.items())
    for s in live:  # never above the quota, and short of it by less than a document (and equal rows) of it
        assert weight[s] * budget - 62 <= out[s] <= weight[s] * budget + 1e-3
    assert {r["doc_id"] for r in got} == {i for i, _, _ in rows}
    assert all(0 <= r["mix_position"] <= 1 for r in got)


def test_pass_limit_wins_and_budget_is_kept(spark):
    d = docs(spark, mix_rows())
    got = mixing.mix(d, entropy=1.0, passes=1.5, block_tokens=300).groupBy("doc_id").count()
    assert got.agg(F.max("count")).first()[0] == 2
    small = mixing.mix(d, budget=3000, block_tokens=300)
    assert 2500 <= small.agg(F.sum("mix_tokens")).first()[0] <= 3000
    assert mixing.mix(d.limit(0)).count() == 0
    one = mixing.mix(docs(spark, [(1, "a b", "s"), (2, "c", "s")]))
    assert one.count() == 2 and one.first()["mix_weight"] == 1.0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    found = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = found.columns, found
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialise(stage(spark, before, sf), f"test-{name}")
        assert after.select(*columns).exceptAll(after.select(*columns)).count() == 0
        assert after.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
        assert after.columns == (columns if name != "sharding" else [*columns, "shard"])
        before = after
    texts = [(r["doc_id"], r["text"], "s") for r in before.dropDuplicates(["doc_id"]).collect()]
    assert len(texts) > 100 and max(brute_classes(texts)[0]) == 0
