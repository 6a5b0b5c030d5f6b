"""Phrases beside a brute-force count of all of them."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from propweave.llm import phrases, tallies


def brute(rows, least, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        alive = []
        for p, a in found.items():
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in longer):
                alive.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(alive)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "zoo", "é", "日本", "a-b", "x" * 90, "to", "be", "or", "not"]
    fixed = ["New York city zoo", "to be or not", "the the the the the", "日本 é"]
    rows = []
    for _ in range(docs):
        n = rng.randrange(1, 25)
        text = "".join((rng.choice(fixed) if rng.random() < 0.3 else rng.choices(words, [8, 7] + [1] * 12)[0])
                       + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " \x0b "]) for _ in range(n))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return rows


def found(spark, rows, least, top, **how):
    docs = spark.createDataFrame(rows, "lang string, text string")
    return sorted(tuple(r) for r in phrases.collocations(docs, least=least, top=top, **how).collect())


@pytest.mark.parametrize("least,top,bits,aim", [(3, 2000, 20, 2), (3, 5, 20, 1), (2, 12, 8, 1), (5, 1, 20, 2)])
def test_equals_brute_force(spark, least, top, bits, aim):
    """Few asked for: several rounds, each with a floor. Eight bits: most prefixes are let through by chance."""
    rows = corpus(least + top)
    assert found(spark, rows, least, top, bits=bits, aim=aim) == brute(rows, least, top)


def test_floors_open_the_best_first(spark):
    scores = spark.createDataFrame([("a", 900000), ("a", 500000), ("a", 3), ("a", 0), ("b", 7)], "lang string, score bigint")
    assert {r["lang"]: r["floor"] for r in phrases._floors(scores, 2).collect()} == {"a": 500000, "b": 0}
    assert {r["lang"]: r["floor"] for r in phrases._floors(scores, 1).collect()} == {"a": 900000, "b": 7}


def test_odd_rows(spark):
    assert found(spark, [], 1, 10) == []
    rows = [(None, None), ("en", ""), ("en", "a b"), ("en", "a b"), ("en", "... !!"), ("fr", "q " * 50000)]
    assert found(spark, rows, 2, 10) == brute(rows, 2, 10)
    docs = spark.createDataFrame([("en", "a b a b", 1, 2, 3)], "lang string, text string, w1 int, score int, phrase int")
    assert [tuple(r) for r in phrases.collocations(docs, least=2).collect()] == brute([("en", "a b a b")], 2, 2000)


def test_ties_are_ranked_by_count_and_bytes(spark):
    rows = [("en", "\n".join(f"{a}{k} {b}{k}" for k in range(40) for a, b in [("é", "z"), ("e", "z")])) for _ in range(3)]
    assert found(spark, rows, 3, 7, aim=1) == brute(rows, 3, 7)


def test_counts_and_sets_are_exact_for_equal_sort_keys(monkeypatch):
    monkeypatch.setattr(tallies, "_rolled", lambda columns: np.zeros(len(columns[0]), np.uint64))
    p = tallies.Partial(2)
    a = np.array([1, 2, 1, 2, 1], np.uint64)
    list(p.add([a, a + np.uint64(1)]))
    got = Counter()
    for columns, n in p.take():
        for x, y, k in zip(*(c.tolist() for c in columns), n.tolist()):
            got[x, y] += k
    assert got == {(1, 2): 3, (2, 3): 2}


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(4 * 10**18, 4 * 10**18, 5 * 10**18)], "a bigint, f1 bigint, f2 bigint")
    assert phrases._with_scores(df, [("f1", "f1")]).first()["score"] == 1000000


def test_words_of_one_hash_are_found_out(spark):
    rows = spark.createDataFrame([("en", "a b a"), ("de", "a")], "lang string, text string")
    got = {(r["lang"], r["word"]): (r["n"], r["clash"]) for r in phrases.count_words(rows.select("text", "lang"), 0).collect()}
    assert got == {("en", "a"): (2, False), ("en", "b"): (1, False), ("de", "a"): (1, False)}
    text = phrases.Text(np.frombuffer(b"a b", np.uint8), np.array([0, 3]), pa.array(["en"]).dictionary_encode(), 1)
    assert len(set(text.hash.tolist())) == 2
