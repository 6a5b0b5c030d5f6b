"""Near words beside all pairs, and the blocks that bring them together."""

import random
import zlib

import numpy as np
import pytest

from propweave.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    out = {}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-words[x], x))
            out[w] = (len(near), words[best], best)
    return out


def vocabulary(seed, n, letters="abé", lengths=(5, 9)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(n)}
    return {w: rng.randint(3, 9) for w in words}


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n bigint")


@pytest.mark.parametrize("most", [1, 4, 30, 5000])
def test_equals_all_pairs(spark, most):
    """Small blocks are cut to the last letter; large ones hold whole length classes."""
    words = vocabulary(most, 500)
    words |= {"common" * 3 + w: n for w, n in vocabulary(1, 60).items()} | {w + "ending" * 3: n for w, n in vocabulary(2, 60).items()}
    got = {r["word"]: (r["n_near"], r["near_n"], r["near"]) for r in variants.near_words(table(spark, words), most).collect()}
    assert got == brute(words)


def test_every_pair_shares_one_block(spark):
    words = vocabulary(3, 150)
    rows = [tuple(r) for r in variants.blocks(table(spark, words), 5).select("word", "m", "p", "s", "b").collect()]
    where = {}
    for w, m, p, s, b in rows:
        where.setdefault((m, p, s, b, w[:p], w[len(w) - s :]), []).append(w)
    assert max(len(v) for k, v in where.items() if k[0] - k[1] - k[2] > 1) <= 5
    for a in words:
        for c in words:
            if a < c and one_edit(a, c):
                split = next((i for i, (x, y) in enumerate(zip(a, c)) if x != y), min(len(a), len(c)))
                m = min(len(a), len(c))
                shared = [k for k, v in where.items() if a in v and c in v and k[0] == m and k[1] <= split < k[3]]
                assert len(shared) == 1


def test_long_words_and_edits_at_the_ends(spark):
    base = "x" * 3000 + "y" * 3000
    words = {base: 9, base + "z": 3, "z" + base: 4, base[1:]: 3, base[:3000] + "z" + base[3001:]: 5, "z" * 6000: 3, "zz" + base: 3}
    got = {r["word"]: (r["n_near"], r["near_n"], r["near"]) for r in variants.near_words(table(spark, words)).collect()}
    assert got == brute(words)


def test_ranges_out_of_reach_are_skipped():
    """A word of another beginning by more than one letter is never looked at beyond it."""
    words = sorted(f"{a}{b}" for a in ("aaa", "bbb", "ccc") for b in ("ddddd", "ddddf", "ddffd"))
    raw = [w.encode() for w in words]
    s = variants.Sorted(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.zeros(9, np.int64))
    seen, real = [], s._next
    s._next = lambda row, letter, q, depth: seen.append((depth, len(q))) or real(row, letter, q, depth)
    m, p, b = np.full(9, 8), np.zeros(9, np.int64), np.full(9, 9)
    pairs = {(int(x), int(y)) for q, o in s.pairs(m, p, b, np.arange(9)) for x, y in zip(q, o)}
    assert pairs == {(i, j) for i in range(9) for j in range(9) if one_edit(words[i], words[j])}
    ranges = dict(seen)
    assert ranges[0] == 27 and ranges[3] == 9  # three beginnings for each word, then its own only


def test_damage_and_counts(spark):
    rows = [(d, "Alpha beta Alpha ÉCOLE naïve x" * (d % 3 + 1) + " alphabet×word") for d in range(300)] + [(None, "alpha"), (5, None), (6, "")]
    want = {}
    for d, text in rows:
        key = "" if d is None else str(d)
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{key}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
                want[word] = want.get(word, 0) + 1
                run = ""
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["word"]: r["n"] for r in variants.vocabulary(docs).collect()} == want


def test_chains_end_at_the_root(spark):
    words = {"aaaaaaaaaa"[:k] + "bbbbbbbbbb"[k:]: 3 * 2**k for k in range(11)} | {"zzzzz": 5}
    docs = spark.createDataFrame([(w,) for w, n in words.items() for _ in range(n)], "text string").selectExpr("text", "'k' as doc_id", "1 as word", "2 as n")
    got = {r["word"]: r for r in variants.variants(docs, least=1).collect()}
    intact = [w for w in words if zlib.crc32(f"k:{w}".encode()) % 97]
    assert len(intact) == len(words)
    assert got["bbbbbbbbbb"]["root"] == "aaaaaaaaaa" and got["bbbbbbbbbb"]["form"] == "abbbbbbbbb" and got["zzzzz"]["root"] == "zzzzz"
    assert got["aaaaaaaaaa"]["form"] is None and got["aaaaaaaaaa"]["n_near"] == 1 and got["zzzzz"]["n_near"] == 0


def test_empty_table(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
