"""The trie encoder beside the tokenizers library."""

import random
import time

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from propweave.llm import bpe, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, "rb") as f:
        return bpe.vocabulary(f.read())


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_odd_strings_equal_the_library(vocab, library):
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "'s", "é", "日", "😀", "\x1c", "<|endoftext|>", "<|endof", "՘", "1", "٣", "the", "--", "===", "　"]
    points = [*range(1, 0x500), *range(0x500, 0xD800, 97), *range(0xE000, 0x110000, 1999)]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.7 else chr(rng.choice(points)) for _ in range(rng.randrange(14))) for _ in range(5000)]
    tokens = list(vocab.token.values())
    texts += [b"".join(rng.choice(tokens) for _ in range(3)).decode("utf-8", "ignore") for _ in range(5000)]
    texts += ["a" * 30000, "ab" * 5000 + "c" * 777, " " * 5000, "-" * 3333 + "=" * 999, "", "<|endoftext|><|endoftext|>"]
    got = bpe.Encoder(vocab).run(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [g for g, w in zip(got, want) if g != packed(w.ids)] == []


def test_prefixes_are_worked_out_once(vocab, monkeypatch):
    asked = []
    monkeypatch.setattr(vocab, "fits", lambda a, b: asked.append((a, b)) or not vocab._joined(a, b))
    word = b"internationalisation"
    alone = list(vocab.encode_sorted([word]))
    once, asked[:] = len(asked), []
    shared = list(vocab.encode_sorted([word + bytes([c]) for c in range(97, 123)]))
    assert len(alone) == 1 and len(shared) == 26 and len(asked) < 10 * once


def test_tokens_that_their_bytes_do_not_give(vocab):
    """In a vocabulary of merges ab, bc, abc = a + bc the token abc is never made: ab comes first."""
    import json

    symbols = {b: c for c, b in bpe.byte_symbols().items()}
    tokens = [symbols[b] for b in range(256)] + ["ab", "bc", "abc"]
    raw = json.dumps({"model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": [["a", "b"], ["b", "c"], ["a", "bc"]]},
                      "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "normalizer": None, "added_tokens": []}).encode()
    v = bpe.vocabulary(raw)
    assert b"abc" not in v.proper
    assert list(v.encode_sorted([b"abc", b"bc"])) == [[256, v.id[b"c"]], [257]]


def test_repeated_merges_go_from_the_left(vocab, library):
    texts = ["a" * n for n in range(1, 60)] + ["=" * n for n in range(1, 200)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert bpe.Encoder(vocab).run([text]) == [packed(want.ids)]


def test_columns_nulls_and_empty_tables(spark):
    rows = [(1, "a b", 7), (1, "a b", 7), (2, None, None), (None, "", 3), (3, "x" * 200000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, IDS int")
    got = bpe.encode(docs, PATH)
    assert got.columns == ["doc_id", "text", "ids"]
    by = {(r["doc_id"], r["text"]): r["ids"] for r in got.collect()}
    assert by[2, None] == [] and by[None, ""] == [] and len(by[1, "a b"]) == 2 and got.count() == 5
    back = bpe.decode(got, PATH)
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())
    assert bpe.encode(docs.limit(0), PATH, packed=True).count() == 0
    named = docs.select("doc_id", "text", docs["IDS"].alias("ids_of"))
    assert bpe.encode(named, PATH).columns == ["doc_id", "text", "ids_of", "ids"]


def test_bytes_that_are_no_text(spark, vocab, library):
    ids = [vocab.id[b"\xe9"], vocab.id[b"a"], 50256, 99999999]
    got = bpe.decode(spark.createDataFrame([(1, ids), (2, None)], "k int, ids array<int>"), PATH)
    assert {r["k"]: r["decoded"] for r in got.collect()} == {1: library.decode(ids[:3], skip_special_tokens=False), 2: ""}


def test_query_equals_the_library(spark, library):
    import hashlib

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_byte_pair_trie"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for key, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[key]["n_tokens"] == len(ids) and got[key]["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert got[key]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_long_words_take_time_in_proportion(vocab):
    def seconds(n):
        start = time.time()
        list(vocab.encode_sorted([("ab" * (n // 2)).encode()]))
        return time.time() - start

    seconds(1000)
    assert seconds(400000) < 60 * max(seconds(40000), 0.02)
