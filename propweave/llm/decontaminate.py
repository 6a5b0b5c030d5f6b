"""Benchmark decontamination by latent semantic retrieval.

Every run of 32 words, in steps of 16, is a passage. Its TF-IDF vector over the content
words of the benchmark is projected on the leading right singular vectors of the passage
matrix, scaled by the singular values. Those come from a randomised SVD: A' A is a sum
over passages, so each task adds up the pairs of words of its own, the parts are summed by
pair, and the products (A' A) Q are taken from the sums. The items are rows of the matrix too, weighing as much as all passages together, or
the few directions kept would be those of the corpus's commonest words. A passage near
a benchmark item is a candidate; around it, the longest common subsequence with the item's
content words and the presence of the answer (the last quarter of the item) decide.

The benchmark may grow. Its items are sparse rows, summed by tasks like the passages; where
the vocabulary is large, the sums are taken some columns at a time. The driver holds the
items' word numbers and latent vectors and the vocabulary's singular vectors; the tasks get
the vocabulary and BLOCK_ITEMS items at a time, and each block is searched in all documents.
Document counts, the SVD and the search cover all passages of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from propweave.llm.bytetext import Words, pieces
from propweave.llm.tables import fresh, tree_sum
from propweave.sources.scratch import materialise

STEP = 16  # words; a passage is two steps
RANK, OVERSAMPLE, POWER = 128, 16, 2
#: A word of more than this share of the distinct items, and of more than so many, is no content word. An item with
#: fewer content words than LEAST_WORDS is known by all its words, of which the last number is the least share in order.
STOP_SHARE, STOP_LEAST, LEAST_WORDS, STRICT = 0.1, 10, 5, 0.9
#: Least cosine of a candidate, least shares of an item's content words and of its answer's, in order.
COSINE, LCS, ANSWER = 0.65, 0.6, 0.5
ANSWER_PART = 0.25
#: Items searched in one pass over the documents, items multiplied with passages at once, numbers a task sums up at once,
#: those of them that are sums of word pairs, other pairs that a task holds before it passes them on, sums that leave it at once.
BLOCK_ITEMS, BLOCK_COSINES, SUM_NUMBERS, PAIR_NUMBERS, HELD_PAIRS, TAKEN = 1 << 16, 1024, 1 << 24, 1 << 21, 1 << 18, 1 << 17



def matches_type(item: T.DataType) -> T.ArrayType:
    share = [T.StructField(n, T.DoubleType()) for n in ("cosine", "lcs", "answer")]
    return T.ArrayType(T.StructType([T.StructField("item_id", item), *share]))



@dataclass
class Index:
    ids: np.ndarray            # item ids
    words: np.ndarray          # sorted hashes of the content words
    items: list[np.ndarray]    # content words of each item, in order
    spread: np.ndarray         # number of words of each item
    strict: np.ndarray         # whether an item is known by all its words
    kind: T.DataType = field(default_factory=T.LongType)  # type of the ids
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    project: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # word -> latent, IDF applied
    latent: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))   # unit vectors of the items

    def blocks(self, most: int) -> list[Index]:
        """The same index with at most ``most`` of the items each."""
        return [replace(self, ids=self.ids[a : a + most], items=self.items[a : a + most], spread=self.spread[a : a + most],
                        strict=self.strict[a : a + most], latent=self.latent[a : a + most]) for a in range(0, max(len(self.items), 1), most)]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())})
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, int)]
    for _, data, at in pieces(batch):
        w = Words(data, at)
        hashes.append(w.hashes())
        counts.append(w.counts())
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(int)


def vocabulary(items: list[tuple[int, str]]) -> Index:
    """Content words of the benchmark, and each item as a sequence of them."""
    texts: dict[str, int] = {}
    which_text = np.array([texts.setdefault(t or "", len(texts)) for _, t in items], np.int64)
    h, at = words_of([t or "" for _, t in items])
    of = np.repeat(np.arange(len(items)), np.diff(at))
    words, which = np.unique(h, return_inverse=True)
    # copies of an item under other ids are one text: they make no word common
    n = np.bincount(np.unique(which * max(len(texts), 1) + which_text[of]) // max(len(texts), 1), minlength=len(words))
    content = n <= max(STOP_LEAST, STOP_SHARE * len(texts))
    all_, own = np.diff(at), np.bincount(of, content[which], minlength=len(items))
    strict = own < np.minimum(LEAST_WORDS, all_)
    used = content[which] | strict[of]
    words = words[np.unique(which[used])]
    pos, _ = lookup(words, h)
    pos = pos.astype(np.int32)
    seqs = [pos[at[i] : at[i + 1]][used[at[i] : at[i + 1]]] for i in range(len(items))]
    ids = np.empty(len(items), object)
    ids[:] = [i for i, _ in items]
    return Index(ids, words, seqs, all_, strict)


def lookup(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(words):
        return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
    low = np.uint64(0xFFFF)
    table = np.zeros(1 << 16, bool)
    table[words & low] = True
    likely = np.flatnonzero(table[hashes & low])  # most words are none of these; a bit tells
    near = np.searchsorted(words, hashes[likely])
    near[near == len(words)] = 0
    hit = words[near] == hashes[likely]
    at, found = np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
    at[likely[hit]], found[likely[hit]] = near[hit], True
    return at, found


def steps_of(index: Index, data: np.ndarray, text_at: np.ndarray):
    """Content words of the texts: number, place among the text's words, first of each text, and their step.

    Steps are numbered through all texts; ``step_at`` is the first of each text.
    """
    w = Words(data, text_at)
    at, hit = lookup(index.words, w.hashes())
    found = np.flatnonzero(hit)
    word_at = np.searchsorted(found, w.word_at)
    counts = w.counts()
    text = np.repeat(np.arange(len(w)), np.diff(word_at))
    place = found - w.word_at[text]
    step_at = np.concatenate([[0], np.cumsum(-(-counts // STEP))])
    return at[found], place, word_at, step_at[text] + place // STEP, step_at


def passage_sums(ids: np.ndarray, step: np.ndarray, step_at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the rows' vectors over each passage: a step and the next one of the same text."""
    sums = np.zeros((step_at[-1], rows.shape[1]), rows.dtype)
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
        nth = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        for j in range(STEP):  # the j-th content word of every step at once
            at = np.flatnonzero(nth == j)
            if not len(at):
                break
            sums[step[at]] += rows[ids[at]]
    out = sums.copy()
    if len(sums) > 1:
        nxt = np.ones(len(sums) - 1, bool)
        nxt[step_at[1:-1][(step_at[1:-1] > 0) & (step_at[1:-1] < len(sums))] - 1] = False
        out[:-1][nxt] += sums[1:][nxt]
    return out


def passage_pairs(ids: np.ndarray, step: np.ndarray, step_at: np.ndarray, square: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(smaller number, larger number, weight) of all two content words of a passage, weighing 1 / squared length of the passage.

    Two words of one step meet in two passages, two of neighbouring steps in one; unlike ones are
    told once, for both orders.
    """
    # length by the words' squares: repeats inside a passage are rare
    alone = 1 / np.maximum(passage_sums(ids, step, step_at, square[:, None])[:, 0], 1e-6)
    begins = np.zeros(len(alone) + 1, bool)
    begins[step_at] = True
    both = alone.copy()
    both[1:][~begins[1:-1]] += alone[:-1][~begins[1:-1]]
    at, lag = np.arange(len(ids)), 0
    while len(at):
        a, b = step[at], step[at + lag]
        i, j = ids[at], ids[at + lag]
        weight = np.where(a == b, both[a], alone[a])
        yield np.minimum(i, j), np.maximum(i, j), np.where(i == j, 2 * weight, weight) if lag else weight
        lag += 1
        at = at[at + lag < len(ids)]
        a, b = step[at], step[at + lag]
        at = at[(a == b) | ((b == a + 1) & ~begins[b])]


class PairSums:
    """Sums by pair of ``n`` words: those of the commonest words in a table, others passed on before they are too many.

    ``common`` has the words' numbers, the commonest first. The table has PAIR_NUMBERS places at most, whatever ``n``,
    and takes most of what is added. A pair leaves as the smaller number times ``n`` plus the larger.
    """

    def __init__(self, n: int, common: np.ndarray | None = None):
        self.n = n
        self.common = np.arange(n) if common is None else common
        self.rank = np.empty(n, np.int64)
        self.rank[self.common] = np.arange(n)
        most = min(PAIR_NUMBERS, SUM_NUMBERS)
        self.top = min(n, int((np.sqrt(8 * most + 1) - 1) // 2))
        small = np.arange(self.top + 1)
        self.rows = small * self.top - small * (small - 1) // 2  # the table holds the upper triangle
        self.table = np.zeros(self.rows[-1])
        self.held, self.size = [], 0

    def add(self, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        near = b < self.top
        np.add.at(self.table, self.rows[a[near]] + b[near] - a[near], weight[near])
        far = ~near
        if far.any():
            self.held.append((i[far] * self.n + j[far], weight[far]))
            self.size += len(self.held[-1][0])
            if self.size >= HELD_PAIRS:
                yield from self._passed_on()

    def _passed_on(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.held:
            return
        pair, which = np.unique(np.concatenate([p for p, _ in self.held]), return_inverse=True)
        total = np.bincount(which, np.concatenate([w for _, w in self.held]))
        self.held, self.size = [], 0
        for at in range(0, len(pair), TAKEN):
            yield pair[at : at + TAKEN], total[at : at + TAKEN]

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from self._passed_on()
        for at in range(0, len(self.table), TAKEN):  # a part at a time: what goes with a number takes several times its own place
            part = self.table[at : at + TAKEN]
            cell = np.flatnonzero(part)
            if len(cell):
                a = np.searchsorted(self.rows, cell + at, side="right") - 1
                i, j = self.common[a], self.common[cell + at - self.rows[a] + a]
                yield np.minimum(i, j) * self.n + np.maximum(i, j), part[cell]


def word_pairs(docs: DataFrame, index: Index) -> DataFrame:
    """(pair, weight): the sums of ``passage_pairs`` over all passages of the column ``text``."""
    n, square = len(index.words), index.idf.astype(float) ** 2

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums(n, np.argsort(index.idf, kind="stable"))

        def rows(found):
            for pair, weight in found:
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(weight)], names=["pair", "weight"])

        for b in batches:
            for _, data, at in pieces(b):
                ids, _, _, step, step_at = steps_of(index, data, at)
                for met in passage_pairs(ids, step, step_at, square):
                    yield from rows(sums.add(*met))
        yield from rows(sums.take())

    # a task's sums are as many however much it reads: no more tasks than can run at once
    texts = docs.select("text").coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    return texts.mapInArrow(apply, "pair bigint, weight double").groupBy("pair").agg(F.sum("weight").alias("weight"))


def pair_products(out: np.ndarray, pair: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Adds the symmetric matrix of the pairs' weights times ``rows``."""
    i, j = pair // len(rows), pair % len(rows)
    other = i != j
    for to, of, w in ((i, j, weight), (j[other], i[other], weight[other])):
        order = np.argsort(to, kind="stable")
        to = to[order]
        if len(to):
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            out[to[first]] += np.add.reduceat(w[order][:, None] * rows[of[order]], first)
    return out


def item_rows(idf: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, weight) of items given by their content words: TF-IDF, each row of length 1."""
    n = len(idf)
    pair, times = np.unique(np.repeat(np.arange(len(at) - 1), np.diff(at)) * n + ids, return_counts=True)
    row, word = pair // n, pair % n
    weight = times * idf[word].astype(float)
    return row, word, weight / np.maximum(np.sqrt(np.bincount(row, weight**2, minlength=len(at) - 1)), 1e-12)[row]


def _row_sums(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their key, which is in order."""
    out = np.zeros((n, values.shape[1]))
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out[key[first]] = np.add.reduceat(values, first)
    return out


def item_products(idf: np.ndarray, ids: np.ndarray, at: np.ndarray, q: np.ndarray, back: bool) -> np.ndarray:
    """B q of the items' rows B, or B' (B q); a few columns at a time."""
    row, word, weight = item_rows(idf, ids, at)
    order = np.argsort(word, kind="stable")
    out = np.zeros((len(idf) if back else len(at) - 1, q.shape[1]))
    for c in range(0, q.shape[1], 16):
        y = _row_sums(row, weight[:, None] * q[word, c : c + 16], len(at) - 1)
        out[:, c : c + 16] = _row_sums(word[order], (weight[:, None] * y[row])[order], len(idf)) if back else y
    return out


def _pairs(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    pair, weight = b.column("pair").to_numpy(), b.column("weight").to_numpy()
    return ((pair[i : i + 2048], weight[i : i + 2048]) for i in range(0, len(pair), 2048))


def fit(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Index:
    """Vocabulary, IDF over all passages, singular vectors and item vectors.

    Null and empty items match nothing; ids may be of any type, and null ids are no items.
    """
    bench = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).alias("id"), F.coalesce(text, F.lit("")).alias("text")).distinct()
    bench = materialise(bench, "items")
    index = vocabulary(sorted((r["id"], r["text"]) for r in bench.collect()))
    index.kind = bench.schema["id"].dataType
    n = len(index.words)
    body = docs.select(F.col(text).alias("text"))
    if not n:
        return index

    bare = replace(index, items=[], ids=index.ids[:0], spread=index.spread[:0], strict=index.strict[:0])  # what the tasks need for the sums

    def counted(total, data, at):
        ids, _, _, step, step_at = steps_of(bare, data, at)
        pair = np.unique(step * n + ids)
        total += np.append(np.bincount(pair % n, minlength=n), step_at[-1])

    df = tree_sum(body, counted, (n + 1,))
    passages = max(df[n], 1.0)
    bare.idf = index.idf = np.log((passages + 1) / (df[:n] + 1)).astype(np.float32)
    at_once = docs.sparkSession.sparkContext.defaultParallelism  # each task returns a matrix
    met = materialise(word_pairs(body, bare), "svd-pairs").coalesce(at_once)
    width = min(RANK + OVERSAMPLE, n)
    weight = max(1.0, passages / max(len(index.items), 1))  # items weigh like the passages together

    def gram(q: np.ndarray) -> np.ndarray:
        some = max(1, SUM_NUMBERS // n)
        return np.concatenate([columns(q[:, c : c + some]) for c in range(0, q.shape[1], some)], axis=1)

    def columns(q: np.ndarray) -> np.ndarray:
        """A' (A q) over all passages, each scaled to length 1, and the items."""
        scaled = bare.idf[:, None] * q

        def part(total, pair, weight):
            pair_products(total, pair, weight, scaled)

        def of_items(total, data, at):
            ids, _, word_at, _, _ = steps_of(bare, data, at)
            total += item_products(bare.idf, ids, word_at, q, True)

        shape = (n, q.shape[1])
        return bare.idf[:, None] * tree_sum(met, part, shape, _pairs) + weight * tree_sum(bench.select("text"), of_items, shape)

    q = np.linalg.qr(np.random.default_rng(2).standard_normal((n, width)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(gram(q))[0]
    small = q.T @ gram(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:RANK]
    order = order[values[order] > 1e-9 * values.max()]
    basis = q @ vectors[:, order] / np.sqrt(values[order])
    index.project = np.ascontiguousarray((index.idf[:, None] * basis).astype(np.float32))
    index.latent = np.zeros((len(index.items), basis.shape[1]), np.float32)
    for i in range(0, len(index.items), BLOCK_COSINES):
        some = index.items[i : i + BLOCK_COSINES]
        y = item_products(index.idf, np.concatenate(some), np.concatenate([[0], np.cumsum([len(x) for x in some])]), basis, False)
        index.latent[i : i + len(some)] = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return index


def lcs_length(masks: dict[int, int], size: int, seq) -> int:
    """Longest common subsequence by bit-parallel rows; ``masks`` has a bit for each place of a word."""
    row = full = (1 << size) - 1
    for c in seq:
        u = row & masks.get(c, 0)
        if u:
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def _masks(seq) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(seq):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Searcher:
    def __init__(self, index: Index):
        self.index = index
        self.masks = lru_cache(1 << 13)(self._item_masks)

    def _item_masks(self, i: int) -> tuple[dict[int, int], int, dict[int, int]]:
        """Masks of an item's words, and the number and masks of its answer's."""
        seq = self.index.items[i].tolist()
        tail = seq[len(seq) - max(1, round(ANSWER_PART * len(seq))):]
        return _masks(seq), len(tail), _masks(tail)

    def matches(self, data: np.ndarray, text_at: np.ndarray) -> list[list[dict]]:
        """Verified matches of each text, ordered by item."""
        x = self.index
        out: list[list[dict]] = [[] for _ in range(len(text_at) - 1)]
        if not len(x.words) or not len(data):
            return out
        ids, place, word_at, step, step_at = steps_of(x, data, text_at)
        if not len(ids):
            return out
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        sums = passage_sums(ids, step, step_at, x.project)
        sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        for a, b in product(range(0, len(sums), 16384), range(0, len(x.latent), BLOCK_COSINES)):
            cos = sums[a : a + 16384] @ x.latent[b : b + BLOCK_COSINES].T
            for p, c in zip(*np.nonzero(cos >= COSINE)):
                i = b + c
                t = int(np.searchsorted(step_at, a + p, side="right")) - 1
                if best.get((t, int(i)), (0.0,))[0] == 1.0:
                    continue
                found = self._verify(int(i), ids, place, word_at[t], word_at[t + 1], int(a + p - step_at[t]))
                if found and found > best.get((t, int(i)), (0.0, 0.0, 0.0))[:2]:
                    best[t, int(i)] = (*found, float(cos[p, c]))
        for (t, i), (lcs, answer, cosine) in sorted(best.items()):
            out[t].append({"item_id": x.ids[i], "cosine": cosine, "lcs": lcs, "answer": answer})
        return out

    def _verify(self, i: int, ids, place, first: int, end: int, step: int) -> tuple[float, float] | None:
        size, reach = len(self.index.items[i]), int(self.index.spread[i])
        if not size:
            return None
        masks, tail, tail_masks = self.masks(i)
        own = place[first:end]
        lo, hi = np.searchsorted(own, [step * STEP - reach, step * STEP + 2 * STEP + reach])
        near = ids[first + lo : first + hi].tolist()
        lcs = lcs_length(masks, size, near) / size
        if lcs < (1.0 if size < LEAST_WORDS else STRICT if self.index.strict[i] else LCS):
            return None
        answer = lcs_length(tail_masks, tail, near) / tail
        return (lcs, answer) if answer >= ANSWER else None


def search(docs: DataFrame, index: Index, text: str = "text", name: str = "matches") -> DataFrame:
    """The documents with ``matches``: the benchmark items each contains, by item, with cosine, LCS and answer shares.

    Each row is searched by itself, over its whole text; a null or empty text has no match.
    Repeated rows get equal results, an empty table an empty result; further columns are kept,
    whatever their names; one called ``name`` is replaced. More than BLOCK_ITEMS items are searched block by block; the rows are then numbered in a copy.
    """
    kept, blocks = docs.drop(name), index.blocks(BLOCK_ITEMS)
    if len(blocks) == 1:
        return _searched(kept, index, text, name)
    row, hit = fresh(kept, "searched", "hits")
    rows = materialise(kept.withColumn(row, F.monotonically_increasing_id()), "searched")
    hits = [materialise(_searched(rows.select(row, text), block, text, hit).filter(F.size(hit) > 0).select(row, hit), "hits") for block in blocks]
    found = reduce(DataFrame.unionByName, hits).groupBy(row).agg(F.array_sort(F.flatten(F.collect_list(hit))).alias(hit))
    return rows.join(found, row, "left").select(*kept.columns, F.coalesce(hit, F.array().cast(matches_type(index.kind))).alias(name))


def _searched(kept: DataFrame, index: Index, text: str, name: str) -> DataFrame:
    schema = T.StructType([*kept.schema, T.StructField(name, matches_type(index.kind))])
    columns, kind = kept.columns, to_arrow_type(matches_type(index.kind))
    shared = kept.sparkSession.sparkContext.broadcast(index)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value)
        for b in batches:
            for part, data, at in pieces(b, text):
                found = pa.array(searcher.matches(data, at), kind)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), found], names=[*columns, name])

    return kept.mapInArrow(apply, schema)
