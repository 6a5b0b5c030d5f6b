r"""Spelling variants: frequent words one edit apart, and the form each is a variant of.

Two words one edit apart share a beginning or an end: of the m letters of the shorter one,
at least m - 1 lie in their common prefix and suffix. So each word goes into blocks by its
first half and by its last half, and every pair lies in exactly one block, told by the length
of its common prefix. A block of too many words is cut again the same way, on the letters
between its shared beginning and its shared end; where one letter is left between them, the
alphabet bounds it. No block grows with the vocabulary, however many words begin alike.

A block's words are sorted. Words that begin with the same d letters are neighbours; the
common prefixes (LCPs) of adjacent words tell where such a range ends. The banded edit matrix
of a word against the sorted list has one row a range: the row of d + 1 letters is made from
that of the range it lies in, once for all words in it, and a range whose row holds no value
below two is skipped with all its words. numpy takes the rows of one depth together, for all
words and blocks of a batch.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from propweave.sources.scratch import materialise

#: A run of letters once A-Z are lower case, and one of how many runs loses a letter.
RUN, DAMAGED = re.compile("[a-zÀ-ÿ]+"), 97
#: Letters and occurrences of a word at least; times that a form is more frequent than its variant.
LETTERS, LEAST, FACTOR = 5, 3, 2
#: Words of a block that are compared together; words and matrix rows that a task works on at once; words held while counting.
BLOCK, WORDS, ROWS, HELD = 2048, 1 << 15, 1 << 20, 1 << 16
#: Rows below a block's shared prefix after which a range of one word is compared letter by letter instead.
DEEP = 48


def damaged_runs(doc: str, text: str) -> Iterator[tuple[str, int]]:
    """(run, count) of a text: letters of all sorts, lower-cased in A-Z; the checksum of document and run
    takes a letter out of some, the same one wherever the run stands in the document."""
    start = zlib.crc32(f"{doc}:".encode())
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of at least ``letters`` letters that stand at least ``least`` times."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc, body in zip(b.column(0), b.column(1)):
                for word, n in damaged_runs(doc.as_py(), body.as_py()):
                    if len(word) >= letters:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield rows()
        yield rows()

    texts = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("doc"),
                        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(apply, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _filed(rows: DataFrame) -> DataFrame:
    """Adds the block of each row: letters of the shorter word, and the first p and last s letters that are shared."""
    return rows.withColumn("block", F.expr("xxhash64(m, p, s, b, left(word, p), right(word, s))"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice, for the pairs that agree in the first half of the letters between, and for the others, which agree
    in the second half. ``b`` bounds the common prefix, so that no pair is in both."""
    half = F.expr("(m - p - s) div 2").cast("int")
    first = F.struct((F.col("p") + half).alias("p"), F.col("s"), F.col("b"))
    second = F.struct(F.col("p"), (F.col("m") - F.col("p") - half).alias("s"), F.least(F.col("b"), F.col("p") + half).alias("b"))
    return _filed(rows.select("word", "n", "m", F.inline(F.array(first, second))))


def blocks(words: DataFrame, most: int = BLOCK, letters: int = 1) -> DataFrame:
    """(word, n, m, p, s, b, block): every pair one edit apart shares exactly one block of at most ``most`` words, or of
    one letter between its shared ends. No word is shorter than ``letters``."""
    size = F.length("word").cast("int")
    classes = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    rows = _halves(classes.filter(F.col("m") >= letters).select("word", "n", "m", F.lit(0).alias("p"), F.lit(0).alias("s"), (F.col("m") + 1).alias("b")))
    of, kept = ["block", "m", "p", "s", "b"], None
    while True:
        rows = materialise(rows, "variant-blocks")
        count = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)  # a word alone has no pair
        cut = (F.col("size") > most) & (F.col("m") - F.col("p") - F.col("s") > 1)
        sized = rows.join(count, of)
        seen: dict = {}
        sized = materialise(sized.withColumn("cut", cut), "variant-sized", also={"cuts": F.count(F.when(cut, 1))}, seen=seen)
        leaves = sized.filter(~F.col("cut")).drop("size", "cut")
        kept = leaves if kept is None else kept.unionByName(leaves)
        if not seen["cuts"]:
            return kept
        rows = _halves(sized.filter("cut").drop("block", "size", "cut"))


class Sorted:
    """Sorted words of some blocks, as Latin-1 bytes, with the common prefix of each and the word before it."""

    def __init__(self, letters: np.ndarray, at: np.ndarray, block: np.ndarray):
        self.letters, self.at, self.block = letters, at[:-1], block
        self.size = np.diff(at)
        self.lcp = self._shared(np.arange(len(block) - 1), np.arange(1, len(block)))
        self.lcp = np.concatenate([[-1], np.where(block[1:] == block[:-1], self.lcp, -1)]) if len(block) else self.lcp

    def _shared(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """Letters that words a and b have in common, from the start or from the end."""
        most = np.minimum(self.size[a], self.size[b])
        out, alive, d = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        step = 1
        while len(alive):
            alive = alive[most[alive] > d]
            step = min(step, int((most[alive] - d).min())) if len(alive) else 1
            x, y = a[alive], b[alive]
            if back:
                first, second = self.at[x] + self.size[x] - d - step, self.at[y] + self.size[y] - d - step
            else:
                first, second = self.at[x] + d, self.at[y] + d
            span = np.arange(step)
            same = (self.letters[first[:, None] + span] == self.letters[second[:, None] + span])
            whole = same.all(axis=1)
            part = same[~whole][:, ::-1] if back else same[~whole]
            out[alive[~whole]] = d + part.argmin(axis=1) if len(part) else 0
            d += step
            alive = alive[whole]
            out[alive] = d
            step = min(step * 2, 4096) if len(alive) * step < ROWS else 1
        return out

    def pairs(self, m: np.ndarray, p: np.ndarray, b: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, other) one edit apart, for the given ``words``; m, p, b of each word as in ``blocks``."""
        n = len(self.block)
        first = np.flatnonzero(np.concatenate([[True], self.block[1:] != self.block[:-1]]))
        last = np.append(first[1:], n)
        of = np.searchsorted(first, words, side="right") - 1
        top = np.minimum.reduceat(np.append(np.where(self.lcp < 0, np.iinfo(np.int64).max, self.lcp), 0), first)  # shared by the whole block
        lo, hi, q = first[of], last[of], words
        busy = hi - lo > 1
        lo, hi, q, start = lo[busy], hi[busy], q[busy], top[of[busy]]
        waiting = {}
        for d in np.unique(start).tolist():
            at = start == d
            waiting[d] = (q[at], lo[at], hi[at])
        depth = min(waiting, default=0)
        empty = np.zeros(0, np.int64)
        q, lo, hi, since = empty, empty, empty, empty
        row = np.zeros((3, 0), np.int8)   # edits against the word's first d - 1, d, d + 1 letters; 2 stands for more
        split = np.full(0, -1)            # common prefix with the range, once it has ended
        while waiting or len(q):
            if depth in waiting:
                more = waiting.pop(depth)
                k = len(more[0])
                q, lo, hi = (np.concatenate([x, y]) for x, y in zip((q, lo, hi), more))
                since = np.concatenate([since, np.full(k, depth)])
                row = np.concatenate([row, np.repeat(np.array([[1], [0], [1]], np.int8), k, axis=1)], axis=1)
                split = np.concatenate([split, np.full(k, -1)])
            # the word that ends here is the first of its range
            done = self.size[lo] == depth
            gap = self.size[q] - depth
            hit = np.flatnonzero(done & (np.abs(gap) <= 1))
            hit = hit[row[gap[hit] + 1, hit] == 1]
            yield self._allowed(q[hit], lo[hit], np.where(split[hit] < 0, depth, split[hit]), m, p, b)
            lo = lo + done
            alive = lo < hi
            deep = alive & (hi - lo == 1) & (depth - since >= DEEP)
            if deep.any():
                x, y = q[deep], lo[deep]
                ahead, behind = self._shared(x, y), self._shared(x, y, back=True)
                near = (x != y) & (np.abs(self.size[x] - self.size[y]) <= 1) & (
                    ahead + behind >= np.maximum(self.size[x], self.size[y]) - 1)
                yield self._allowed(x[near], y[near], ahead[near], m, p, b)
                alive &= ~deep
            q, lo, hi, since, row, split = q[alive], lo[alive], hi[alive], since[alive], row[:, alive], split[alive]
            if not len(q):
                depth = min(waiting, default=0)
                continue
            starts = np.append(np.flatnonzero(self.lcp <= depth), n)
            left, right = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
            parts = right - left
            parent = np.repeat(np.arange(len(q)), parts)
            child = left[parent] + np.arange(len(parent)) - (np.cumsum(parts) - parts)[parent]
            lo, hi, q, since = starts[child], np.minimum(starts[child + 1], hi[parent]), q[parent], since[parent]
            row, split = self._next(row[:, parent], self.letters[self.at[lo] + depth], q, depth), np.where(
                (split[parent] < 0) & (self._letter(q, depth) != self.letters[self.at[lo] + depth]), depth, split[parent])
            depth += 1
            # ranges more than one edit away, and those whose pairs belong into another block
            alive = (row.min(axis=0) <= 1) & np.where(split < 0, depth < b[q], (p[q] <= split) & (split < b[q]))
            q, lo, hi, since, row, split = q[alive], lo[alive], hi[alive], since[alive], row[:, alive], split[alive]

    def _letter(self, q: np.ndarray, i: int) -> np.ndarray:
        """Letter i of each word; 0, which is none, outside of it."""
        inside = (self.size[q] > i) & (i >= 0)
        return np.where(inside, self.letters[np.where(inside, self.at[q] + i, 0)], 0)

    def _next(self, row: np.ndarray, letter: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
        out, size = np.empty_like(row), self.size[q]
        for k in range(3):
            here = depth + k  # letters of the word that this place of the new row stands for
            best = row[k] + (self._letter(q, here - 1) != letter) if here else np.full(len(q), 2, np.int8)
            if k < 2:
                best = np.minimum(best, row[k + 1] + 1)
            if k:
                best = np.minimum(best, out[k - 1] + 1)
            out[k] = np.where(here > size, 2, np.minimum(best, 2))
        return out

    def _allowed(self, q, other, split, m, p, b):
        """Pairs of this block: not two of the longer words, and divided where the block says."""
        ok = (p[q] <= split) & (split < b[q]) & ((self.size[q] == m[q]) | (self.size[other] == m[q]))
        return q[ok], other[ok]


NEAR = "word string, n_near bigint, near_n bigint, near string"


def near_in_blocks(rows: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of every word and block: how many words are near, and the most frequent of them."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            for i in range(0, len(b), WORDS):
                held.append(b.slice(i, WORDS))
                count += len(held[-1])
                if count >= WORDS:
                    yield from work(pa.Table.from_batches(held), False, held)
                    count = sum(len(x) for x in held)
        if held:
            yield from work(pa.Table.from_batches(held), True, held)

    def work(table: pa.Table, end: bool, held: list) -> Iterator[pa.RecordBatch]:
        """Whole blocks of the rows; the last, which may go on, is left in ``held``."""
        cols = np.array([table.column(c).to_numpy().astype(np.int64) for c in ("block", "m", "p", "s", "b")])
        new = np.concatenate([[True], np.any(cols[:, 1:] != cols[:, :-1], axis=0)])
        upto = len(new) if end else int(np.flatnonzero(new)[-1])
        held.clear()
        held.extend(table.slice(upto).combine_chunks().to_batches())
        if not upto:
            return
        words = table.column("word").slice(0, upto).to_pylist()
        raw = [w.encode("latin-1") for w in words]
        at = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
        text = Sorted(np.frombuffer(b"".join(raw), np.uint8), at, np.cumsum(new[:upto]))
        n = table.column("n").slice(0, upto).to_numpy()
        _, m, p, _, b = cols[:, :upto]
        step = max(1, ROWS // 512)
        for i in range(0, upto, step):
            got = list(text.pairs(m, p, b, np.arange(i, min(i + step, upto))))
            q, other = (np.concatenate([g[k] for g in got]) for k in (0, 1))
            if not len(q):
                continue
            order = np.lexsort((other, -n[other], q))  # words are sorted inside a block: the smaller index is the smaller word
            q, other = q[order], other[order]
            first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            yield pa.RecordBatch.from_arrays([
                pa.array([words[k] for k in q[first]], pa.string()), pa.array(np.diff(np.append(first, len(q)))),
                pa.array(n[other[first]]), pa.array([words[k] for k in other[first]], pa.string())],
                names=["word", "n_near", "near_n", "near"])

    of = ["block", "m", "p", "s", "b"]
    return rows.repartition(*of).sortWithinPartitions(*of, "word").mapInArrow(apply, NEAR)


def near_words(words: DataFrame, most: int = BLOCK, letters: int = 1) -> DataFrame:
    """(word, n_near, near_n, near): how many words of the (word, n) table are one edit away, and the most frequent of
    them, the smallest in code-point order of equal ones. Words without any are missing."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return near_in_blocks(blocks(words, most, letters)).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms that begins at each word, by doubling the steps."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        seen: dict = {}
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = at.join(onward, "root", "left")
        moved = materialise(moved, "variant-roots", also={"moved": F.count("further")}, seen=seen)
        at = moved.select("word", F.coalesce("further", "root").alias("root"))
        if not seen["moved"]:
            return at


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST,
             factor: int = FACTOR, most: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every frequent word of the documents with the form that it is a variant of.

    ``form`` is the most frequent word one letter away (inserted, deleted or replaced; of equal
    ones the smallest) if it is at least ``factor`` times as frequent; ``root`` the end of the
    chain of forms, the word itself where it has none. A null text is empty, a null key the
    empty text; repeated rows count each; an empty table gives no rows; other columns do not
    matter. Letters are those below U+0100, so a word is one byte a letter in the tasks.
    """
    words = materialise(vocabulary(docs, key, text, letters, least), "variant-words")
    near = near_words(words, most, letters)
    found = words.join(near, "word", "left")
    is_form = F.col("near_n") >= factor * F.col("n")
    found = materialise(found.select("word", F.when(is_form, F.col("near")).alias("form"), "n",
                                     F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                     F.when(is_form, F.col("near_n")).alias("form_n")), "variant-forms")
    ends = roots(found.filter(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
