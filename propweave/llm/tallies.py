"""Counts and sets of symbol runs in bounded memory, inside tasks and across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from propweave.llm.bytetext import mix

#: Occurrences sorted at once in a task, distinct ones held, and distinct words held before they are handed on.
BATCH, HELD, HELD_WORDS = 1 << 20, 1 << 20, 1 << 18


def _rolled(columns: list[np.ndarray]) -> np.ndarray:
    """One number for the words of a phrase."""
    out = columns[0]
    for c in columns[1:]:
        out = mix((out << np.uint64(21) | out >> np.uint64(43)) ^ c)
    return out


def _place(columns: list[np.ndarray], bits: int) -> np.ndarray:
    return (mix(_rolled(columns)) >> np.uint64(64 - bits)).astype(np.int64)


class Bits:
    """A set of phrases as bits; may hold phrases by chance that were never put in."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    def __call__(self, *columns: np.ndarray) -> np.ndarray:
        p = _place(list(columns), self.bits)
        return (self.table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def bit_tables(sets: list[tuple[DataFrame, list[str]]], bits: int) -> list[Bits]:
    """The phrases of each table's columns as bits, all in one job: set in the tasks, joined by OR; the driver receives
    2**bits / 64 rows for each at most."""
    def filled(number: int, width: int):
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = _place([b.column(i).to_numpy().view(np.uint64) for i in range(width)], bits)
                p.sort()
                first = np.flatnonzero(np.concatenate([[True], p[1:] >> 6 != p[:-1] >> 6])) if len(p) else np.zeros(0, int)
                word = np.bitwise_or.reduceat(np.uint64(1) << (p & 63).astype(np.uint64), first) if len(p) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), number, np.int32)), pa.array(p[first] >> 6),
                                                  pa.array(word.view(np.int64))], names=["number", "slot", "word"])
        return apply

    rows = None
    for i, (phrases, columns) in enumerate(sets):
        own = phrases.select(*columns).mapInArrow(filled(i, len(columns)), "number int, slot bigint, word bigint")
        rows = own if rows is None else rows.unionByName(own)
    got = rows.groupBy("number", "slot").agg(F.bit_or("word").alias("word")).toArrow()
    number, slot, word = (got[c].to_numpy() for c in ("number", "slot", "word"))
    out = []
    for i in range(len(sets)):
        table = np.zeros(1 << max(bits - 6, 0), np.uint64)
        table[slot[number == i]] = word[number == i].view(np.uint64)
        out.append(Bits(table.view(np.uint8), bits))
    return out


def bit_table(phrases: DataFrame, columns: list[str], bits: int) -> Bits:
    return bit_tables([(phrases, columns)], bits)[0]


class Partial:
    """Counts of phrases in bounded memory: sorted and merged now and then, handed on when many."""

    def __init__(self, size: int):
        self.size, self.pending, self.waiting = size, [], 0
        self.held = [np.zeros(0, np.uint64)] * size, np.zeros(0, np.int64)

    def add(self, columns: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        self.pending.append(columns)
        self.waiting += len(columns[0])
        if self.waiting >= BATCH:
            self._merge()
            if len(self.held[1]) >= HELD:
                yield from self.take()

    def _merge(self) -> None:
        columns = [np.concatenate([self.held[0][k], *(p[k] for p in self.pending)]) for k in range(self.size)]
        n = np.concatenate([self.held[1], np.ones(self.waiting, np.int64)])
        self.pending, self.waiting = [], 0
        order = np.argsort(_rolled(columns))
        columns, n = [c[order] for c in columns], n[order]
        if len(n):  # phrases of one sort key lie apart where they differ in a word, so none are thrown together
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
            first = np.flatnonzero(new)
            columns, n = [c[first] for c in columns], np.add.reduceat(n, first)
        self.held = columns, n

    def take(self) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        self._merge()
        if len(self.held[1]):
            yield self.held
        self.held = [np.zeros(0, np.uint64)] * self.size, np.zeros(0, np.int64)


class NamedCounts:
    """Counts of words by hash, each with its spelling where it was first met, in bounded memory."""

    def __init__(self, most: int = HELD_WORDS):
        self.most, self.told = most, set()
        self.names: list[tuple[np.ndarray, pa.Array, pa.Array | None]] = []
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray, tag=None) -> Iterator[tuple]:
        """(hashes, counts, spellings, tags) now and then; ``tag`` gives an array for places among the words."""
        own, at, n = np.unique(hashes, return_index=True, return_counts=True)
        told = self.told
        new = np.array([k for k, h in enumerate(own.tolist()) if h not in told], dtype=np.int64)
        if len(new):
            told.update(own[new].tolist())
            self.names.append((own[new], spellings(start[at[new]], end[at[new]], data), tag(at[new]) if tag else None))
        self.pending.append((own, n))
        self.waiting += len(own)
        if self.waiting >= BATCH:
            self._merge()
        if len(told) >= self.most:
            yield from self.take()

    def _merge(self) -> None:
        keys, n = (np.concatenate([p[k] for p in self.pending]) for k in (0, 1))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.pending = [(keys[first], np.add.reduceat(n, first) if len(first) else n)]
        self.waiting = len(first)

    def take(self) -> Iterator[tuple]:
        if self.names:
            self._merge()
            keys, n = self.pending[0]
            order = np.argsort(np.concatenate([k for k, _, _ in self.names]))  # every key has one name
            words = pa.concat_arrays([w for _, w, _ in self.names]).take(pa.array(order))
            tags = None if self.names[0][2] is None else pa.concat_arrays([t for _, _, t in self.names]).take(pa.array(order))
            yield keys, n, words, tags
        self.pending, self.names, self.waiting = [], [], 0
        self.told.clear()


def spellings(start: np.ndarray, end: np.ndarray, data: np.ndarray) -> pa.Array:
    """The byte ranges of UTF-8 text as strings."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    raw = data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.string())
