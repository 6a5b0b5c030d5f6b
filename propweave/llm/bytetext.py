"""Texts as byte arrays: words, hashes and sums over whole Arrow batches without a loop over words.

Words are runs of bytes other than space and tab to carriage return, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer text is a piece of its own.
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words from a seed."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_BYTE = _splitmix(256, 11)
_STEP = _splitmix(16, 29) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(1, dtype=np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if n <= 2 * PIECE:
            _POWERS[base] = have
    return have


class Words:
    """The words of consecutive texts.

    ``data``: lower-cased bytes of all texts; ``text_at``: where each text starts, and the end;
    ``start``, ``end``: byte range of each word; ``word_at``: first word of each text, and the end.
    ``between`` tells for each byte whether it stands between words.
    """

    def __init__(self, data: np.ndarray, text_at: np.ndarray, between: np.ndarray = SPACE):
        self.data, self.text_at = LOWER[data], text_at
        inside = ~between[data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = text_at[1:] > text_at[:-1]
        before[text_at[:-1][full]] = False
        after[text_at[1:][full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.word_at = np.searchsorted(self.start, text_at)

    def __len__(self) -> int:
        return len(self.text_at) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: a polynomial over scrambled bytes, scrambled again."""
        return self._range(self.start, self.end)

    def _range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * _powers(_BASE, len(self.data) + 1)[: len(self.data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * _powers(_BACK, len(self.data) + 1)[start])

    def prefix_hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first n bytes of the words that are longer, and which words those are."""
        long = np.flatnonzero(self.end - self.start > n)
        return self._range(self.start[long], self.start[long] + n), long


def shingles(words: np.ndarray, word_at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words inside a text, and where each text's runs start.

    A text of fewer words has one run of all its words; a text without words has none.
    """
    count = np.diff(word_at)
    total = len(words)
    padded = np.concatenate([words, np.zeros(n, dtype=np.uint64)])
    out = np.zeros(total, dtype=np.uint64)
    for j in range(n):
        out += padded[j : total + j] * _STEP[j]
    keep = np.ones(total, dtype=bool)
    for j in range(1, n):  # runs that would reach into the next text
        last = word_at[1:] - j
        keep[last[last >= word_at[:-1]]] = False
    short = np.flatnonzero((count > 0) & (count < n))
    for t in short:
        first = word_at[t]
        keep[first] = True
        out[first] = (words[first : word_at[t + 1]] * _STEP[: count[t]]).sum(dtype=np.uint64)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    return mix(out[keep]), np.concatenate([[0], np.cumsum(runs)])


def sums_by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; ``at`` holds the first value of each text, and the end."""
    out = np.zeros(len(at) - 1, dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, at[:-1][full])
    return out


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, text_at) for runs of rows with about PIECE bytes of text; null counts as empty."""
    col = batch.column(column)
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    at = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
