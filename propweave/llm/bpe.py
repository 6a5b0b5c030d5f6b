r"""Byte-pair encoding by a trie of distinct words that carries the last token of every prefix.

The merges of a byte-level BPE fix one token sequence for every byte string, and the sequence
of a prefix ends in exactly one token: the one that fits behind the sequence of what stands
before it. So a prefix needs one number, its last token, and the whole encoding is read back
from the end of the word. Distinct words of a run of texts are the leaves of a trie; it is
walked depth first, children in byte order, which visits the words in sorted order. The last
tokens of the path stay on a stack, so a prefix that words share is worked out once.

Whether a token fits behind another is decided by the merges alone: no merge may join a
token on the right edge of the left one with a token on the left edge of the right one before
either is swallowed by a merge inside its own side.

Texts are cut into words by the tokenizer's pattern; strings of special tokens are cut out
first and keep their own ids, as the tokenizer does. Every task works text by text in bounded
runs; nothing is shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

#: Pattern that cuts a text into words, and the ranges of tokens for the 256 bytes: fixed values of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = ((33, 126), (161, 172), (174, 255))
#: Characters of text worked on at once; words and bytes that a task remembers the encodings of; token pairs it remembers.
RUN, KNOWN, KNOWN_BYTES, PAIRS = 1 << 21, 1 << 19, 1 << 25, 1 << 20
NEVER = 1 << 30


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself where printable, else the next from 256 on."""
    own = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranges(chars: list[str]) -> list[tuple[str, str]]:
    """Ascending characters as ranges."""
    out: list[list[str]] = []
    for c in chars:
        if out and ord(out[-1][1]) == ord(c) - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, raw: bytes):
        data = json.loads(raw)
        model, symbols = data["model"], byte_symbols()
        if model["type"] != "BPE" or (data["pre_tokenizer"] or {}).get("type") != "ByteLevel" or data["normalizer"]:
            raise ValueError("not a byte-level BPE without normalizer")
        if data["pre_tokenizer"].get("add_prefix_space") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("prefix spaces, dropout and ignored merges are not supported")
        self.token = {i: bytes(symbols[c] for c in t) for t, i in model["vocab"].items()}
        self.id = {b: i for i, b in self.token.items()}
        self.parts: dict[int, tuple[int, int]] = {}     # token -> the two it is made of
        self.born = {self.id[bytes([b])]: -1 for b in range(256)}  # token -> rank of its merge
        self.rank: dict[tuple[int, int], int] = {}      # pair -> rank of its merge
        for n, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (self.id[bytes(symbols[c] for c in t)] for t in (left, right))
            made = self.id[self.token[a] + self.token[b]]
            self.rank[a, b] = n
            if made not in self.born:
                self.parts[made], self.born[made] = (a, b), n
        self._pairs: dict[tuple[int, int], bool] = {}
        self._right = {t: self._edge(t, 1) for t in self.born}
        self._left = {t: self._edge(t, 0) for t in self.born}
        #: Bytes -> token, of those tokens that their own bytes are encoded as; each is told after the ones it is made of.
        self.proper = {bytes([b]): self.id[bytes([b])] for b in range(256)}
        for made, (a, b) in self.parts.items():
            if self.token[a] in self.proper and self.token[b] in self.proper and self._own(a, b):
                self.proper[self.token[made]] = made
        ends: dict[bytes, set[int]] = {}
        for t in self.proper:
            if len(t) > 2:
                ends.setdefault(t[-3:], set()).add(len(t))
        few = {t: (2, 1) for t in self.proper if len(t) == 2}
        #: Last three bytes of a prefix (all, where it is shorter) -> lengths of the tokens it may end in, longest first.
        self.sizes = {end: (*sorted(sizes, reverse=True), *few.get(end[1:], (1,))) for end, sizes in ends.items()} | few
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in data["added_tokens"]):
            raise ValueError("special tokens that take part of their surroundings are not supported")
        self.text_of = self.token | {i: s.encode() for s, i in self.special.items()}
        import regex

        self.words = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
        late = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
        #: Letters and digits younger than the interpreter's Unicode tables: on them the pattern and the tokenizer may differ.
        self.late = re.compile("[" + "".join(f"{a}-{b}" for a, b in _ranges(late)) + "]" if late else "(?!)")

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens on one edge of a token, and the rank at which a merge on their own side swallows each."""
        out, end = [(token, NEVER)], NEVER
        while token in self.parts:
            token, end = self.parts[token][side], self.born[token]
            out.append((token, end))
        return out

    def _joined(self, left: int, right: int) -> bool:
        """Whether some merge reaches across the border. Of equal merges the left one comes first, so a merge that is
        due at the rank that swallows its left token comes too late, and one due when its right token goes does not."""
        rank, right_edge = self.rank, self._left[right]
        for a, a_end in self._right[left]:
            for b, b_end in right_edge:
                due = rank.get((a, b))
                if due is not None and due < a_end and due <= b_end:
                    return True
        return False

    def _own(self, left: int, right: int) -> bool:
        """Whether nothing comes before the merge of two tokens when they stand alone."""
        made = self.rank[left, right]
        return not any((a, b) != (left, right) and self.rank.get((a, b), NEVER) < min(a_end, made)
                       and self.rank.get((a, b), NEVER) <= min(b_end, made)
                       for a, a_end in self._right[left] for b, b_end in self._left[right])

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = not self._joined(left, right)
        return known

    def encode_sorted(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of sorted distinct words: a walk over their trie, depth first."""
        proper, sizes, fits, pairs, one = self.proper, self.sizes, self.fits, self._pairs, (1,)
        last: list[int] = []    # last token of each prefix on the path
        length = {token: len(b) for b, token in proper.items()}
        before = b""
        for word in words:
            keep, most = 0, min(len(before), len(word))
            while keep < most and before[keep] == word[keep]:
                keep += 1
            del last[keep:]
            for end in range(keep + 1, len(word) + 1):
                tail = word[max(end - 3, 0) : end]
                for size in sizes.get(tail) or sizes.get(tail[1:], one):
                    token = proper.get(word[end - size : end]) if size <= end else None
                    if token is not None:
                        if size == end:
                            break
                        left = last[end - size - 1]
                        fit = pairs.get((left, token))
                        if fits(left, token) if fit is None else fit:
                            break
                last.append(token)
            tokens, end = [], len(word)
            while end:
                tokens.append(last[end - 1])
                end -= length[last[end - 1]]
            yield tokens[::-1]
            before = word

    @staticmethod
    def _plain(text: str) -> bool:
        """Whether all characters are below U+0100; told at the speed of a copy."""
        try:
            return text.isascii() or len(text.encode("latin-1")) >= 0
        except UnicodeEncodeError:
            return False

    def cut(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not self._plain(text) and self.late.search(text):
            from tokenizers.pre_tokenizers import ByteLevel

            return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]
        return self.words.findall(text)

    def pieces(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Words between special tokens, each list with the special token behind it, if any."""
        at = 0
        for m in self.marks.finditer(text):
            yield self.cut(text[at : m.start()]), self.special[m.group()]
            at = m.end()
        yield self.cut(text[at:] if at else text), None


@lru_cache(maxsize=4)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


class Encoder:
    """Texts to tokens; remembers the words of the last runs, within bounds."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known, self.held = vocab, {}, 0

    def run(self, texts: list[str]) -> list[bytes]:
        """Tokens of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > KNOWN or self.held > KNOWN_BYTES:
            self.known, self.held = {}, 0
        known, cut = self.known, [list(self.vocab.pieces(t)) for t in texts]
        new = set().union(*(words for text in cut for words, _ in text)).difference(known)
        ordered = sorted((w.encode(), w) for w in new)
        for (b, w), tokens in zip(ordered, self.vocab.encode_sorted(b for b, _ in ordered)):
            known[w] = np.array(tokens, "<u4").tobytes()
            self.held += len(b) + len(known[w])
        get = known.__getitem__
        return [b"".join(b"".join(map(get, words)) + (mark.to_bytes(4, "little") if mark is not None else b"") for words, mark in text)
                for text in cut]


def runs(column: pa.Array, most: int = RUN) -> Iterator[tuple[int, list]]:
    """(first row, values) of runs of rows with about ``most`` characters or bytes; null counts as empty."""
    values, size, first = [], 0, 0
    for i in range(len(column)):
        v = column[i].as_py()
        v = v if v is not None else b"" if pa.types.is_binary(column.type) else ""
        values.append(v)
        size += len(v) + 64
        if size >= most:
            yield first, values
            values, size, first = [], 0, i + 1
    if values:
        yield first, values


def _rest(df: DataFrame, *made: str) -> list[StructField]:
    taken = {m.lower() for m in made}
    return [f for f in df.schema if f.name.lower() not in taken]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", packed: bool = False, keep_text: bool = True) -> DataFrame:
    """The rows with the token ids of a text column, as array<int> or, ``packed``, as little-endian unsigned 32-bit integers.

    ``path`` names the tokenizer's file, read by the driver; its size bounds what is broadcast.
    A null or empty text has no tokens. Repeated rows get equal ids, an empty table gives an
    empty table, a text of any length is encoded whole. A column named like ``ids`` is replaced.
    """
    with open(path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = _rest(docs, ids, *([] if keep_text else [text]))
    names = [f.name for f in rest]
    whole = docs.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)), F.col(f"`{text}`").cast("string").alias("t"))
    kind = pa.binary() if packed else pa.list_(pa.int32())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(raw.value))
        for b in batches:
            for first, texts in runs(b.column(len(names))):
                got = encoder.run(texts)
                col = pa.array(got, kind) if packed else pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in got], kind)
                rows = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(names))), col], names=[*names, ids])

    return whole.mapInArrow(apply, StructType([*rest, StructField(ids, BinaryType() if packed else ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the text of their ids (either form). Bytes that are no UTF-8 become U+FFFD; null ids are none.

    An id that the vocabulary lacks is skipped. A column named like ``text`` is replaced.
    """
    with open(path, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())
    rest = _rest(encoded, text)
    names = [f.name for f in rest]
    packed = isinstance(encoded.schema[ids].dataType, BinaryType)
    at = names.index(ids)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = vocabulary(raw.value).text_of
        for b in batches:
            for first, values in runs(b.column(at)) if packed else ((i, [b.column(at)[i].as_py() or []]) for i in range(len(b))):
                lists = [np.frombuffer(v, "<u4").tolist() for v in values] if packed else values
                got = [b"".join([text_of.get(i, b"") for i in v]).decode("utf-8", "replace") for v in lists]
                rows = b.slice(first, len(got))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(got, pa.string())], names=[*names, text])

    return encoded.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(apply, StructType([*rest, StructField(text, StringType())]))
