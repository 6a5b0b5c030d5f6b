"""Quality by compression: a text is good if a dictionary of good texts helps more than one of bad texts.

Two zstandard dictionaries are built from labelled texts: the tasks build one of each group
of texts, then of each group of dictionaries, until there is one. A document is compressed
with each and without any; the normalised difference of the sizes, with the sizes per byte
that tell how much a dictionary could help at all, goes through a logistic calibration, whose
sums are taken in the tasks. Every labelled row is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from propweave.llm.bytetext import pieces
from propweave.llm.samples import smallest_hashes
from propweave.llm.tables import tree_sum
from propweave.sources.scratch import materialise

#: Bytes of text that a dictionary is built from at once, size of a dictionary, dictionaries that become one.
GROUP_BYTES, DICT_BYTES, MERGED = 6 << 20, 64 << 10, 64
LEVEL = 3
RIDGE = 1.0


def build_dictionary(texts: list[bytes], size: int = DICT_BYTES) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; too few samples to train on become a dictionary of raw content."""
    parts = [t[i : i + 2048] for t in texts for i in range(0, len(t), 2048)]
    try:
        return zstandard.train_dictionary(size, parts)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b" ".join(texts)[-size:] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@dataclass
class Sizes:
    """Compressed sizes of a text: with the good dictionary, with the bad one, with none."""
    good: bytes
    bad: bytes
    raw: tuple[bool, bool] = (False, False)

    def compressors(self):
        out = []
        for data, raw in zip((self.good, self.bad), self.raw):
            kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT
            d = zstandard.ZstdCompressionDict(data, dict_type=kind)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        return [*out, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)]


#: Columns of ``features``.
WIDTH = 13


def features(texts, compressors) -> np.ndarray:
    """Columns: 1, normalised size difference, its square, sizes per byte, log length and their products."""
    rows = np.array([[len(t), *(len(c.compress(t)) for c in compressors)] for t in texts], dtype=float).reshape(-1, 4)
    n, good, bad, none = rows.T
    diff = (bad - good) / np.maximum(np.maximum(good, bad), 1)
    length, g, z = np.log1p(n), good / np.maximum(n, 16), none / np.maximum(n, 16)
    return np.column_stack([np.ones(len(n)), diff, diff**2, (bad - good) / np.maximum(n, 16), g, z, g**2, z**2, g * z,
                            length, length**2, length * g, length * diff])


def _points(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(b):
        yield b.column("x").flatten().to_numpy().reshape(len(b), -1), b.column("y").to_numpy()


def fit_logistic(points: DataFrame, width: int, ridge: float = RIDGE, rounds: int = 40) -> np.ndarray:
    """Weights on the ``width`` raw columns of ``x`` (the first is constant) for ``y``; standardised and damped inside.

    The tasks take the sums of each round over the rows; the driver sees the sums.
    """
    def moments(total, x, y):
        total += np.append(x.sum(0), len(x))

    def squares(total, x, y):
        total += ((x - mu) ** 2).sum(0)

    def derivatives(total, x, y):
        s = (x - mu) / sd
        p = 1 / (1 + np.exp(-np.clip(s @ w, -30, 30)))
        total += np.column_stack([s.T @ (s * (p * (1 - p))[:, None]), s.T @ (y - p)])

    sums = tree_sum(points, moments, (width + 1,), _points)
    mu = sums[:-1] / sums[-1]
    sd = np.sqrt(tree_sum(points, squares, (width,), _points) / sums[-1])
    mu[0], sd[0] = 0.0, 1.0
    sd[sd < 1e-12] = 1.0
    w, damp = np.zeros(width), np.full(width, ridge)
    damp[0] = 1e-3
    for _ in range(rounds):
        got = tree_sum(points, derivatives, (width, width + 1), _points)
        step = np.linalg.solve(got[:, :-1] + np.diag(damp), got[:, -1] - damp * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    out = w / sd
    out[0] -= (w[1:] * mu[1:] / sd[1:]).sum()
    return out


def _built(key, rows):
    """One dictionary of the texts, or of the dictionaries, of a group."""
    import pandas as pd

    if "data" in rows and len(rows) == 1:
        return rows[["label", "data", "raw"]]
    parts = sorted(rows["data"]) if "data" in rows else [t.encode() for _, t in sorted(zip(rows["h"], rows["text"]))]
    made = build_dictionary(parts)
    return pd.DataFrame({"label": [key[0]], "data": [made.as_bytes()], "raw": [made.dict_id() == 0]})


def dictionaries(rows: DataFrame, size: dict[int, int], group_bytes: int = GROUP_BYTES) -> dict[int, tuple[bytes, bool]]:
    """A dictionary, and whether it is raw content, of all texts of each label; ``size`` has the bytes of each label."""
    kind = "label int, data binary, raw boolean"
    many = {c: max(1, -(-n // group_bytes)) for c, n in size.items()}
    dealt = F.pmod(F.xxhash64(F.lit(4), "h", "text"), F.when(F.col("label") == 1, many[1]).otherwise(many[0]))
    made = rows.select("label", dealt.alias("group"), "h", "text").groupBy("label", "group").applyInPandas(_built, kind)
    while max(many.values()) > 1:
        many = {c: -(-n // MERGED) for c, n in many.items()}
        made = materialise(made, "dictionaries")
        dealt = F.pmod(F.xxhash64(F.lit(5), "data"), F.when(F.col("label") == 1, many[1]).otherwise(many[0]))
        made = made.withColumn("group", dealt).groupBy("label", "group").applyInPandas(_built, kind)
    return {r["label"]: (bytes(r["data"]), r["raw"]) for r in made.collect()}


@dataclass
class Model:
    sizes: Sizes | None
    weights: np.ndarray | None
    share: float

    def scorer(self):
        """A function from texts (bytes) to scores."""
        if self.sizes is None:
            return lambda texts: np.full(len(texts), self.share)
        compressors = self.sizes.compressors()
        return lambda texts: 1 / (1 + np.exp(-np.clip(features(texts, compressors) @ self.weights, -30, 30)))


def labelled(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label), each once. Labels grow like the documents, so both are dealt by key at every size."""
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(known.hint("merge"), key).distinct()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label",
        rows: int | None = None, budget: int = GROUP_BYTES) -> Model:
    """Fit on all labelled documents, or on those of ``rows`` keys of each class, drawn by a hash of the key.

    Half of the keys, by a hash, build the dictionaries, from ``budget`` bytes of text at a time; the
    others calibrate. Equal rows count once. Without any example of one class and use every
    score is the smoothed share of label 1.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("label")).dropna().distinct()
    if rows is not None:
        drawn = [smallest_hashes(known.filter(F.col("label") == c), key, rows, 6).withColumn("label", F.lit(c)) for c in (0, 1)]
        known = drawn[0].unionByName(drawn[1])
    h = F.xxhash64(F.lit(6), F.col(key))
    found = labelled(docs, known, key, text)
    found = found.select("label", F.pmod(h, F.lit(2)).alias("use"), h.alias("h"), "text")
    of = lambda c, u: (F.col("label") == c) & (F.col("use") == u)
    also = {f"n{c}{u}": F.count(F.when(of(c, u), 1)) for c in (0, 1) for u in (0, 1)}
    also |= {f"bytes{c}": F.sum(F.when(of(c, 0), F.octet_length("text"))) for c in (0, 1)}
    seen: dict = {}
    found = materialise(found, "quality-rows", also=also, seen=seen)
    count = [seen[f"n{c}0"] + seen[f"n{c}1"] for c in (0, 1)]
    share = (count[1] + 1) / (sum(count) + 2)
    if not all(seen[f"n{c}{u}"] for c in (0, 1) for u in (0, 1)):
        return Model(None, None, share)
    made = dictionaries(found.filter("use = 0"), {c: seen[f"bytes{c}"] for c in (0, 1)}, budget)
    sizes = Sizes(made[1][0], made[0][0], (made[1][1], made[0][1]))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = sizes.compressors()
        for b in batches:
            for part, data, at in pieces(b):
                x = features([data[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], compressors)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.float64()), lists], names=["y", "x"])

    points = materialise(found.filter("use = 1").select("label", "text").mapInArrow(measured, "y double, x array<double>"), "quality-points")
    return Model(sizes, fit_logistic(points, WIDTH), share)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with a column for their quality, 0 to 1; a null text is scored as the empty text.

    Each row is scored by itself from its whole text: repeated rows get the same score, an
    empty table gives an empty result, further columns are kept.
    """
    schema = docs.drop(name).schema.add(name, "double")
    columns = [f.name for f in schema]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            for part, data, at in pieces(b, text):  # about a megabyte of text at a time
                texts = [data[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns[:-1]), pa.array(scorer(texts))], names=columns)

    return docs.drop(name).mapInArrow(apply, schema)
