"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts carry a label; everything else is a mixture. With the share pi of
toxic texts, the risk of a scorer is pi * R+(P) + max(0, R-(U) - pi * R-(P)): the bracket
estimates the risk on clean texts and must not become negative (Kiryo et al., 2017). Where
it would, the step goes the other way, which undoes over-fitting of the positives.

Features are hashed words and word beginnings, present or not. The scorer is linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from propweave.llm.bytetext import Words, pieces
from propweave.llm.samples import smallest_hashes, texts_of

#: Bounds of the fit: toxic rows, unlabelled rows, features.
POSITIVE_ROWS, UNLABELLED_ROWS, FEATURES = 4000, 12000, 4096
#: A feature counts if its shares among toxic and all texts differ by so many standard errors, and by this factor.
LEAST_Z, LEAST_RATIO = 4.0, 2.0
#: Beginnings of words, in bytes.
PREFIXES = (4, 5, 6)
EPOCHS, RATE, DECAY = 400, 0.05, 1e-4


def hashed(data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, and the text each belongs to."""
    w = Words(data, text_at)
    of = np.repeat(np.arange(len(w)), w.counts())
    keys, rows = [w.hashes()], [of]
    for i, n in enumerate(PREFIXES):
        h, at = w.prefix_hashes(n)
        keys.append(h + np.uint64(i + 1))  # a beginning is not the same feature as a word
        rows.append(of[at])
    return np.concatenate(keys).view(np.int64), np.concatenate(rows)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def raw(self, data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
        """Weighted sum over the distinct features of each text."""
        out = np.full(len(text_at) - 1, self.bias)
        if len(self.features):
            keys, rows = hashed(data, text_at)
            at = np.searchsorted(self.features, keys)
            at[at == len(self.features)] = 0
            hit = self.features[at] == keys
            pair = np.unique(rows[hit] * len(self.features) + at[hit])
            out += np.bincount(pair // len(self.features), self.weights[pair % len(self.features)], len(out))
        return out


def train(pos: list[np.ndarray], unl: list[np.ndarray], n: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear scorer from the feature numbers present in each text."""
    def matrix(rows):
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, int)]).astype(int), len(rows)

    p, u = matrix(pos), matrix(unl)
    w, b = np.zeros(n), np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    value = lambda x: np.bincount(x[0], w[x[1]], x[2]) + b
    back = lambda x, g: np.append(np.bincount(x[1], g[x[0]], n), g.sum())
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, EPOCHS + 1):
        fp, fu = value(p), value(u)
        clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        grad_clean = back(u, sigmoid(fu) / u[2]) - prior * back(p, sigmoid(fp) / p[2])
        if clean >= 0:
            grad = grad_clean - prior * back(p, sigmoid(-fp) / p[2])
        else:
            grad = -grad_clean
        grad[:n] += DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:n], b - step[n]
    return w, b


def by_document(docs: list[np.ndarray], total: int) -> list[np.ndarray]:
    """Feature numbers of each of ``total`` documents, from the documents of each feature."""
    feature = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    _, doc = np.unique(np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64), return_inverse=True)
    order = np.lexsort((feature, doc))
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    out = np.split(feature[order], cuts) if len(doc) else []
    return out + [np.zeros(0, int)] * (total - len(out))


def feature_rows(sample: DataFrame) -> DataFrame:
    """(feature, doc, toxic) of a sample with columns doc, toxic, text; each feature once a text."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, at in pieces(b):
                keys, rows = hashed(data, at)
                order = np.lexsort((keys, rows))
                keys, rows = keys[order], rows[order]
                first = np.ones(len(keys), bool)
                first[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
                keys, rows = keys[first], pa.array(rows[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), part.column("doc").take(rows), part.column("toxic").take(rows)], names=["feature", "doc", "toxic"])

    return sample.mapInArrow(apply, "feature bigint, doc bigint, toxic int")


def fit(docs: DataFrame, labels: DataFrame, unlabelled: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "label", prior: float | None = None, positives: int = POSITIVE_ROWS,
        others: int = UNLABELLED_ROWS, most: int = FEATURES) -> Model:
    """Fit on at most ``positives`` toxic and ``others`` unlabelled documents, drawn by a hash of the key.

    ``unlabelled`` holds the keys to draw the mixture from. Without ``prior`` the share of
    label 1 among the labels stands for it. Without toxic examples every score is about 0.
    """
    known = labels.filter(F.col(label).isin(0, 1))
    total, toxic = known.agg(F.count(F.lit(1)), F.sum(label)).first()
    if prior is None:
        prior = (toxic or 0) / total if total else 0.0
    prior = min(max(prior, 1e-3), 0.5)
    p = smallest_hashes(known.filter(F.col(label) == 1), key, positives, 7).withColumn("toxic", F.lit(1))
    u = smallest_hashes(unlabelled, key, others, 71).withColumn("toxic", F.lit(0))
    rows = texts_of(docs, p.unionByName(u), positives + others, key, text)
    rows = rows.select(F.xxhash64(F.col(key), F.col("text")).alias("doc"), "toxic", "text")
    found = feature_rows(rows).groupBy("feature").agg(
        F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("u"), *[
            F.collect_list(F.when(F.col("toxic") == c, F.col("doc"))).alias(f"docs{c}") for c in (0, 1)])
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    share = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    sp, su = share("p", sizes[1]), share("u", sizes[0])
    z = F.abs(sp - su) / F.sqrt(sp * (1 - sp) / sizes[1] + su * (1 - su) / sizes[0])
    best = found.withColumn("z", z).filter(F.col("z") >= LEAST_Z).filter(
        (sp >= LEAST_RATIO * su) | (su >= LEAST_RATIO * sp)).orderBy(F.desc("z"), "feature").limit(most)
    # at most positives + others document numbers for each of at most ``most`` features
    got = best.select("feature", "docs0", "docs1").toPandas().sort_values("feature")
    features = got["feature"].to_numpy(np.int64)
    lists = {c: by_document(got[f"docs{c}"].tolist(), sizes[c]) for c in (0, 1)}
    weights, bias = train(lists[1], lists[0], len(features), prior)
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with a column for their toxicity, 0 to 1; a null text is scored as the empty text.

    Each row is scored by itself from its whole text: repeated rows get the same score, an
    empty table gives an empty result, further columns are kept.
    """
    schema = docs.drop(name).schema.add(name, "double")
    columns = [f.name for f in schema]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, at in pieces(b, text):
                scores = 1 / (1 + np.exp(-np.clip(model.raw(data, at), -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns[:-1]), pa.array(scores)], names=columns)

    return docs.drop(name).mapInArrow(apply, schema)
