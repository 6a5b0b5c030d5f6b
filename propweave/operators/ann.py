"""A trained index for nearest neighbours: inverted lists, residual product codes, exact re-ranking.

The lists' centres come from k-means over a bounded sample, every round a sum over tasks; the
number of lists grows with the root of the corpus. A vector is stored in the list of its
nearest centre; its residual is cut into parts, each coded by the nearest of a few trained
ones. Centres, codes and lists are tables and can be read back. A query visits the lists
nearest to it, orders their codes by looked-up distances, and compares the best few exactly.
So it costs about visits * root(corpus) code distances, where a full search costs the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from propweave.operators.similarity import MOST_ROWS, ROWS_PER_CHUNK, block_join
from propweave.sources.scratch import materialise

#: Rows that the centres and codes are trained on, lists at most, rounds of k-means, parts of a vector, codes of a part.
SAMPLE, MOST_LISTS, ROUNDS, PARTS, CODES = 65_536, 16_384, 8, 8, 64
#: Queries that a task holds against the centres, or against its lists, at once.
QUERIES_AT_ONCE = 1024


@dataclass
class Index:
    centres: np.ndarray  # list -> centre
    codes: np.ndarray    # part, code -> vector of the part's width
    lists: DataFrame     # id, cell, code (one byte a part), value
    vectors: DataFrame   # id, vec
    sizes: DataFrame     # cell, n

    def save(self, path: str) -> None:
        """Tables below a folder; the lists in the order of their numbers, so that a visit skips files."""
        spark = self.lists.sparkSession
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "cell int, vec array<double>").write.mode("overwrite").parquet(f"{path}/centres")
        spark.createDataFrame([(p, c, v.tolist()) for p, part in enumerate(self.codes) for c, v in enumerate(part)],
                              "part int, code int, vec array<double>").write.mode("overwrite").parquet(f"{path}/codes")
        self.lists.repartitionByRange("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/lists")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        centres = [r["vec"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]  # MOST_LISTS rows at most
        codes = spark.read.parquet(f"{path}/codes").orderBy("part", "code").collect()
        parts = 1 + max(r["part"] for r in codes)
        lists = spark.read.parquet(f"{path}/lists")
        return Index(np.array(centres), np.array([r["vec"] for r in codes]).reshape(parts, len(codes) // parts, -1), lists,
                     spark.read.parquet(f"{path}/vectors"), lists.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The numbers of the k centres nearest to each row, nearest first."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 4096):
        far = (centres**2).sum(1)[None, :] - 2 * x[i : i + 4096] @ centres.T
        some = np.argpartition(far, k - 1, axis=1)[:, :k] if k < len(centres) else np.tile(np.arange(len(centres)), (len(far), 1))
        order = np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable")
        out[i : i + 4096] = np.take_along_axis(some, order, 1)
    return out


def k_means(rows: DataFrame, start: np.ndarray, view, rounds: int = ROUNDS) -> np.ndarray:
    """Centres (group, centre, width) after some rounds over ``vec``; ``view`` makes (row, group, width) of a matrix of rows.

    Each task adds up its rows by group and nearest centre; the parts are added in a tree. A
    centre without rows stays where it is.
    """
    centres = start
    groups, k, width = start.shape
    for _ in range(rounds):
        def apply(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros((groups, k, width + 1))
            for b in batches:
                if len(b):
                    x = view(_matrix(b.column("vec")))
                    for g in range(groups):
                        own = nearest(x[:, g], centres[g])[:, 0]
                        np.add.at(total[g], own, np.concatenate([x[:, g], np.ones((len(x), 1))], axis=1))
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

        parts = rows.select("vec").mapInArrow(apply, "part binary").rdd.map(lambda r: np.frombuffer(bytes(r["part"])))
        total = parts.treeReduce(lambda a, b: a + b, 3).reshape(groups, k, width + 1)
        n = total[..., -1:]
        centres = np.where(n > 0, total[..., :-1] / np.maximum(n, 1), centres)
    return centres


def fit(corpus: DataFrame, lists: int | None = None, parts: int = PARTS, codes: int = CODES, rounds: int = ROUNDS, sample: int = SAMPLE) -> Index | None:
    """The index of (id, vec) or (id, vec, value); every row is in one list. None for an empty corpus.

    Trained on ``sample`` rows at most, those of the smallest hashes of their ids. Vectors have
    one width; ``parts`` that do not divide it are made fewer.
    """
    value = F.col("value").cast("double") if "value" in corpus.columns else F.lit(None).cast("double")
    rows = materialise(corpus.select("id", F.col("vec").cast("array<double>").alias("vec"), value.alias("value")), "ann-corpus")
    n = rows.count()
    if not n:
        return None
    lists = min(lists or ceil(sqrt(n)), MOST_LISTS, n)
    drawn = materialise(rows.select("id", "vec").orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(sample), "ann-sample")
    drawn = drawn.repartition(max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), sample // 4096)))
    first = drawn.orderBy(F.xxhash64(F.lit(4), "id"), "id").limit(max(lists, codes)).collect()  # the centres to begin with
    start = np.array([r["vec"] for r in first], float)
    width = start.shape[1]
    while width % parts:
        parts -= 1
    centres = k_means(drawn, start[None, :lists], lambda x: x[:, None, :], rounds)[0]

    def residuals(x: np.ndarray) -> np.ndarray:
        return (x - centres[nearest(x, centres)[:, 0]]).reshape(len(x), parts, width // parts)

    code_start = residuals(start)[:codes].transpose(1, 0, 2)
    coded = k_means(drawn, np.ascontiguousarray(code_start), residuals, rounds)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column("vec"))
            cell = nearest(x, centres)[:, 0]
            r = (x - centres[cell]).reshape(len(x), parts, -1)
            code = np.stack([nearest(r[:, p], coded[p])[:, 0] for p in range(parts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()),
                                              b.column("value")], names=["id", "cell", "code", "value"])

    kind = rows.schema["id"].dataType.simpleString()
    stored = materialise(rows.mapInArrow(apply, f"id {kind}, cell int, code binary, value double"), "ann-lists")
    return Index(centres, coded, stored, rows.select("id", "vec"), stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))


def _near(b: pa.RecordBatch, centres: np.ndarray, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch, some at a time, and the lists that each visits."""
    for at in range(0, len(b), QUERIES_AT_ONCE):
        part = b.slice(at, QUERIES_AT_ONCE)
        yield part, nearest(_matrix(part.column("vec")), centres, k)


def _visits(queries: DataFrame, index: Index, visits: int, groups: int) -> DataFrame:
    """(id, vec, _cell, cells): each query once for every group of lists that it visits, with the lists visited there."""
    centres, k = index.centres, min(visits, len(index.centres))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, near in (x for b in batches for x in _near(b, centres, k)):
            for g in range(groups):
                row, at = np.nonzero(near % groups == g)
                if len(row):
                    own, first = np.unique(row, return_index=True)
                    cells = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(near[row, at].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(own)), part.column("vec").take(pa.array(own)),
                                                      pa.array([str(g)] * len(own)), cells], names=["id", "vec", "_cell", "cells"])

    kind = queries.schema["id"].dataType.simpleString()
    return queries.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(
        apply, f"id {kind}, vec array<double>, _cell string, cells array<int>")


def _visitors(queries: DataFrame, index: Index, visits: int) -> DataFrame:
    """(cell, q): how many queries visit each list, from each task."""
    centres, k = index.centres, min(visits, len(index.centres))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centres), np.int64)
        for _, near in (x for b in batches for x in _near(b, centres, k)):
            n += np.bincount(near.ravel(), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], names=["cell", "q"])

    return queries.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(apply, "cell int, q bigint")


def search(queries: DataFrame, index: Index, k: int = 5, visits: int = 8, rerank: int = 50, exclude_self: bool = False) -> DataFrame:
    """(qid, cid, score, value, rank): the k nearest of the ``rerank`` best by code in the ``visits`` lists nearest to each query.

    ``score`` is the negative squared distance. The lists are put into groups of bounded size, a query is sent once to each
    group that it visits, and a task goes from list to list; of a group, cut into chunks where a list is large, a
    query gets its ``rerank`` best.
    """
    centres, codes = index.centres, index.codes
    groups = max(1, ceil((index.sizes.agg(F.sum("n")).first()[0] or 0) / MOST_ROWS))

    def best_of(x: np.ndarray, own: np.ndarray, visited: list, code: np.ndarray, ids: np.ndarray, cells: dict):
        """(row, column) of the best of some queries: those not worse than the last of the best so far are put among them now and then."""
        edge = np.full(len(x), np.inf)
        best, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []

        def merged(held, waiting):
            r, c, n = (np.concatenate([h, *(w[i] for w in waiting)]) for i, h in enumerate(held))
            order = np.lexsort((c, n, r))  # columns are in the order of the ids, which breaks ties
            r, c, n = r[order], c[order], n[order]
            place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
            edge[r[place == rerank - 1]] = n[place == rerank - 1]
            return tuple(v[place < rerank] for v in (r, c, n))

        size = np.array([len(v) for v in visited])
        asked, of = np.concatenate(visited), np.repeat(np.arange(len(x)), size)
        order = np.argsort(asked, kind="stable")
        asked, of = asked[order], of[order]
        for cell, members in cells.items():
            rows = of[np.searchsorted(asked, cell):np.searchsorted(asked, cell, side="right")]
            if not len(rows):
                continue
            q = (x[rows] - centres[cell]).reshape(len(rows), codes.shape[0], -1)
            tables = [((q[:, p, None, :] - codes[p][None]) ** 2).sum(2) for p in range(codes.shape[0])]
            for at in range(0, len(members), ROWS_PER_CHUNK):
                there = members[at:at + ROWS_PER_CHUNK]
                far = np.zeros((len(rows), len(there)))
                for p, table in enumerate(tables):  # distances to the codes of a part are looked up
                    far += table[:, code[there, p]]
                if exclude_self:
                    far[own[rows][:, None] == ids[there][None, :]] = np.inf
                close = (far <= edge[rows][:, None]) & np.isfinite(far)
                if rerank < len(there) and np.count_nonzero(close) > 2 * rerank * len(rows):
                    close &= far <= np.partition(far, rerank - 1, axis=1)[:, rerank - 1, None]
                r, j = np.nonzero(close)
                waiting.append((rows[r], there[j], far[r, j]))
                if sum(len(w[0]) for w in waiting) > 2 * rerank * len(x):
                    best, waiting = merged(best, waiting), []
        return merged(best, waiting)

    def kernel(key, lp, rp):
        out = {"qid": "int64", "cid": "int64", "near": "float64", "value": "float64"}
        found = []
        if len(lp) and len(rp):
            rp = rp.sort_values("id", kind="stable")
            code = np.frombuffer(b"".join(rp["code"].to_list()), np.uint8).reshape(len(rp), codes.shape[0])
            ids, cell, value = rp["id"].to_numpy(), rp["cell"].to_numpy(), rp["value"].to_numpy()
            cells = {int(c): np.flatnonzero(cell == c) for c in np.unique(cell)}
            for at in range(0, len(lp), QUERIES_AT_ONCE):
                some = lp.iloc[at:at + QUERIES_AT_ONCE]
                own = some["id"].to_numpy()
                row, col, near = best_of(np.stack(some["vec"].to_list()), own, some["cells"].to_list(), code, ids, cells)
                found.append(pd.DataFrame({"qid": own[row], "cid": ids[col], "near": near, "value": value[col]}))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype=t) for c, t in out.items()})

    asked = _visits(queries, index, visits, groups)
    stored = index.lists.withColumn("_cell", F.pmod("cell", F.lit(groups)).cast("string"))
    best = block_join(asked, stored, kernel, "qid bigint, cid bigint, near double, value double", most=MOST_ROWS, right_rows=MOST_ROWS)
    few = best.withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy("near", "cid"))).filter(F.col("_r") <= rerank).drop("_r", "near")
    both = few.join(index.vectors.select(F.col("id").alias("cid"), F.col("vec").alias("c")), "cid").join(
        queries.select(F.col("id").alias("qid"), F.col("vec").cast("array<double>").alias("q")).distinct(), "qid")
    score = -F.aggregate(F.zip_with("q", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    ranked = both.select("qid", "cid", score.alias("score"), "value")
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "cid"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k)


def comparisons(queries: DataFrame, index: Index, visits: int = 8) -> DataFrame:
    """One row: mean code distances a query, rows of the corpus."""
    n = index.sizes.agg(F.sum("n")).first()[0]
    return _visitors(queries, index, visits).groupBy("cell").agg(F.sum("q").alias("q")).join(index.sizes, "cell").agg(
        (F.sum(F.col("q") * F.col("n")) / F.lit(max(queries.count(), 1))).alias("per_query"), F.lit(n).alias("corpus"))
