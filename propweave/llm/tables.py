"""The given tables, and the code in the workers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from propweave.llm.bytetext import pieces

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Where it is installed or shipped with ``--py-files``, the extra search path does no harm.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the table does not have: the given ones, with underscores before them as needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _texts(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return ((data, at) for _, data, at in pieces(b))


def tree_sum(rows: DataFrame, part, shape: tuple[int, ...], cut=_texts) -> np.ndarray:
    """Sum over all tasks of a float64 array to which ``part`` adds the pieces that ``cut`` makes of a batch."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for piece in cut(b):
                part(total, *piece)
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(apply, "part binary").rdd.map(lambda r: np.frombuffer(bytes(r["part"])))
    if parts.getNumPartitions() == 0:
        return np.zeros(shape)
    return parts.treeReduce(lambda a, b: a + b, 3).reshape(shape)
