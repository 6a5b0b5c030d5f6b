"""Shared scratch storage.

Tables go below the folder named by ``spark.checkpoint.dir``, which every executor of a
cluster can reach. Only a session whose master is ``local[...]`` may leave it unset; it
then gets a fresh local folder. Anywhere else that would lose rows without a word, so it
is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
_SHARED: set[tuple[str, str]] = set()  # folders of an application whose rows have come back


def checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def scratch_root(spark: SparkSession, master: str | None = None) -> str:
    """Folder for intermediate tables. ``master`` stands in for the session's own (tests)."""
    root = checkpoint_dir(spark)
    if root:
        return root.rstrip("/")
    master = master or spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is not set; master {master} needs a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="propweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[app] = f"file://{folder}"
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/propweave/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str, by: list[str] | None = None, also: dict[str, Column] | None = None,
                seen: dict | None = None) -> DataFrame:
    """Write once and read back: cuts the lineage and survives the loss of executors.

    The rows that went in are counted on the way; the first table with rows in a folder is counted
    again as read, which shows whether all executors share it. ``also`` names further aggregates
    to take on the way; with ``n``, the count, they go to ``seen``.
    """
    spark, watch = df.sparkSession, Observation()
    path = scratch_path(spark, name)
    writer = df.observe(watch, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (also or {}).items()]).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    got = watch.get
    if seen is not None:
        seen.update(got)
    written, folder = got["n"], (spark.sparkContext.applicationId, scratch_root(spark))
    if not written or folder in _SHARED:
        return out
    read = out.count()
    if written != read:
        raise RuntimeError(f"{path}: {written} rows written, {read} read back; is the folder shared by all executors?")
    _SHARED.add(folder)
    return out


def release(spark: SparkSession) -> None:
    """Remove the scratch tables of this application; for the end of a job, when no result needs them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
