"""Tensor shards: what a failed task leaves, what other programs find, what comes back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from propweave.sources import shards


def examples(spark, n=500):
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 8, "trn").otherwise("tst").alias("split"), "id", F.array(F.col("id"), F.lit(1).cast("bigint"), F.lit(2).cast("bigint")).alias("fixed"),
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("id") % 4), lambda x: x + F.col("id")).alias("ragged"))


def content(df):
    return sorted((r["split"], r["id"], tuple(r["fixed"]), tuple(r["ragged"])) for r in df.collect())


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def test_write_and_read(spark, tmp_path):
    rows = examples(spark).repartition(3)
    path = shards.write_tensors(rows, str(tmp_path / "s"), per_shard=100)
    assert content(shards.read_tensors(spark, path)) == content(rows)
    assert content(shards.read_tensors(spark, path, "tst")) == content(rows.filter("split = 'tst'"))
    listed = json.loads((tmp_path / "s" / "_shards.json").read_text())
    assert sum(x["rows"] for x in listed) == 500 and max(x["rows"] for x in listed) < 200
    assert files(tmp_path / "s") == sorted([x["file"] for x in listed] + ["_shards.json"])


def test_another_program_reads_the_arrays(spark, tmp_path):
    shards.write_tensors(examples(spark, 20).coalesce(1), str(tmp_path / "s"))
    found = [np.load(p) for p in (tmp_path / "s").rglob("*.npz")]
    assert sum(len(f["id"]) for f in found) == 20
    for f in found:
        assert f["fixed"].shape == (len(f["id"]), 3) and f["offsets"][-1] == len(f["values"])
        i = len(f["id"]) - 1
        key = f["id"][i]
        assert f["values"][f["offsets"][i] :].tolist() == [key + k for k in range(key % 4 + 1)]


def test_a_failed_task_leaves_no_shard(spark, tmp_path):
    path = str(tmp_path / "s")
    shards.write_tensors(examples(spark, 50), path)
    before, kept = files(tmp_path / "s"), content(shards.read_tensors(spark, path))
    broken = examples(spark, 80).withColumn("fixed", F.when(F.col("id") == 79, F.array(F.lit(1).cast("bigint"))).otherwise(F.col("fixed")))
    with pytest.raises(Exception, match="different widths"):
        shards.write_tensors(broken.repartition(4), path)
    assert files(tmp_path / "s") == before and content(shards.read_tensors(spark, path)) == kept


def test_empty_partitions_write_nothing(spark, tmp_path):
    shards.write_tensors(examples(spark, 2).filter("id = 1").repartition(8), str(tmp_path / "s"))
    assert len(files(tmp_path / "s")) == 2
    path = shards.write_tensors(examples(spark, 0), str(tmp_path / "e"))
    assert shards.read_tensors(spark, path).count() == 0


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "s")
    shards.write_tensors(examples(spark, 10), path)
    shards.write_tensors(examples(spark, 20).filter("id >= 10"), path, mode="append")
    assert content(shards.read_tensors(spark, path)) == content(examples(spark, 20))
    shards.write_tensors(examples(spark, 5), path)
    assert content(shards.read_tensors(spark, path)) == content(examples(spark, 5))
