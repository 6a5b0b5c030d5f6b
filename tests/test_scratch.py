"""Scratch tables: where they may lie, and that none loses rows."""

import pytest
from pyspark.sql import functions as F

from propweave.sources import scratch


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(scratch, "checkpoint_dir", lambda session: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(spark, master="spark://host:7077")
    assert scratch.scratch_root(spark, master="local[4]").startswith("file:")


def test_rows_are_counted_and_tables_removed(spark):
    got = {}
    df = scratch.materialise(spark.range(100).toDF("x"), "t", also={"s": F.sum("x")}, seen=got)
    assert df.count() == 100 and got == {"n": 100, "s": 4950}
    path = scratch._WRITTEN[spark.sparkContext.applicationId][-1]
    scratch.release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_a_lost_table_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_SHARED", set())  # as in a session that has written nothing yet
    real = scratch.scratch_path
    paths = iter(["elsewhere"])

    def split(session, name):
        path = real(session, name)
        reader = type(session.read)
        monkeypatch.setattr(reader, "parquet", lambda self, p, f=reader.parquet: f(self, p).limit(0) if p == path else f(self, p))
        return path
    monkeypatch.setattr(scratch, "scratch_path", split)
    with pytest.raises(RuntimeError, match="3 rows written, 0 read"):
        scratch.materialise(spark.range(3).toDF("x"), next(paths))
