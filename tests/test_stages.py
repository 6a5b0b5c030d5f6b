"""Stored stages: what runs again, and what a killed run leaves behind."""

import pytest
from pyspark.sql import functions as F

from propweave.operators import clean
from propweave.sources.stages import Stages


def source(spark, path, n=10):
    spark.range(n).toDF("x").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def doubled(a, factor):
    return a.select((F.col("x") * factor).alias("y"))


def counted(b):
    return {"n": b.agg(F.count(F.lit(1)).alias("n")), "low": b.filter("y < 6")}


def total(a, b, c):
    y, n = b.agg(F.sum("y")).first()[0], c["n"].first()["n"]
    return a.agg(F.sum("x").alias("x"), F.lit(y).alias("y"), F.lit(n).alias("n"))


def graph(spark, folder, path, factor=2, fail=False, last=total, code=()):
    s = Stages(spark, folder)
    s.source("a", path)

    def broken(b):
        raise RuntimeError("killed")
    s.stage("b", doubled, ["a"], code, factor=factor)
    s.stage("c", broken if fail else counted, ["b"])
    s.stage("d", last, ["a", "b", "c"])
    return s


def test_a_second_run_reads_every_stage(spark, tmp_path):
    path = source(spark, str(tmp_path / "in"))
    first, second = (graph(spark, str(tmp_path / "job"), path) for _ in range(2))
    assert set(first.done.values()) == {"ran"} and set(second.done.values()) == {"kept"}
    assert [tuple(r) for r in second.tables["d"].collect()] == [(45, 90, 10)]
    assert sorted(tuple(r) for r in second.manifest().collect()) == [
        ("b", "", 10, "kept"), ("c", "low", 3, "kept"), ("c", "n", 1, "kept"), ("d", "", 1, "kept")]


def test_a_change_reaches_what_depends_on_it(spark, tmp_path):
    path, folder = source(spark, str(tmp_path / "in")), str(tmp_path / "job")
    graph(spark, folder, path)
    assert graph(spark, folder, path, factor=3).done == {"b": "ran", "c": "ran", "d": "ran"}
    assert graph(spark, folder, path, factor=3).tables["d"].first()["y"] == 135
    assert graph(spark, folder, path, factor=3, last=lambda a, b, c: a).done == {"b": "kept", "c": "kept", "d": "ran"}
    assert graph(spark, folder, path, factor=3, code=(clean,)).done["b"] == "ran"
    source(spark, path, 20)
    assert set(graph(spark, folder, path, factor=3, code=(clean,)).done.values()) == {"ran"}


def test_a_killed_run_goes_on(spark, tmp_path):
    path, folder = source(spark, str(tmp_path / "in")), str(tmp_path / "job")
    with pytest.raises(RuntimeError, match="killed"):
        graph(spark, folder, path, fail=True)
    assert graph(spark, folder, path).done == {"b": "kept", "c": "ran", "d": "ran"}


def test_an_output_without_a_record_is_not_read(spark, tmp_path):
    path, folder = source(spark, str(tmp_path / "in")), str(tmp_path / "job")
    s = graph(spark, folder, path)
    half = s.records["b"]["outputs"][""]["path"]
    spark.range(1).toDF("y").write.mode("overwrite").parquet(half)
    s.files.remove(f"{folder}/records/b.json")
    again = graph(spark, folder, path)
    assert again.done == {"b": "ran", "c": "kept", "d": "kept"} and again.tables["b"].count() == 10


def test_former_outputs_are_removed(spark, tmp_path):
    path, folder = source(spark, str(tmp_path / "in")), str(tmp_path / "job")
    graph(spark, folder, path)
    s = graph(spark, folder, path, factor=5)
    assert s.tidy() == 3 and s.tidy() == 0 and set(graph(spark, folder, path, factor=5).done.values()) == {"kept"}


def test_names_are_checked(spark, tmp_path):
    s = Stages(spark, str(tmp_path / "job"))
    s.source("a", source(spark, str(tmp_path / "in")))
    with pytest.raises(KeyError, match="needs"):
        s.stage("b", doubled, ["z"], factor=1)
    s.stage("b", doubled, ["a"], factor=1)
    with pytest.raises(KeyError, match="two stages"):
        s.stage("b", doubled, ["a"], factor=2)


def test_an_empty_input_has_empty_stages(spark, tmp_path):
    s = graph(spark, str(tmp_path / "job"), source(spark, str(tmp_path / "in"), 0))
    assert s.tables["b"].count() == 0 and s.tables["d"].count() == 1
