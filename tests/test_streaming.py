"""Streams: growing files, keyed state, stopping and starting again."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from propweave.operators import reports
from propweave.sources import follow, logs
from propweave.streaming import logs as sl

LOG = [("train", i, float((i * 37) % 101) + 1) for i in range(60)] + [("eval", i, 5.0 - (i % 50) / 8) for i in range(0, 60, 2)]


def log(spark, data):
    return spark.createDataFrame(data, "type string, batch bigint, loss double").selectExpr("*", "0.1D as lr")


def test_stream_equals_batch(spark, tmp_path):
    path = logs.write_log(log(spark, LOG), str(tmp_path / "log"), files=5)
    live = lambda: sl.run_available(sl.log_summary(logs.stream_log(spark, path, 1)), str(tmp_path / "t"), "complete")
    assert rows(live()) == rows(sl.log_summary(logs.read_log(spark, path)))
    log(spark, [("train", 900, 0.5)]).select("type", "batch", "loss", "lr").coalesce(1).write.mode("append").option("header", "true").option("sep", "\t").csv(path)
    assert rows(live()) == rows(sl.log_summary(logs.read_log(spark, path)))  # the same folder: only the new file is read
    assert rows(live()) == rows(sl.log_summary(logs.read_log(spark, path)))  # nothing new


def test_stream_dedupe_over_files_and_restarts(spark, tmp_path):
    def events(*times):
        return spark.createDataFrame([(1, "a", t) for t in times], "user_id int, event_type string, t string").selectExpr(
            "user_id", "event_type", "timestamp(t) as ts").coalesce(1)
    ev = events("2024-01-01 01:00:00", "2024-01-01 09:00:00", "2024-01-02 01:00:00")
    for _ in range(3):
        ev.write.mode("append").parquet(str(tmp_path / "ev"))

    def run():
        src = sl.stream_table(spark, str(tmp_path / "ev"), "*.parquet", ev.schema, 1)
        return sl.run_available(sl.stream_dedupe(src, ["user_id", "event_type"]), str(tmp_path / "d"), "append")
    assert run().count() == 2
    events("2024-01-02 05:00:00", "2024-01-03 05:00:00").write.mode("append").parquet(str(tmp_path / "ev"))
    assert [str(r["day"])[:10] for r in run().orderBy("day").collect()] == ["2024-01-01", "2024-01-02", "2024-01-03"]


def whole(spark, path, **options):
    return [(r["at"], r["line"]) for r in follow.lines(spark, str(path), False, **options).orderBy("file", "at").collect()]


@pytest.mark.parametrize("block", [1, 2, 5, 7, 64, 1 << 20])
def test_blocks_share_the_lines(spark, tmp_path, block):
    """Wherever a block is cut, each line is read by exactly one."""
    path = tmp_path / "log.tsv"
    path.write_bytes("head\n\nä\r\nlonger line\n\n\nx\nhalf".encode())
    assert whole(spark, path, blockBytes=block, header=True) == [(6, "ä"), (10, "longer line"), (24, "x")]
    assert whole(spark, path, blockBytes=block)[0] == (0, "head")


def test_files_that_hold_no_line(spark, tmp_path):
    assert whole(spark, tmp_path / "missing") == []
    (tmp_path / "a.tsv").write_bytes(b"")
    (tmp_path / "b.tsv").write_bytes(b"no end")
    (tmp_path / "c.txt").write_bytes(b"other\n")
    assert whole(spark, tmp_path, pattern="*.tsv") == []
    assert whole(spark, tmp_path) == [(0, "other")]


def test_appended_lines_are_read_once(spark, tmp_path):
    """Three appends to one file, a half-written line, a stop and a start between any two."""
    path = tmp_path / "log.tsv"

    def run():
        stream = follow.lines(spark, str(path), blockBytes=16)
        return rows(sl.run_available(stream.select("line"), str(tmp_path / "q"), "append"))
    path.write_bytes(b"a\nb\nha")
    assert run() == [("a",), ("b",)]
    with open(path, "ab") as f:
        f.write(b"lf\n" + b"c" * 100 + b"\n")
    assert run() == sorted([("a",), ("b",), ("half",), ("c" * 100,)])
    assert run() == sorted([("a",), ("b",), ("half",), ("c" * 100,)])
    with open(path, "ab") as f:
        f.write(b"d\n")
    assert run()[-1] == ("half",) and len(run()) == 5
    path.write_bytes(b"new\n")
    with pytest.raises(Exception, match="shorter"):
        run()


def test_malformed_lines_are_none(spark):
    lines = spark.createDataFrame([("t\t1\t0.5\t0.1",), ("t\tx\t0.5",), ("t\t2",), ("t\t3\t1e-3",), ("",)], "line string")
    assert rows(follow.log_rows(lines)) == [("t", 1, 0.5, 0.1), ("t", 3, 0.001, None)]


def test_state_has_the_figures_of_the_whole_log(spark, tmp_path):
    """After every append, on a stream that stops and starts again: as the batch operators over all rows so far."""
    seen = []
    for k in range(4):
        part = [r for r in LOG if r[1] * 4 // 60 == k]
        seen += part
        follow.append_log(log(spark, part), str(tmp_path / "live"), writers=2)
        stream = follow.log_rows(follow.lines(spark, str(tmp_path / "live"), header=True))
        out = sl.run_available(sl.follow_log(stream, 3), str(tmp_path / "q"), "append")
        now = log(spark, seen)
        assert rows(sl.tail_rows(out).select("type", "batch", "loss", "from_end", "min_loss", "is_min")) == rows(reports.log_tail_min(now, 3))
        last = reports.early_stop(now).groupBy("type").agg(F.max_by(F.struct("iteration", "best", "since_best"), "iteration").alias("r"))
        assert rows(sl.latest(out).select("type", "n_rows", "min_loss", "since_best")) == rows(last.select("type", "r.*"))
    assert sl.latest(out).filter("late = 0").count() == 2 and out.count() == 8


def test_rows_out_of_order_are_counted(spark, tmp_path):
    for batch in (5, 3):
        follow.append_log(log(spark, [("t", batch, float(batch))]), str(tmp_path / "live"))
        out = sl.run_available(sl.follow_log(follow.log_rows(follow.lines(spark, str(tmp_path / "live"), header=True))), str(tmp_path / "q"), "append")
    r = sl.latest(out).first()
    assert (r["n_rows"], r["late"], r["last_batch"], r["min_loss"], r["tail_batch"]) == (2, 1, 5, 3.0, [3, 5])


def test_appends_grow_one_file_for_each_writer(spark, tmp_path):
    folder = str(tmp_path / "live")
    follow.append_log(log(spark, LOG[:10]), folder, writers=1)
    before = (tmp_path / "live" / "log-0.tsv").read_bytes()
    follow.append_log(log(spark, LOG[10:20]), folder, writers=1)
    after = (tmp_path / "live" / "log-0.tsv").read_bytes()
    assert after.startswith(before) and after.count(b"batch") == 1 and len(list((tmp_path / "live").iterdir())) == 1
    got = follow.log_rows(follow.lines(spark, folder, False, header=True)).collect()
    assert sorted((r["type"], r["batch"], r["loss"]) for r in got) == sorted(LOG[:20])
