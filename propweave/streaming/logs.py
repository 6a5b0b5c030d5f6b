"""Live training-log monitor and incremental dedupe.

Everything a stream knows between batches lies in its checkpoint below the caller's folder:
offsets, keyed state, the files of its result. A stream that is started again on the same
folder goes on where it stopped.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_summary(log: DataFrame) -> DataFrame:
    """Rows, minimum, best batch and last loss per type; works on a table and on a stream."""
    return log.groupBy("type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("loss").alias("min_loss"),
        F.min(F.struct("loss", "batch"))["batch"].alias("best_batch"),
        F.max("batch").alias("last_batch"), F.max(F.struct("batch", "loss"))["loss"].alias("last_loss"))


STATE = "n bigint, late bigint, last_batch bigint, best double, best_batch bigint, since bigint, tail_batch array<bigint>, tail_loss array<double>"
REPORT = ("type string, n_rows bigint, late bigint, last_batch bigint, min_loss double, best_batch bigint, new_min int, since_best bigint, "
          "tail_batch array<bigint>, tail_loss array<double>")


def _advance(old: tuple | None, batch: np.ndarray, loss: np.ndarray, n: int) -> tuple[tuple, bool]:
    """The state after more rows of a type, and whether they brought a new minimum."""
    count, late, last, best, best_batch, since, tail_batch, tail_loss = old or (0, 0, None, None, None, 0, [], [])
    order = np.argsort(batch, kind="stable")
    batch, loss = batch[order], loss[order]
    low = int(np.argmin(loss))  # the first of equal ones
    new_min = best is None or loss[low] < best
    if new_min:
        best, best_batch, since = float(loss[low]), int(batch[low]), 0
    since += int((batch > best_batch).sum())
    late += int((batch < last).sum()) if last is not None else 0
    tail = sorted([*zip(tail_batch, tail_loss), *zip(batch[-n:].tolist(), loss[-n:].tolist())])[-n:]
    return (count + len(batch), late, max(int(batch[-1]), last) if last is not None else int(batch[-1]), best, best_batch, since,
            [b for b, _ in tail], [v for _, v in tail]), new_min


def follow_log(log: DataFrame, n: int = 5) -> DataFrame:
    """One report per type and batch of a log stream: minimum, rows since it was first reached, the last ``n`` rows.

    The figures are those of the whole log up to the batch. They are kept as state per type, a
    few numbers each, whatever the length of the log; the rows of a type in one batch meet as
    two arrays of numbers. Rows may come in any order within a batch; ``late`` counts rows that
    came in a later batch than a row behind them, which ``since_best`` may then miss.
    """
    def follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [(c["batch"].to_numpy(np.int64), c["loss"].to_numpy(np.float64)) for c in chunks if len(c)]
        if not parts:
            return
        new, low = _advance(state.get if state.exists else None, *(np.concatenate(p) for p in zip(*parts)), n)
        state.update(new)
        yield pd.DataFrame({"type": [key[0]], "n_rows": [new[0]], "late": [new[1]], "last_batch": [new[2]], "min_loss": [new[3]],
                            "best_batch": [new[4]], "new_min": [int(low)], "since_best": [new[5]], "tail_batch": [new[6]], "tail_loss": [new[7]]})

    rows = log.select("type", "batch", "loss").filter(F.col("batch").isNotNull() & F.col("loss").isNotNull())
    return rows.groupBy("type").applyInPandasWithState(follow, REPORT, STATE, "append", GroupStateTimeout.NoTimeout)


def latest(reports: DataFrame) -> DataFrame:
    """The last report of each type."""
    rest = [c for c in reports.columns if c != "type"]
    return reports.groupBy("type").agg(F.max_by(F.struct(*rest), "n_rows").alias("r")).select("type", "r.*")


def tail_rows(reports: DataFrame) -> DataFrame:
    """(type, batch, loss, from_end, min_loss, is_min) of the last report's rows, the newest first."""
    pair = F.arrays_zip("tail_batch", "tail_loss")
    rows = latest(reports).select("type", "min_loss", F.size("tail_batch").alias("n"), F.posexplode(pair).alias("i", "p"))
    return rows.select("type", F.col("p.tail_batch").alias("batch"), F.col("p.tail_loss").alias("loss"), (F.col("n") - F.col("i")).cast("int").alias("from_end"),
                       "min_loss", (F.col("p.tail_loss") <= F.col("min_loss")).cast("int").alias("is_min"))


def watch_log(stream: DataFrame, folder: str, n: int = 5) -> DataFrame:
    """Follow a log up to what is there: the last ``n`` rows of every type beside its minimum."""
    return tail_rows(run_available(follow_log(stream, n), folder, "append"))


def run_available(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Process what is there since the last call on this folder, stop, and return the result so far.

    Append mode writes a table of all rows. Complete mode writes each batch to its own folder,
    so a repeated batch overwrites itself; the last one holds the full answer.
    """
    spark, out = stream.sparkSession, f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
        query.awaitTermination()
        lost = late_rows([json.loads(p.json) for p in query.recentProgress])
        if lost:
            warnings.warn(f"{folder}: {lost} rows came after the watermark and were dropped", stacklevel=2)
        return spark.read.schema(stream.schema).parquet(out)

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer.foreachBatch(save).start().awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    every = spark.read.schema(f"{stream.schema.toDDL()}, batch bigint").parquet(out)
    return every.join(every.agg(F.max("batch").alias("batch")), "batch").drop("batch")


def stream_dedupe(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """First sight of each key per day. The day is part of the key and carries the watermark, so state of
    days that can no longer receive rows is dropped. Rows later than ``late`` are lost to the stream; ``late_rows``
    counts them beside it."""
    daily = events.withColumn("day", F.date_trunc("day", F.col(ts))).withWatermark("day", late)
    return daily.select(*keys, "day").dropDuplicates([*keys, "day"])


def late_rows(query_progress: list[dict]) -> int:
    """Rows that the watermark dropped, from the progress reports of a query."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query_progress for op in p.get("stateOperators", []))


def stream_table(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(folder)
