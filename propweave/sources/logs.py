"""The append-only training log (tab separated: type, batch, loss, lr)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG_SCHEMA = "type string, batch bigint, loss double, lr double"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).option("sep", "\t").option("header", "true").csv(path)


def stream_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG_SCHEMA).option("sep", "\t").option("header", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.csv(path)


def write_log(df: DataFrame, path: str, files: int | None = None) -> str:
    """Without ``files`` the number of files follows the size."""
    df = df.select("type", "batch", "loss", "lr")
    df = df.repartition(files) if files else df.hint("rebalance")
    (df.write.mode("overwrite").option("header", "true").option("sep", "\t").csv(path))
    return path
