"""Parquet and CSV tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet scan; the column list reaches the file reader."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_glob(spark: SparkSession, folder: str, pattern: str, *columns: str) -> DataFrame:
    """All files below ``folder`` whose name matches, as one table."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(folder)
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer partitions than the cluster has cores; else leave it alone.

    Meant for work that is dear per row on small inputs: a large table has many more
    partitions than cores and is never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_table(df: DataFrame, path: str, by: list[str] | None = None, files: int | None = None,
                sort: list[str] | None = None) -> str:
    """Overwrite a Parquet table.

    Without ``files``, which fixes the width, the rows are rebalanced so that the number of
    files follows the size. ``by`` partitions the folder, ``sort`` gives each file its own
    range of those columns, in order, so that a lookup on them skips files and row groups.
    """
    if files:
        df = df.repartition(files)
    elif not sort:
        df = df.hint("rebalance", *(by or []))
    if sort:
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)
    return path


def read_csv(spark: SparkSession, paths: str | list[str], schema: StructType | str, sep: str = ",") -> DataFrame:
    """CSV files with a header; the schema is given, never inferred by a second pass."""
    return spark.read.schema(schema).option("header", "true").option("sep", sep).csv(paths)
