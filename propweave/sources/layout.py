"""Table layouts for lookups and joins: Z-order with bloom filters, and buckets with a catalog entry."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from propweave.operators.ordering import SAMPLE, bucket_of
from propweave.sources.scratch import scratch_path

#: Ranges that each column of a Z-order is cut into, as a power of two.
BITS = 6


def _cuts(df: DataFrame, column: str, ranges: int) -> list[tuple]:
    """Cut points between ``ranges`` ranges of about equally many rows, from a bounded sample; a small table has them too."""
    sample = df.select(column).dropna().orderBy(F.rand(17)).limit(SAMPLE).collect()
    values = sorted(tuple(r) for r in sample)
    step = max(1, len(values) // ranges)
    return [v for v in dict.fromkeys(values[step::step]) if v != values[0]][: ranges - 1]


def z_key(df: DataFrame, columns: list[str], bits: int = BITS) -> Column:
    """The bits of the columns' ranges in turn, the first column's highest bit first.

    The ranges are those of a bounded sample and hold about equally many rows each, so skewed
    values do not crowd one end. Rows close in every column are close in the key.
    """
    ranges = []
    for c in columns:
        cuts = _cuts(df, c, 1 << bits)
        # few ranges use the highest bits, so that each column weighs alike
        ranges.append(F.shiftleft(bucket_of(df, [c], cuts), bits - max(len(cuts).bit_length(), 1)))
    taken = [F.shiftleft(F.shiftright(r, bits - 1 - b).bitwiseAND(F.lit(1)).cast("bigint"), len(columns) * (bits - 1 - b) + len(columns) - 1 - i)
             for b in range(bits) for i, r in enumerate(ranges)]
    return reduce(lambda a, b: a.bitwiseOR(b), taken)


def write_z_ordered(df: DataFrame, path: str, columns: list[str], bloom: list[str] | None = None, files: int | None = None,
                    distinct: int = 100_000, bits: int = BITS) -> str:
    """A Parquet table that can be asked by any of several columns without being read whole.

    Files are ranges of the Z-order of ``columns``, so each file holds a narrow range of every
    one of them and its statistics let it be skipped. Columns in ``bloom``, texts whose order
    tells nothing, get bloom filters for about ``distinct`` values a file.
    """
    key = "_z"
    while key in df.columns:
        key = f"_{key}"
    rows = df.withColumn(key, z_key(df, columns, bits))
    rows = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    writer = rows.sortWithinPartitions(key, *columns).drop(key).write.mode("overwrite")
    for c in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    writer.parquet(path)
    return path


def lookup(spark: SparkSession, path: str, column: str, values: list) -> DataFrame:
    """The rows whose column has one of a few values; the condition reaches the statistics and the bloom filters."""
    return spark.read.parquet(path).filter(F.col(column).isin(values))


def rows_read(found: DataFrame) -> int:
    """Runs a query on one table: the rows its scan took out of files. Row groups that were skipped are not among them."""
    plan = found._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def write_bucketed(df: DataFrame, name: str, key: str | list[str], buckets: int, path: str | None = None) -> DataFrame:
    """A table in hash buckets of a key, sorted inside, with an entry in the session's catalog; returned as read.

    Joins and groupings on the key of tables with the same number of buckets need no exchange.
    Rows are dealt by the bucket's own hash before they are written, so a bucket is one file.
    """
    spark, keys = df.sparkSession, [key] if isinstance(key, str) else key
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    rows = df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path or scratch_path(spark, name)).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def exchanges(df: DataFrame) -> int:
    """Exchanges in the plan of a query."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" +-:*(0123456789)").startswith(("Exchange", "BroadcastExchange")) for line in plan.splitlines())
