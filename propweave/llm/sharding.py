"""Rendezvous hashing over weighted shards.

Every (record key, shard) pair has a pseudo-random number u in (0, 1); the shard with the
largest -weight / ln(u) wins. A shard's share follows its weight, and a new shard takes
records only into itself, since the numbers of the old ones stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propweave.sources.scratch import materialise

#: Rows numbered by one task at a time, about.
SLOT_ROWS = 1 << 16


def _draw(key: Column, shard: int) -> Column:
    """52 bits that only depend on the key and the shard's number."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def score(key: Column, shard: int, weight: float) -> Column:
    u = (_draw(key, shard).cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.ln(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the winning shard. A shard of weight 0 gets nothing; a null key is the key ''."""
    live = [(j, w) for j, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    best = [F.struct(score(key, j, w).alias("score"), F.lit(-j).alias("shard")) for j, w in live]
    return (-(F.greatest(*best) if len(best) > 1 else best[0])["shard"]).cast("int")


def shard(docs: DataFrame, weights: list[float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """The documents with a column for their shard; rows of equal key share a shard."""
    return docs.withColumn(name, rendezvous(F.col(key), weights))


def numbered(units: DataFrame, order: list[str], copies: str = "copies") -> DataFrame:
    """Units with ``slot``: the number of rows of the same shard before them, by digest of the first column, then ``order``.

    The digests are cut into ranges of about SLOT_ROWS rows; rows are numbered inside their
    range, and the few range totals are summed per shard. The result does not depend on the cuts.
    """
    rows = units.agg(F.sum(copies)).first()[0] or 0
    ranges = max(1, -(-rows // SLOT_ROWS))
    digest = F.md5(F.coalesce(F.col(order[0]).cast("string"), F.lit("")))
    head = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("bigint")
    cut = units.withColumn("_digest", digest).withColumn("_range", F.floor(head * ranges / float(1 << 32)).cast("bigint"))
    inside = W.partitionBy("shard", "_range").orderBy("_digest", *order).rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumn("_inside", F.coalesce(F.sum(copies).over(inside), F.lit(0)))
    before = W.partitionBy("shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy("shard", "_range").agg(F.sum(copies).alias("_n")).select(
        "shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(totals, ["shard", "_range"]).withColumn("slot", F.col("_before") + F.col("_inside")).drop(
        "_digest", "_range", "_inside", "_before")


def manifest(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1; a null text counts as empty. ``law`` is 'key':
    key and shard list alone decide. ``slot`` numbers a shard's rows without gaps from 0.
    ``grown_shard`` is the shard under the ``grown`` list (null without one). Equal rows
    become one unit with a count before anything is numbered, so a repeated key makes no
    large group; they get slots side by side. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("bigint").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    units = rows.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    units = units.withColumn("shard", rendezvous(F.col("key"), weights)).withColumn(
        "grown_shard", rendezvous(F.col("key"), grown) if grown else F.lit(None).cast("int"))
    out = numbered(materialise(units, "shard-units"), ["key", "size", "text_crc32"])
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("slot") + F.col("copy")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float], key: str = "doc_id") -> str:
    """One folder per shard."""
    shard(docs, weights, key).write.mode("overwrite").partitionBy("shard").parquet(path)
    return path
