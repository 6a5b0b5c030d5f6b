"""Bounded samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def key_crc(key: str = "doc_id") -> Column:
    """Unsigned CRC-32 of the key as text; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))


def smallest_hashes(keys: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` distinct keys, at random but the same on every run and any cluster."""
    return keys.select(key).dropna().distinct().orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(rows)


def texts_of(docs: DataFrame, sample: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``most`` different rows of the sampled documents. The sample's row bound is what allows to broadcast it: keys and labels only.

    A key may stand in many rows: equal ones count once, and of too many those with the smallest hashes stay.
    """
    body = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = body.join(F.broadcast(sample), key).distinct()
    return found.orderBy(F.xxhash64(F.lit(9), F.col(key), F.col("text")), key, "text").limit(most)
