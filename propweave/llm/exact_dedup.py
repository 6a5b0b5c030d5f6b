"""Exact dedup by a tree-merge of sorted digest runs.

Documents are dealt to blocks by a hash of their key. Each block's run holds one row per
distinct text, in the order of digests: digest, smallest key, number of rows. The runs are
then merged in rounds of a binomial tree: in a round every group of 2**FAN sibling blocks
exchanges its rows and each sibling takes over one range of digests. What it gets, one row a
run for each text at most, is brought into the order of digest, proof and key; equal texts
are then neighbours, the first of them has the smallest key and takes over the rows of the
others. The order is what the merge works on: a window over neighbours, no hash table. So
the number of runs stays the same, no run ever holds more than its share, and after the last
round a run holds all rows of its digest range. A text with a third of all rows meets in at
most 2**FAN rows of a round.

The verdict travels back the way the rows came: to (block, digest), then to the documents,
so a large group of copies is never joined on its digest alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from propweave.llm.tables import fresh
from propweave.sources.scratch import materialise

#: Bits of the block number, and how many of them one round settles.
BITS, FAN = 8, 2

SPACES = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: str = "text") -> Column:
    """Every run of spaces and control spaces becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def _digest(text: str) -> tuple[Column, Column]:
    """SHA-256 of the normalised text; its length and a second, independent hash."""
    norm = normalised(text)
    return F.unhex(F.sha2(norm, 256)), F.struct(F.octet_length(norm).alias("bytes"), F.xxhash64(norm).alias("hash"))


def digest_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block, digest, proof): the only pass over the texts.

    ``digest`` and ``proof`` must both agree, at every level, for two texts to be one.
    """
    digest, proof = _digest("norm")
    doc = docs.select(F.col(key).alias("key"), normalised(text).alias("norm"))
    return doc.select("key", F.pmod(F.xxhash64("key"), F.lit(1 << BITS)).cast("int").alias("block"),
                      digest.alias("digest"), proof.alias("proof"))


def merged(rows: DataFrame, node: Column) -> DataFrame:
    """Sorted runs of the new nodes, merged: of neighbours with one text the first stays, with the sum of their rows."""
    same = Window.partitionBy("node", "digest", "proof")
    sorted_ = same.orderBy(F.asc_nulls_last("key"))
    return rows.withColumn("node", node).select(
        "node", "digest", "proof", "key", F.row_number().over(sorted_).alias("place"),
        F.sum("rows").over(sorted_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("rows"),
    ).filter("place = 1").drop("place")


def tree_merge(runs: DataFrame) -> DataFrame:
    """(node, digest, proof, key, rows) of all blocks' runs, merged in BITS / FAN rounds."""
    # the top bits of the digest, which take the place of the block's bits round by round
    head = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    for done in range(0, BITS, FAN):
        low = (1 << (BITS - done - FAN)) - 1  # the block's bits not yet settled
        range_ = F.shiftright(head, 16 - done - FAN)
        node = range_ * F.lit(low + 1) + F.col("node").bitwiseAND(F.lit(low))
        runs = merged(runs, node)
    return runs


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of space, tab, newline, vertical
    tab, form feed and carriage return became one space; a null text is an empty text. Of
    equal texts the row with the smallest key stays; a null key comes after all others. If
    that key stands in several equal rows, one of them stays. Every input row has its row in
    the result, an empty table gives an empty result, further columns are ignored.
    """
    return _verdicts(docs, key, text).drop("proof")


def _verdicts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``exact_dedup`` with each text's proof."""
    rows = materialise(digest_rows(docs, key, text), "digests")
    # equal rows (key and text) are one unit with a count, so repeated rows need no numbering
    units = rows.groupBy("block", "digest", "proof", "key").agg(F.count(F.lit(1)).alias("copies"))
    runs = units.groupBy("block", "digest", "proof").agg(
        F.min("key").alias("key"), F.sum("copies").alias("rows")).withColumnRenamed("block", "node")
    final = tree_merge(runs).select("digest", "proof", F.col("key").alias("keep_id"), F.col("rows").alias("group_size"))
    verdict = runs.select(F.col("node").alias("block"), "digest", "proof").join(final, ["digest", "proof"])
    out = units.join(verdict, ["block", "digest", "proof"])
    stays = F.col("key").eqNullSafe(F.col("keep_id"))
    return out.select(
        F.col("key").alias(key), "keep_id", "group_size", stays.alias("stays"),
        F.lower(F.hex("digest")).alias("text_sha256"), "proof",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    ).select(key, "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "proof")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: of each text one row of the smallest key."""
    own = fresh(docs, "digest", "proof")
    norm = fresh(docs, "norm")[0]
    marked = docs.withColumn(norm, normalised(text))
    marked = marked.withColumns(dict(zip(own, _digest(norm)))).drop(norm)
    stays = _verdicts(docs, key, text).filter("kept").select(
        F.col(key).alias("stay_key"), F.unhex("text_sha256").alias("stay_digest"), F.col("proof").alias("stay_proof"))
    first = marked.join(stays, F.col(key).eqNullSafe(F.col("stay_key")) & (F.col(own[0]) == F.col("stay_digest"))
                        & (F.col(own[1]) == F.col("stay_proof")), "left_semi")
    return first.dropDuplicates([key, *own]).drop(*own)
