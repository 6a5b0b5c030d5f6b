"""Corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
``documents``; the last adds the shard. ``run`` writes each stage's rows to the shared
scratch folder and reads them again for the next one, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from propweave.llm import chosen_path, decontaminate, mixing, quality, sharding
from propweave.llm.tables import fresh, importable, read
from propweave.sources.scratch import materialise

#: Least quality score of a document that stays, and weights of the shards.
LEAST_QUALITY = 0.5
SHARDS = [1.0] * 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject. It is fitted on the labels of these documents."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    score = fresh(docs, "score")[0]
    return quality.score(docs, quality.fit(docs, labels), name=score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of five-word shingle sets linked at 0.8 or more."""
    importable(spark)
    return chosen_path.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified match to a benchmark item."""
    index = decontaminate.fit(docs, read(spark, sf_dir, "benchmark"))
    matches = fresh(docs, "matches")[0]
    return decontaminate.search(docs, index, name=matches).filter(F.size(matches) == 0).drop(matches)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: each document at least once, documents of smaller sources again up to the pass limit."""
    return mixing.mix(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard of their id; the repeats of a document share one."""
    return sharding.shard(docs, SHARDS)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", source_mixing), ("sharding", shards)]
#: Compression and sketches are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
