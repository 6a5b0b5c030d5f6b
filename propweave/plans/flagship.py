"""The shortest real question end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from propweave.operators import clean, metrics, reports
from propweave.plans.fixtures import Tables


def usable_assay_quality(spark: SparkSession, sf_dir: str, min_per_class: int = 100) -> DataFrame:
    """Balanced assays, their prediction metrics, and the median AUC by source and context size."""
    t = Tables(spark, sf_dir)
    pred = clean.restrict(t.pred, clean.balanced_assays(t.act, min_per_class))
    m = metrics.binary_metrics(pred, ["nprops", "assay"], "value", "probs", "chemical_id")
    dim = t.prop.join(t.src, "source_id").select(F.col("property_id").alias("assay"), "source")
    out = reports.median_metrics(m.join(dim, "assay"), ["source", "nprops"], ["auc"])
    return out.select("source", "nprops", F.round("auc", 6).alias("auc"), "n").orderBy(F.desc("auc"), "source", "nprops")
