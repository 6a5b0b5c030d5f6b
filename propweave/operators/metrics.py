"""Classification metrics per group, from (group, score) counts instead of collected lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propweave.operators.ordering import bucket_of, order_cuts

# Fixed value: scores are kept this far from 0 and 1 before the logarithm.
CLIP = 1e-15


def score_counts(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Positives and negatives per (group, score): the map side combines tied scores."""
    pos = F.sum(F.col(y).cast("bigint")).alias("pos")
    neg = F.sum((F.lit(1) - F.col(y)).cast("bigint")).alias("neg")
    return df.groupBy(*keys, score).agg(pos, neg)


def _rank_wins(counts: DataFrame, keys: list[str], score: str, cuts: list[tuple]) -> DataFrame:
    """Per group: positives, negatives, and the number of (positive, negative) pairs ranked right, ties half.

    Scores are cut into buckets, so a hot group's scores are ranked by many tasks; only
    bucket totals meet in one place.
    """
    rest = [c for c in counts.columns if c not in (*keys, score)]
    wins = F.sum(F.col("pos") * (F.coalesce(F.col("_below"), F.lit(0)) + F.col("neg") / 2)).alias("_wins")
    rows = counts.withColumn("_b", bucket_of(counts, [score], cuts))
    below = W.partitionBy(*keys, "_b").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("_below", F.sum("neg").over(below))
    per_bucket = local.groupBy(*keys, "_b").agg(wins, *[F.sum(c).alias(c) for c in rest])
    ahead = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    total = per_bucket.withColumn("_wins", F.col("_wins") + F.col("pos") * F.coalesce(F.sum("neg").over(ahead), F.lit(0)))
    return total.groupBy(*keys).agg(F.sum("_wins").alias("wins"), *[F.sum(c).alias(c) for c in rest])


def _auc() -> Column:
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return F.when(both, F.col("wins") / (F.col("pos").cast("double") * F.col("neg")))


def safe_auc(df: DataFrame, keys: list[str], y: str, score: str, buckets: int | None = None) -> DataFrame:
    """AUC per group with average ranks for ties; NULL where a group has one class only."""
    ranked = _rank_wins(score_counts(df, keys, y, score), keys, score, order_cuts(df, [score], buckets))
    return ranked.select(*keys, "pos", "neg", _auc().alias("auc"))


def _with_cells(counts: DataFrame, score: str, threshold: float, strict: bool) -> DataFrame:
    s = F.col(score)
    called = (s > threshold) if strict else (s >= threshold)
    p = F.least(F.greatest(s.cast("double"), F.lit(CLIP)), F.lit(1 - CLIP))
    return (counts.withColumn("tp", F.when(called, F.col("pos")).otherwise(0))
                  .withColumn("fp", F.when(called, F.col("neg")).otherwise(0))
                  .withColumn("loss", -(F.col("pos") * F.log(p) + F.col("neg") * F.log(1 - p))))


def binary_metrics(df: DataFrame, keys: list[str], y: str, score: str, item: str | None = None,
                   threshold: float = 0.5, min_pos: int = 10, min_neg: int = 10, min_items: int = 20,
                   strict: bool = True, buckets: int | None = None) -> DataFrame:
    """AUC, accuracy, balanced accuracy and log-loss per group with enough support."""
    counts = _with_cells(score_counts(df, keys, y, score), score, threshold, strict)
    m = _rank_wins(counts, keys, score, order_cuts(df, [score], buckets)).filter((F.col("pos") >= min_pos) & (F.col("neg") >= min_neg))
    if item:
        items = df.groupBy(*keys).agg(F.count_distinct(item).alias("n_items")).filter(F.col("n_items") >= min_items)
        m = m.join(items.select(*keys), keys, "left_semi")
    n, tn = F.col("pos") + F.col("neg"), F.col("neg") - F.col("fp")
    return m.select(
        *keys, _auc().alias("auc"),
        ((F.col("tp") + tn) / n).alias("acc"),
        ((F.col("tp") / F.col("pos") + tn / F.col("neg")) / 2).alias("bac"),
        (F.col("loss") / n).alias("cross_entropy_loss"),
        F.col("pos").alias("num_pos"), F.col("neg").alias("num_neg"))


def support_counts(df: DataFrame, keys: list[str], y: str, item: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_distinct(item).alias("n_items"),
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("num_pos"),
        F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("num_neg"))


def confusion_by_group(df: DataFrame, keys: list[str], y: str, score: str, threshold: float = 0.5,
                       min_rows: int = 30, strict: bool = False, buckets: int | None = None) -> DataFrame:
    """Confusion counts, sensitivity, specificity and AUC; NULL scores are dropped first and reported
    through ``groupsize``; groups with too few rows or one class are left out."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("groupsize"))
    kept = df.filter(F.col(score).isNotNull())
    counts = _with_cells(score_counts(kept, keys, y, score), score, threshold, strict)
    m = _rank_wins(counts, keys, score, order_cuts(kept, [score], buckets))
    n = F.col("pos") + F.col("neg")
    m = m.filter((n >= min_rows) & (F.col("pos") > 0) & (F.col("neg") > 0))
    tn, fn = F.col("neg") - F.col("fp"), F.col("pos") - F.col("tp")
    out = m.select(
        *keys, F.col("tp"), tn.alias("tn"), F.col("fp"), fn.alias("fn"),
        (F.col("tp") / F.col("pos")).alias("sensitivity"), (tn / F.col("neg")).alias("specificity"),
        _auc().alias("auc"), ((F.col("tp") + tn) / n).alias("acc"),
        ((F.col("tp") / F.col("pos") + tn / F.col("neg")) / 2).alias("bac"), n.alias("n"))
    return out.join(sizes, keys)


def balanced_accuracy_multi(df: DataFrame, keys: list[str], y: str, yhat: str) -> DataFrame:
    """Mean over the true classes of the share called right."""
    recall = df.groupBy(*keys, y).agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("_recall"))
    return recall.groupBy(*keys).agg(F.avg("_recall").alias("bac"), F.count(F.lit(1)).alias("n_classes"))


def sequence_accuracy(df: DataFrame, a: str, b: str, out: str = "pct") -> DataFrame:
    """Share of equal positions of two sequences, in percent of the first one's length."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return df.withColumn(out, F.aggregate(same, F.lit(0), lambda s, x: s + x) * 100.0 / F.size(a))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigmoid_accuracy(df: DataFrame, logit: str, y: str, keys: list[str] | None = None) -> DataFrame:
    right = ((sigmoid(F.col(logit)) > 0.5).cast("int") == F.col(y)).cast("double")
    return df.groupBy(*(keys or [])).agg(F.avg(right).alias("acc"), F.count(F.lit(1)).alias("n"))


def softmax(arr: str | Column) -> Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    top = F.array_max(a)
    ex = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(ex, F.lit(0.0), lambda s, x: s + x)
    return F.transform(ex, lambda x: x / total)


def normalize_probs(df: DataFrame, p0: str, p1: str, out: str = "prob_one") -> DataFrame:
    """Share of the second of two class probabilities."""
    return df.withColumn(out, F.col(p1) / (F.col(p0) + F.col(p1)))


def agreement_rate(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return df.agg(*[F.avg((F.col(a) == F.col(b)).cast("double")).alias(o) for o, (a, b) in pairs.items()])


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str, out: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(out))
