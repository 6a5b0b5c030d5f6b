"""Report tables over metric rows, predictions and logs.

Whatever runs over predictions, metric rows or log rows is an aggregate with map-side
combine, or uses the bucketed helpers of ``ordering``; medians are exact and never hold a
group's values in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propweave.operators.ordering import bucket_count, exact_median, first_row, ordered_position, prefix_scan, top_n
from propweave.sources.scratch import materialise


def median_metrics(df: DataFrame, keys: list[str], metrics: list[str], distinct: str | None = None) -> DataFrame:
    """Exact medians per group from value counts, rows and, if asked, distinct items."""
    df = materialise(df, "metric-rows")  # each median reads it
    aggs = [F.count(F.lit(1)).alias("n")]
    if distinct:
        aggs.append(F.count_distinct(distinct).alias("n_distinct"))
    out = df.groupBy(*keys).agg(*aggs)
    for m in metrics:
        out = out.join(exact_median(df, keys, m, m).drop("n"), keys, "left")
    return out.select(*keys, *metrics, "n", *(["n_distinct"] if distinct else []))


def groups_with_all_positions(df: DataFrame, group: str, position: str, n: int) -> DataFrame:
    """Rows of groups seen at exactly ``n`` different positions."""
    full = df.groupBy(group).agg(F.count_distinct(position).alias("_n")).filter(F.col("_n") == n)
    return df.join(full.select(group), group, "left_semi")


def well_predicted(df: DataFrame, group: str, metric: str = "auc", floor: float = 0.7) -> DataFrame:
    return exact_median(df, [group], metric, metric).drop("n").filter(F.col(metric) > floor)


def auc_histogram(df: DataFrame, position: str = "nprops", metric: str = "auc", bins: int = 30) -> DataFrame:
    """Equal-width histogram per position over that position's own range, with its median.

    The top edge belongs to the last bin.
    """
    df = materialise(df.select(position, metric), "histogram-rows")
    span = df.groupBy(position).agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    rows = df.join(span.join(exact_median(df, [position], metric, "median").drop("n"), position), position)
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(metric) - F.col("lo")) / width), F.lit(bins - 1)))
    return rows.groupBy(position, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("median").alias("median"))


def dimension(df: DataFrame, column: str) -> list:
    """All values of a dimension column, sorted: the columns of a pivot. A dimension is a small table."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


def pivot_metric(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """One map column -> value per row, over the columns that occur for it, with the mean of its cells."""
    cell = F.struct(F.col(column), F.col(value))
    return df.filter(F.col(value).isNotNull()).groupBy(row).agg(
        F.map_from_entries(F.sort_array(F.collect_list(cell))).alias("cells"), F.avg(value).alias("mean"))


def pivot_mean(df: DataFrame, row: str, column: str, names: list, value: str) -> DataFrame:
    """Wide table of means, 0 where there is none; ``names`` is the whole dimension."""
    return df.groupBy(row).pivot(column, names).agg(F.avg(value)).na.fill(0.0)


def category_accuracy(df: DataFrame, min_rows: int = 20, min_strength: float = 8.0, cut: float = 0.5) -> DataFrame:
    """Accuracy per category over strongly categorised properties with known values."""
    right = (F.col("prediction") > cut).cast("int") == F.col("value")
    return (df.filter((F.col("strength") > min_strength) & F.col("value").isNotNull())
              .groupBy("category").agg(
                  F.avg(right.cast("double")).alias("accuracy"), F.count_distinct("property_token").alias("numprops"),
                  F.sum(F.col("value").cast("bigint")).alias("numtrue"),
                  F.sum((1 - F.col("value")).cast("bigint")).alias("numfalse"), F.count(F.lit(1)).alias("numeval"))
              .filter(F.col("numeval") > min_rows))


def _different(rows: DataFrame) -> DataFrame:
    """The distinct rows, dealt out by candidate and property first.

    A join by category makes many rows of few, so the tasks it runs in are few and a table of all
    their rows would grow with the join; after the exchange there are many tasks whatever its input.
    """
    return rows.repartition(4 * bucket_count(rows), "name", "property_title").distinct()


def hazard_counts(df: DataFrame, categories: list[str], min_strength: float = 8.0, cut: float = 0.1) -> DataFrame:
    """Likely hazards per candidate over distinct (candidate, property, category) rows."""
    kept = df.filter(F.col("category").isin(*categories) & (F.col("strength") > min_strength))
    rows = _different(kept.select("name", "property_title", "category", "prediction"))
    return rows.groupBy("name").agg(F.sum((F.col("prediction") > cut).cast("bigint")).alias("likely_hazards"))


def property_prevalence(df: DataFrame, n_candidates: int, min_strength: float = 8.0) -> DataFrame:
    """Predicted share of candidates with the property, and how many are above one half."""
    rows = _different(df.filter(F.col("strength") > min_strength).select(
        "source", "property_title", "category", "name", "prediction"))
    return rows.groupBy("source", "property_title", "category").agg(
        (F.sum("prediction") / n_candidates).alias("prevalence"),
        F.sum((F.col("prediction") > 0.5).cast("bigint")).alias("n_likely"))


def top_per_group(df: DataFrame, group: str, order: list, n: int = 10) -> DataFrame:
    """First n rows per group; the row-number filter is also applied before the shuffle."""
    return (df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))
              .filter(F.col("rank") <= n))


def group_median_broadcast(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """The median of its group beside every row: an aggregate joined back, not a window over the group."""
    df = materialise(df, "group-rows")
    return df.join(exact_median(df, [group], value, out).drop("n"), group).select(*df.columns, out)


def group_count_filter(df: DataFrame, group: str, more_than: int) -> DataFrame:
    """Rows of groups with more than ``more_than`` rows: counted by an aggregate, kept by a semi-join."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > more_than)
    return df.join(big.select(group), group, "left_semi")


def best_per_key(df: DataFrame, key: str, metric: str, tie: str) -> DataFrame:
    """The row with the largest metric per key, as an aggregate."""
    rest = [c for c in df.columns if c != key]
    return first_row(df.withColumn("_neg", -F.col(metric)), [key], ["_neg", tie], rest)


def heat_code(c: Column) -> Column:
    return F.when(c <= 0.6, 0).when(c <= 0.7, 1).otherwise(2)


def rebalance(c: Column, at: float = 0.1) -> Column:
    """Stretch probabilities so that ``at`` becomes one half: 0 -> 0, at -> 0.5, 1 -> 1."""
    return F.when(c <= at, c / (2 * at)).otherwise(0.5 + (c - at) / (2 * (1 - at)))


def log_row_number(log: DataFrame, group: str = "type", order: str = "batch") -> DataFrame:
    return ordered_position(log, [order], "iteration", group=[group])


def log_tail_min(log: DataFrame, n: int = 5, skip: int = 0, digits: int = 6) -> DataFrame:
    """Last n losses per type, flagged where they reach the type's minimum."""
    rows = log.withColumn("loss", F.round("loss", digits))
    if skip:
        rows = ordered_position(rows, ["batch"], "_pos").filter(F.col("_pos") > skip).drop("_pos")
    low = rows.groupBy("type").agg(F.min("loss").alias("min_loss"))
    tail = top_n(rows.select("type", "batch", "loss"), ["type"], [F.col("batch").desc()], n)
    return tail.join(low, "type").select("type", "batch", "loss", F.col("rank").alias("from_end"), "min_loss",
                                         (F.col("loss") <= F.col("min_loss")).cast("int").alias("is_min"))


def early_stop(log: DataFrame, group: str = "type", order: str = "batch", value: str = "loss") -> DataFrame:
    """Best value so far and evaluations since it was first reached.

    One scan carries the row number and the running minimum with its place; the few rows that
    set a new minimum then tell its number.
    """
    rows = log.withColumns({"_one": F.lit(1).cast("bigint"), "_pair": F.struct(F.col(value).alias("v"), F.col(order).alias("o"))})
    run = materialise(prefix_scan(rows, [order], sums={"_before": "_one"}, mins={"_best": "_pair"}, group=[group]), "early-stop")
    number = (F.col("_before") + 1).alias("iteration")
    marks = run.filter(F.col("_best.o") == F.col(order)).select(group, F.col(order).alias("_o"), (F.col("_before") + 1).alias("_at"))
    seen = run.select(group, order, value, number, F.col("_best.v").alias("best"), F.col("_best.o").alias("_o")).join(marks, [group, "_o"])
    return seen.select(group, order, value, "iteration", "best", (F.col("iteration") - F.col("_at")).alias("since_best"))


def loss_every(log: DataFrame, every: int = 100, group: str = "type", order: str = "batch", value: str = "loss") -> DataFrame:
    numbered = log_row_number(log, group, order)
    step = F.floor((F.col("iteration") - 1) / every).cast("bigint").alias("step")
    return numbered.groupBy(group, step).agg(F.avg(value).alias("mean_loss"), F.count(F.lit(1)).alias("n"))


def method_diff(df: DataFrame, key: str, method: str, a: str, b: str, value: str) -> DataFrame:
    wide = df.groupBy(key).agg(F.max(F.when(F.col(method) == a, F.col(value))).alias(a),
                               F.max(F.when(F.col(method) == b, F.col(value))).alias(b))
    return wide.withColumn("diff", F.col(a) - F.col(b))


def gain_over_first(df: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Difference to the value at the key's first position."""
    first = F.first(value).over(W.partitionBy(key).orderBy(position))
    return df.withColumn("gain", F.col(value) - first)


def order_by_group_stat(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows of groups in the order of the group's median, largest first."""
    df = materialise(df, "group-rows")
    stat = exact_median(df, [group], value, "group_median").drop("n")
    stat = ordered_position(stat.withColumn("_neg", -F.col("group_median")), ["_neg", group], "group_rank").drop("_neg")
    return df.join(stat, group).orderBy("group_rank")
