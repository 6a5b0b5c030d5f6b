"""Numbering, prefix sums, running minima and top-n over groups of any size.

A plain window sends a whole group to one task. When one group may hold a third of all
rows, that task is the job. So the order is cut into buckets first: values are combined
inside (group, bucket), then the few bucket totals are combined per group, then joined
back. The cut points come from a small sample; they only balance the work, the result
does not depend on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propweave.sources.scratch import materialise

SAMPLE = 4096


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions, 16 at least."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def order_cuts(df: DataFrame, order: list[str], buckets: int | None = None) -> list[tuple]:
    """At most ``buckets - 1`` cut points from a random row sample of bounded size.

    Taken over rows, so a frequent key weighs what it costs. Empty when the whole input fits
    into the sample: then one bucket is enough. The draw may differ between runs; the cut
    points become constants of the plan and do not change the result.
    """
    buckets = buckets or bucket_count(df)
    sample = df.select(*order).orderBy(F.rand(17)).limit(SAMPLE).collect()
    if len(sample) < SAMPLE:
        return []
    rows = sorted(tuple(r) for r in sample if all(v is not None and v == v for v in r))
    step = max(1, len(rows) // buckets)
    return list(dict.fromkeys(rows[step::step]))[: buckets - 1]


def bucket_of(df: DataFrame, order: list[str], cuts: list[tuple]) -> Column:
    """Number of cut points not above the row's key, by binary search."""
    types = [df.schema[c].dataType for c in order]
    key = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])

    def literal(cut):
        if len(order) == 1:
            return F.lit(cut[0]).cast(types[0])
        return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(cut, types, order)])

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < literal(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    found = search(0, len(cuts))
    if len(order) == 1:  # NULL sorts first
        found = F.when(key.isNull(), F.lit(0)).otherwise(found)
    return found.cast("int")


def prefix_scan(df: DataFrame, order: list[str], sums: dict[str, str] | None = None,
                mins: dict[str, str] | None = None, group: list[str] | None = None,
                buckets: int | None = None) -> DataFrame:
    """Running values over ``order`` inside ``group``.

    ``sums``: new column -> summed column, rows before this one (exclusive).
    ``mins``: new column -> column (or struct), up to and with this row.
    ``order`` must be unique inside a group for a repeatable result.
    """
    group, sums, mins = group or [], sums or {}, mins or {}
    rows = df.withColumn("_b", bucket_of(df, order, order_cuts(df, order, buckets)))
    parts = [*group, "_b"]
    before = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()],
        *[F.min(c).alias(f"_t_{o}") for o, c in mins.items()],
    )
    # one row per (group, bucket): at most `buckets` rows in each window below
    ahead = W.partitionBy(*(group or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *parts,
        *[F.sum(f"_t_{o}").over(ahead).alias(f"_o_{o}") for o in sums],
        *[F.min(f"_t_{o}").over(ahead).alias(f"_o_{o}") for o in mins],
    )
    local = rows.select(
        "*",
        *[F.sum(c).over(before).alias(f"_l_{o}") for o, c in sums.items()],
        *[F.min(c).over(upto).alias(f"_l_{o}") for o, c in mins.items()],
    )
    out = local.join(totals, parts)
    zero = F.lit(0)
    return out.select(
        *df.columns,
        *[(F.coalesce(f"_l_{o}", zero) + F.coalesce(f"_o_{o}", zero)).alias(o) for o in sums],
        *[F.least(F.col(f"_l_{o}"), F.col(f"_o_{o}")).alias(o) for o in mins],
    )


def ordered_position(df: DataFrame, order: list[str], out: str, group: list[str] | None = None,
                     start: int = 1, buckets: int | None = None) -> DataFrame:
    """Row number over ``order``; no task ever sorts more than one bucket."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    scanned = prefix_scan(one, order, sums={"_pos": "_one"}, group=group, buckets=buckets)
    return scanned.select(*df.columns, (F.col("_pos") + F.lit(start)).cast("bigint").alias(out))


def top_n(df: DataFrame, group: list[str], order: list, n: int, salts: int | None = None,
          spread: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows of each group, in two rounds.

    Round one keeps n rows in each of ``salts`` slices of a group, so a hot group is cut
    down in parallel; round two sees at most ``salts * n`` rows per group. There are as many
    slices as the session has shuffle partitions, 32 at least.
    """
    salts = salts or max(32, bucket_count(df))
    slice_of = F.pmod(F.xxhash64(*(spread or df.columns)), F.lit(salts))
    first = W.partitionBy(*group, "_s").orderBy(*order)
    final = W.partitionBy(*group).orderBy(*order)
    return (df.withColumn("_s", slice_of)
              .withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n)
              .withColumn("_r", F.row_number().over(final)).filter(F.col("_r") <= n)
              .drop("_s").withColumnRenamed("_r", "rank"))


def first_row(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The first row per key as an aggregate: combined on the map side, so hot keys are harmless."""
    best = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                          *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])).alias("_m")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_m.k{i}").alias(c) for i, c in enumerate(keep)])


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, buckets: int | None = None) -> DataFrame:
    """Exact median from value counts and their prefix sums (no value list per group)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = materialise(counts, "value-counts")  # cut points, prefix sums and sizes read it
    ranked = prefix_scan(counts, [value], sums={"_before": "_c"}, group=keys, buckets=buckets)
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)

    def holds(pos):
        return (F.col("_before") <= pos) & (pos < F.col("_before") + F.col("_c"))

    return (ranked.join(sizes, keys)
                  .groupBy(*keys)
                  .agg(((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2)
                       .alias(out), F.first("_n").alias("n")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
