"""Cleaning of raw substances and activities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from propweave.operators.ordering import first_row, union_all


def _variant_path(path: str) -> str:
    """'$.Ligand SMILES' as a path of a variant: keys that are no plain names stand in brackets."""
    keys = path.removeprefix("$.").split(".")
    return "$" + "".join(f".{k}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k) else f"['{k}']" for k in keys)


def json_coalesce(df: DataFrame, json_col: str, out: dict[str, list[str]]) -> DataFrame:
    """First non-null alternative per output column from a JSON text column.

    Each text is parsed once, into a variant. A text that is no JSON, a missing key and a JSON
    null give null; other values become text.
    """
    parsed = "_parsed"
    while parsed in df.columns:
        parsed = f"_{parsed}"
    got = df.withColumn(parsed, F.try_parse_json(json_col))
    return got.select(*df.columns, *[
        F.coalesce(*[F.try_variant_get(F.col(parsed), _variant_path(p), "string") for p in paths]).alias(name) for name, paths in out.items()
    ])


def coalesce_fallback(df: DataFrame, col: str, fallback: Column) -> DataFrame:
    """Keep the value where present, derive it otherwise."""
    return df.withColumn(col, F.coalesce(F.col(col), fallback))


def clean_substances(raw: DataFrame, json_col: str, paths: dict[str, list[str]], derived: Column,
                     symbols: Column, key: str = "sid") -> DataFrame:
    """Extract, fall back, drop rows without a structure, then make rows distinct."""
    df = json_coalesce(raw, json_col, paths)
    df = coalesce_fallback(df, "smiles", derived).filter(F.col("smiles").isNotNull())
    df = df.withColumn("symbols", symbols).filter(F.col("symbols").isNotNull())
    return df.select(key, "inchi", "smiles", "symbols").distinct()


def validity_filter(df: DataFrame, col: str, charset: str, max_length: int = 120) -> DataFrame:
    """Rows whose text is non-empty, within the length and made of ``charset`` (a regex class body) only."""
    return df.filter(is_valid(F.col(col), charset, max_length))


def is_valid(c: Column, charset: str, max_length: int = 120) -> Column:
    return (F.length(c) > 0) & (F.length(c) <= max_length) & c.rlike(rf"^[{charset}]*\z")


def assay_value_counts(act: DataFrame) -> DataFrame:
    return act.groupBy("assay", "value").agg(F.count(F.lit(1)).alias("n"))


def assay_pivot_counts(act: DataFrame) -> DataFrame:
    """Both class counts per assay in one aggregate; a missing class counts 0."""
    return act.groupBy("assay").agg(
        F.count(F.when(F.col("value") == 0, 1)).alias("count_0"),
        F.count(F.when(F.col("value") == 1, 1)).alias("count_1"),
    )


def balanced_assays(act: DataFrame, min_per_class: int = 100, max_imbalance: float = 0.9) -> DataFrame:
    """Assays with enough rows of both classes and an imbalance within the bound."""
    c0, c1 = F.col("count_0"), F.col("count_1")
    return (assay_pivot_counts(act)
            .filter((c0 >= min_per_class) & (c1 >= min_per_class))
            .withColumn("imbalance", F.abs((c0 - c1) / (c0 + c1)))
            .filter(F.col("imbalance") <= max_imbalance))


def restrict(act: DataFrame, kept: DataFrame, on: str = "assay") -> DataFrame:
    """Semi-join: the kept list only filters, it cannot multiply rows."""
    return act.join(kept.select(on), on, "left_semi")


def consistent_values(act: DataFrame, keys: tuple[str, ...] = ("sid", "assay"), value: str = "value") -> DataFrame:
    """Keep (substance, assay) pairs whose known values all agree.

    min = max says the same as a one-element value set, without collecting the set; NULLs
    are ignored and an all-NULL pair is dropped.
    """
    lo, hi = F.min(value).alias("_lo"), F.max(value).alias("_hi")
    return (act.groupBy(*keys).agg(lo, hi)
               .filter(F.col("_lo") == F.col("_hi"))
               .select(*keys, F.col("_lo").alias(value)))


def dedupe_subset(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first under an explicit order (all columns break ties)."""
    rest = [c for c in df.columns if c not in keys]
    ties = [c for c in rest if c not in order]
    return first_row(df, keys, [*order, *ties], rest).select(*df.columns)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """First non-null value per column and key, in the given order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(*[
        F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"].alias(c)
        for c in rest
    ])


def quality_checks(df: DataFrame, columns: list[str], min_rows: int) -> DataFrame:
    """Nulls per column, its type, and whether the table reaches a row floor: one pass, one row per column."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"),
                    *[F.sum(F.col(c).isNull().cast("bigint")).alias(f"n_{c}") for c in columns])
    report = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                 F.col(f"n_{c}").alias("n_null"), F.col("n_rows"),
                 (F.col("n_rows") > min_rows).cast("int").alias("enough_rows"))
        for c in columns
    ])
    return counts.select(F.inline(report))


def _digest(col: str) -> list[Column]:
    """192 bits that stand for a text as a join key, so that whole texts are not shuffled."""
    return [F.md5(col).alias("_md5"), F.xxhash64(col).alias("_xx")]


def novel_items(made: DataFrame, known: list[DataFrame], col: str) -> DataFrame:
    """Distinct made items that occur in none of the known tables.

    Copies are reduced to one key before the join on both sides, on the map side first; the
    known tables are one side of one join.
    """
    keys = ["_md5", "_xx"]
    items = made.groupBy(*_digest(col)).agg(F.min(col).alias(col))
    if known:
        seen = union_all([table.select(*_digest(col)) for table in known]).distinct()
        items = items.join(seen, keys, "left_anti")
    return items.drop(*keys)


def quality_rates(made: DataFrame, known: DataFrame, col: str, charset: str, max_length: int) -> DataFrame:
    """Share of made items that are valid, and share not found among the known ones."""
    keys = ["_md5", "_xx"]
    items = made.groupBy(*_digest(col)).agg(
        F.count(F.lit(1)).alias("_n"), F.first(is_valid(F.col(col), charset, max_length).cast("double")).alias("_ok"))
    seen = known.select(*_digest(col)).distinct().withColumn("_seen", F.lit(1))
    rows = items.join(seen, keys, "left")
    new = F.when(F.col("_seen").isNull(), F.col("_n")).otherwise(0)
    return rows.agg(F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.col("_ok")) / F.sum("_n")).alias("validity"),
                    (F.sum(new) / F.sum("_n")).alias("novelty"))
