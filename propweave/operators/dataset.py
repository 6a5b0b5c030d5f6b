"""Training-example building: nesting, splits, shards, sequences, evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from propweave.functions.arrays import (chunk_pairs, flat_pairs, joined, pad_list, permutation_list, prefixes, reorder,
                                        shift_right)
from propweave.functions.hashing import seeded_bucket, seeded_digest, seeded_unit
from propweave.functions.symbols import PAD_ID, SOS_ID
from propweave.operators.clean import consistent_values
from propweave.operators.vocab import assay_token, encode_symbols, fit_vocab, id_space_of, value_token
from propweave.sources.scratch import materialise


def nest_pairs(data: DataFrame, key: str = "sid", prop: str = "assay_index", value: str = "value") -> DataFrame:
    """One row per substance with its sorted (property, value) list.

    The input holds one value per (substance, property), so a list is never longer than
    the number of properties, however many raw rows the substance has.
    """
    pair = F.struct(F.col(prop).alias("assay_index"), F.col(value).alias("value"))
    return data.groupBy(key).agg(F.sort_array(F.collect_list(pair)).alias("assay_val_pairs"))


def split_name(key: Column | str, weights: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 37,
               names: tuple[str, ...] = ("trn", "tst", "hld")) -> Column:
    """Split chosen by the substance key alone: all its rows land together, on any cluster."""
    unit = seeded_bucket(1000, seed, key)
    edge, out = 0.0, F.lit(names[-1])
    edges = []
    for w in weights[:-1]:
        edge += w * 1000
        edges.append(round(edge))
    for name, e in reversed(list(zip(names, edges))):
        out = F.when(unit < e, F.lit(name)).otherwise(out)
    return out


def split_by_hash(df: DataFrame, key: str = "sid", weights=(0.8, 0.1, 0.1), seed: int = 37) -> DataFrame:
    return df.withColumn("split", split_name(key, weights, seed))


def pair_tokens(meta: dict[str, int], pairs: str | Column) -> Column:
    """Separator, property and value ids in turn, end."""
    p = F.col(pairs) if isinstance(pairs, str) else pairs
    coded = F.transform(p, lambda x: F.struct(assay_token(meta, x["assay_index"]).alias("a"),
                                              value_token(meta, x["value"]).alias("v")))
    return F.concat(F.array(F.lit(meta["sep"]).cast("bigint")), flat_pairs(coded, "a", "v"),
                    F.array(F.lit(meta["end"]).cast("bigint")))


def encode_pairs(df: DataFrame, meta: dict[str, int], out: str = "assay_vals") -> DataFrame:
    return df.withColumn(out, pair_tokens(meta, "assay_val_pairs"))


def _joint(meta: dict[str, int]) -> tuple[Column, Column]:
    """Symbols without padding, then the pair sequence; and how many pad ids fill it up."""
    body = F.concat(F.filter("encoded", lambda x: x != PAD_ID), pair_tokens(meta, "assay_val_pairs"))
    width = F.size("encoded") + F.lit(meta["n_assays"])
    # the fill never goes below zero: an example longer than the width is kept whole
    return body, F.greatest(width - F.size(body), F.lit(0))


def encode_joint(df: DataFrame, meta: dict[str, int], out: str = "joint") -> DataFrame:
    """Symbols without padding, then the pair sequence, filled to symbol length + number of properties."""
    body, fill = _joint(meta)
    return df.withColumn(out, F.concat(body, F.array_repeat(F.lit(PAD_ID).cast("bigint"), fill)))


def joint_text(df: DataFrame, meta: dict[str, int], out: str = "joint", sep: str = " ") -> DataFrame:
    """The ids of ``encode_joint`` as one text. The fill, as wide as there are properties, is one repeated string."""
    body, fill = _joint(meta)
    return df.withColumn(out, F.concat(joined(body, sep), F.repeat(F.lit(f"{sep}{PAD_ID}"), fill)))


def pad_to_max(df: DataFrame, col: str, out: str) -> DataFrame:
    """Fill every list to the longest one; the maximum is a single number computed first."""
    width = df.agg(F.max(F.size(col)).alias("w")).first()["w"] or 0
    return df.withColumn(out, pad_list(col, width, F.lit(PAD_ID).cast("bigint")))


def write_shards(examples: DataFrame, path: str) -> str:
    """All splits in one write, one folder per split; empty partitions write nothing."""
    examples.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split else df


def shards_to_long(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol key, property token, value token) rows: pads off, separator and end off, pairs exploded."""
    bare = F.filter("assay_vals", lambda x: x != PAD_ID)
    inner = F.slice(bare, F.lit(2), F.greatest(F.size(bare) - 2, F.lit(0)))
    keyed = df.select(*keep, joined("encoded").alias("symbols_key"), inner.alias("_inner"))  # once per row, not per pair
    rows = keyed.select(*keep, "symbols_key", F.explode(chunk_pairs("_inner", "a", "v")).alias("p"))
    return rows.select(*keep, "symbols_key", F.col("p.a").alias("assay"), F.col("p.v").alias("value"))


def sample_pairs(pairs: str | Column, k: int | Column, seed: int, key: str | Column, rep: Column | None = None,
                 field: str = "assay_index") -> Column:
    """k pairs (a number or a column) in a seeded random order."""
    p = F.col(pairs) if isinstance(pairs, str) else pairs
    who = [F.col(key) if isinstance(key, str) else key] + ([rep] if rep is not None else [])
    ranked = F.sort_array(F.transform(p, lambda x: F.struct(
        seeded_digest(seed, *who, x[field]).alias("r"), x.alias("x"))))
    return F.slice(F.transform(ranked, lambda t: t["x"]), F.lit(1), k if isinstance(k, Column) else F.lit(k))


def training_examples(nested: DataFrame, meta: dict[str, int], nprops: int = 5, seed: int = 37,
                      key: str = "sid") -> DataFrame:
    """Input symbols, teacher (start + output without its last id) and output of fixed width 2n+2."""
    chosen = sample_pairs("assay_val_pairs", nprops, seed, key)
    out = pad_list(pair_tokens(meta, chosen), 2 * nprops + 2, F.lit(PAD_ID).cast("bigint"))
    df = nested.withColumn("output", out)
    return df.withColumn("teacher", shift_right("output", F.lit(SOS_ID).cast("bigint")))


def pair_chunks(pairs: str | Column, n: int, seed: int, key: str) -> Column:
    """All pairs in a seeded random order, in chunks of ``n``; the last chunk is filled up from the start."""
    p = F.col(pairs) if isinstance(pairs, str) else pairs
    size = F.size(p)
    order = sample_pairs(p, size, seed, key)
    chunks = F.sequence(F.lit(0), F.floor((size - 1) / n).cast("int"))
    slots = F.sequence(F.lit(0), F.lit(n - 1))
    # the order is bound as the one element of an array: inside the lambda it would be sorted anew for every slot
    deal = lambda o: F.transform(chunks, lambda c: F.transform(slots, lambda j: F.get(o, ((c * n + j) % size).cast("int"))))
    return F.get(F.transform(F.array(order), deal), F.lit(0))


def eval_rows(nested: DataFrame, nprops: int = 5, seed: int = 37, key: str = "sid", passes: int | None = None) -> DataFrame:
    """Every order of ``nprops`` random pairs per pass and substance that has that many, one row per position.

    The passes go through a substance's pairs in a seeded random order, ``nprops`` at a time,
    so that all pairs are used; ``passes`` limits their number. The key travels inside the
    row, so a prediction cannot be attached to another substance.
    """
    ok = nested.filter(F.size("assay_val_pairs") >= nprops)
    drawn = ok.select(key, F.posexplode(pair_chunks("assay_val_pairs", nprops, seed, key)).alias("pass", "p"))
    if passes is not None:
        drawn = drawn.filter(F.col("pass") < passes)
    perms = drawn.select(key, "pass", "p", F.posexplode(permutation_list(nprops)).alias("perm", "ord"))
    perms = perms.select(key, "pass", "perm", reorder("p", F.col("ord")).alias("p"))
    rows = perms.select(key, "pass", "perm", F.posexplode(prefixes("p")).alias("nprops", "prior"))
    last = F.element_at("prior", -1)
    return rows.select(
        key, "pass", "perm", "nprops",
        F.array_join(F.transform("prior", lambda x: x["assay_index"].cast("string")), " + ").alias("prior_assays"),
        F.transform("prior", lambda x: x["value"]).alias("prior_values"),
        last["assay_index"].alias("assay"), last["value"].alias("value"),
    )


def skip_seen(rows: DataFrame, seen: DataFrame, inputs: list[str]) -> DataFrame:
    """Each input of ``rows`` once, without those already in ``seen``: a repeated question is not asked again."""
    return rows.dropDuplicates(inputs).join(seen.select(*inputs).distinct(), inputs, "left_anti")


def context_empty(props: DataFrame, meta: dict[str, int], token: str = "property_token") -> DataFrame:
    """Scoring rows without known values: separator, property, pad, end."""
    ids = [F.lit(meta["sep"]), F.col(token), F.lit(PAD_ID), F.lit(meta["end"])]
    return props.withColumn("context", F.array(*[i.cast("bigint") for i in ids]))


def mask_tokens(df: DataFrame, col: str, out: str, key: str, p: float = 0.1, seed: int = 137,
                only_from: int | None = None) -> DataFrame:
    """Set ids to pad with rate p, never the first; ``only_from``: only ids at or above it."""
    def masked(x, i):
        hit = (i > 0) & (seeded_unit(seed, F.col(key), i) < p)
        if only_from is not None:
            hit = hit & (x >= only_from)
        return F.when(hit, F.lit(PAD_ID).cast("bigint")).otherwise(x)
    return df.withColumn(out, F.transform(F.col(col), masked))


def finetune_shards(act: DataFrame, subs: DataFrame, path: str, prop: str = "assay") -> str:
    """The data job of a fine-tune set: consistent values, vocabulary, encoded inputs and pairs, split, shards.

    ``act`` has sid, the property's index and value; ``subs`` has sid and symbols.
    """
    cons = materialise(consistent_values(act.withColumnRenamed(prop, "assay_index"), ("sid", "assay_index")), "finetune-values")
    subs = materialise(subs.join(cons.select("sid"), "sid", "left_semi"), "finetune-inputs")
    voc = fit_vocab(subs, "symbols")
    enc = encode_symbols(subs, voc, "symbols", "encoded").select("sid", "encoded")
    rows = encode_pairs(nest_pairs(cons), id_space_of(voc, cons)).join(enc, "sid")
    return write_shards(split_by_hash(rows).select("sid", "split", "encoded", "assay_vals"), path)


def pair_map(pairs: str | Column) -> Column:
    """[(a, v), ...] to a map a -> v."""
    p = F.col(pairs) if isinstance(pairs, str) else pairs
    return F.map_from_entries(p)


def dataset_report(data: DataFrame, source: str | None = None) -> DataFrame:
    """Totals of a set of activities; with a ``source`` column the number of sources too."""
    more = [F.count_distinct(source).alias("n_sources")] if source else []
    return data.agg(
        *more, F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sid").alias("n_substances"),
        F.count_distinct("assay").alias("n_properties"),
        F.sum(F.col("value").cast("bigint")).alias("n_positive"),
        F.round(F.avg(F.col("value").cast("double")), 6).alias("share_positive"))


def split_overlap(left: DataFrame, right: DataFrame, key: str = "sid") -> DataFrame:
    """Number of keys found in both sets; 0 when the splits are clean."""
    return (left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")
                .agg(F.count(F.lit(1)).alias("n_shared")))
