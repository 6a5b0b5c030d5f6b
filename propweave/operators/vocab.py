"""Vocabularies: fit, encode, decode, property indexes and token ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from propweave.functions.arrays import pad_list
from propweave.functions.symbols import EOS, EOS_ID, PAD, PAD_ID, SOS, SOS_ID, greedy_split, notation_ids, split_symbols
from propweave.operators.ordering import ordered_position
from propweave.sources.scratch import materialise


def fit_vocab(df: DataFrame, col: str, specials: tuple[str, ...] = (PAD, SOS, EOS)) -> DataFrame:
    """(symbol, index): the specials, then all distinct symbols in symbol order."""
    symbols = (df.select(F.explode(split_symbols(col)).alias("symbol")).distinct()
                 .filter(~F.col("symbol").isin(*specials)))
    # stored, so that the corpus is read once although the numbering reads its input more than once
    numbered = ordered_position(materialise(symbols, "symbols"), ["symbol"], "index", start=len(specials))
    special = F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(i).cast("bigint").alias("index"))
                        for i, s in enumerate(specials)])
    head = df.sparkSession.range(1, numPartitions=1).select(F.inline(special))
    return head.unionByName(numbered)


def char_vocab(df: DataFrame, col: str) -> DataFrame:
    """(symbol, index): every character of the corpus and the blank, sorted, from 0."""
    chars = df.select(F.explode(F.split(F.col(col), "")).alias("symbol")).filter(F.col("symbol") != "")
    blank = df.sparkSession.range(1, numPartitions=1).select(F.lit(" ").alias("symbol"))
    return ordered_position(materialise(chars.unionByName(blank).distinct(), "characters"), ["symbol"], "index", start=0)


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _lookup(df: DataFrame, vocab: DataFrame, arr: Column, forward: bool, missing: Column) -> DataFrame:
    """Adds ``_ids``: the array with every entry replaced through the vocabulary; NULL stays NULL.

    The same way for every vocabulary size: an array's result depends on the array alone, so
    each distinct array is taken apart once, joined entry by entry and put together again,
    under a digest of its content. Rows with equal keys are not mixed and copies cost nothing.
    """
    src, dst = ("symbol", "index") if forward else ("index", "symbol")
    marked = df.withColumn("_arr", arr).withColumn("_of", F.sha2(F.to_json("_arr"), 256))
    once = marked.filter(F.col("_of").isNotNull()).select("_of", "_arr").dropDuplicates(["_of"])
    parts = once.select("_of", F.posexplode("_arr").alias("_pos", "_entry"))
    table = vocab.select(F.col(src).alias("_entry"), F.col(dst).alias("_id"))
    hits = parts.join(table, "_entry", "left").select("_of", "_pos", F.coalesce("_id", missing).alias("_id"))
    lists = hits.groupBy("_of").agg(F.sort_array(F.collect_list(F.struct("_pos", "_id"))).alias("_list"))
    out = marked.join(lists.select("_of", F.col("_list._id").alias("_ids")), "_of", "left")
    none = F.array().cast("array<bigint>" if forward else "array<string>")
    return out.withColumn("_ids", F.when(F.col("_of").isNotNull(), F.coalesce("_ids", none))).drop("_arr", "_of")


def encode_symbols(df: DataFrame, vocab: DataFrame, col: str, out: str, pad_length: int | None = 120) -> DataFrame:
    """Start id, symbol ids (unknown: pad id), end id; filled or cut to ``pad_length``; NULL text: all pad.

    Without a ``pad_length`` every row keeps its own length and a NULL text has no ids.
    """
    pad = F.lit(PAD_ID).cast("bigint")
    looked = _lookup(df, vocab, split_symbols(col), True, pad)
    marked = F.concat(F.array(F.lit(SOS_ID).cast("bigint")), F.col("_ids"), F.array(F.lit(EOS_ID).cast("bigint")))
    if pad_length is None:
        return looked.withColumn(out, F.coalesce(marked, F.array().cast("array<bigint>"))).drop("_ids")
    empty = F.array_repeat(pad, pad_length)
    ids = F.when(F.col(col).isNull(), empty).otherwise(pad_list(marked, pad_length, pad))
    return looked.withColumn(out, ids).drop("_ids")


def decode_symbols(df: DataFrame, vocab: DataFrame, col: str, out: str) -> DataFrame:
    """Ids back to text; pad, start and end ids are dropped; NULL stays NULL."""
    kept = F.filter(F.col(col), lambda x: ~x.isin(PAD_ID, SOS_ID, EOS_ID))
    looked = _lookup(df, vocab, kept, False, F.lit(""))
    return looked.withColumn(out, F.array_join("_ids", "")).drop("_ids")


def decode_mixed(df: DataFrame, vocab: DataFrame, col: str, out: str, n_symbols: int) -> DataFrame:
    """Symbol text for ids of the symbol vocabulary, then the remaining ids as numbers."""
    small = F.filter(F.col(col), lambda x: x < n_symbols)
    large = F.transform(F.filter(F.col(col), lambda x: x >= n_symbols), lambda x: x.cast("string"))
    return _lookup(df, vocab, small, False, F.lit("")).withColumn(out, F.concat("_ids", large)).drop("_ids")


def greedy_tokens(df: DataFrame, col: str, out: str, max_length: int = 120) -> DataFrame:
    """Greedy two-character tokenisation of line notation; unknown characters become the blank."""
    ids = notation_ids()
    table, blank = _map(ids), F.lit(ids[" "])
    tokens = F.transform(greedy_split(col), lambda x: F.coalesce(table[x], blank))
    return df.withColumn(out, pad_list(tokens, max_length, blank))


def char_encode(df: DataFrame, vocab: DataFrame, col: str, out: str, max_length: int = 120) -> DataFrame:
    """Characters to ids after filling with blanks (or cutting) to ``max_length``; NULL stays NULL.

    An alphabet is bounded by Unicode, so it goes to the tasks and every row is encoded where it is.
    """
    symbols = vocab.filter(F.char_length("symbol") == 1).select("symbol", "index").collect()
    codes, numbers = np.array(sorted((ord(r["symbol"]), r["index"]) for r in symbols), np.int64).reshape(-1, 2).T

    @F.pandas_udf("array<bigint>")
    def encoded(texts):
        import pandas as pd

        def ids(text):
            if text is None:
                return None
            chars = np.frombuffer(text[:max_length].ljust(max_length).encode("utf-32-le"), np.uint32)
            at = np.searchsorted(codes, chars)
            at[at == len(codes)] = 0
            hit = codes[at] == chars if len(codes) else np.zeros(len(chars), bool)
            return numbers[at] if len(codes) and hit.all() else [int(numbers[a]) if h else None for a, h in zip(at, hit)]

        return pd.Series([ids(t) for t in texts], dtype=object)

    return df.withColumn(out, encoded(F.col(col)))


def property_index(act: DataFrame, col: str = "assay", out: str = "assay_index") -> DataFrame:
    """Index by frequency, most frequent first, ties by name."""
    counts = act.groupBy(col).agg((-F.count(F.lit(1))).alias("_neg"))
    return ordered_position(materialise(counts, "property-counts"), ["_neg", col], out, start=0).select(col, (-F.col("_neg")).alias("n"), out)


def label_index(df: DataFrame, col: str, out: str, offset: int = 0) -> DataFrame:
    """Alphabetical index; ``offset`` moves new labels past ids already given out."""
    return ordered_position(df.select(col).distinct(), [col], out, start=offset)


def vocab_sizes(data: DataFrame) -> DataFrame:
    """Number of property and value ids, both maxima in one pass."""
    return data.agg((F.max("assay_index") + 1).cast("bigint").alias("n_assays"),
                    (F.max("value") + 1).cast("bigint").alias("n_values"))


def id_space(n_symbols: int, n_assays: int, n_values: int) -> dict[str, int]:
    """Offsets of the joint id space: symbols, properties, values, separator, end."""
    sep = n_symbols + n_assays + n_values
    return {"n_symbols": n_symbols, "n_assays": n_assays, "n_values": n_values, "pad": PAD_ID,
            "sep": sep, "end": sep + 1, "size": sep + 2}


def write_id_space(spark: SparkSession, meta: dict[str, int], path: str) -> str:
    """The offsets as a one-row table beside the vocabulary, so that token ids can be read in a later job."""
    spark.range(1, numPartitions=1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in meta.items()]).write.mode("overwrite").parquet(path)
    return path


def read_id_space(spark: SparkSession, path: str) -> dict[str, int]:
    return spark.read.parquet(path).first().asDict()


def id_space_of(vocab: DataFrame, data: DataFrame) -> dict[str, int]:
    sizes = vocab_sizes(data).first()
    return id_space(vocab.count(), sizes["n_assays"], sizes["n_values"])


def assay_token(meta: dict[str, int], assay_index: Column) -> Column:
    return assay_index.cast("bigint") + F.lit(meta["n_symbols"])


def value_token(meta: dict[str, int], value: Column) -> Column:
    return value.cast("bigint") + F.lit(meta["n_symbols"] + meta["n_assays"])


def token_ids(df: DataFrame, meta: dict[str, int]) -> DataFrame:
    return df.withColumn("property_token", assay_token(meta, F.col("assay_index"))) \
             .withColumn("value_token", value_token(meta, F.col("value")))
