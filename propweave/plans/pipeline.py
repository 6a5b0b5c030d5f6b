"""The end-to-end batch job: a graph of stages, each stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from propweave.functions import symbols
from propweave.operators import catalog as cat, clean, dataset, metrics, reports, scoring, vocab
from propweave.plans import fixtures
from propweave.plans.fixtures import Tables
from propweave.sources.scratch import scratch_path
from propweave.sources.stages import Stages

SPLIT = (0.5, 0.1, 0.4)


def _substances(raw: DataFrame) -> DataFrame:
    return clean.clean_substances(raw, "data", {"inchi": ["$.inchi", "$.Ligand InChI"], "smiles": ["$.SMILES", "$.Ligand SMILES"]},
                                  F.col("inchi"), symbols.bracketed("smiles"))


def _raw(part: DataFrame) -> DataFrame:
    """The JSON column of the raw substances is made from the part table; the rest is the same for real inputs."""
    return part.select(F.col("p_partkey").alias("sid"), F.to_json(F.struct(
        F.concat_ws("|", "p_name", "p_type", "p_brand", "p_size").alias("SMILES"))).alias("data"))


def _vocab(subs: DataFrame) -> DataFrame:
    return vocab.fit_vocab(subs, "symbols")


def _encoded(subs: DataFrame, voc: DataFrame) -> DataFrame:
    return vocab.encode_symbols(subs, voc, "symbols", "encoded").select("sid", "encoded")


def _meta(cons: DataFrame, voc: DataFrame) -> tuple[DataFrame, dict]:
    data = cons.join(vocab.property_index(cons).select("assay", "assay_index"), "assay")
    return data, vocab.id_space_of(voc, data)


def _examples(cons: DataFrame, enc: DataFrame, voc: DataFrame, weights: list) -> DataFrame:
    data, meta = _meta(cons, voc)
    rows = dataset.encode_pairs(dataset.nest_pairs(data), meta).join(enc, "sid")
    return dataset.split_by_hash(rows, weights=tuple(weights))


def _long(examples: DataFrame, cons: DataFrame, voc: DataFrame) -> DataFrame:
    meta = _meta(cons, voc)[1]
    long = dataset.shards_to_long(examples, keep=("sid", "split"))
    return long.select("sid", "split", "assay", (F.col("value") - meta["n_symbols"] - meta["n_assays"]).cast("int").alias("value"))


def _split(long: DataFrame, name: str) -> DataFrame:
    return long.filter(F.col("split") == name).select("sid", "assay", "value")


def _metrics(long: DataFrame) -> DataFrame:
    trn, hld = _split(long, "trn"), _split(long, "hld")
    shared = dataset.split_overlap(trn, hld).first()["n_shared"]
    if shared:
        raise ValueError(f"{shared} substances are in both splits")
    return scoring.eval_by_nprops(trn, hld)


def _report(scored: DataFrame, catalog: dict, cons: DataFrame, voc: DataFrame) -> DataFrame:
    data, meta = _meta(cons, voc)
    names = data.select("assay", vocab.assay_token(meta, F.col("assay_index")).alias("target")).distinct()
    dims = catalog["property"].join(catalog["source"], "source_id")
    named = scored.join(names, "target").join(dims.select(F.col("property_id").alias("assay"), "source"), "assay")
    out = reports.median_metrics(named, ["source", "nprops"], ["auc"])
    return out.withColumn("auc", F.round("auc", 6))


def job(spark: SparkSession, sf_dir: str, folder: str, min_per_class: int = 200, weights: tuple[float, ...] = SPLIT) -> Stages:
    """Clean, fit, filter, nest, split, evaluate on the held-out part, build the catalogue, report medians by source.

    Stages that stand in ``folder`` with the same inputs, code and parameters are read.
    """
    t, s = Tables(spark, sf_dir), Stages(spark, folder)
    for name in ("part", "lineitem", "supplier", "nation"):
        s.source(name, f"{sf_dir}/{name}.parquet")

    # the fixture tables are views over the inputs named
    def substances(part: DataFrame) -> DataFrame:
        return _substances(_raw(part))

    def activities(lineitem: DataFrame, subs: DataFrame, min_per_class: int) -> DataFrame:
        act = t.act.join(subs.select("sid"), "sid", "left_semi")
        return clean.consistent_values(clean.restrict(act, clean.balanced_assays(act, min_per_class)))

    def catalog(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame, cons: DataFrame, subs: DataFrame, voc: DataFrame) -> dict:
        meta = _meta(cons, voc)[1]
        return cat.build_catalog(t.prop.join(t.src, "source_id").drop("source_id"), t.pcat, cons.withColumnRenamed("assay", "property_id"), subs,
                                 meta["n_symbols"] + meta["n_assays"])

    s.stage("substances", substances, ["part"], (clean, symbols))
    s.stage("vocab", _vocab, ["substances"], (vocab,))
    s.stage("encoded", _encoded, ["substances", "vocab"], (vocab,))
    s.stage("activities", activities, ["lineitem", "substances"], (clean, fixtures), min_per_class=min_per_class)
    s.stage("examples", _examples, ["activities", "encoded", "vocab"], (dataset, vocab), weights=list(weights))
    s.stage("long", _long, ["examples", "activities", "vocab"], (dataset,))
    s.stage("catalog", catalog, ["lineitem", "part", "supplier", "nation", "activities", "substances", "vocab"], (cat, fixtures))
    s.stage("metrics", _metrics, ["long"], (scoring, metrics))
    s.stage("report", _report, ["metrics", "catalog", "activities", "vocab"], (reports,))
    return s


def run_pipeline(spark: SparkSession, sf_dir: str, min_per_class: int = 200, folder: str | None = None) -> DataFrame:
    """The job's report; without a folder all is worked out."""
    return job(spark, sf_dir, folder or scratch_path(spark, "pipeline"), min_per_class).tables["report"]
