"""Property-analytics tables read from the given star-schema tables.

A part is a substance, a supplier is a property (assay), a line item is one activity row;
nations are sources and part types are hazard categories.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from propweave.functions.symbols import bracketed
from propweave.operators.clean import consistent_values
from propweave.operators.dataset import nest_pairs, split_by_hash
from propweave.operators.dataset import encode_pairs
from propweave.operators.metrics import binary_metrics
from propweave.operators.vocab import encode_symbols, fit_vocab, id_space, property_index
from propweave.sources.scratch import materialise
from propweave.sources.tables import scan, spread


def active() -> Column:
    """Returned items count as positive."""
    return F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("value")


def family_of(part: str) -> Column:
    """Sixteen neighbouring parts are a family, so that families grow in number and not in size."""
    return F.concat(F.lit("F"), family_number(part))


def family_number(part: str) -> Column:
    return F.floor(F.col(part) / 16).cast("bigint")


class Tables:
    """Views over one data folder; each is built only when a query asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str, *columns: str) -> DataFrame:
        return scan(self.spark, f"{self.dir}/{name}.parquet", *columns)

    def docs(self) -> DataFrame:
        """Whole texts, spread over the cores where the file layout gives fewer tasks than there are cores."""
        return spread(self.raw("documents", "doc_id", "text"))

    @cached_property
    def act(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_partkey").alias("sid"), F.col("l_suppkey").alias("assay"), active())

    @cached_property
    def cons(self) -> DataFrame:
        return consistent_values(self.act)

    @cached_property
    def prop(self) -> DataFrame:
        data = F.concat(F.lit('{"unit":"u'), F.col("s_nationkey"), F.lit('","rank":'), F.col("s_suppkey"), F.lit("}"))
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("property_id"), F.col("s_name").alias("title"),
            (F.col("s_suppkey") + 8).alias("property_token"), F.col("s_nationkey").alias("source_id"), data.alias("data"))

    @cached_property
    def src(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source"))

    @cached_property
    def pcat(self) -> DataFrame:
        li = self.raw("lineitem", "l_partkey", "l_suppkey").join(
            self.raw("part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        n = li.groupBy(F.col("l_suppkey").alias("property_id"), F.col("p_type").alias("category")).agg(
            F.count(F.lit(1)).alias("n"))
        top = F.max("n").over(W.partitionBy("property_id"))  # a handful of categories per property
        return n.select("property_id", "category", F.concat(F.lit("n="), F.col("n")).alias("reason"),
                        ((F.lit(10) * F.col("n")).cast("double") / top).alias("strength"))

    @cached_property
    def pred(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("chemical_id"), (F.col("l_linenumber") - 1).alias("nprops"),
            F.col("l_suppkey").alias("assay"), active(), (F.col("l_quantity") / 50.0).alias("probs"))

    @cached_property
    def met(self) -> DataFrame:
        return binary_metrics(self.pred, ["nprops", "assay"], "value", "probs", "chemical_id", min_pos=25)

    @cached_property
    def sub(self) -> DataFrame:
        smiles = F.concat_ws("|", "p_name", "p_type", "p_brand", F.col("p_size").cast("string"))
        return self.raw("part").select(F.col("p_partkey").alias("sid"), smiles.alias("smiles")) \
                   .withColumn("symbols", bracketed("smiles"))

    @cached_property
    def voc(self) -> DataFrame:
        return fit_vocab(self.sub, "symbols")

    @cached_property
    def stored(self) -> DataFrame:
        """The cleaned activities as a stored stage: index, sizes and nesting all read it."""
        return materialise(self.cons, "activities")

    @cached_property
    def pix(self) -> DataFrame:
        return property_index(self.stored)

    @cached_property
    def data(self) -> DataFrame:
        return self.stored.join(self.pix.select("assay", "assay_index"), "assay")

    @cached_property
    def meta(self) -> dict[str, int]:
        n_values = self.stored.agg(F.max("value")).first()[0] + 1
        return id_space(self.voc.count(), self.pix.count(), n_values)

    @cached_property
    def nest(self) -> DataFrame:
        return nest_pairs(self.data)

    @cached_property
    def enc(self) -> DataFrame:
        return encode_symbols(self.sub, self.voc, "symbols", "encoded")

    @cached_property
    def examples(self) -> DataFrame:
        rows = encode_pairs(self.nest, self.meta).join(self.enc.select("sid", "encoded"), "sid")
        return split_by_hash(rows).select("sid", "split", "encoded", "assay_vals")

    @cached_property
    def cons_split(self) -> DataFrame:
        return split_by_hash(self.cons, weights=(0.5, 0.1, 0.4))

    @cached_property
    def trn(self) -> DataFrame:
        return self.cons_split.filter("split = 'trn'").drop("split")

    @cached_property
    def hld(self) -> DataFrame:
        return self.cons_split.filter("split = 'hld'").drop("split")

    @cached_property
    def fam_act(self) -> DataFrame:
        return self.raw("lineitem").select(family_of("l_partkey").alias("sid"), F.col("l_suppkey").alias("assay"), active(),
                         "l_quantity")

    @cached_property
    def fam(self) -> DataFrame:
        return consistent_values(self.fam_act)

    @cached_property
    def families(self) -> DataFrame:
        """The families' values as a stored stage: conditional table, priors, contexts and requests all read it.

        They are grouped by the family's number, which is shorter in a shuffle than its name.
        """
        act = self.raw("lineitem").select(family_number("l_partkey").alias("sid"), F.col("l_suppkey").alias("assay"), active())
        return materialise(consistent_values(act).withColumn("sid", F.concat(F.lit("F"), F.col("sid"))), "families")

    @cached_property
    def fam_pred(self) -> DataFrame:
        return self.fam_act.groupBy(F.col("sid").alias("name"), F.col("assay").alias("property_id")).agg(
            F.round(F.avg("l_quantity") / 50, 9).alias("prediction"))

    @cached_property
    def alt(self) -> DataFrame:
        """Candidate predictions with known values, source and categories."""
        known = self.fam.select(F.col("sid").alias("name"), F.col("assay").alias("property_id"), "value")
        return (self.fam_pred.join(known, ["name", "property_id"], "left")
                    .join(self.prop.join(self.src, "source_id").select(
                        "property_id", "property_token", F.col("title").alias("property_title"), "source"), "property_id")
                    .join(self.pcat.select("property_id", "category", "strength"), "property_id"))

    @cached_property
    def log(self) -> DataFrame:
        return self.raw("events").select(F.col("event_type").alias("type"), F.col("event_id").alias("batch"),
                                         F.col("value").alias("loss"), F.lit(0.001).alias("lr"))

    @cached_property
    def emb(self) -> DataFrame:
        """Every vector, with its block (label modulo 5) and binary class (label of 5 and above)."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") % 5).alias("block"),
            F.when(F.col("label") >= 5, 1).otherwise(0).alias("cls"), F.when(F.col("label") >= 5, 1).otherwise(0).alias("value"))

    @cached_property
    def lab(self) -> DataFrame:
        return self.raw("labels").unpivot("doc_id", ["quality", "toxic"], "assay", "value")
