"""Property catalogue: dimensions with surrogate keys, star joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from propweave.operators.ordering import ordered_position
from propweave.sources.scratch import materialise
from propweave.sources.layout import write_z_ordered
from propweave.sources.tables import write_table


def surrogate(df: DataFrame, name: str, id_name: str) -> DataFrame:
    """(name, id): ids in name order, the same on every run."""
    return ordered_position(df.select(name).filter(F.col(name).isNotNull()).distinct(), [name], id_name, start=0)


def build_catalog(prop: DataFrame, pcat: DataFrame, act: DataFrame, subs: DataFrame, value_base: int) -> dict[str, DataFrame]:
    """Five relations from a property table with source names, a category bridge, the activities and the substances.

    The activity relation has an id of its own, the structure texts and the value's token
    (``value_base`` + value), so that it can be asked by structure. Ids are positions in key
    order. Dimension sides are left to the optimizer, which broadcasts them when their
    measured size is below its threshold and shuffles otherwise.
    """
    category = surrogate(pcat, "category", "category_id")
    source = surrogate(prop, "source", "source_id")
    bridge = pcat.join(category, "category").select("property_id", "category_id", "reason", "strength")
    props = prop.join(source, "source").select("property_id", "title", "property_token", "source_id", "data")
    activity = act.join(props.select("property_id", "property_token", "source_id"), "property_id").join(
        subs.select("sid", "inchi", "smiles"), "sid", "left")
    activity = activity.withColumn("value_token", F.col("value").cast("bigint") + value_base).withColumnRenamed("value", "binary_value")
    activity = ordered_position(materialise(activity, "activity"), ["sid", "property_id"], "activity_id", start=0)
    return {"category": category, "source": source, "property_category": bridge, "property": props,
            "activity": activity}


def activities_of(activity: DataFrame, structures: DataFrame, column: str = "smiles") -> DataFrame:
    """The activities of the asked structures: a lookup by text, not by internal id."""
    return activity.join(structures.select(column).distinct(), column, "left_semi")


def write_catalog(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One Parquet table per relation.

    Activities are asked by substance, property and structure: their files are ranges of the
    first two together, with bloom filters on the texts. Of the others rows are sorted by the
    lookup column inside each file.
    """
    sort = {"property": ["property_id"], "property_category": ["property_id"]}
    paths = {n: write_table(df, f"{folder}/{n}", sort=sort.get(n)) for n, df in tables.items() if n != "activity"}
    paths["activity"] = write_activity(tables["activity"], f"{folder}/activity")
    return paths


def write_activity(activity: DataFrame, path: str, files: int | None = None) -> str:
    return write_z_ordered(activity, path, ["sid", "property_token"], bloom=["smiles", "inchi"], files=files)


def property_source(prop: DataFrame, source: DataFrame) -> DataFrame:
    return prop.join(source, "source_id").select("property_token", "title", "source")


def property_category(prop: DataFrame, bridge: DataFrame, source: DataFrame) -> DataFrame:
    return (prop.join(bridge, "property_id").join(source, "source_id")
                .select("source", "property_id", "property_token", "title", "category", "reason", "strength"))


def known_properties(requests: DataFrame, act: DataFrame, prop: DataFrame, bridge: DataFrame, source: DataFrame,
                     category: str | None = None) -> DataFrame:
    """Known values of the requested substances, one row per value, with source and list of categories.

    A request list is a table, not a loop. A property without category keeps its values, with
    an empty list; ``category`` keeps only properties that have it.
    """
    one = F.struct("category", "strength")
    cats = bridge.groupBy("property_id").agg(F.sort_array(F.collect_list(one)).alias("categories"))
    empty = F.array().cast(cats.schema["categories"].dataType)
    wide = prop.join(source, "source_id").join(cats, "property_id", "left").withColumn("categories", F.coalesce("categories", empty))
    if category is not None:
        wide = wide.filter(F.exists("categories", lambda c: c["category"] == category))
    return (act.join(requests.select("sid").distinct(), "sid", "left_semi")
               .withColumnRenamed("assay", "property_id").join(wide, "property_id")
               .select("sid", "source", "property_token", "categories", "value"))


def property_catalog(prop: DataFrame, bridge: DataFrame, source: DataFrame) -> DataFrame:
    """Each property once, with the list of its categories; a property without any keeps an empty list."""
    cat = F.struct("category", "reason", "strength")
    cats = bridge.groupBy("property_id").agg(F.sort_array(F.collect_list(cat)).alias("categories"))
    empty = F.array().cast(cats.schema["categories"].dataType)
    return (prop.join(source, "source_id").join(cats, "property_id", "left")
                .select("property_token", "title", "source", "data", F.coalesce("categories", empty).alias("categories")))


def catalog_metadata(prop: DataFrame, schema: str) -> DataFrame:
    return prop.select("property_token", F.from_json("data", schema).alias("metadata"))
