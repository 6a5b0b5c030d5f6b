"""The SQL surface: operators as temporary functions, the catalogue as views and a table function.

After ``register`` a session's SQL can call them by name; each is SQL itself, so the optimizer
sees through it and no Python runs. ``catalog_views`` puts the stored relations of a catalogue
under their names and defines the lookup of a structure's known values.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name -> (parameters, result, body).
FUNCTIONS = {
    "symbols_of": ("text STRING", "ARRAY<STRING>", r"regexp_extract_all(text, '(\\[[^\\]]*\\]|.)', 1)"),
    "bracketed": ("text STRING", "STRING", "regexp_replace(text, '(.)', '[$1]')"),
    "value_code": ("value INT", "STRING", "CASE value WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'unknown' END"),
    "heat_code": ("p DOUBLE", "INT", "CASE WHEN p <= 0.6D THEN 0 WHEN p <= 0.7D THEN 1 ELSE 2 END"),
    "rebalanced": ("p DOUBLE, at DOUBLE", "DOUBLE", "CASE WHEN p <= at THEN p / (2 * at) ELSE 0.5D + (p - at) / (2 * (1 - at)) END"),
    "sigmoid": ("x DOUBLE", "DOUBLE", "1D / (1D + exp(-x))"),
    "pair_list": ("pairs ARRAY<STRUCT<assay_index: BIGINT, value: INT>>", "STRING",
                  "array_join(transform(pairs, p -> concat(p.assay_index, '=', p.value)), ' ')"),
}

#: The known values of a structure, one row per value and category.
KNOWN_VALUES = """CREATE OR REPLACE TEMPORARY FUNCTION known_values(asked STRING)
RETURNS TABLE (source STRING, structure STRING, property_token BIGINT, category STRING, strength DOUBLE, value INT)
RETURN SELECT s.source, a.inchi, p.property_token, c.category, b.strength, a.binary_value
FROM activity a JOIN source s ON a.source_id = s.source_id JOIN property p ON a.property_id = p.property_id
JOIN property_category b ON p.property_id = b.property_id JOIN category c ON b.category_id = c.category_id
WHERE a.inchi = known_values.asked"""


def register(spark: SparkSession) -> list[str]:
    """Defines the functions in the session; their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)


def catalog_views(spark: SparkSession, paths: dict[str, str]) -> None:
    """The relations of ``catalog.write_catalog`` as views, and ``known_values(structure)``."""
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    spark.sql(KNOWN_VALUES)
