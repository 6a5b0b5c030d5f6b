from conftest import rows
from pyspark.sql import functions as F

from propweave.operators import clean


def test_json_null_and_alternatives(spark):
    df = spark.createDataFrame([(1, '{"inchi":"A"}'), (2, '{"inchi":null,"Ligand InChI":"B"}'), (3, '{"x":1}'), (4, None)],
                               "sid int, data string")
    out = clean.json_coalesce(df, "data", {"inchi": ["$.inchi", "$.Ligand InChI"]})
    assert rows(out.select("sid", F.coalesce("inchi", F.lit("-")))) == [(1, "A"), (2, "B"), (3, "-"), (4, "-")]


def test_clean_substances_is_distinct_and_drops_missing(spark):
    data = '{"SMILES":"CC","inchi":"I"}'
    df = spark.createDataFrame([(1, data), (1, data), (2, '{"inchi":"J"}'), (3, "{}")], "sid int, data string")
    out = clean.clean_substances(df, "data", {"inchi": ["$.inchi"], "smiles": ["$.SMILES"]},
                                 F.concat(F.lit("from-"), F.col("inchi")), F.col("smiles"))
    assert rows(out.select("sid", "smiles")) == [(1, "CC"), (2, "from-J")]


def test_consistent_values_ignore_null(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 1, 1), (2, 1, None), (3, 1, 0), (3, 1, 1), (4, 1, 0), (4, 1, 0)],
                               "sid int, assay int, value int")
    assert rows(clean.consistent_values(df)) == [(1, 1, 1), (4, 1, 0)]


def test_pivot_counts_missing_class_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "assay int, value int")
    assert rows(clean.assay_pivot_counts(df)) == [(1, 2, 0), (2, 0, 1)]


def test_balance_keeps_the_bound(spark):
    # 95 : 5 has an imbalance of exactly 0.9 and stays, 96 : 4 goes
    df = spark.createDataFrame([(1, int(i < 5)) for i in range(100)] + [(2, int(i < 4)) for i in range(100)],
                               "assay int, value int")
    assert [r["assay"] for r in clean.balanced_assays(df, 1, 0.9).collect()] == [1]


def test_restrict_does_not_multiply(spark):
    act = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "sid int, assay int, value int")
    kept = spark.createDataFrame([(1,), (1,)], "assay int")
    assert clean.restrict(act, kept).count() == 2


def test_dedupe_and_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    assert rows(clean.dedupe_subset(df, ["k"], ["o"]))[0] == ("a", 1, "y")
    d2 = spark.createDataFrame([("a", 1, None, 7), ("a", 2, "p", None), ("a", 3, "q", 9)], "k string, o int, v string, w int")
    r = clean.first_per_key(d2, "k", "o").first()
    assert (r["v"], r["w"]) == ("p", 7)


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(clean.quality_checks(df, ["a", "b"], 1)) == [("a", "int", 0, 2, 1), ("b", "string", 1, 2, 1)]


def test_validity(spark):
    df = spark.createDataFrame([("abc",), ("",), ("ab!",), ("a" * 11,), (None,)], "t string")
    assert rows(clean.validity_filter(df, "t", "a-z", 10)) == [("abc",)]


def test_novelty_and_rates(spark):
    made = spark.createDataFrame([("a",), ("a",), ("b",), ("c!",)], "t string")
    known = spark.createDataFrame([("b",), ("b",)], "t string")
    assert rows(clean.novel_items(made, [known], "t")) == [("a",), ("c!",)]
    r = clean.quality_rates(made, known, "t", "a-z", 5).first()
    assert (r["n"], r["validity"], r["novelty"]) == (4, 0.75, 0.75)


def test_a_newline_at_the_end_is_no_valid_character(spark):
    df = spark.createDataFrame([("abc",), ("abc\n",), ("ab c",), ("",)], "t string")
    assert [r["t"] for r in clean.validity_filter(df, "t", "a-z").collect()] == ["abc"]


def test_each_text_is_parsed_once(spark):
    """Malformed texts, JSON nulls, keys with spaces, numbers and nested values."""
    texts = ['{"a b": "x", "n": 1}', '{"a b": null, "n": 2.5}', '{"n": true}', "{broken", "", None, "null", "[1]", '{"o": {"a b": "y"}, "n": {"k": 1}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, data string")
    got = clean.json_coalesce(df, "data", {"x": ["$.a b", "$.o.a b"], "n": ["$.n"]})
    assert [(r["x"], r["n"]) for r in got.orderBy("i").collect()] == [
        ("x", "1"), (None, "2.5"), (None, "true"), *[(None, None)] * 5, ("y", '{"k":1}')]
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") <= 2
