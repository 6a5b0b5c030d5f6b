import pytest
from conftest import rows
from pyspark.sql import functions as F

from propweave.functions import arrays as A, symbols as S
from propweave.operators import dataset as d, vocab as v


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "[C][N]"), (2, "[N][O][O]"), (3, None), (4, "")], "sid bigint, s string")


def test_encode_decode_identity(spark, texts):
    voc = v.fit_vocab(texts, "s")
    assert rows(voc)[:3] == [("<eos>", 2), ("<pad>", 0), ("<sos>", 1)]
    enc = v.encode_symbols(texts, voc, "s", "e", 6)
    got = {r["sid"]: r["e"] for r in enc.collect()}
    assert got == {1: [1, 3, 4, 2, 0, 0], 2: [1, 4, 5, 5, 2, 0], 3: [0] * 6, 4: [1, 2, 0, 0, 0, 0]}
    back = {r["sid"]: r["t"] for r in v.decode_symbols(enc, voc, "e", "t").collect()}
    assert back[1] == "[C][N]" and back[2] == "[N][O][O]"


@pytest.mark.parametrize("extra", [0, 300])
def test_equal_keys_and_nulls_at_any_vocabulary_size(spark, extra):
    """Rows of one key are not mixed, NULL stays NULL, whatever the number of symbols."""
    more = [(9, "".join(f"[x{i}]" for i in range(extra)))] if extra else []
    df = spark.createDataFrame([(1, "[C][N]"), (1, "[N][O][O]"), (1, None), (None, "[C]")] + more, "sid bigint, s string")
    voc = v.fit_vocab(df, "s")
    enc = v.encode_symbols(df, voc, "s", "e", None)
    ids = {r["s"]: r["e"] for r in enc.collect()}
    n = {r["symbol"]: r["index"] for r in voc.collect()}
    assert ids["[C][N]"] == [1, n["[C]"], n["[N]"], 2] and ids["[N][O][O]"] == [1, n["[N]"], n["[O]"], n["[O]"], 2] and ids[None] == []
    assert enc.count() == 4 + len(more)
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [n["[C]"]])], "sid bigint, e array<bigint>")
    assert [r["t"] for r in v.decode_symbols(nulls, voc, "e", "t").orderBy("sid").collect()] == [None, "", "[C]"]
    assert v.decode_mixed(nulls, voc, "e", "m", len(n)).filter("sid = 1").first()["m"] is None
    chars = v.char_encode(df, v.char_vocab(df, "s"), "s", "c", 130)
    assert {len(r["c"]) if r["c"] else None for r in chars.collect()} == {130, None}


def test_char_encode_encodes_rows_where_they_are(spark):
    df = spark.createDataFrame([(1, "ab\U0001F600"), (2, None), (3, ""), (4, "bxa")], "sid int, s string")
    voc = spark.createDataFrame([(" ", 0), ("a", 1), ("b", 2), ("\U0001F600", 7), ("ab", 9)], "symbol string, index bigint")
    out = v.char_encode(df, voc, "s", "c", 4)
    assert {r["sid"]: r["c"] for r in out.collect()} == {1: [1, 2, 7, 0], 2: None, 3: [0] * 4, 4: [2, None, 1, 0]}
    assert "Exchange" not in out._jdf.queryExecution().toString()  # no row is taken apart and put together again


def test_id_space_is_stored(spark, tmp_path):
    meta = v.id_space(10, 5, 2)
    assert v.read_id_space(spark, v.write_id_space(spark, meta, str(tmp_path / "m"))) == meta


def test_unknown_is_pad_and_cut_loses_end(spark, texts):
    voc = v.fit_vocab(texts.filter("sid = 1"), "s")
    got = {r["sid"]: r["e"] for r in v.encode_symbols(texts, voc, "s", "e", 4).collect()}
    assert got[2] == [1, 4, 0, 0] and got[1] == [1, 3, 4, 2]
    assert v.encode_symbols(texts, voc, "s", "e", 3).filter("sid = 1").first()["e"] == [1, 3, 4]


def test_special_in_data_leaves_no_hole(spark):
    df = spark.createDataFrame([("[A]",), ("<",)], "s string")
    assert sorted(r["index"] for r in v.fit_vocab(df, "s").collect()) == [0, 1, 2, 3, 4]


def test_greedy_tokens(spark):
    df = spark.createDataFrame([("CCl@@?",)], "s string")
    ids = v.greedy_tokens(df, "s", "t", 10).first()["t"]
    n = S.notation_ids()
    assert ids == [n["^"], n["C"], n["Cl"], n["@@"], n[" "], n["$"]] + [n[" "]] * 4
    assert len(set(S.NOTATION)) == len(S.NOTATION)


def test_property_index_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "assay string")
    assert rows(v.property_index(df)) == [("a", 1, 1), ("b", 1, 2), ("c", 2, 0)]


def test_new_labels_start_past_old(spark):
    df = spark.createDataFrame([("x",), ("y",)], "l string")
    assert rows(v.label_index(df, "l", "i", offset=40)) == [("x", 40), ("y", 41)]


def test_id_space():
    m = v.id_space(10, 5, 2)
    assert (m["sep"], m["end"], m["size"]) == (17, 18, 19)


@pytest.fixture(scope="module")
def nested(spark):
    data = [(1, a, a % 2) for a in range(4)] + [(2, 3, 1)]
    return d.nest_pairs(spark.createDataFrame(data, "sid bigint, assay_index bigint, value int"))


META = {"n_symbols": 10, "n_assays": 5, "n_values": 2, "pad": 0, "sep": 17, "end": 18, "size": 19}


def test_pair_tokens_and_long_rows(spark, nested):
    enc = d.encode_pairs(nested, META)
    assert enc.filter("sid = 2").first()["assay_vals"] == [17, 13, 16, 18]
    both = d.pad_to_max(enc, "assay_vals", "assay_vals").withColumn("encoded", F.array(F.lit(1), F.lit(2)))
    long = d.shards_to_long(both, keep=("sid",))
    assert rows(long.select("sid", "assay", "value")) == [(1, 10, 15), (1, 11, 16), (1, 12, 15), (1, 13, 16), (2, 13, 16)]


def test_training_example_shape(spark, nested):
    ex = {r["sid"]: r for r in d.training_examples(nested, META, nprops=3).collect()}
    out, tch = ex[1]["output"], ex[1]["teacher"]
    assert len(out) == 8 and out[0] == 17 and out[7] == 18 and tch == [1] + out[:-1]
    assert ex[2]["output"] == [17, 13, 16, 18, 0, 0, 0, 0]
    pairs = {tuple(out[i:i + 2]) for i in (1, 3, 5)}
    assert len(pairs) == 3 and pairs <= {(10, 15), (11, 16), (12, 15), (13, 16)}


def test_eval_rows_keep_their_substance(spark, nested):
    ev = d.eval_rows(nested, 3)
    assert ev.count() == 2 * 6 * 3 and {r["sid"] for r in ev.collect()} == {1}  # four pairs, three at a time
    assert {r["assay"] for r in ev.collect()} == {0, 1, 2, 3}
    assert d.eval_rows(nested, 3, passes=1).count() == 6 * 3
    new = d.skip_seen(ev.filter("pass > 0"), ev.filter("pass = 0"), ["sid", "prior_assays"])
    old = {r["prior_assays"] for r in ev.filter("pass = 0").collect()}
    assert {r["prior_assays"] for r in new.collect()} == {r["prior_assays"] for r in ev.collect()} - old
    assert ev.filter("nprops = 2").first()["prior_assays"].count(" + ") == 2


def test_mask_never_first(spark, nested):
    enc = d.encode_pairs(nested, META)
    all_masked = d.mask_tokens(enc, "assay_vals", "m", "sid", p=1.1).filter("sid = 2").first()["m"]
    assert all_masked == [17, 0, 0, 0]
    values_only = d.mask_tokens(enc, "assay_vals", "m", "sid", p=1.1, only_from=15).filter("sid = 2").first()["m"]
    assert values_only == [17, 13, 0, 0]


def test_splits_are_disjoint_and_cover(spark):
    df = d.split_by_hash(spark.range(2000).withColumnRenamed("id", "sid"))
    n = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert sum(n.values()) == 2000 and 1500 < n["trn"] < 1700
    parts = {s: df.filter(F.col("split") == s) for s in n}
    assert d.split_overlap(parts["trn"], parts["hld"]).first()["n_shared"] == 0


def test_array_functions(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "a array<bigint>")
    one = F.lit(1).cast("bigint")
    r = df.select(A.chunk_pairs("a", "x", "y").alias("c"), A.shift_left("a", F.lit(0).cast("bigint")).alias("l"),
                  A.shift_right("a", one).alias("r"), A.prefixes("a").alias("p"), A.one_hot(F.lit(2), 4).alias("h")).first()
    assert [tuple(x) for x in r["c"]] == [(1, 2), (3, 4)]
    assert r["l"] == [2, 3, 4, 5, 0] and r["r"] == [1, 1, 2, 3, 4] and r["p"][1] == [1, 2] and r["h"] == [0, 0, 1, 0]


def test_empty_partition_shards(spark, tmp_path):
    df = spark.createDataFrame([(1, "trn")], "sid bigint, split string").repartition(8)
    path = d.write_shards(df, str(tmp_path / "s"))
    assert d.read_shards(spark, path).count() == 1
