"""The registered queries beside their SQL, and odd documents through every query and stage."""

import pytest
from compare import difference, duck, duck_table, spark_table

import corpus_pipeline
from propweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(spark_table(QUERIES[name](spark, SF)), duck_table(duck(SF), ORACLES[name])) is None


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    long = "lorem ipsum dolor sit amet " * 8000
    docs = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (3, "", "en", None, 0),
            (None, "x password=abcdefghijklmnop", "en", "s", 5), (4, long, "en", "t", 1), (5, long + "x", "en", "t", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (None, None), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(None, None, None, None), (1, 0, "assistant", "hi")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


ROWS = {"op1_suffix_tree_scores": 7, "op2_latent_decontamination": 0, "op4_chosen_path_join": 7, "op5_chat_formatting": 3,
        "op6_compression_quality": 7, "op7_pu_toxicity": 7, "op8_secret_scan": 7, "op9_exact_dedup": 7, "op10_rendezvous_sharding": 7, "op11_spelling_variants": 3,
        "op12_phrase_collocations": 5, "op13_byte_pair_trie": 7}


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_rows(spark, odd_tables, name):
    n = QUERIES[name](spark, odd_tables).count()
    assert n == ROWS[name] if name in ROWS else n >= 7


def test_odd_rows_through_the_pipeline(spark, odd_tables):
    assert corpus_pipeline.run(spark, odd_tables).count() >= 3
