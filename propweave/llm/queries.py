"""The operators applied to their whole tables, reduced to the columns their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from propweave.llm import bpe, chat, chosen_path, decontaminate, exact_dedup, mixing, phrases, quality, secrets, sharding, suffix_tree, toxicity, variants
from propweave.llm.samples import key_crc
from propweave.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def _escaped(text: str) -> str:
    """SQL for an escaped text."""
    sql = f"replace({text}, '{chat.ESC}', '{chat.ESC}0')"
    for control, pair in chat.PAIRS:
        sql = f"replace({sql}, '{control}', '{pair}')"
    return sql


@query("op5_chat_formatting", f"""
with turns as (
    select conv_id, turn, role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
    coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn), '')) as loss_sha256,
    sum({len(chat.OPEN)} + length(role) + 1 + length({_escaped("text")}) + {len(chat.CLOSE)} + 1)::bigint as formatted_chars
from turns group by conv_id
""")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(probe).alias("text"))
    rows = turns.unionByName(more).withColumn("parts", chat.text_parts(F.col("text")))
    back = chat.parse_chat(chat.format_chat(rows))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op8_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = lambda: F.filter("found", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "entropy")],
        F.sha2(line(base()), 256).alias("base_sha256"), line("found").alias("spans"))


@query("op9_exact_dedup", r"""
with norm as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
digest as (select doc_id, sha256(t) as text_sha256 from norm)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
    row_number() over (partition by text_sha256 order by doc_id) = 1 as kept, text_sha256
from digest window g as (partition by text_sha256)
""")
def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def _winner(shards: int) -> str:
    """SQL for the shard of the largest draw; with equal weights the score grows with the draw."""
    draws = ", ".join(f"('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{j}'), 1, 13))::bigint" for j in range(shards))
    return f"list_position([{draws}], list_max([{draws}])) - 1"


@query("op10_rendezvous_sharding", f"""
with recursive crc as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
        case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t),
texts as (select doc_id, coalesce(text, '') as x, hex(encode(coalesce(text, ''))) as h from documents),
bytes as (select doc_id, octet_length(encode(x)) + 1 as size,
    list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint) as b from texts),
sums as (select doc_id, size, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) as text_crc32
    from bytes, crc),
dealt as (select *, {_winner(16)} as shard, {_winner(17)} as grown_shard from sums)
select doc_id, size, text_crc32, 'key' as law, shard, grown_shard, row_number() over
    (partition by shard order by md5(coalesce(doc_id::varchar, '')), doc_id, size, text_crc32) - 1 as slot from dealt
""")
def rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.manifest(read(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)


def _classified(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_latent_decontamination")
def latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = decontaminate.fit(docs, read(spark, sf_dir, "benchmark"))
    return decontaminate.search(docs, index).select("doc_id", F.inline("matches"))


@query("op3_temperature_mixing")
def temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", F.col("mix_tokens").alias("tokens"), F.col("mix_epoch").alias("epoch"),
                                   F.col("mix_block").alias("block"), F.col("mix_weight").alias("weight"),
                                   F.col("mix_position").alias("position"))


@query("op6_compression_quality")
def compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    held_out = key_crc() % 3 == 1
    return _classified(quality.score(docs, quality.fit(docs, labels.filter(~held_out))).drop("text"), held_out)


@query("op7_pu_toxicity")
def pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    held_out = key_crc() % 5 == 0
    model = toxicity.fit(docs, labels.filter(~held_out), docs.filter(~held_out))
    return _classified(toxicity.score(docs, model).drop("text"), held_out)


@query("op1_suffix_tree_scores")
def suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = key_crc() % 5 == 1
    return suffix_tree.lm_scores(docs.withColumn("held_out", held_out), docs.filter(~held_out))


@query("op4_chosen_path_join")
def chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_classes(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("h1", "h2")


@query("op13_byte_pair_trie")
def byte_pair_trie(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, packed=True, keep_text=False)
    return bpe.decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_phrase_collocations", r"""
with docs as (
    select row_number() over () as d, coalesce(lang, 'und') as lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select d, lang, unnest(x) as piece, generate_subscripts(x, 1) as p
    from (select d, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') as x from docs)),
parts as (select d, lang, p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces),
grams as (
    select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) as g
    from parts, (select unnest([1, 2, 3, 4]) as k) where len(ws) >= k),
f as (select lang, k, g, count(*) as a from grams group by all),
total as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
cand as (select lang, k, g, a, string_split(g, ' ') as ws from f where k > 1 and a >= 30),
cuts as (select lang, k, g, a, ws, unnest(range(1, k)) as c from cand),
parted as (select lang, k, g, a, c, array_to_string(ws[1 : c], ' ') as lg, array_to_string(ws[c + 1 : k], ' ') as rg from cuts),
scored as (
    select p.lang, p.k, p.g, p.a, p.c, l.a as l, r.a as r, ((2000000::hugeint * p.a) // (l.a + r.a))::bigint as score
    from parted p join f l on l.lang = p.lang and l.k = p.c and l.g = p.lg join f r on r.lang = p.lang and r.k = p.k - p.c and r.g = p.rg),
worst as (select * from scored qualify row_number() over (partition by lang, g order by score, c) = 1),
inner_grams as (
    select y.lang, y.a, array_to_string(y.ws[i : i + m - 1], ' ') as g
    from cand y, (select unnest([2, 3]) as m), (select unnest([1, 2, 3]) as i) where m < y.k and i + m - 1 <= y.k),
longer as (select lang, g, max(a) as most from inner_grams group by all),
alive as (select w.* from worst w left join longer x on x.lang = w.lang and x.g = w.g where not coalesce(100::hugeint * x.most >= 80::hugeint * w.a, false))
select lang, rank, phrase, a, l, r, n, score from (
    select s.lang, row_number() over (partition by s.lang order by score desc, a desc, g) as rank, g as phrase, a, l, r, n, score
    from alive s join total t on t.lang = s.lang) where rank <= 2000
""")
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


@query("op11_spelling_variants", r"""
with recursive crc as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
        case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t),
runs as (
    select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as w from documents),
per as (select d, w, count(*) as k, hex(encode(d || ':' || w)) as h from runs group by d, w),
bytes as (select w, k, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint) as b from per),
sums as (select w, k, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) as h from bytes, crc),
damaged as (
    select k, case when h % 97 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word from sums),
vocab as (select word, sum(k)::bigint as n from damaged group by word having length(word) >= 5 and sum(k) >= 3),
cut as (select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as v
    from (select word, n, unnest(range(length(word))) as i from vocab)),
pairs as (
    select a.word, b.word as near, b.n as near_n from cut a join cut b on a.v = b.v and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from cut a join vocab b on a.v = b.word
    union select b.word, a.word, a.n from cut a join vocab b on a.v = b.word),
best as (
    select word, near, near_n, count(*) over (partition by word) as n_near from pairs
    qualify row_number() over (partition by word order by near_n desc, near) = 1),
formed as (
    select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * v.n then near end as form,
        case when near_n >= 2 * v.n then near_n end as form_n from vocab v left join best b on b.word = v.word),
chain as (
    select word, word as at from formed
    union all select c.word, f.form from chain c join formed f on f.word = c.at where f.form is not null)
select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n
from formed f join chain c on c.word = f.word join formed e on e.word = c.at and e.form is null
""")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read(spark, sf_dir, "documents").select("doc_id", "text"))
