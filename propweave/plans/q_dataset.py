"""Vocabularies, sequences, array functions and dataset building."""

from __future__ import annotations

from pyspark.sql import functions as F

from propweave.functions import arrays as A, symbols as S
from propweave.functions.hashing import seeded_digest
from propweave.operators import clean, dataset, ordering, vocab
from propweave.plans.registry import query, rounded, text
from propweave.sources.scratch import scratch_path


def spaced(arr: str) -> str:
    return f"array_to_string({arr}, ' ')"


@query("assay_value_counts", "select assay, value, count(*) as n from ACT group by all")
def _(t):
    return clean.assay_value_counts(t.act)


@query("assay_pivot_counts", "select assay, sum(1 - value)::bigint as count_0, sum(value)::bigint as count_1 from ACT group by assay")
def _(t):
    return clean.assay_pivot_counts(t.act)


@query("balanced_assays", """select *, round(abs(count_0 - count_1)::double / (count_0 + count_1), 6) as imbalance from
    (select assay, sum(1 - value)::bigint as count_0, sum(value)::bigint as count_1 from ACT group by assay) t
    where count_0 >= 200 and count_1 >= 200 and abs(count_0 - count_1)::double / (count_0 + count_1) <= 0.9""")
def _(t):
    return rounded(clean.balanced_assays(t.act, 200), "imbalance")


@query("consistent_values", "select sid, assay, value from CONS")
def _(t):
    return t.cons


@query("nest_pairs", """select sid, string_agg(assay_index || ':' || value, ' ' order by assay_index) as pairs from DATA group by sid""")
def _(t):
    pair = F.transform("assay_val_pairs", lambda p: F.concat_ws(":", p["assay_index"], p["value"]))
    return t.nest.select("sid", F.array_join(pair, " ").alias("pairs"))


@query("vocab_sizes", "select na as n_assays, nv::bigint as n_values from META")
def _(t):
    return vocab.vocab_sizes(t.data)


@query("vocab_fit", "select symbol, index from VOC")
def _(t):
    return t.voc


@query("char_vocab", """select symbol, row_number() over (order by encode(symbol)) - 1 as index from
    (select distinct unnest(string_split(text, '')) as symbol from documents union select ' ') t where symbol <> ''""")
def _(t):
    return vocab.char_vocab(t.raw("documents", "text"), "text")


@query("char_encode", f"""with c as (select s, row_number() over (order by s) - 1 as i from
        (select distinct unnest(string_split(smiles, '')) as s from SUB union select ' ') t where s <> ''),
    p as (select sid, rpad(smiles, 120, ' ') as padded from SUB),
    x as (select sid, substr(padded, pos::int, 1) as s, pos from p, range(1, 121) r(pos))
    select sid, string_agg(i, ' ' order by pos) as ids from x join c using (s) group by sid""")
def _(t):
    df = vocab.char_encode(t.sub, vocab.char_vocab(t.sub, "smiles"), "smiles", "ids", 120)
    return df.select("sid", text("ids").alias("ids"))


@query("split_symbols", r"""select sid, array_to_string(regexp_extract_all(symbols || 'N', '(\[[^\]]*\]|.)', 1), ' ') as parts,
    len(regexp_extract_all(symbols || 'N', '(\[[^\]]*\]|.)', 1)) as n from SUB""")
def _(t):
    df = t.sub.withColumn("p", S.split_symbols(F.concat("symbols", F.lit("N"))))
    return df.select("sid", F.array_join("p", " ").alias("parts"), F.size("p").alias("n"))


def _greedy_sql() -> str:
    wide = "|".join(s.replace("*", "\\*") for s in S.NOTATION if len(s) == 2)
    pairs = ", ".join("('" + s.replace("'", "''") + f"', {i})" for i, s in enumerate(S.NOTATION))
    return f"""with v(s, i) as (values {pairs}),
    x as (select sid, unnest(l) as s, generate_subscripts(l, 1) as pos from
          (select sid, regexp_extract_all('^' || smiles || '$', '({wide}|.)', 1) as l from SUB) a),
    y as (select sid, list(coalesce(i, 2) order by pos) as ids from x left join v using (s) group by sid)
    select sid, array_to_string(list_resize(ids, 120, 2), ' ') as ids from y"""


@query("greedy_tokens", _greedy_sql())
def _(t):
    return vocab.greedy_tokens(t.sub, "smiles", "ids", 120).select("sid", text("ids").alias("ids"))


@query("encode_symbols", f"select sid, {spaced('encoded')} as ids from ENC")
def _(t):
    return t.enc.select("sid", text("encoded").alias("ids"))


@query("decode_symbols", "select sid, symbols as decoded from SUB")
def _(t):
    return vocab.decode_symbols(t.enc, t.voc, "encoded", "decoded").select("sid", "decoded")


@query("encode_words", r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') as l from documents),
    v as (select s, 2 + row_number() over (order by encode(s)) as i from (select distinct '[' || replace(unnest(l), ']', '') || ']' as s from w) a),
    x as (select doc_id, '[' || replace(unnest(l), ']', '') || ']' as s, generate_subscripts(l, 1) as pos from w)
    select doc_id, count(*) + 2 as n, sum(i * (pos % 97 + 1))::bigint as checksum from x join v using (s) group by doc_id""")
def _(t):
    from propweave.operators.similarity import words

    docs = t.docs()
    docs = docs.withColumn("w", F.transform(words("text"), lambda x: F.concat(F.lit("["), F.replace(x, F.lit("]"), F.lit("")), F.lit("]"))))
    docs = docs.select("doc_id", F.array_join("w", "").alias("symbols"))
    voc = vocab.fit_vocab(docs, "symbols")
    enc = vocab.encode_symbols(docs, voc, "symbols", "ids", pad_length=None)
    real = F.filter("ids", lambda x: x > 2)
    check = F.aggregate(F.transform(real, lambda x, i: x * ((i + 1) % 97 + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return enc.select("doc_id", F.size(F.filter("ids", lambda x: x > 0)).cast("bigint").alias("n"), check.alias("checksum"))


@query("decode_mixed", r"""select sid, rtrim(symbols_spaced || ' ' || nums) as mixed from
    (select sid, array_to_string(regexp_extract_all(symbols, '(\[[^\]]*\]|.)', 1), ' ') as symbols_spaced, array_to_string(assay_vals, ' ') as nums
     from SUB join TOK using (sid)) t""")
def _(t):
    df = dataset.encode_pairs(t.nest, t.meta).join(t.enc.select("sid", "encoded"), "sid")
    df = df.withColumn("ids", F.concat(F.filter("encoded", lambda x: x > 2), "assay_vals"))
    out = vocab.decode_mixed(df, t.voc, "ids", "mixed", t.meta["n_symbols"])
    return out.select("sid", F.array_join("mixed", " ").alias("mixed"))


@query("prior_string", """select sid, string_agg(assay_index, ' + ' order by assay_index) as prior, count(*) as n from DATA group by sid""")
def _(t):
    joined = t.nest.select("sid", A.joined(F.transform("assay_val_pairs", lambda p: p["assay_index"]), " + ").alias("prior"))
    return joined.withColumn("n", F.size(F.split("prior", r" \+ ")).cast("bigint"))


@query("truncate_title", "select property_token, substr(title, 1, 12) as short, source from PROP join SRC using (source_id)")
def _(t):
    return t.prop.join(t.src, "source_id").select("property_token", F.substring("title", 1, 12).alias("short"), "source")


@query("encode_pairs", f"select sid, {spaced('assay_vals')} as ids from TOK")
def _(t):
    return dataset.encode_pairs(t.nest, t.meta).select("sid", text("assay_vals").alias("ids"))


@query("encode_joint", """select sid, array_to_string(list_resize(list_concat(list_filter(encoded, lambda x: x <> 0), assay_vals),
    greatest(120 + na, len(list_concat(list_filter(encoded, lambda x: x <> 0), assay_vals))), 0), ' ') as ids from EX, META""")
def _(t):
    df = t.nest.join(t.enc.select("sid", "encoded"), "sid")
    return dataset.joint_text(df, t.meta, "ids").select("sid", "ids")


@query("pad_to_max", f"select sid, {spaced('list_resize(assay_vals, (select max(len(assay_vals)) from TOK), 0)')} as ids from TOK")
def _(t):
    df = dataset.pad_to_max(dataset.encode_pairs(t.nest, t.meta), "assay_vals", "padded")
    return df.select("sid", text("padded").alias("ids"))


@query("chunk_pairs", """select sid, string_agg((assay_index + ns) || ':' || (value + ns + na), ' ' order by assay_index) as pairs
    from DATA, META group by sid""")
def _(t):
    flat = dataset.encode_pairs(t.nest, t.meta)
    inner = flat.select("sid", F.slice("assay_vals", F.lit(2), F.size("assay_vals") - 2).alias("f"))
    pair = F.transform(A.chunk_pairs("f", "a", "v"), lambda p: F.concat_ws(":", p["a"], p["v"]))
    return inner.select("sid", F.array_join(pair, " ").alias("pairs"))


PERM3 = "(values (0,0,1,2),(1,0,2,1),(2,1,0,2),(3,1,2,0),(4,2,0,1),(5,2,1,0)) p(perm,i0,i1,i2)"
RANKED = """select sid, assay_index, value, row_number() over (partition by sid order by md5('37|' || sid || '|' || assay_index)) as r from DATA"""
TRIPLE = f"""select sid, list(assay_index order by r) as a, list(value order by r) as v from ({RANKED}) k where r <= 3
    group by sid having count(*) = 3"""


@query("pair_permutations", f"""select sid, perm, a[i0+1] || ':' || v[i0+1] || ' ' || a[i1+1] || ':' || v[i1+1] || ' ' || a[i2+1] || ':' || v[i2+1] as pairs
    from ({TRIPLE}) t, {PERM3}""")
def _(t):
    ok = t.nest.filter(F.size("assay_val_pairs") >= 3)
    ok = ok.select("sid", dataset.sample_pairs("assay_val_pairs", 3, 37, "sid").alias("p"))
    perms = ok.select("sid", "p", F.posexplode(A.permutation_list(3)).alias("perm", "ord"))
    pair = F.transform(A.reorder("p", F.col("ord")), lambda x: F.concat_ws(":", x["assay_index"], x["value"]))
    return perms.select("sid", "perm", F.array_join(pair, " ").alias("pairs"))


@query("prefixes", """select a.sid, b.assay_index as last_assay, string_agg(a.assay_index, ' ' order by a.assay_index) as prefix
    from DATA a join DATA b on a.sid = b.sid and a.assay_index <= b.assay_index group by a.sid, b.assay_index""")
def _(t):
    ids = t.nest.select("sid", F.transform("assay_val_pairs", lambda p: p["assay_index"]).alias("a"))
    pre = ids.select("sid", F.explode(A.prefixes("a")).alias("p"))
    return pre.select("sid", F.element_at("p", -1).alias("last_assay"), text("p").alias("prefix"))


@query("pair_position", "select sid, row_number() over (partition by sid order by assay_index) - 1 as pos, assay_index, value from DATA")
def _(t):
    rows = t.nest.select("sid", F.posexplode("assay_val_pairs").alias("pos", "p"))
    return rows.select("sid", "pos", "p.assay_index", "p.value")


@query("sample_pairs", f"select sid, string_agg(assay_index || ':' || value, ' ' order by r) as pairs from ({RANKED}) t where r <= 4 group by sid")
def _(t):
    pair = F.transform(dataset.sample_pairs("assay_val_pairs", 4, 37, "sid"), lambda p: F.concat_ws(":", p["assay_index"], p["value"]))
    return t.nest.select("sid", F.array_join(pair, " ").alias("pairs"))


@query("shift_tokens", """select sid, array_to_string(list_concat(assay_vals[2:], [0]), ' ') as target,
    array_to_string(list_concat([1], assay_vals[:len(assay_vals)-1]), ' ') as teacher from TOK""")
def _(t):
    df = dataset.encode_pairs(t.nest, t.meta)
    return df.select("sid", text(A.shift_left("assay_vals", F.lit(0).cast("bigint"))).alias("target"),
                     text(A.shift_right("assay_vals", F.lit(1).cast("bigint"))).alias("teacher"))


@query("one_hot", """select property_id, string_agg((i = source_id)::int, '' order by i) as hot from PROP, (select unnest(range(0, (select max(n_nationkey) + 1 from nation))) as i) r group by property_id""")
def _(t):
    n = t.src.agg(F.max("source_id")).first()[0] + 1
    return t.prop.select("property_id", F.array_join(F.transform(A.one_hot("source_id", n), lambda x: x.cast("string")), "").alias("hot"))


@query("one_hot_matrix", """select sid, string_agg((value = 0)::int || '' || (value = 1)::int, ' ' order by assay_index) as hot from DATA group by sid""")
def _(t):
    rows = t.nest.select("sid", A.one_hot_matrix(F.transform("assay_val_pairs", lambda p: p["value"]), t.meta["n_values"]).alias("m"))
    return rows.select("sid", F.array_join(F.transform("m", lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), "")), " ").alias("hot"))


@query("mask_tokens", """select sid, string_agg(case when pos > 0 and ('0x' || substr(md5('137|' || sid || '|' || pos), 1, 8))::bigint / 4294967296.0::double < 0.1
        then 0 else tok end, ' ' order by pos) as ids
    from (select sid, unnest(assay_vals) as tok, generate_subscripts(assay_vals, 1) - 1 as pos from TOK) t group by sid""")
def _(t):
    df = dataset.mask_tokens(dataset.encode_pairs(t.nest, t.meta), "assay_vals", "masked", "sid")
    return df.select("sid", text("masked").alias("ids"))


@query("pair_map", """select sid, count(*) as n, min(assay_index) as first_assay, arg_min(value, assay_index) as first_value from DATA group by sid""")
def _(t):
    m = t.nest.withColumn("m", dataset.pair_map("assay_val_pairs"))
    low = F.array_min(F.map_keys("m"))
    return m.select("sid", F.size("m").cast("bigint").alias("n"), low.alias("first_assay"), F.col("m")[low].alias("first_value"))


@query("property_index", "select assay, n, assay_index from PIX")
def _(t):
    return t.pix


@query("label_index", "select n_name as label, row_number() over (order by n_name) - 1 + 100 as idx from nation")
def _(t):
    return vocab.label_index(t.raw("nation").select(F.col("n_name").alias("label")), "label", "idx", offset=100)


@query("token_ids", "select sid, assay_index + ns as property_token, value + ns + na as value_token from DATA, META")
def _(t):
    return vocab.token_ids(t.data, t.meta).select("sid", "property_token", "value_token")


@query("split_80_10_10", """select p_partkey as sid, case when b < 800 then 'trn' when b < 900 then 'tst' else 'hld' end as split
    from (select p_partkey, ('0x' || substr(md5('37|' || p_partkey), 1, 8))::bigint % 1000 as b from part) t""")
def _(t):
    return dataset.split_by_hash(t.sub.select("sid"))


@query("training_examples", f"""with o as (select sid, list_resize(list_concat(list_concat([any_value(ns + na + nv)],
        flatten(list([assay_index + ns, value + ns + na] order by r))), [any_value(ns + na + nv + 1)]), 12, 0) as o
        from ({RANKED}) t, META where r <= 5 group by sid)
    select sid, array_to_string(o, ' ') as output, array_to_string(list_concat([1], o[:11]), ' ') as teacher,
    array_to_string(encoded, ' ') as input from o join ENC using (sid)""")
def _(t):
    ex = dataset.training_examples(t.nest, t.meta).join(t.enc.select("sid", "encoded"), "sid")
    return ex.select("sid", text("output").alias("output"), text("teacher").alias("teacher"), text("encoded").alias("input"))


CHUNKS = f"""o as (select *, count(*) over (partition by sid) as m from ({RANKED}) k),
    s as (select distinct sid, m from o where m >= 3), c as (select sid, m, unnest(range(0, (m + 2) // 3)) as pass from s),
    e as (select sid, m, pass, unnest(range(0, 3)) as j from c),
    t as (select e.sid, pass, list(assay_index order by j) as a, list(value order by j) as v
          from e join o on o.sid = e.sid and o.r - 1 = (3 * pass + j) % e.m group by e.sid, pass),
    x as (select sid, pass, perm, a[i0+1] as a0, v[i0+1] as v0, a[i1+1] as a1, v[i1+1] as v1, a[i2+1] as a2, v[i2+1] as v2 from t, {PERM3}),
    ev as (select sid, pass, perm, 0 as nprops, '' || a0 as prior_assays, '' || v0 as prior_values, a0 as assay, v0 as value from x
        union all select sid, pass, perm, 1, a0 || ' + ' || a1, v0 || ' ' || v1, a1, v1 from x
        union all select sid, pass, perm, 2, a0 || ' + ' || a1 || ' + ' || a2, v0 || ' ' || v1 || ' ' || v2, a2, v2 from x)"""


@query("eval_rows", f"with {CHUNKS} select * from ev")
def _(t):
    return dataset.eval_rows(t.nest, nprops=3).withColumn("prior_values", text("prior_values"))


@query("seen_inputs", f"""with {CHUNKS} select distinct sid, prior_assays, value from ev
    where (sid, prior_assays) not in (select (sid, prior_assays) from ev where pass = 0)""")
def _(t):
    rows = dataset.eval_rows(t.nest, nprops=3)
    inputs = ["sid", "prior_assays"]
    return dataset.skip_seen(rows.filter("pass > 0"), rows.filter("pass = 0"), inputs).select(*inputs, "value")


@query("context_empty", """select property_token, (ns + na + nv) || ' ' || property_token || ' 0 ' || (ns + na + nv + 1) as context from PROP, META""")
def _(t):
    return dataset.context_empty(t.prop.select("property_token"), t.meta).select("property_token", text("context").alias("context"))


@query("finetune_dataset", """with v as (select lang, row_number() over (order by lang) - 1 + 100 as idx from (select distinct lang from documents) a),
    c as (select doc_id as sid, idx, max((quality > 0)::int) as value from documents join labels using (doc_id) join v using (lang)
          group by all having count(distinct quality > 0) = 1),
    s as (select count(distinct ch) + 3 as ns from (select unnest(string_split('' || sid, '')) as ch from c) a where ch <> ''),
    m as (select ns, max(idx) + 1 as na, max(value) + 1 as nv from c, s group by ns),
    n as (select sid, list_concat(list_concat([any_value(ns + na + nv)], flatten(list([idx + ns, value + ns + na] order by idx))),
          [any_value(ns + na + nv + 1)]) as t, list(('0x' || substr(md5('37|' || sid), 1, 8))::bigint % 1000)[1] as b from c, m group by sid),
    d as (select ch, 2 + row_number() over (order by ch) as i from (select distinct ch from (select unnest(string_split('' || sid, '')) as ch from c) a where ch <> '') b),
    q as (select sid, unnest(string_split('' || sid, '')) as ch, generate_subscripts(string_split('' || sid, ''), 1) as pos from n),
    e as (select q.sid, list_resize(list_concat(list_concat([1::bigint], list(i order by pos)), [2::bigint]), 120, 0::bigint) as enc from q join d using (ch) group by q.sid)
    select sid, array_to_string(t, ' ') as ids, list_sum(enc)::bigint as input_sum,
    case when b < 800 then 'trn' when b < 900 then 'tst' else 'hld' end as split from n join e using (sid)""")
def _(t):
    src = t.raw("documents", "doc_id", "lang").join(t.raw("labels", "doc_id", "quality"), "doc_id")
    idx = vocab.label_index(t.raw("documents", "lang"), "lang", "assay", offset=100)  # new ids start past the old ones
    act = src.join(idx, "lang").select(F.col("doc_id").alias("sid"), "assay", (F.col("quality") > 0).cast("int").alias("value"))
    subs = src.select(F.col("doc_id").alias("sid")).distinct().withColumn("symbols", S.bracketed(F.col("sid").cast("string")))
    path = dataset.finetune_shards(act, subs, scratch_path(t.spark, "finetune"))
    df = dataset.read_shards(t.spark, path)
    return df.select("sid", text("assay_vals").alias("ids"), "split",
                     F.aggregate("encoded", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("input_sum"))


@query("dataset_report", """select count(*) as n_rows, count(distinct sid) as n_substances, count(distinct assay) as n_properties,
    sum(value)::bigint as n_positive, round(avg(value), 6) as share_positive,
    count(distinct source_id) as n_sources from CONS left join PROP on assay = property_id""")
def _(t):
    rows = t.cons.join(t.prop.select(F.col("property_id").alias("assay"), "source_id"), "assay", "left")
    return dataset.dataset_report(rows, "source_id")


@query("seeded_order", "select p_partkey as sid, row_number() over (order by md5('52|' || p_partkey), p_partkey) as pos from part")
def _(t):
    df = t.sub.select("sid").withColumn("d", seeded_digest(52, "sid"))
    return ordering.ordered_position(df, ["d", "sid"], "pos").select("sid", "pos")


@query("sample_per_group", """select assay, sid, value from (select *, row_number() over (partition by assay order by md5('7|' || sid || '|' || assay), sid) as r
    from CONS) t where r <= 100""")
def _(t):
    df = t.cons.withColumn("d", seeded_digest(7, "sid", "assay"))
    return ordering.top_n(df, ["assay"], ["d", "sid"], 100, spread=["sid"]).select("assay", "sid", "value")


@query("sample_groups", """select sid, assay, value from CONS where assay in
    (select assay from (select distinct assay from CONS) a order by md5('8|' || assay), assay limit 40)""")
def _(t):
    some = t.cons.select("assay").distinct().orderBy(seeded_digest(8, "assay"), "assay").limit(40)
    return t.cons.join(some, "assay", "left_semi").select("sid", "assay", "value")
