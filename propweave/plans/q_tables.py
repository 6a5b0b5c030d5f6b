"""Scans, sinks, projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from propweave import sql
from propweave.operators import catalog as cat, clean, dataset, features, scoring
from propweave.operators.ordering import union_all
from propweave.plans.fixtures import family_of
from propweave.plans.registry import query, r6, rounded
from propweave.sources import layout, logs, shards, tables
from propweave.sources.scratch import scratch_path


@query("scan_project", "select l_partkey as sid, l_suppkey as assay, l_quantity as amount from lineitem")
def _(t):
    return t.raw("lineitem", "l_partkey", "l_suppkey", "l_quantity").toDF("sid", "assay", "amount")


@query("scan_glob", "select o_orderkey, o_orderstatus from orders")
def _(t):
    return tables.scan_glob(t.spark, t.dir, "orders*.parquet", "o_orderkey", "o_orderstatus")


@query("roundtrip_parquet", "select sid, assay, count(*) as n, sum(value)::bigint as n_active from ACT group by all")
def _(t):
    path = tables.write_table(t.act, scratch_path(t.spark, "activities"))
    return tables.scan(t.spark, path).groupBy("sid", "assay").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("n_active"))


@query("roundtrip_csv", "select chemical_id, nprops, assay, value, round(probs, 6) as probs from PRED")
def _(t):
    cols = ["chemical_id", "nprops", "assay", "value", "probs"]
    one = tables.write_csv(t.pred.filter("value = 1").select(*cols), scratch_path(t.spark, "pred-csv"))
    two = tables.write_csv(t.pred.filter("value = 0").select(*cols), scratch_path(t.spark, "pred-csv"))
    schema = "chemical_id bigint, nprops int, assay bigint, value int, probs double"
    return rounded(tables.read_csv(t.spark, [one, two], schema), "probs")


@query("train_log_scan", "select type, batch, round(loss, 6) as loss, round(lr, 6) as lr from LOG")
def _(t):
    path = logs.write_log(t.log, scratch_path(t.spark, "log"))
    return rounded(logs.read_log(t.spark, path), "loss", "lr")


def _catalog(t):
    prop = t.prop.join(t.src, "source_id").drop("source_id")
    base = t.meta["n_symbols"] + t.meta["n_assays"]
    return cat.build_catalog(prop, t.pcat, t.cons.withColumnRenamed("assay", "property_id"), t.sub.withColumn("inchi", F.upper("smiles")), base)


@query("catalog_tables", """with d as (select n_name, row_number() over (order by n_name) - 1 as source_id from nation
        where n_nationkey in (select s_nationkey from supplier))
    select 'activity' as relation, count(*) as n, sum((value + ns + na) * (length(smiles) + 1))::bigint as checksum from CONS left join SUB using (sid), META
    union all select 'category', count(distinct category), sum(distinct 0)::bigint from PCAT
    union all select 'property', count(*), sum(d.source_id)::bigint from PROP join SRC using (source_id) join d on d.n_name = source
    union all select 'property_category', count(*), sum(length(reason))::bigint from PCAT
    union all select 'source', count(*), sum(source_id)::bigint from d""")
def _(t):
    folder = scratch_path(t.spark, "catalog")
    paths = cat.write_catalog(_catalog(t), folder)
    check = {"activity": F.sum(F.col("value_token") * (F.length("smiles") + 1)), "category": F.sum(F.lit(0)), "property": F.sum("source_id"),
             "property_category": F.sum(F.length("reason")), "source": F.sum("source_id")}
    parts = [t.spark.read.parquet(paths[n]).agg(F.lit(n).alias("relation"), F.count(F.lit(1)).alias("n"),
                                                c.cast("bigint").alias("checksum")) for n, c in check.items()]
    return union_all(parts)


@query("activities_by_structure", """with a as (select CONS.*, row_number() over (order by sid, assay) - 1 as activity_id from CONS join PROP on assay = property_id)
    select activity_id, sid, smiles, upper(smiles) as inchi, assay as property_id, assay + 8 as property_token, value as binary_value, value + ns + na as value_token
    from a join SUB using (sid), META where smiles in (select smiles from SUB where smiles like '%|PROMO|%')""")
def _(t):
    asked = t.sub.filter(F.col("smiles").contains("|PROMO|"))
    found = cat.activities_of(_catalog(t)["activity"], asked)
    return found.select("activity_id", "sid", "smiles", "inchi", "property_id", "property_token", "binary_value", "value_token")


@query("shards_by_split", """select split, count(*) as n, sum(m)::bigint as n_pairs, sum(list_sum(encoded))::bigint as id_sum from EX group by split""")
def _(t):
    path = dataset.write_shards(t.examples, scratch_path(t.spark, "shards"))
    df = dataset.read_shards(t.spark, path)
    pairs = (F.size(F.filter("assay_vals", lambda x: x != 0)) - 2) / 2
    ids = F.aggregate("encoded", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(pairs).cast("bigint").alias("n_pairs"),
                                   F.sum(ids).alias("id_sum"))


@query("shards_to_long", """select EX.split, array_to_string(encoded, ' ') as symbols_key, assay_index + ns as assay, value + ns + na as value
    from EX join DATA using (sid), META""")
def _(t):
    path = dataset.write_shards(t.examples, scratch_path(t.spark, "shards"))
    return dataset.shards_to_long(dataset.read_shards(t.spark, path), keep=("split",))


@query("tensor_shards", """select EX.split, array_to_string(encoded, ' ') as symbols_key, assay_index + ns as assay, value + ns + na as value
    from EX join DATA using (sid), META""")
def _(t):
    """The examples as numpy files, read back, with the pairs exploded."""
    rows = t.examples.select("split", F.col("sid").cast("bigint").alias("id"), F.col("encoded").cast("array<bigint>").alias("fixed"),
                             F.col("assay_vals").cast("array<bigint>").alias("ragged"))
    path = shards.write_tensors(rows, scratch_path(t.spark, "tensors"), per_shard=4096)
    back = shards.read_tensors(t.spark, path).select("split", F.col("fixed").alias("encoded"), F.col("ragged").alias("assay_vals"))
    return dataset.shards_to_long(back, keep=("split",))


@query("vocab_roundtrip", "select symbol, index from VOC")
def _(t):
    path = tables.write_table(t.voc, scratch_path(t.spark, "vocab"))
    return tables.scan(t.spark, path, "symbol", "index")


@query("results_partitioned", """select assay as property_token, count(*) as n, round(avg(probs), 6) as mean_pred from PRED group by assay""")
def _(t):
    rows = t.pred.select(F.col("assay").alias("property_token"), "value", "probs")
    stored = layout.write_bucketed(rows, "results", "property_token", 16)
    return stored.groupBy("property_token").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("probs")).alias("mean_pred"))


@query("bucketed_nest", """select sid, count(*) as n, string_agg(assay || '=' || value, ' ' order by assay) as pairs, 0 as exchanges
    from CONS group by sid""")
def _(t):
    """Nesting a table in buckets of the substance: nothing moves."""
    stored = layout.write_bucketed(t.cons, "activities", "sid", 16)
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("assay", "value"))), lambda p: F.concat_ws("=", p["assay"], p["value"]))
    out = stored.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.array_join(pairs, " ").alias("pairs"))
    return out.withColumn("exchanges", F.lit(layout.exchanges(out)))


@query("bucketed_join", """select sid, smiles, n_pairs, n_same, 0 as exchanges from (select a.sid, count(*) as n_pairs,
        sum(case when a.value = b.value then 1 else 0 end)::bigint as n_same
        from CONS a join CONS b on a.sid = b.sid and a.assay < b.assay group by a.sid) x join SUB using (sid)""")
def _(t):
    """A self-join and a lookup of the substance, all in the same buckets."""
    one = layout.write_bucketed(t.cons, "activities", "sid", 16)
    subs = layout.write_bucketed(t.sub.select("sid", "smiles"), "substances", "sid", 16)
    other = one.select("sid", F.col("assay").alias("other"), F.col("value").alias("v"))
    both = one.hint("merge").join(other, "sid").filter("assay < other").groupBy("sid").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum((F.col("value") == F.col("v")).cast("bigint")).alias("n_same"))
    out = both.join(subs.hint("merge"), "sid").select("sid", "smiles", "n_pairs", "n_same")
    return out.withColumn("exchanges", F.lit(layout.exchanges(out)))


@query("catalog_lookups", """with a as (select sid, smiles, assay + 8 as property_token from CONS join SUB using (sid) join PROP on assay = property_id),
    m as (select max(sid) as s, max(property_token) as p, max(smiles) as x from a)
    select 'sid' as asked, count(*) as n, 1 as small_share from a, m where sid = s
    union all select 'property_token', count(*), 1 from a, m where property_token = p
    union all select 'smiles', count(*), 1 from a, m where smiles = x""")
def _(t):
    """Lookups by three columns of one table, and whether each read at most a third of its rows."""
    activity = _catalog(t)["activity"]
    path = cat.write_activity(activity, scratch_path(t.spark, "activity"), files=64)
    stored = t.spark.read.parquet(path)
    top = stored.agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("sid", "property_token", "smiles")]).first()
    out = []
    for column in ("sid", "property_token", "smiles"):
        found = layout.lookup(t.spark, path, column, [top[column]])
        few = layout.rows_read(found) * 3 <= top["n"]
        out.append(found.agg(F.lit(column).alias("asked"), F.count(F.lit(1)).alias("n"), F.lit(int(few)).alias("small_share")))
    return union_all(out)


@query("rename_select", "select sid, assay as property_id, value as binary_value from ACT")
def _(t):
    return t.act.withColumnRenamed("assay", "property_id").withColumnRenamed("value", "binary_value")


@query("json_coalesce", r"""select event_id as sid, event_type as source,
    coalesce(json_extract_string(props, '$.inchi'), json_extract_string(props, '$.k')) as inchi,
    coalesce(json_extract_string(props, '$.SMILES'), json_extract_string(props, '$."Ligand SMILES"')) as smiles from events""")
def _(t):
    raw = t.raw("events").select(F.col("event_id").alias("sid"), F.col("event_type").alias("source"), "props")
    return clean.json_coalesce(raw, "props", {"inchi": ["$.inchi", "$.k"], "smiles": ["$.SMILES", "$.Ligand SMILES"]}) \
                .drop("props")


@query("coalesce_fallback", r"""select event_id as sid, coalesce(json_extract_string(props, '$.SMILES'),
    'k' || json_extract_string(props, '$.k')) as smiles from events""")
def _(t):
    raw = t.raw("events").select(F.col("event_id").alias("sid"), F.get_json_object("props", "$.SMILES").alias("smiles"),
                                 F.get_json_object("props", "$.k").alias("k"))
    return clean.coalesce_fallback(raw, "smiles", F.concat(F.lit("k"), F.col("k"))).drop("k")


@query("dropna_subset", """select doc_id, lang, quality from documents left join labels using (doc_id) where quality is not null""")
def _(t):
    df = t.raw("documents", "doc_id", "lang").join(t.raw("labels", "doc_id", "quality"), "doc_id", "left")
    return df.dropna(subset=["quality"])


@query("category_filter", """select property_id, category, round(strength, 6) as strength from PCAT
    where strength > 8.0 and category not in ('PROMO', 'SMALL')""")
def _(t):
    out = t.pcat.filter((F.col("strength") > 8.0) & ~F.col("category").isin("PROMO", "SMALL"))
    return rounded(out.select("property_id", "category", "strength"), "strength")


@query("isin_semi", """select sid, assay, value from ACT where assay in (select property_id from PCAT where strength >= 10
        and category in ('PROMO', 'SMALL')) and value in (0, 1)""")
def _(t):
    strong = t.pcat.filter("strength >= 10 and category in ('PROMO', 'SMALL')").select(F.col("property_id").alias("assay"))
    return t.act.filter(F.col("value").isin(0, 1)).join(strong, "assay", "left_semi").select("sid", "assay", "value")


@query("binarize_value", """select event_id, case when event_type = 'error' then 0 else 1 end as value, (value > 50)::int as high from events""")
def _(t):
    return t.raw("events").select("event_id", F.when(F.col("event_type") == "error", 0).otherwise(1).alias("value"),
                                  (F.col("value") > 50).cast("int").alias("high"))


@query("known_value_code", """select p_partkey as sid, s.s_suppkey as assay_hint, coalesce(case value when 1 then 1 when 0 then -1 end, 0) as code
    from part join supplier s on s.s_suppkey = p_size left join CONS on sid = p_partkey and assay = s.s_suppkey""")
def _(t):
    # every substance asked about the property numbered like its size
    ask = t.raw("part", "p_partkey", "p_size").join(t.raw("supplier", "s_suppkey"), F.col("p_size") == F.col("s_suppkey"))
    ask = ask.select(F.col("p_partkey").alias("sid"), F.col("s_suppkey").alias("assay"))
    code = F.when(F.col("value") == 1, 1).when(F.col("value") == 0, -1)
    return ask.join(t.cons, ["sid", "assay"], "left").select("sid", F.col("assay").alias("assay_hint"),
                                                            F.coalesce(code, F.lit(0)).alias("code"))


@query("min_props_filter", "select sid, m as n_props from TOK where m >= 24")
def _(t):
    return t.nest.filter(F.size("assay_val_pairs") >= 24).select("sid", F.size("assay_val_pairs").alias("n_props"))


@query("validity_filter", r"""select doc_id, length(text) as n from documents
    where length(text) > 0 and length(text) <= 120 and regexp_full_match(text, '[A-Za-z ,.\n]*')""")
def _(t):
    return clean.validity_filter(t.raw("documents", "doc_id", "text"), "text", r"A-Za-z ,.\n", 120) \
                .select("doc_id", F.length("text").alias("n"))


@query("activity_substance_join", "select sid, assay, value, smiles from ACT join SUB using (sid)")
def _(t):
    return t.act.join(t.sub.select("sid", "smiles"), "sid").select("sid", "assay", "value", "smiles")


@query("semi_join_assays", """select sid, assay, value from ACT where assay in (select assay from ACT group by assay
    having sum(value) >= 200 and sum(1 - value) >= 200)""")
def _(t):
    return clean.restrict(t.act, clean.balanced_assays(t.act, 200, 1.0)).select("sid", "assay", "value")


@query("property_source", "select property_token, title, source from PROP join SRC using (source_id)")
def _(t):
    return cat.property_source(t.prop, t.src)


@query("property_category", """select source, property_token, title, category, reason, round(strength, 6) as strength
    from PROP join PCAT using (property_id) join SRC using (source_id)""")
def _(t):
    return rounded(cat.property_category(t.prop, t.pcat, t.src), "strength").drop("property_id").orderBy(F.desc("strength"))


@query("known_properties", """with c as (select property_id, string_agg(category, ';' order by category) as categories from PCAT
        where strength > 9.5 group by property_id)
    select sid, source, property_token, coalesce(categories, '') as categories, value
    from CONS join PROP on assay = property_id join SRC using (source_id) left join c using (property_id)
    where sid in (select p_partkey from part where p_type = 'ECONOMY')""")
def _(t):
    asked = t.raw("part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("sid"))
    known = cat.known_properties(asked, t.cons, t.prop, t.pcat.filter("strength > 9.5"), t.src)
    return known.withColumn("categories", F.array_join(F.transform("categories", lambda c: c["category"]), ";"))


@query("surrogate_keys", """with d as (select source, row_number() over (order by source) - 1 as source_id
        from (select distinct source from PROP join SRC using (source_id)) a),
    c as (select category, row_number() over (order by category) - 1 as category_id from (select distinct category from PCAT) b)
    select PROP.property_id, title, property_token, d.source_id, c.category_id from PROP join SRC using (source_id)
    join d using (source) join PCAT using (property_id) join c using (category)""")
def _(t):
    tabs = _catalog(t)
    return tabs["property"].join(tabs["property_category"], "property_id") \
        .select("property_id", "title", "property_token", "source_id", "category_id")


@query("metrics_with_source", """select nprops, assay, title, source, round(auc, 6) as auc, num_pos, num_neg
    from MET join PROP on assay = property_id join SRC using (source_id)""")
def _(t):
    dim = t.prop.join(t.src, "source_id").select("property_id", "title", "source")
    m = t.met.join(dim, F.col("assay") == F.col("property_id"))
    return rounded(m.select("nprops", "assay", "title", "source", "auc", "num_pos", "num_neg"), "auc")


@query("left_join_metrics", """select property_id, title, round(auc, 6) as auc from PROP
    left join (select * from MET where nprops = 0 and auc > 0.5) m on assay = property_id""")
def _(t):
    m = t.met.filter((F.col("nprops") == 0) & (F.col("auc") > 0.5)).select(F.col("assay").alias("property_id"), "auc")
    return rounded(t.prop.select("property_id", "title").join(m, "property_id", "left"), "auc")


ASKED = "(select distinct 'F' || p_partkey // 16 as name from part where p_size = 1)"


def asked_families(t):
    """A request list that grows with the tables: the families with a part of size 1."""
    parts = t.raw("part", "p_partkey", "p_size").filter("p_size = 1")
    return parts.select(family_of("p_partkey").alias("name")).distinct()


@query("candidate_x_property", "select c.name, p.property_id from (select distinct sid as name from FAMACT) c, PROP p")
def _(t):
    return scoring.candidate_x_property(t.fam_act.select(F.col("sid").alias("name")).distinct(), t.prop.select("property_id"))


@query("sql_catalog", """with a as (select upper(smiles) as inchi, assay as property_id, value from CONS join SUB using (sid)),
    w as (select max(inchi) as inchi from a)
    select 'categories' as asked, source, title as name, category, round(strength, 6) as number from PROP join PCAT using (property_id) join SRC using (source_id) where strength > 8
    union all select 'values', source, property_token::varchar, category, round(strength * 10 + value, 6)
        from a join w using (inchi) join PROP using (property_id) join PCAT using (property_id) join SRC using (source_id)
    union all select 'counts', source, case value when 1 then 'positive' when 0 then 'negative' else 'unknown' end, '', count(*)
        from CONS join PROP on assay = property_id join SRC using (source_id) group by source, value""")
def _(t):
    """Three statements in SQL over the stored catalogue: strong categories, a structure's known values, counts by source."""
    spark = t.spark
    sql.register(spark)
    sql.catalog_views(spark, cat.write_catalog(_catalog(t), scratch_path(spark, "sql-catalog")))
    top = spark.sql("SELECT max(inchi) AS inchi FROM activity").first()["inchi"]
    strong = spark.sql("""SELECT 'categories' AS asked, s.source, p.title AS name, c.category, round(b.strength, 6) AS number
        FROM property p JOIN property_category b ON p.property_id = b.property_id JOIN category c ON b.category_id = c.category_id
        JOIN source s ON p.source_id = s.source_id WHERE b.strength > 8""")
    values = spark.sql("SELECT 'values' AS asked, source, CAST(property_token AS STRING) AS name, category, round(strength * 10 + value, 6) AS number "
                       "FROM known_values(:asked)", args={"asked": top})
    counts = spark.sql("""SELECT 'counts' AS asked, s.source, value_code(a.binary_value) AS name, '' AS category, CAST(count(*) AS DOUBLE) AS number
        FROM activity a JOIN source s ON a.source_id = s.source_id GROUP BY s.source, a.binary_value""")
    return union_all([strong, values, counts])


@query("known_or_unknown", """select distinct 'F' || p_partkey // 16 as name, p_partkey % (select count(*) from supplier) + 1 as property_id,
    case value when 1 then 'positive' when 0 then 'negative' else 'unknown' end as known
    from part left join FAM on sid = 'F' || p_partkey // 16 and assay = p_partkey % (select count(*) from supplier) + 1""")
def _(t):
    n = t.raw("supplier").count()
    ask = t.raw("part", "p_partkey").select(family_of("p_partkey").alias("name"), (F.col("p_partkey") % n + 1).alias("property_id")).distinct()
    known = t.fam.select(F.col("sid").alias("name"), F.col("assay").alias("property_id"),
                         F.when(F.col("value") == 1, "positive").otherwise("negative").alias("known"))
    return ask.join(known, ["name", "property_id"], "left").select(
        "name", "property_id", F.coalesce("known", F.lit("unknown")).alias("known"))


@query("cooccurrence", """select x as target, y as feature, sum(n)::bigint as n,
    sum(case when vx = vy then n else 0 end)::bigint as n_same from PC group by all having sum(n) > 30""")
def _(t):
    return features.cooccurrence(t.cons)


@query("split_overlap", "select count(*) as n_shared from (select distinct sid from TRN where sid in (select sid from HLD)) s")
def _(t):
    return dataset.split_overlap(t.trn, t.hld)


@query("novelty_anti", """with k as (select l_partkey || '-' || l_suppkey as text, l_linenumber as n from lineitem)
    select distinct text from k where n > 4 and text not in (select text from k where n <= 2)
    and text not in (select text from k where n = 3)""")
def _(t):
    k = t.raw("lineitem").select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("text"), F.col("l_linenumber").alias("n"))
    return clean.novel_items(k.filter("n > 4").select("text"), [k.filter("n <= 2"), k.filter("n = 3")], "text")


@query("distinct_rows", "select distinct l_suppkey as assay, l_returnflag as flag from lineitem")
def _(t):
    return t.raw("lineitem").select(F.col("l_suppkey").alias("assay"), F.col("l_returnflag").alias("flag")).distinct()


@query("dedupe_subset", """select l_orderkey, l_suppkey, l_linenumber, l_partkey from (select *, row_number() over
    (partition by l_orderkey, l_suppkey order by l_linenumber, l_partkey) as r from lineitem) t where r = 1""")
def _(t):
    df = t.raw("lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    return clean.dedupe_subset(df, ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey"])


@query("union_methods", """select 'first' as method, assay, round(auc, 6) as auc from MET where nprops = 0
    union all select 'later', assay, round(auc, 6) from MET where nprops > 0""")
def _(t):
    m = rounded(t.met, "auc")
    first = m.filter("nprops = 0").select(F.lit("first").alias("method"), "assay", "auc")
    return first.unionByName(m.filter("nprops > 0").select(F.lit("later").alias("method"), "assay", "auc"))


@query("first_per_key", "select p_brand, min(p_name) as p_name, min(p_partkey) as first_part from part group by p_brand")
def _(t):
    by_name = clean.first_per_key(t.raw("part", "p_brand", "p_name"), "p_brand", "p_name")
    by_part = clean.first_per_key(t.raw("part").select("p_brand", F.col("p_partkey").alias("first_part")), "p_brand", "first_part")
    return by_name.join(by_part, "p_brand")


@query("key_uniqueness", """select max(n) as max_rows_per_token, (max(n) = 1)::int as is_unique from
    (select property_token, count(*) as n from PROP group by property_token) t""")
def _(t):
    n = t.prop.groupBy("property_token").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max("n").alias("max_rows_per_token"), (F.max("n") == 1).cast("int").alias("is_unique"))


@query("quality_checks", """with j as (select d.doc_id, lang, quality from documents d left join labels l on d.doc_id = l.doc_id)
    select unnest(['doc_id', 'lang', 'quality']) as column_name, unnest(['bigint', 'string', 'int']) as data_type,
    unnest([sum((doc_id is null)::int), sum((lang is null)::int), sum((quality is null)::int)])::bigint as n_null,
    count(*) as n_rows, (count(*) > 100)::int as enough_rows from j""")
def _(t):
    df = t.raw("documents", "doc_id", "lang").join(t.raw("labels", "doc_id", "quality"), "doc_id", "left")
    return clean.quality_checks(df, ["doc_id", "lang", "quality"], 100)


@query("property_catalog", """select property_token, title, source, string_agg(category || ':' || reason, ';' order by category) as categories
    from PROP join SRC using (source_id) left join PCAT using (property_id) group by all""")
def _(t):
    c = cat.property_catalog(t.prop, t.pcat, t.src)
    names = F.transform("categories", lambda x: F.concat_ws(":", x["category"], x["reason"]))
    return c.select("property_token", "title", "source", F.array_join(names, ";").alias("categories"))


@query("catalog_metadata", """select property_token, json_extract_string(data, '$.unit') as unit,
    json_extract(data, '$.rank')::bigint as rank from PROP""")
def _(t):
    return cat.catalog_metadata(t.prop, "unit string, rank bigint").select("property_token", "metadata.unit", "metadata.rank")
