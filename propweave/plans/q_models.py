"""Feature selection, conditional scoring, similarity, streaming and the end-to-end job."""

from __future__ import annotations

from pyspark.sql import functions as F

from propweave.operators import ann, clean, features, metrics, reports, scoring, similarity
from propweave.plans.fixtures import family_of
from propweave.plans.pipeline import job, run_pipeline
from propweave.plans.q_tables import ASKED, asked_families
from propweave.plans.registry import query, r6, rounded, text
from propweave.sources import logs
from propweave.sources.follow import append_log, lines, log_rows
from propweave.sources.scratch import materialise, scratch_path
from propweave.streaming.logs import follow_log, latest, log_summary, run_available, stream_dedupe, stream_table, tail_rows, watch_log

ENT = """(with c as (select x, y, vy, sum(n)::double as n from PC group by all),
    h as (select *, sum(n) over (partition by x, y) as tot from c)
    select x as target, y as feature, max(tot)::bigint as n, greatest(-sum(n / tot * log2(n / tot)), 0) as entropy
    from h group by all having max(tot) > 30)"""


@query("useful_features", f"select target, feature, n, round(entropy, 6) as entropy from {ENT} e where entropy > 0.025 and entropy <= 0.9")
def _(t):
    return rounded(features.useful_features(t.cons), "entropy")


@query("holdout_features", """with c as (select a.assay as x, b.assay as y, b.value as vy, count(*)::double as n from TRN a join TRN b using (sid) group by all),
    h as (select *, sum(n) over (partition by x, y) as tot from c),
    u as (select x as target, y as feature from h group by all having max(tot) > 30 and -sum(n / tot * log2(n / tot)) > 0.025
          and -sum(n / tot * log2(n / tot)) <= 0.9)
    select a.sid, u.target, a.value as target_value, u.feature, b.value as feature_value
    from HLD a join u on a.assay = u.target join HLD b on b.sid = a.sid and b.assay = u.feature""")
def _(t):
    return features.holdout_features(t.trn, t.hld).select("sid", "target", "target_value", "feature", "feature_value")


@query("conditional_table", """select target, feature, fvalue, support::bigint as support, n1::bigint as n1, round(p1, 6) as p1,
    round(prior, 6) as prior, round(lift, 6) as lift, round(llr, 6) as llr from COND""")
def _(t):
    return rounded(features.conditional_table(t.cons), "p1", "prior", "lift", "llr")


@query("information_gain", """with h as (select x, y, n::double as n, sum(n) over (partition by x, y)::double as tot,
        sum(n) over (partition by x, y, vy)::double as cf, sum(n) over (partition by x, y, vx)::double as cv from PC where x <> y)
    select x as target, y as feature, max(tot)::bigint as support, round(greatest(sum(n / tot * (log2(n / cf) - log2(cv / tot))), 0), 6) as gain
    from h group by all having max(tot) > 30""")
def _(t):
    return rounded(features.information_gain(t.cons), "gain")


@query("known_context", """with o as (select a.sid, a.assay as target, b.assay as feature, b.value, row_number() over (partition by a.sid, a.assay
        order by md5('137|' || a.sid || '|1|' || b.assay)) as rn from FAM a join FAM b on a.sid = b.sid and a.assay <> b.assay)
    select sid, target, count(*) as n_known, sum(value)::bigint as n_positive,
    string_agg(feature || ':' || value, ' ' order by feature) as context from o where rn <= 16 group by sid, target""")
def _(t):
    req = t.fam.select("sid", F.col("assay").alias("target"))
    ctx = scoring.known_context(req, t.fam).filter(F.size("context") > 0)
    pair = F.transform("context", lambda p: F.concat_ws(":", p["assay_index"], p["value"]))
    pos = F.aggregate("context", F.lit(0).cast("bigint"), lambda s, p: s + p["value"])
    return ctx.select("sid", "target", F.size("context").cast("bigint").alias("n_known"), pos.alias("n_positive"),
                      F.array_join(pair, " ").alias("context"))


def _draws(known: str, requests: str, r: int, k: int | None = 4, distinct: bool = True) -> str:
    """SQL for the seeded contexts: (sid, target, pairs list); ``distinct``: equal draws of a request once; no ``k``: all values."""
    return f"""(select {'distinct' if distinct else ''} sid, target, pairs from (select sid, target, rep, list(feature || ':' || fvalue order by feature) as pairs from
        (select q.sid, q.target, k.assay as feature, k.value as fvalue, rep, row_number() over (partition by q.sid, q.target, rep
            order by md5('137|' || q.sid || '|' || rep || '|' || k.assay)) as rn
         from (select distinct sid, target from {requests} o) q join {known} k on k.sid = q.sid and k.assay <> q.target, range(1, {r} + 1) g(rep)) a
        {'' if k is None else f'where rn <= {k}'} group by sid, target, rep) b)"""


FREQ = "(select sid, assay as target from FAM)"


@query("random_contexts", f"select sid, target, array_to_string(pairs, ' ') as pairs from {_draws('FAM', FREQ, 10)} d")
def _(t):
    req = t.fam.select("sid", F.col("assay").alias("target"))
    out = scoring.random_contexts(req, t.fam, k=4, r=10).filter(F.size("pairs") > 0)
    pair = F.transform("pairs", lambda p: F.concat_ws(":", p["assay_index"], p["value"]))
    return out.select("sid", "target", F.array_join(pair, " ").alias("pairs"))


def _predictions(known: str, requests: str, cond: str, prior: str, r: int, distinct: bool = False, k: int | None = 4) -> str:
    """SQL for the mean naive-Bayes probability over the contexts; a request without context uses the prior."""
    return f"""(with d as (select *, row_number() over () as ctx from {_draws(known, requests, r, k, distinct)} z),
        e as (select sid, target, ctx, unnest(pairs) as p from d),
        s as (select e.sid, e.target, ctx, coalesce(sum(llr), 0) as llr from e left join {cond} c on c.target = e.target
              and c.feature = split_part(p, ':', 1)::bigint and c.fvalue = split_part(p, ':', 2)::int group by all),
        q as (select distinct sid, target from {requests} y),
        w as (select q.sid, q.target, 1 / (1 + exp(-(ln(prior / (1 - prior)) + coalesce(llr, 0)))) as prob
              from q join {prior} pr on pr.target = q.target left join s on s.sid = q.sid and s.target = q.target)
        select sid, target, avg(prob) as prob, count(*) as n_contexts from w group by sid, target)"""


@query("predict_property", f"select sid, target, round(prob, 6) as prob, n_contexts from {_predictions('FAM', FREQ, 'FCOND', 'FPRIOR', 10, k=None)} p")
def _(t):
    fam = t.families
    req = fam.select("sid", F.col("assay").alias("target"))
    out = scoring.predict_property(req, fam, features.conditional_table(fam), features.priors(fam), r=10)
    return rounded(out, "prob")


FALL = f"(select c.name as sid, p.target from {ASKED} c, FPRIOR p)"


@query("score_all", f"select sid, target, round(prob, 6) as prob, n_contexts from {_predictions('FAM', FALL, 'FCOND', 'FPRIOR', 3, True)} p")
def _(t):
    fam = t.families
    out = scoring.score_all(asked_families(t).withColumnRenamed("name", "sid"), fam, features.conditional_table(fam), features.priors(fam), r=3)
    return rounded(out, "prob")


REQS = """(select p_partkey as request_id, case when p_size = 1 then null else 'F' || p_partkey // 16 end as sid,
    (p_partkey % (select count(*) + 3 from supplier)) + 8 as property_token from part)"""


@query("batch_requests", f"""with r as (select * from {REQS} x),
    n as (select r.*, property_id as target, case when sid is null or r.property_token is null then 'missing argument'
          when property_id is null then 'unknown property token' end as error from r left join PROP on PROP.property_token = r.property_token),
    a as (select * from {_predictions('FAM', "(select sid, target from n where error is null)", 'FCOND', 'FPRIOR', 5)} p)
    select request_id, n.sid, property_token, round(prob, 6) as value, error from n left join a on a.sid = n.sid and a.target = n.target""")
def _(t):
    n = t.raw("supplier").count()
    req = t.raw("part").select(
        F.col("p_partkey").alias("request_id"),
        F.when(F.col("p_size") != 1, family_of("p_partkey")).alias("sid"),
        (F.col("p_partkey") % (n + 3) + 8).alias("property_token"))
    tokens = t.prop.select("property_token", F.col("property_id").alias("target"))
    fam = t.families
    out = scoring.batch_requests(req, fam, tokens, features.conditional_table(fam), features.priors(fam), r=5)
    return rounded(out, "value")


EVAL = """cl as (select a.assay as target, b.assay as feature, b.value as fvalue, count(*)::double as support, sum(a.value)::double as n1
        from TRN a join TRN b using (sid) where a.assay <> b.assay group by all),
    cs as (select *, sum(n1) over (partition by target, feature) as all1, sum(support) over (partition by target, feature) as alln from cl),
    co as (select target, feature, fvalue, ln((n1 + 1) / (all1 + 2)) - ln((support - n1 + 1) / (alln - all1 + 2)) as llr from cs where alln > 30),
    pr as (select assay as target, (sum(value) + 1.0::double) / (count(*) + 2) as prior from TRN group by assay),
    rk as (select a.sid, a.assay as target, a.value as y, b.assay as feature, b.value as fvalue, row_number() over (partition by a.sid, a.assay
            order by md5('137|' || a.sid || '|1|' || b.assay)) as rn, count(*) over (partition by a.sid, a.assay) as m
           from HLD a join HLD b on a.sid = b.sid and a.assay <> b.assay),
    sc as (select g.nprops, sid, rk.target, any_value(y) as y, round(1 / (1 + exp(-(any_value(ln(prior / (1 - prior)))
            + coalesce(sum(llr) filter (rn <= g.nprops), 0)))), 9) as prob
           from rk join pr using (target) left join co on co.target = rk.target and co.feature = rk.feature and co.fvalue = rk.fvalue,
           range(0, 5) g(nprops) where m >= 4 and rn <= 4 group by g.nprops, sid, rk.target),
    ra as (select *, rank() over (partition by nprops, target order by prob) + (count(*) over (partition by nprops, target, prob) - 1) / 2.0::double as ar from sc),
    mt as (select nprops, target, sum(y)::double as n1, sum(1 - y)::double as n0, sum(y * ar) as sr,
           sum((prob > 0.5 and y = 1)::int)::double as tp, sum((prob <= 0.5 and y = 0)::int)::double as tn from ra group by all)"""


@query("eval_by_nprops", f"""with {EVAL} select nprops, target, round((sr - n1 * (n1 + 1) / 2) / (n1 * n0), 6) as auc, round((tp + tn) / (n1 + n0), 6) as acc,
    n1::bigint as num_pos, n0::bigint as num_neg from mt where n1 >= 10 and n0 >= 10 and n1 + n0 >= 20""")
def _(t):
    m = scoring.eval_by_nprops(t.trn, t.hld)
    return rounded(m.select("nprops", "target", "auc", "acc", "num_pos", "num_neg"), "auc", "acc")


@query("lr_scores", "select count(*) as n_rows, count(distinct sid) as n_substances, count(*) as n_in_range, sum(value)::bigint as n_positive from HLD")
def _(t):
    from propweave.functions.symbols import bracketed, split_symbols

    def rows(part):
        known = scoring.known_context(part.select("sid", F.col("assay").alias("target"), "value"), part)
        tok = F.transform("context", lambda p: F.concat_ws("=", p["assay_index"], p["value"]))
        return known.select("sid", F.col("target").alias("assay"), "value", split_symbols(bracketed(F.col("sid").cast("string"))).alias("symbols"),
                            F.concat(tok, F.array(F.concat(F.lit("target="), "target"))).alias("known_tokens"))
    out = scoring.learned_scores(rows(t.trn), rows(t.hld))
    inside = F.sum(F.when(F.col("prob").between(0, 1), 1).otherwise(0))
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sid").alias("n_substances"), inside.alias("n_in_range"),
                   F.sum(F.col("value").cast("bigint")).alias("n_positive"))


BENCH = """with c as (select a.assay as x, b.assay as y, a.value as vx, b.value as vy, count(*)::double as n from TRN a join TRN b using (sid) group by all),
    f as (select x, y, vy, sum(n) as n from c group by all), h as (select *, sum(n) over (partition by x, y) as tot from f),
    u as (select x as target, y as feature from h group by all having max(tot) > 30 and -sum(n / tot * log2(n / tot)) > 0.025
          and -sum(n / tot * log2(n / tot)) <= 0.9),
    cl as (select x as target, y as feature, vy as fvalue, sum(n) as support, sum(n * vx) as n1 from c where x <> y group by all),
    cs as (select *, sum(n1) over (partition by target, feature) as all1, sum(support) over (partition by target, feature) as alln from cl),
    co as (select target, feature, fvalue, ln((n1 + 1) / (all1 + 2)) - ln((support - n1 + 1) / (alln - all1 + 2)) as llr from cs where alln > 30),
    pr as (select assay as target, (sum(value) + 1.0::double) / (count(*) + 2) as prior from TRN group by assay),
    k as (select a.sid, u.target, a.value as y, u.feature, b.value as fvalue from HLD a join u on a.assay = u.target
          join HLD b on b.sid = a.sid and b.assay = u.feature),
    d as (select *, row_number() over (partition by sid, target, rep order by md5('137|' || sid || '/' || target || '|' || rep || '|' || feature)) as rn
          from k, range(1, 11) g(rep)),
    e as (select sid, target, any_value(y) as y, rep, list(feature || ':' || fvalue order by feature) as pairs from d where rn <= 4 group by sid, target, rep),
    o as (select distinct sid, target, y, pairs from e), n as (select *, row_number() over () as ctx from o),
    p as (select sid, target, y, ctx, unnest(pairs) as q from n),
    s as (select p.sid, p.target, p.y, ctx, 1 / (1 + exp(-(any_value(ln(prior / (1 - prior))) + coalesce(sum(llr), 0)))) as prob
          from p join pr using (target) left join co on co.target = p.target and co.feature = split_part(q, ':', 1)::bigint
          and co.fvalue = split_part(q, ':', 2)::int group by p.sid, p.target, p.y, ctx),
    m as (select sid, target, y, round(avg(prob), 9) as prob from s group by all),
    ra as (select *, rank() over (partition by target order by prob) + (count(*) over (partition by target, prob) - 1) / 2.0::double as ar from m),
    au as (select target, sum(y)::double as n1, sum(1 - y)::double as n0, sum(y * ar) as sr from ra group by all)"""


@query("feature_benchmark", f"""{BENCH} select source, round(median((sr - n1 * (n1 + 1) / 2) / (n1 * n0)), 4) as auc, count(*) as n
    from au join PROP on target = property_id join SRC using (source_id) where n1 > 0 and n0 > 0 group by source""")
def _(t):
    src = t.prop.join(t.src, "source_id").select(F.col("property_id").alias("assay"), "source")
    return scoring.feature_benchmark(t.trn, t.hld, src).withColumn("auc", F.round("auc", 4))


NEAR = "(select *, row_number() over (partition by qid order by score desc, cid) as r from SIM)"


@query("knn_predict", f"""select e.id, value, n.prediction, coalesce(n.n, 0) as n_neighbours from EMB e left join
    (select qid, round(avg(value), 6) as prediction, count(*) as n from {NEAR} t where r <= 5 and score > 0.25 group by qid) n on n.qid = e.id""")
def _(t):
    q = t.emb.select("id", "vec", "value")
    out = similarity.knn_predict(q, q, k=5, minsim=0.25, exclude_self=True)
    return rounded(out, "prediction")


@query("knn_dist_predict", """with d as (select q.id as qid, c.id as cid, c.value,
        round(list_dot_product(q.vec, q.vec) + list_dot_product(c.vec, c.vec) - 2 * list_dot_product(q.vec, c.vec), 6) as dist
        from EMB q, EMB c where q.id <> c.id),
    r as (select *, row_number() over (partition by qid order by dist, cid) as r from d)
    select e.id, value, n.prediction, coalesce(n.n, 0) as n_neighbours from EMB e left join
    (select qid, round(avg(value), 6) as prediction, count(*) as n from r where r <= 5 and dist < 1.5 group by qid) n on n.qid = e.id""")
def _(t):
    q = t.emb.select("id", "vec", "value")
    return rounded(similarity.knn_dist_predict(q, q, k=5, maxdist=1.5, exclude_self=True), "prediction")


def _half(n: int) -> str:
    part = "1:32" if n == 0 else "33:64"
    return f"""select '{'head' if n == 0 else 'tail'}' as method, q.id, q.block, q.value, round(list_dot_product(q.vec[{part}], c.vec[{part}]), 6) as score,
        c.id as cid, c.value as cvalue from EMB q join EMB c on q.block = c.block and q.id <> c.id"""


@query("knn_by_label", f"""with s as ({_half(0)} union all {_half(1)}),
    r as (select *, row_number() over (partition by method, id order by score desc, cid) as r from s)
    select method, e.id, e.block, e.value, round(avg(cvalue), 6) as prediction, count(cvalue) as n_neighbours
    from EMB e cross join (values ('head'), ('tail')) m(method)
    left join r on r.id = e.id and r.method = m.method and r.r <= 5 and r.score > 0.1 group by m.method, e.id, e.block, e.value""".replace(
        "select method, e.id, e.block", "select m.method, e.id, e.block"))
def _(t):
    from propweave.operators.ordering import union_all

    halves = {"head": F.slice("vec", 1, 32), "tail": F.slice("vec", 33, 32)}  # two embeddings of the same rows
    outs = []
    for name, vec in halves.items():
        e = t.emb.select("id", vec.alias("vec"), "block", "value")
        outs.append(similarity.knn_predict(e, e, k=5, minsim=0.1, block="block", exclude_self=True)
                    .withColumn("method", F.lit(name)))
    return rounded(union_all(outs), "prediction").select("method", "id", "block", "value", "prediction", "n_neighbours")


@query("knn_metrics", f"""with n as (select qid, avg(value) as p from {NEAR} t where r <= 5 and score > 0.25 group by qid),
    k as (select value, p, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::double as ar from n join EMB e on e.id = n.qid),
    m as (select sum(value)::double as n1, sum(1 - value)::double as n0, sum(value * ar) as sr, sum((p > 0.5 and value = 1)::int)::double as tp,
          sum((p > 0.5 and value = 0)::int)::double as fp from k)
    select tp::bigint as tp, (n0 - fp)::bigint as tn, round(tp / n1, 6) as sensitivity, round((n0 - fp) / n0, 6) as specificity,
    round((tp + n0 - fp) / (n1 + n0), 6) as acc, round((tp / n1 + (n0 - fp) / n0) / 2, 6) as bac,
    round((sr - n1 * (n1 + 1) / 2) / (n1 * n0), 6) as auc, (n1 + n0)::bigint as n, (select count(*) from EMB) as groupsize from m""")
def _(t):
    q = t.emb.select("id", "vec", "value")
    pred = similarity.knn_predict(q, q, k=5, minsim=0.25, exclude_self=True).withColumn("g", F.lit(1))
    pred = materialise(pred, "predictions")  # counts, ranks and sizes read it
    m = metrics.confusion_by_group(pred, ["g"], "value", "prediction", strict=True)
    cols = ["tp", "tn", "sensitivity", "specificity", "acc", "bac", "auc", "n", "groupsize"]
    return rounded(m, "sensitivity", "specificity", "acc", "bac", "auc").select(*cols)


@query("analogues", f"""select qid as id, string_agg(r || ':' || cid || ':' || value, ' ' order by r) as analogues, round(avg(value), 6) as mean_value,
    round(max(score), 6) as best from (select *, row_number() over (partition by qid order by score desc, cid) as r from SIM where same_block) t
    where r <= 5 group by qid""")
def _(t):
    q = t.emb.select("id", "vec", "value", "block")
    a = similarity.analogues(q, q, k=5, block="block", exclude_self=True)
    one = F.transform("analogues", lambda x: F.concat_ws(":", x["rank"], x["id"], x["value"].cast("int")))
    best = F.array_max(F.transform("analogues", lambda x: x["weight"]))
    return a.select("id", F.array_join(one, " ").alias("analogues"), r6("mean_value").alias("mean_value"), r6(best).alias("best"))


TRIP = """(select block, qid, cid, case when qcls = ccls then 'positive' else 'negative' end as kind, rank, score from
    (select s.*, row_number() over (partition by qid, ccls order by score desc, cid) as rank from SIM s join
        (select id from (select id, row_number() over (partition by block order by md5('42|' || id), id) as a from EMB) z where a <= 150) k
        on k.id = s.qid where same_block) t where rank <= 5)"""


@query("triplets", f"select block, qid, cid, kind, rank, round(score, 6) as score from {TRIP} t")
def _(t):
    return rounded(similarity.triplets(t.emb.select("id", "vec", "block", "cls"), label="block"), "score")


@query("triplet_gap", f"""select block, round(avg((1 + score) / 2) filter (kind = 'positive'), 6) as pos_sim,
    round(avg((1 + score) / 2) filter (kind = 'negative'), 6) as neg_sim,
    round(avg((1 + score) / 2) filter (kind = 'positive') - avg((1 + score) / 2) filter (kind = 'negative'), 6) as gap from {TRIP} t group by block""")
def _(t):
    found = similarity.triplets(t.emb.select("id", "vec", "block", "cls"), label="block")
    return rounded(similarity.triplet_gap(found, "block"), "pos_sim", "neg_sim", "gap")


@query("fingerprint", "select id as doc_id, len(bits) as n_bits, md5(array_to_string(bits, ' ')) as digest from FSETS")
def _(t):
    fp = similarity.fingerprint(t.docs(), "text")
    return fp.select("doc_id", F.size("bits").cast("bigint").alias("n_bits"), F.md5(text("bits")).alias("digest"))


@query("tanimoto_pairs", """with u as (select id, unnest(bits) as h from FSET),
    p as (select a.id as a, b.id as b, count(*) as k from u a join u b on a.h = b.h and a.id <> b.id group by all)
    select * from (select a, b, x.copies as copies_a, y.copies as copies_b, round(k::double / (x.n + y.n - k), 6) as tanimoto
        from p join FSET x on x.id = a join FSET y on y.id = b where x.n < y.n or (x.n = y.n and a < b)) t where tanimoto >= 0.5""")
def _(t):
    return similarity.tanimoto_pairs(similarity.fingerprint(t.docs(), "text"), "doc_id", 0.5)


@query("set_diversity", """with s as (select h, sum(w) as w from (select unnest(bits) as h, 1 / sqrt(len(bits)) as w from FSETS) a group by h)
    select (select count(*) from FSETS) as n, round((sum(w * w) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 9) as mean_cosine
    from s, (select count(*)::double as n from FSETS) c""")
def _(t):
    out = similarity.set_diversity(similarity.fingerprint(t.docs(), "text"))
    return out.withColumn("mean_cosine", F.round("mean_cosine", 9))


@query("tanimoto_diversity", """with p as (select a.copies * b.copies as w, round(bit_count(a.bs & b.bs)::double / (a.n + b.n - bit_count(a.bs & b.bs)), 6) as s
        from FBIT a join FBIT b on a.id < b.id union all select copies * (copies - 1) // 2, 1.0 from FBIT where copies > 1)
    select least(floor(s * 20 + 1e-9), 19)::int as bin, sum(w)::bigint as n_pairs, round(sum(w * s) / sum(w), 5) as mean_sim from p group by all""")
def _(t):
    fp = similarity.fingerprint(t.docs(), "text", n_bits=2048)
    return similarity.tanimoto_diversity(fp, "doc_id").withColumn("mean_sim", F.round("mean_sim", 5))


@query("cosine_pairs", """with d as (select list(category order by category) as cs from (select distinct category from PCAT) c),
    m as (select property_id as id, category, avg(prediction) as v from ALT group by all),
    g as (select p.id, c.category from (select distinct id from m) p, (select distinct category from PCAT) c),
    x as (select id, list(coalesce(v, 0.0) order by category)::double[] as vec from g left join m using (id, category) group by id),
    u as (select id, list_transform(vec, lambda e: e / sqrt(list_dot_product(vec, vec))) as vec from x),
    s as (select a.id as qid, b.id as cid, round(list_dot_product(a.vec, b.vec), 6) as score from u a join u b on a.id <> b.id)
    select qid, cid, round(1 - score, 6) as distance, r as rank from
    (select *, row_number() over (partition by qid order by score desc, cid) as r from s) z where r <= 5""")
def _(t):
    names = reports.dimension(t.pcat, "category")
    wide = reports.pivot_mean(t.alt, "property_id", "category", names, "prediction")
    return similarity.cosine_neighbours(wide.select(F.col("property_id").alias("id"), F.array(*names).alias("vec")), k=5)


@query("cosine_columns", """with m as (select property_id, category, avg(prediction) as v from ALT group by all),
    n as (select category, sqrt(sum(v * v)) as len from m group by category having sum(v * v) > 0),
    d as (select a.category as a, b.category as b, sum(a.v * b.v) as dot from m a join m b using (property_id) where a.category < b.category group by all)
    select x.category as a, y.category as b, round(1 - coalesce(dot, 0) / (x.len * y.len), 6) as distance
    from n x join n y on x.category < y.category left join d on d.a = x.category and d.b = y.category""")
def _(t):
    return rounded(similarity.pivot_column_distances(t.alt, "property_id", "category", "prediction"), "distance")


@query("knn_lsh", "select count(*) * 5 as n, 1 as recall_reached from EMB")
def _(t):
    q = t.emb.select("id", "vec", "value")
    exact = similarity.neighbours(q, q, k=5, exclude_self=True)
    r = similarity.recall(similarity.knn_lsh(q, q, k=5, exclude_self=True), exact)
    return r.select("n", (F.col("recall") >= 0.9).cast("int").alias("recall_reached"))


@query("knn_index", """select v as visits, count(*) * 5 as n, case when v = 'all' then 1 end as recall_reached, (v = 'two')::int as less_than_half
    from EMB, (select unnest(['two', 'all']) as v) group by v""")
def _(t):
    """A trained index, two lists visited and all: the share of the corpus compared by code, and the recall beside the exact search."""
    q = t.emb.select("id", "vec", "value")
    index, exact = ann.fit(q), similarity.neighbours(q, q, k=5, metric="l2", exclude_self=True)
    out = []
    for name, visits in (("two", 2), ("all", ann.MOST_LISTS)):
        work = ann.comparisons(q, index, visits).first()
        r = similarity.recall(ann.search(q, index, 5, visits, rerank=100, exclude_self=True), exact)
        out.append(r.select(F.lit(name).alias("visits"), "n", F.when(F.lit(name) == "all", (F.col("recall") >= 0.9).cast("int")).alias("recall_reached"),
                            F.lit(int(2 * work["per_query"] < work["corpus"])).alias("less_than_half")))
    return out[0].unionByName(out[1])


@query("quality_rates", r"""select count(*) as n, round(avg((length(text) > 0 and length(text) <= 200 and regexp_full_match(text, '[A-Za-z ,.\n]*'))::int), 6) as validity,
    round(avg((text not in (select text from documents))::int), 6) as novelty from conversations""")
def _(t):
    out = clean.quality_rates(t.raw("conversations", "text"), t.raw("documents", "text"), "text", r"A-Za-z ,.\n", 200)
    return rounded(out, "validity", "novelty")


@query("stream_log_summary", """select type, count(*) as n_rows, round(min(loss), 6) as min_loss, arg_min(batch, loss * 1e9 + batch / 1e9) as best_batch,
    max(batch) as last_batch, round(arg_max(loss, batch), 6) as last_loss from LOG group by type""")
def _(t):
    path = logs.write_log(t.log, scratch_path(t.spark, "live-log"), files=4)
    live = log_summary(logs.stream_log(t.spark, path, files_per_trigger=2))
    return rounded(run_available(live, scratch_path(t.spark, "log-summary"), "complete"), "min_loss", "last_loss")


@query("stream_log_tail", """with r as (select type, batch, round(loss, 6) as loss, row_number() over (partition by type order by batch desc)::int as from_end,
    round(min(loss) over (partition by type), 6) as min_loss from LOG) select *, (loss <= min_loss)::int as is_min from r where from_end <= 5""")
def _(t):
    path = logs.write_log(t.log, scratch_path(t.spark, "live-log"), files=4)
    out = watch_log(logs.stream_log(t.spark, path, files_per_trigger=2), scratch_path(t.spark, "log-tail"), 5)
    return rounded(out, "loss", "min_loss")


def _grown(t, follow):
    """The log comes in three appends to files that grow; after each a stream on the same folder is started again."""
    folder, state = scratch_path(t.spark, "growing-log"), scratch_path(t.spark, "growing-state")
    ends = t.log.agg(F.min("batch").alias("lo"), F.max("batch").alias("hi")).first()
    step = ((ends["hi"] or 0) - (ends["lo"] or 0)) // 3 + 1
    out = None
    for k in range(3):
        part = F.floor((F.col("batch") - (ends["lo"] or 0)) / step)
        append_log(t.log.filter(part == k), folder)
        out = run_available(follow(log_rows(lines(t.spark, folder, header=True, pattern="*.tsv"))), state, "append")
    return out


@query("log_follow", "select type, batch, round(loss, 6) as loss, round(lr, 6) as lr from LOG")
def _(t):
    return rounded(_grown(t, lambda rows: rows), "loss", "lr")


@query("log_state", """with b as (select type, batch, loss, row_number() over (partition by type order by batch) as i, count(*) over (partition by type) as n_rows,
        min(loss) over (partition by type) as min_loss from LOG),
    m as (select type, min(i) as place, arg_min(batch, i) as best_batch from b where loss = min_loss group by type)
    select type, n_rows, 0::bigint as late, round(min_loss, 6) as min_loss, best_batch, n_rows - place as since_best, batch, round(loss, 6) as loss, (n_rows - i + 1)::int as from_end
    from b join m using (type) where n_rows - i < 5""")
def _(t):
    reports = _grown(t, lambda rows: follow_log(rows, 5))
    state = latest(reports).select("type", "n_rows", "late", "best_batch", "since_best")
    return rounded(tail_rows(reports).drop("is_min").join(state, "type"), "loss", "min_loss")


@query("stream_dedupe", """select distinct user_id, event_type, strftime(ts, '%Y-%m-%d') as day from events""")
def _(t):
    schema = t.raw("events").schema
    seen = stream_dedupe(stream_table(t.spark, t.dir, "events.parquet", schema), ["user_id", "event_type"])
    out = run_available(seen, scratch_path(t.spark, "dedupe"), "append")
    return out.select("user_id", "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("pipeline_end_to_end", f"""with ka as (select assay from ACT group by assay having sum(value) >= 200 and sum(1 - value) >= 200
        and abs(sum(1 - value) - sum(value))::double / count(*) <= 0.9),
    kc as (select sid, assay, max(value) as value from ACT where assay in (select assay from ka) group by sid, assay having count(distinct value) = 1),
    px as (select assay, row_number() over (order by count(*) desc, assay) - 1 + (select count(*) from VOC) as token from kc group by assay),
    ex as (select sid, token as assay, value, ('0x' || substr(md5('37|' || sid), 1, 8))::bigint % 1000 as b from kc join px using (assay)),
    etrn as (select sid, assay, value from ex where b < 500), ehld as (select sid, assay, value from ex where b >= 600),
    {EVAL.replace("TRN", "etrn").replace("HLD", "ehld")}
    select source, nprops, round(median((sr - n1 * (n1 + 1) / 2) / (n1 * n0)), 6) as auc, count(*) as n
    from mt join px on token = target join PROP on px.assay = property_id join SRC using (source_id)
    where n1 >= 10 and n0 >= 10 and n1 + n0 >= 20 group by source, nprops""")
def _(t):
    return run_pipeline(t.spark, t.dir)


@query("stage_graph", """with ka as (select assay from ACT group by assay having sum(value) >= 200 and sum(1 - value) >= 200
        and abs(sum(1 - value) - sum(value))::double / count(*) <= 0.9),
    kc as (select sid, assay from ACT where assay in (select assay from ka) group by sid, assay having count(distinct value) = 1)
    select 'substances' as stage, '' as output, count(*) as rows, 'kept' as state from part
    union all select 'vocab', '', count(*), 'kept' from VOC
    union all select 'encoded', '', count(*), 'kept' from part
    union all select 'activities', '', count(*), 'kept' from kc
    union all select 'examples', '', count(distinct sid), 'ran' from kc
    union all select 'long', '', count(*), 'ran' from kc
    union all select 'catalog', 'activity', count(*), 'kept' from kc
    union all select 'catalog', 'category', count(distinct category), 'kept' from PCAT
    union all select 'catalog', 'property', count(*), 'kept' from PROP
    union all select 'catalog', 'property_category', count(*), 'kept' from PCAT
    union all select 'catalog', 'source', count(distinct source_id), 'kept' from PROP
    union all select 'metrics', '', null, 'ran' union all select 'report', '', null, 'ran'""")
def _(t):
    """The job twice in one folder, the second time with another split: what came before the split is read."""
    folder = scratch_path(t.spark, "stage-graph")
    job(t.spark, t.dir, folder)
    second = job(t.spark, t.dir, folder, weights=(0.6, 0.1, 0.3)).manifest()
    return second.withColumn("rows", F.when(~F.col("stage").isin("metrics", "report"), F.col("rows")))
