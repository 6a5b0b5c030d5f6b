"""Metrics, reports and window-type queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from propweave.operators import features, metrics, ordering, reports, scoring
from propweave.plans.registry import query, r6, rounded

MET_COLS = ["auc", "acc", "bac", "cross_entropy_loss"]
MET_R = ", ".join(f"round({c}, 6) as {c}" for c in MET_COLS)
MSRC = "MET join PROP on assay = property_id join SRC using (source_id)"


def _msrc(t):
    return t.met.join(t.prop.join(t.src, "source_id").select("property_id", "title", "property_token", "source"),
                      F.col("assay") == F.col("property_id")).drop("property_id")


def _mcat(t):
    return t.met.join(t.pcat.filter("strength > 8.0").select("property_id", "category", "strength"),
                      F.col("assay") == F.col("property_id")).drop("property_id")


MCAT = "(select MET.*, category, strength from MET join PCAT on assay = property_id where strength > 8.0)"


@query("support_counts", """select nprops, assay, count(distinct chemical_id) as n_items, sum(value)::bigint as num_pos,
    sum(1 - value)::bigint as num_neg from PRED group by all""")
def _(t):
    return metrics.support_counts(t.pred, ["nprops", "assay"], "value", "chemical_id")


@query("binary_metrics", f"select nprops, assay, {MET_R}, num_pos, num_neg from MET")
def _(t):
    return rounded(t.met, *MET_COLS)


@query("metrics_struct", "select nprops, assay, round(auc, 6) as auc, round(bac, 6) as bac from MET")
def _(t):
    packed = t.met.select("nprops", "assay", F.struct("auc", "acc", "bac").alias("metrics"))
    return packed.select("nprops", "assay", r6("metrics.auc").alias("auc"), r6("metrics.bac").alias("bac"))


@query("confusion_by_group", """with k as (select *, case when probs < 0.04 then null else probs end as p from PRED),
    r as (select *, rank() over (partition by assay order by p) + (count(*) over (partition by assay, p) - 1) / 2.0::double as ar
          from k where p is not null),
    m as (select assay, sum(value)::double as n1, sum(1 - value)::double as n0, sum(value * ar) as sr,
          sum((p >= 0.5 and value = 1)::int)::double as tp, sum((p >= 0.5 and value = 0)::int)::double as fp from r group by assay),
    g as (select assay, count(*) as groupsize from k group by assay)
    select assay, tp::bigint as tp, (n0 - fp)::bigint as tn, fp::bigint as fp, (n1 - tp)::bigint as fn,
    round(tp / n1, 6) as sensitivity, round((n0 - fp) / n0, 6) as specificity,
    round((sr - n1 * (n1 + 1) / 2) / (n1 * n0), 6) as auc, round((tp + n0 - fp) / (n1 + n0), 6) as acc,
    round((tp / n1 + (n0 - fp) / n0) / 2, 6) as bac, (n1 + n0)::bigint as n, groupsize
    from m join g using (assay) where n1 + n0 >= 30 and n1 > 0 and n0 > 0""")
def _(t):
    p = t.pred.withColumn("p", F.when(F.col("probs") >= 0.04, F.col("probs")))
    m = metrics.confusion_by_group(p, ["assay"], "value", "p")
    return rounded(m, "sensitivity", "specificity", "auc", "acc", "bac")


@query("safe_auc", """with r as (select sid, value, l_quantity, rank() over (partition by sid, assay order by l_quantity)
        + (count(*) over (partition by sid, assay, l_quantity) - 1) / 2.0::double as ar, assay from FAMACT),
    m as (select sid, assay, sum(value)::double as n1, sum(1 - value)::double as n0, sum(value * ar) as sr from r group by all)
    select sid, assay, n1::bigint as pos, n0::bigint as neg,
    case when n1 > 0 and n0 > 0 then round((sr - n1 * (n1 + 1) / 2) / (n1 * n0), 6) end as auc from m""")
def _(t):
    return rounded(metrics.safe_auc(t.fam_act, ["sid", "assay"], "value", "l_quantity"), "auc")


@query("median_metrics", f"""select nprops, {', '.join(f'round(median({c}), 6) as {c}' for c in MET_COLS)}, count(*) as n,
    count(distinct assay) as n_distinct from MET where num_pos > 20 and num_neg >= 20 group by nprops""")
def _(t):
    m = t.met.filter("num_pos > 20 and num_neg >= 20")
    return rounded(reports.median_metrics(m, ["nprops"], MET_COLS, "assay"), *MET_COLS)


@query("median_auc_by_source", f"select source, round(median(auc), 6) as auc, count(*) as n from {MSRC} group by source")
def _(t):
    return rounded(reports.median_metrics(_msrc(t), ["source"], ["auc"]), "auc").orderBy(F.desc("auc"))


@query("groups_with_all_positions", f"""select nprops, assay, round(auc, 6) as auc from MET where assay in
    (select assay from MET group by assay having count(distinct nprops) = 7)""")
def _(t):
    return rounded(reports.groups_with_all_positions(t.met, "assay", "nprops", 7).select("nprops", "assay", "auc"), "auc")


@query("pair_entropy", """with c as (select x, y, vy, sum(n)::double as n from PC group by all),
    h as (select *, sum(n) over (partition by x, y) as tot from c)
    select x as target, y as feature, max(tot)::bigint as n, round(greatest(-sum(n / tot * log2(n / tot)), 0), 6) as entropy
    from h group by all having max(tot) > 30""")
def _(t):
    return rounded(features.pair_entropy(t.cons), "entropy")


@query("pair_entropy_conditional", """with h as (select x, y, n::double as n, sum(n) over (partition by x, y)::double as tot,
        sum(n) over (partition by x, y, vx)::double as cx from PC)
    select x as target, y as feature, max(tot)::bigint as n, round(greatest(-sum(n / tot * log2(n / cx)), 0), 6) as entropy
    from h where x <> y group by all having max(tot) > 30""")
def _(t):
    return rounded(features.pair_entropy(t.cons, exclude_self=True, conditional=True), "entropy")


@query("pair_count_distribution", "select n_values, count(*) as n_items from (select sid, assay, count(*) as n_values from ACT group by all) t group by n_values")
def _(t):
    return features.pair_count_distribution(t.act)


@query("ensemble_mean", "select chemical_id as sid, assay as target, round(avg(probs), 6) as prob, count(*) as n_contexts from PRED group by all")
def _(t):
    s = t.pred.select(F.col("chemical_id").alias("sid"), F.col("assay").alias("target"), F.col("probs").alias("prob"))
    return rounded(scoring.ensemble_mean(s), "prob")


@query("category_accuracy", """select category, round(avg(((prediction > 0.5)::int = value)::int), 6) as accuracy,
    count(distinct property_token) as numprops, sum(value)::bigint as numtrue, sum(1 - value)::bigint as numfalse, count(*) as numeval
    from ALT where strength > 8.0 and value is not null group by category having count(*) > 20""")
def _(t):
    return rounded(reports.category_accuracy(t.alt), "accuracy")


HAZARDS = ["PROMO", "SMALL", "LARGE"]


@query("hazard_counts", """select name, sum((prediction > 0.1)::int)::bigint as likely_hazards from
    (select distinct name, property_title, category, prediction from ALT where strength > 8.0 and category in ('PROMO', 'SMALL', 'LARGE')) t
    group by name""")
def _(t):
    return reports.hazard_counts(t.alt, HAZARDS).orderBy("likely_hazards")


PREV = """(select source, property_title, category, sum(prediction) / (select count(distinct sid) from FAMACT) as prevalence,
    sum((prediction > 0.5)::int)::bigint as n_likely from
    (select distinct source, property_title, category, name, prediction from ALT where strength > 8.0) t group by all)"""


def _prevalence(t):
    n = t.fam_act.agg(F.count_distinct("sid")).first()[0]
    return reports.property_prevalence(t.alt, n)


@query("property_prevalence", f"select source, property_title, category, round(prevalence, 6) as prevalence, n_likely from {PREV} p")
def _(t):
    return rounded(_prevalence(t), "prevalence")


@query("top10_per_category", f"""select category, property_title, round(prevalence, 6) as prevalence, r as rank from
    (select *, row_number() over (partition by category order by round(prevalence, 6) desc, property_title) as r from {PREV} p) q where r <= 10""")
def _(t):
    p = rounded(_prevalence(t), "prevalence")
    return reports.top_per_group(p, "category", [F.desc("prevalence"), "property_title"], 10) \
        .select("category", "property_title", "prevalence", "rank")


TYPE = "(select distinct category from PCAT)"


def cells(names, columns, digits=6):
    """A row's cells as text: name:value."""
    return F.concat_ws(" ", *[F.concat_ws(":", F.lit(str(n)), F.format_number(c, digits)) for n, c in zip(names, columns)])


@query("pivot_mean", f"""with m as (select name, category, avg(prediction) as v from ALT where strength > 9 group by all),
    g as (select n.name, c.category from (select distinct name from m) n, {TYPE} c)
    select name, string_agg(category || ':' || printf('%.6f', coalesce(1e-9 + v, 0)), ' ' order by category) as cells
    from g left join m using (name, category) group by name""")
def _(t):
    names = reports.dimension(t.pcat, "category")
    p = reports.pivot_mean(t.alt.filter("strength > 9"), "name", "category", names, "prediction")
    return p.select("name", cells(names, [F.when(F.col(c) > 0, F.col(c) + 1e-9).otherwise(0.0) for c in names]).alias("cells"))  # off exact rounding ties


@query("pivot_candidates", f"""with m as (select property_id, category, avg(prediction) as v from ALT group by all),
    g as (select n.property_id, c.category from (select distinct property_id from m) n, {TYPE} c)
    select property_id, string_agg(category || ':' || printf('%.6f', coalesce(1e-9 + v, 0)), ' ' order by category) as cells
    from g left join m using (property_id, category) group by property_id""")
def _(t):
    names = reports.dimension(t.pcat, "category")
    p = reports.pivot_mean(t.alt, "property_id", "category", names, "prediction")
    return p.select("property_id", cells(names, [F.when(F.col(c) > 0, F.col(c) + 1e-9).otherwise(0.0) for c in names]).alias("cells"))


@query("pivot_auc", f"""with m as (select source, nprops, median(auc) as auc from {MSRC} group by all)
    select source, string_agg(nprops || ':' || printf('%.6f', auc + 1e-9), ' ' order by nprops) as cells, round(avg(auc), 6) as mean from m group by source""")
def _(t):
    m = reports.median_metrics(_msrc(t), ["source", "nprops"], ["auc"])
    wide = reports.pivot_metric(m, "source", "nprops", "auc")
    one = F.transform(F.map_entries("cells"), lambda e: F.concat_ws(":", e["key"], F.format_number(e["value"] + 1e-9, 6)))
    return wide.select("source", F.array_join(one, " ").alias("cells"), r6("mean").alias("mean")).orderBy(F.desc("mean"))


@query("heat_code", f"""select source, nprops, case when median(auc) <= 0.6 then 0 when median(auc) <= 0.7 then 1 else 2 end as code
    from {MSRC} group by all""")
def _(t):
    m = reports.median_metrics(_msrc(t), ["source", "nprops"], ["auc"])
    return m.select("source", "nprops", reports.heat_code(F.col("auc")).alias("code"))


@query("auc_histogram", """with s as (select nprops, min(auc) as lo, max(auc) as hi, median(auc) as med from MET group by nprops)
    select nprops, least(floor((auc - lo) / ((hi - lo) / 30)), 29)::int as bin, count(*) as n, round(any_value(med), 6) as median
    from MET join s using (nprops) group by all""")
def _(t):
    return rounded(reports.auc_histogram(t.met), "median")


@query("method_summary", """select case when nprops = 0 then 'none' else 'some' end as method, round(avg(probs), 6) as mean,
    round(median(probs), 6) as median, count(*) as n from PRED group by all""")
def _(t):
    p = t.pred.withColumn("method", F.when(F.col("nprops") == 0, "none").otherwise("some"))
    med = ordering.exact_median(p, ["method"], "probs", "median").select("method", r6("median").alias("median"))
    return p.groupBy("method").agg(r6(F.avg("probs")).alias("mean"), F.count(F.lit(1)).alias("n")).join(med, "method")


@query("agreement_rate", """select round(avg((value = (probs > 0.5)::int)::int), 6) as value_rate,
    round(avg((nprops = assay % 7)::int), 6) as assay_rate from PRED""")
def _(t):
    p = t.pred.withColumn("called", (F.col("probs") > 0.5).cast("int")).withColumn("guess", F.col("assay") % 7)
    return rounded(metrics.agreement_rate(p, {"value_rate": ("value", "called"), "assay_rate": ("nprops", "guess")}),
                   "value_rate", "assay_rate")


@query("weighted_mean", "select assay, round(sum(cross_entropy_loss * (num_pos + num_neg)) / sum(num_pos + num_neg), 6) as mean_loss from MET group by assay")
def _(t):
    m = t.met.withColumn("n", F.col("num_pos") + F.col("num_neg"))
    return rounded(metrics.weighted_mean(m, ["assay"], "cross_entropy_loss", "n", "mean_loss"), "mean_loss")


@query("balanced_accuracy_multi", """select round(avg(r), 6) as bac, count(*) as n_classes from
    (select l_returnflag, avg((l_returnflag = case when l_quantity > 33 then 'R' when l_quantity > 16 then 'A' else 'N' end)::int) as r
     from lineitem group by l_returnflag) t""")
def _(t):
    q = F.col("l_quantity")
    li = t.raw("lineitem", "l_returnflag", "l_quantity").withColumn("guess", F.when(q > 33, "R").when(q > 16, "A").otherwise("N"))
    return rounded(metrics.balanced_accuracy_multi(li, [], "l_returnflag", "guess"), "bac")


@query("well_predicted", "select assay, round(median(auc), 6) as auc from MET group by assay having median(auc) > 0.5")
def _(t):
    return rounded(reports.well_predicted(t.met, "assay", floor=0.5), "auc")


@query("sequence_accuracy", r"""with s as (select sid, string_split(smiles, '') as a, string_split(lower(smiles), '') as b from SUB)
    select sid, round(100.0::double * list_sum(list_transform(list_zip(a, b), lambda p: (p[1] = p[2])::int)) / len(a), 6) as pct from s""")
def _(t):
    s = t.sub.select("sid", F.split("smiles", "").alias("a"), F.split(F.lower("smiles"), "").alias("b"))
    s = s.select("sid", *[F.filter(c, lambda x: x != "").alias(c) for c in "ab"])
    return rounded(metrics.sequence_accuracy(s, "a", "b").select("sid", "pct"), "pct")


@query("normalize_probs", """select event_id, round(exp(value / 100) / (1 + exp(value / 100)), 6) as prob_one,
    round(exp(value / 100) / (1 + exp(value / 100)), 6) as softmax_one from events""")
def _(t):
    e = t.raw("events", "event_id", "value").withColumn("p1", F.exp(F.col("value") / 100)).withColumn("p0", F.lit(1.0))
    e = metrics.normalize_probs(e, "p0", "p1")
    soft = metrics.softmax(F.array(F.lit(0.0), F.col("value") / 100))[1]
    return e.select("event_id", r6("prob_one").alias("prob_one"), r6(soft).alias("softmax_one"))


@query("sigmoid_accuracy", """select assay, round(avg(((1 / (1 + exp(-(probs - 0.5))) > 0.5)::int = value)::int), 6) as acc, count(*) as n
    from PRED group by assay""")
def _(t):
    p = t.pred.withColumn("logit", F.col("probs") - 0.5)
    return rounded(metrics.sigmoid_accuracy(p, "logit", "value", ["assay"]), "acc")


@query("rebalance", """select name, property_id, round(case when prediction <= 0.1 then prediction / 0.2 else 0.5 + (prediction - 0.1) / 1.8 end, 6) as p
    from (select sid as name, assay as property_id, round(avg(l_quantity) / 50, 9) as prediction from FAMACT group by all) t""")
def _(t):
    return t.fam_pred.select("name", "property_id", r6(reports.rebalance(F.col("prediction"))).alias("p"))


@query("group_median_broadcast", f"""select source, nprops, round(auc, 6) as auc, round(median(auc) over (partition by source), 6) as meanauc
    from (select source, nprops, median(auc) as auc from {MSRC} group by all) t""")
def _(t):
    m = reports.median_metrics(_msrc(t), ["source", "nprops"], ["auc"]).drop("n")
    return rounded(reports.group_median_broadcast(m, "source", "auc", "meanauc"), "auc", "meanauc")


@query("group_count_filter", f"""select category, nprops, round(auc, 6) as auc from (select *, count(*) over (partition by category) as k from
    (select category, nprops, median(auc) as auc from {MCAT} m group by all) t) u where k > 4""")
def _(t):
    m = reports.median_metrics(_mcat(t), ["category", "nprops"], ["auc"]).drop("n")
    return rounded(reports.group_count_filter(m, "category", 4), "auc")


@query("order_by_group_stat", f"""with m as (select category, nprops, median(auc) as auc from {MCAT} x group by all),
    s as (select category, median(auc) as group_median, row_number() over (order by median(auc) desc, category) as group_rank from m group by category)
    select substr(category, 1, 25) as category, nprops, round(auc, 6) as auc, round(group_median, 6) as group_median, group_rank from m join s using (category)""")
def _(t):
    m = reports.median_metrics(_mcat(t), ["category", "nprops"], ["auc"]).drop("n")
    out = rounded(reports.order_by_group_stat(m, "category", "auc"), "auc", "group_median")
    return out.withColumn("category", F.substring("category", 1, 25))


@query("log_row_number", "select type, batch, iteration from LOGN")
def _(t):
    return reports.log_row_number(t.log).select("type", "batch", "iteration")


@query("log_tail_min", """with f as (select *, row_number() over (order by batch) as p from LOG),
    r as (select type, batch, round(loss, 6) as loss, row_number() over (partition by type order by batch desc) as from_end,
          min(round(loss, 6)) over (partition by type) as min_loss from f where p > 100)
    select *, (loss <= min_loss)::int as is_min from r where from_end <= 5""")
def _(t):
    return reports.log_tail_min(t.log, n=5, skip=100)


@query("early_stop", """with b as (select *, min(loss) over (partition by type order by batch rows unbounded preceding) as best from LOGN)
    select type, batch, round(loss, 6) as loss, iteration, round(best, 6) as best,
    iteration - min(iteration) over (partition by type, best) as since_best from
    (select *, 1 as one from b) c where loss > best or loss = best""")
def _(t):
    return rounded(reports.early_stop(t.log), "loss", "best")


@query("loss_every_100", """select type, floor((iteration - 1) / 100)::bigint as step, round(avg(loss), 6) as mean_loss, count(*) as n from LOGN group by all""")
def _(t):
    return rounded(reports.loss_every(t.log), "mean_loss")


@query("best_per_property", """select assay, nprops, round(auc, 6) as auc, num_pos, num_neg from
    (select *, row_number() over (partition by assay order by auc desc, nprops) as r from MET) t where r = 1""")
def _(t):
    best = reports.best_per_key(t.met, "assay", "auc", "nprops")
    return rounded(best.select("assay", "nprops", "auc", "num_pos", "num_neg"), "auc")


@query("method_diff", """select assay, round(max(auc) filter (nprops = 0), 6) as first, round(max(auc) filter (nprops = 4), 6) as fifth,
    round(max(auc) filter (nprops = 0) - max(auc) filter (nprops = 4), 6) as diff from MET where nprops in (0, 4) group by assay""")
def _(t):
    m = t.met.filter(F.col("nprops").isin(0, 4)).withColumn("method", F.when(F.col("nprops") == 0, "first").otherwise("fifth"))
    return rounded(reports.method_diff(m, "assay", "method", "first", "fifth", "auc"), "first", "fifth", "diff")


@query("auc_gain", """select assay, nprops, round(auc - first_value(auc) over (partition by assay order by nprops), 6) as gain from MET""")
def _(t):
    return rounded(reports.gain_over_first(t.met, "assay", "nprops", "auc").select("assay", "nprops", "gain"), "gain")


@query("unpivot_methods", """select assay, nprops, 'acc' as method, round(acc, 6) as value from MET
    union all select assay, nprops, 'auc', round(auc, 6) from MET union all select assay, nprops, 'bac', round(bac, 6) from MET""")
def _(t):
    m = t.met.select("assay", "nprops", "acc", "auc", "bac")
    return rounded(m.unpivot(["assay", "nprops"], ["acc", "auc", "bac"], "method", "value"), "value")
