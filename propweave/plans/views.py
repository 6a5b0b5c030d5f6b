"""The fixture views in SQL, for the checks. Each is written on its own, not derived from the Spark side."""

VIEWS = {
    "ACT": "select l_partkey as sid, l_suppkey as assay, case when l_returnflag = 'R' then 1 else 0 end as value from lineitem",
    "CONS": "select sid, assay, max(value) as value from ACT group by sid, assay having count(distinct value) = 1",
    "PROP": """select s_suppkey as property_id, s_name as title, s_suppkey + 8 as property_token, s_nationkey as source_id,
        '{"unit":"u' || s_nationkey || '","rank":' || s_suppkey || '}' as data from supplier""",
    "SRC": "select n_nationkey as source_id, n_name as source from nation",
    "PCAT": """select property_id, category, 'n=' || n as reason,
        cast(10 * n as double) / max(n) over (partition by property_id) as strength
        from (select l_suppkey as property_id, p_type as category, count(*) as n
              from lineitem join part on l_partkey = p_partkey group by all) t""",
    "PRED": """select l_orderkey as chemical_id, l_linenumber - 1 as nprops, l_suppkey as assay,
        case when l_returnflag = 'R' then 1 else 0 end as value, l_quantity / 50.0::double as probs from lineitem""",
    "PRANK": """select *, rank() over (partition by nprops, assay order by probs)
        + (count(*) over (partition by nprops, assay, probs) - 1) / 2.0::double as ar from PRED""",
    "METALL": """select nprops, assay, sum(value)::double as n1, sum(1 - value)::double as n0, sum(value * ar) as sr,
        count(distinct chemical_id) as items,
        sum(case when probs > 0.5 and value = 1 then 1 else 0 end)::double as tp,
        sum(case when probs <= 0.5 and value = 0 then 1 else 0 end)::double as tn,
        -avg(value * ln(greatest(least(probs, 1 - 1e-15), 1e-15)) + (1 - value) * ln(1 - greatest(least(probs, 1 - 1e-15), 1e-15))) as ce
        from PRANK group by all""",
    "MET": """select nprops, assay, (sr - n1 * (n1 + 1) / 2) / (n1 * n0) as auc, (tp + tn) / (n1 + n0) as acc,
        (tp / n1 + tn / n0) / 2 as bac, ce as cross_entropy_loss, n1::bigint as num_pos, n0::bigint as num_neg
        from METALL where n1 >= 25 and n0 >= 10 and items >= 20""",
    "SUB": r"""select p_partkey as sid, p_name || '|' || p_type || '|' || p_brand || '|' || p_size as smiles,
        regexp_replace(p_name || '|' || p_type || '|' || p_brand || '|' || p_size, '(.)', '[\1]', 'g') as symbols from part""",
    "VOC": r"""select '<pad>' as symbol, 0::bigint as index union all select '<sos>', 1 union all select '<eos>', 2
        union all select s, 2 + row_number() over (order by s) from
        (select distinct unnest(regexp_extract_all(symbols, '(\[[^\]]*\]|.)', 1)) as s from SUB) t""",
    "PIX": """select assay, n, row_number() over (order by n desc, assay) - 1 as assay_index
        from (select assay, count(*) as n from CONS group by assay) t""",
    "DATA": "select sid, assay, assay_index, value from CONS join PIX using (assay)",
    "META": """select (select count(*) from VOC) as ns, (select max(assay_index) + 1 from PIX) as na,
        (select max(value) + 1 from CONS) as nv""",
    "ENC": r"""select sid, list_resize(list_concat(list_concat([1::bigint], list(index order by pos)), [2::bigint]), 120, 0::bigint) as encoded
        from (select sid, unnest(l) as symbol, generate_subscripts(l, 1) as pos
              from (select sid, regexp_extract_all(symbols, '(\[[^\]]*\]|.)', 1) as l from SUB) a) b join VOC using (symbol) group by sid""",
    "TOK": """select sid, list_concat(list_concat([any_value(ns + na + nv)],
        flatten(list([assay_index + ns, value + ns + na] order by assay_index, value))), [any_value(ns + na + nv + 1)]) as assay_vals,
        count(*) as m from DATA, META group by sid""",
    "EX": """select sid, encoded, assay_vals, m, case when b < 800 then 'trn' when b < 900 then 'tst' else 'hld' end as split
        from (select *, ('0x' || substr(md5('37|' || sid), 1, 8))::bigint % 1000 as b from TOK join ENC using (sid)) t""",
    "HALF": """select *, case when b < 500 then 'trn' when b < 600 then 'tst' else 'hld' end as split
        from (select *, ('0x' || substr(md5('37|' || sid), 1, 8))::bigint % 1000 as b from CONS) t""",
    "TRN": "select sid, assay, value from HALF where split = 'trn'",
    "HLD": "select sid, assay, value from HALF where split = 'hld'",
    "FAMACT": """select 'F' || l_partkey // 16 as sid, l_suppkey as assay, case when l_returnflag = 'R' then 1 else 0 end as value,
        l_quantity from lineitem""",
    "FAM": "select sid, assay, max(value) as value from FAMACT group by sid, assay having count(distinct value) = 1",
    "ALT": """select p.name, p.property_id, p.prediction, f.value, pr.property_token, pr.title as property_title, s.source,
        c.category, c.strength
        from (select sid as name, assay as property_id, round(avg(l_quantity) / 50, 9) as prediction from FAMACT group by all) p
        left join FAM f on f.sid = p.name and f.assay = p.property_id
        join PROP pr using (property_id) join SRC s using (source_id) join PCAT c using (property_id)""",
    "LOG": "select event_type as type, event_id as batch, value as loss, 0.001::double as lr from events",
    "LOGN": "select *, row_number() over (partition by type order by batch) as iteration from LOG",
    "EMB": """select vec_id as id, embedding::double[] as vec, label % 5 as block, case when label >= 5 then 1 else 0 end as cls,
        case when label >= 5 then 1 else 0 end as value from embeddings""",
    "SIM": """select q.id as qid, c.id as cid, round(list_dot_product(q.vec, c.vec), 6) as score, c.value, q.block = c.block as same_block,
        q.cls as qcls, c.cls as ccls, q.block as block from EMB q, EMB c where q.id <> c.id""",
    "LAB": "select doc_id, 'quality' as assay, quality as value from labels union all select doc_id, 'toxic', toxic from labels",
    "PC": """select a.assay as x, a.value as vx, b.assay as y, b.value as vy, count(*) as n
        from CONS a join CONS b using (sid) group by all""",
    "PRIOR": "select assay as target, (sum(value) + 1.0::double) / (count(*) + 2) as prior from CONS group by assay",
    "CELL": """select x as target, y as feature, vy as fvalue, sum(n)::double as support,
        sum(case when vx = 1 then n else 0 end)::double as n1 from PC where x <> y group by all""",
    "CELLS": """select *, sum(n1) over (partition by target, feature) as all1, sum(support) over (partition by target, feature) as alln
        from CELL""",
    "COND": """select target, feature, fvalue, support, n1, (n1 + 1) / (support + 2) as p1, prior, (n1 + 1) / (support + 2) / prior as lift,
        ln((n1 + 1) / (all1 + 2)) - ln((support - n1 + 1) / (alln - all1 + 2)) as llr from CELLS join PRIOR using (target) where alln > 30""",
    "FPRIOR": "select assay as target, (sum(value) + 1.0::double) / (count(*) + 2) as prior from FAM group by assay",
    "FCELLS": """select *, sum(n1) over (partition by target, feature) as all1, sum(support) over (partition by target, feature) as alln from
        (select a.assay as target, b.assay as feature, b.value as fvalue, count(*)::double as support, sum(a.value)::double as n1
         from FAM a join FAM b using (sid) where a.assay <> b.assay group by all) t""",
    "FCOND": """select target, feature, fvalue,
        ln((n1 + 1) / (all1 + 2)) - ln((support - n1 + 1) / (alln - all1 + 2)) as llr from FCELLS where alln > 30""",
    "FBITS": """select doc_id as id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1),
        lambda i: (('0x' || substr(md5(array_to_string(w[i:i+2], ' ')), 1, 15))::bigint % 2048)::int))) as bits
        from (select doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') as w from documents) t""",
    "FSETS": r"""select doc_id as id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1),
        lambda i: ('0x' || substr(md5(array_to_string(w[i:i+2], ' ')), 1, 15))::bigint))) as bits
        from (select doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') as w from documents) t""",
    "FSET": "select min(id) as id, count(*) as copies, bits, len(bits) as n from FSETS group by bits",
    "FBIT": """select min(id) as id, count(*) as copies, n, bs from
        (select id, count(*) as n, bitstring_agg(b, 0, 2047) as bs from (select id, unnest(bits) as b from FBITS) u group by id) t
        group by n, bs""",
}
