"""Exact neighbour search, triplets and set similarity in blocks.

Candidate pairs are never rows. Both sides are cut into cells (blocks given by the data,
pivot cells, or size classes) and cells into chunks of bounded size; each (cell, chunk,
chunk) task multiplies two small matrices and gives back only its k best, the pairs above
a bound, or a histogram. A hot cell simply has more chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propweave.functions.hashing import seeded_digest
from propweave.operators.ordering import bucket_count, top_n
from propweave.sources.scratch import materialise

ROWS_PER_CHUNK = 2048
#: A side of a join is cut into so many chunks, so that a row is sent a fixed number of times, while a chunk stays
#: between ROWS_PER_CHUNK rows and MOST_ROWS, which bound what a task holds.
CHUNKS = 16
MOST_ROWS = 65536
#: Pivot cells grow with the root of the corpus: one cell per so many roots.
ROOTS_PER_PIVOT = 32
#: The entries of sets are dealt to so many buckets at least; a task holds one of them.
ENTRY_BUCKETS = 256


def block_join(left: DataFrame, right: DataFrame, kernel: Callable, schema: str, id_col: str = "id",
               rows: int = ROWS_PER_CHUNK, triangle: bool = False, *, most: int | None = None, right_rows: int | None = None) -> DataFrame:
    """Run ``kernel(key, left_chunk, right_chunk)`` on every chunk pair of every shared ``_cell``.

    A left row is sent once per right chunk of its cell and the other way round. A chunk has about
    ``rows`` rows, or a ``CHUNKS``-th of its side where that is more, up to ``most`` (a kernel that
    goes through a chunk in steps can take more rows than it could compare at once); ``right_rows`` in place of ``rows`` on the right.
    ``triangle``: for a join with itself, only chunk pairs with left <= right.
    """
    def cut(side: DataFrame, name: str, rows: int) -> DataFrame:
        n = side.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
        size = F.least(F.greatest(F.col("_all") / CHUNKS, F.lit(rows)), F.lit(max(rows, most or rows)))
        return n.crossJoin(n.agg(F.sum("_n").alias("_all"))).select("_cell", F.ceil(F.col("_n") / size).cast("int").alias(name))

    sizes = cut(left, "_nl", rows).join(cut(right, "_nr", right_rows or rows), "_cell")
    mine = F.xxhash64(id_col)
    l = (left.join(sizes, "_cell").withColumn("_l", F.pmod(mine, F.col("_nl")).cast("int"))
             .withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))))
    r = (right.join(sizes, "_cell").withColumn("_r", F.pmod(mine, F.col("_nr")).cast("int"))
              .withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1))))
    if triangle:
        l, r = l.filter("_l <= _r"), r.filter("_l <= _r")
    l, r = l.drop("_nl", "_nr"), r.drop("_nl", "_nr")
    l, r = l.toDF(*l.columns), r.toDF(*r.columns)  # fresh column ids: both sides may come from one table
    key = ["_cell", "_l", "_r"]
    return l.groupBy(*key).cogroup(r.groupBy(*key)).applyInPandas(kernel, schema)


def _k_best(q, c, qid, cid, k: int, metric: str, bound: float | None, exclude_self: bool):
    """(row, column, score) of the k best columns of each row; ``c`` is in the order of ``cid``, which breaks ties.

    The matrix is worked out ROWS_PER_CHUNK by ROWS_PER_CHUNK; what is not below a row's k-th cost so far is dropped at once.
    """
    import numpy as np

    found = []
    limit = np.inf if bound is None else bound if metric == "l2" else -bound
    for top in range(0, len(q), ROWS_PER_CHUNK):
        x, xid = q[top:top + ROWS_PER_CHUNK], qid[top:top + ROWS_PER_CHUNK]
        edge = np.full(len(x), limit + 1e-6)  # costs are compared rounded to six places
        row, col, held = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
        for at in range(0, len(c), ROWS_PER_CHUNK):
            y = c[at:at + ROWS_PER_CHUNK]
            cost = -(x @ y.T)
            if metric == "l2":
                cost = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] + 2 * cost
            if exclude_self:
                cost[xid[:, None] == cid[None, at:at + ROWS_PER_CHUNK]] = np.inf
            near = (cost <= edge[:, None]) & np.isfinite(cost)
            if k < len(y) and np.count_nonzero(near) > 4 * k * len(x):
                places = np.round(np.where(near, cost, np.inf), 6)
                last = np.partition(places, k - 1, axis=1)[:, k - 1, None]
                near &= places <= last
                if np.count_nonzero(near) > 4 * k * len(x):  # of many that are equally near, the first
                    near &= (places < last) | (np.cumsum(near & (places == last), axis=1, dtype=np.int32) <= k)
            r, j = np.nonzero(near)
            new = np.round(cost[r, j], 6)
            if bound is not None:
                r, j, new = (v[new < limit] for v in (r, j, new))
            row, col, held = np.concatenate([row, r]), np.concatenate([col, j + at]), np.concatenate([held, new])
            order = np.lexsort((col, held, row))
            row, col, held = row[order], col[order], held[order]
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            row, col, held, place = (v[place < k] for v in (row, col, held, place))
            # a later column that is as near as the k-th so far comes after it, so it must be nearer by a place
            edge[row[place == k - 1]] = held[place == k - 1] - 4e-7
        found.append((row + top, col, held if metric == "l2" else -held))
    return tuple(np.concatenate(v) for v in zip(*found))


def _topk_kernel(k: int, metric: str, bound: float | None, exclude_self: bool) -> Callable:
    def kernel(key, lp, rp):
        import numpy as np
        import pandas as pd

        cols = {"qid": "int64", "cid": "int64", "score": "float64", "value": "float64"}
        if len(lp) == 0 or len(rp) == 0:
            return pd.DataFrame({"cell": pd.Series(dtype="object"), **{c: pd.Series(dtype=t) for c, t in cols.items()}})
        rp = rp.sort_values("id", kind="stable")
        q = np.stack(lp["vec"].to_list()).astype("float64")
        c = np.stack(rp["vec"].to_list()).astype("float64")
        qid, cid = lp["id"].to_numpy(), rp["id"].to_numpy()
        row, col, score = _k_best(q, c, qid, cid, k, metric, bound, exclude_self)
        return pd.DataFrame({"cell": str(key[0]), "qid": qid[row], "cid": cid[col], "score": score,
                             "value": rp["value"].to_numpy(dtype="float64")[col]})
    return kernel


_HITS = "cell string, qid bigint, cid bigint, score double, value double"


def _pivot_rows(corpus: DataFrame, n: int):
    import numpy as np

    rows = corpus.select("vec").orderBy(seeded_digest(11, "id"), "id").limit(n).collect()
    return np.array([r["vec"] for r in rows], dtype="float64")


def _nearest(pivots) -> Callable:
    @F.pandas_udf("cell int, dist double")
    def nearest(v):
        import numpy as np
        import pandas as pd

        x = np.stack(v.to_list()).astype("float64")
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))
        at = d.argmin(axis=1)
        return pd.DataFrame({"cell": at.astype("int32"), "dist": d[np.arange(len(x)), at]})
    return nearest


def _reachable(pivots, radius, metric: str) -> Callable:
    """Cells that can hold a hit: |q - p| - r < bound, or q.p + |q| r > bound. Nothing else is left out."""
    @F.pandas_udf("array<int>")
    def reachable(v, bound):
        import numpy as np
        import pandas as pd

        x = np.stack(v.to_list()).astype("float64")
        b = bound.to_numpy(dtype="float64")[:, None]
        if metric == "l2":
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))
            ok = d - radius <= np.sqrt(np.maximum(b + 1e-6, 0)) + 1e-6  # the bound is rounded to six places
        else:
            ok = x @ pivots.T + np.sqrt((x * x).sum(1))[:, None] * radius >= b - 1e-6
        return pd.Series([np.nonzero(r)[0].astype("int32") for r in ok])
    return reachable


def neighbours(queries: DataFrame, corpus: DataFrame, k: int = 5, metric: str = "ip", bound: float | None = None,
               block: str | None = None, exclude_self: bool = False, cells: int | None = None) -> DataFrame:
    """(qid, cid, score, value, rank): the k best corpus rows of each query, exactly.

    Inputs have ``id``, ``vec`` and (corpus) ``value``; ``block``: only rows of the same block
    meet. ``metric`` is the inner product (larger is nearer) or the squared distance.
    Large corpora are cut into pivot cells and a query visits only cells that can still
    hold a hit; without a bound, its own cell is searched first to get one.
    """
    value = F.col("value").cast("double") if "value" in corpus.columns else F.lit(None).cast("double")
    name = F.coalesce(F.col(block).cast("string"), F.lit("")) if block else F.lit("")
    q = queries.select("id", "vec", name.alias("_cell"))
    c = corpus.select("id", "vec", value.alias("value"), name.alias("_cell"))
    if cells is None:
        cells = int(c.count() ** 0.5 / ROOTS_PER_PIVOT)
    if cells > 1:
        q, c = _pivot_cells(q, c, k, metric, bound, exclude_self, cells)
    hits = block_join(q, c, _topk_kernel(k, metric, bound, exclude_self), _HITS, most=MOST_ROWS)
    order = [F.col("score") if metric == "l2" else F.col("score").desc(), "cid"]
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("qid", "cid", "score", "value", "rank")


def _pivot_cells(q, c, k, metric, bound, exclude_self, cells):
    import numpy as np

    pivots = _pivot_rows(c, cells)
    nearest = _nearest(pivots)
    sub = F.concat_ws(":", "_cell", F.col("_p.cell").cast("string"))
    homed = c.withColumn("_p", nearest("vec"))
    radius = np.zeros(len(pivots))
    for r in homed.groupBy("_p.cell").agg(F.max("_p.dist").alias("r")).collect():  # one row per pivot
        radius[r["cell"]] = r["r"]
    corpus = homed.select("id", "vec", "value", sub.alias("_cell"))
    if bound is None:
        home = q.select("id", "vec", F.col("_cell").alias("_outer"), "_cell", nearest("vec").alias("_p"))
        home = home.select("id", "vec", sub.alias("_cell"))
        hits = block_join(home, corpus, _topk_kernel(k, metric, None, exclude_self), _HITS, most=MOST_ROWS)
        worst = F.max("score") if metric == "l2" else F.min("score")
        order = F.col("score") if metric == "l2" else F.col("score").desc()
        best = hits.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(order, "cid")))
        best = best.filter(F.col("rank") <= k).groupBy(F.col("qid").alias("id")).agg(
            F.when(F.count(F.lit(1)) >= k, worst).alias("_bound"))
        q = q.join(best, "id", "left")
    else:
        q = q.withColumn("_bound", F.lit(float(bound)))
    none = float("inf") if metric == "l2" else float("-inf")
    limit = F.coalesce(F.col("_bound"), F.lit(none))
    # the cells are a column of their own before they are exploded: as the generator's input the call would lose ``_cell``
    q = q.select("id", "vec", "_cell", _reachable(pivots, radius, metric)("vec", limit).alias("_in"))
    q = q.select("id", "vec", "_cell", F.explode("_in").alias("_v"))
    return q.select("id", "vec", F.concat_ws(":", "_cell", F.col("_v").cast("string")).alias("_cell")), corpus


def knn_predict(queries: DataFrame, corpus: DataFrame, k: int = 5, minsim: float = 0.9, block: str | None = None,
                exclude_self: bool = False, cells: int | None = None) -> DataFrame:
    """Mean value of those among the k most similar rows whose similarity is above ``minsim``; else NULL."""
    hits = neighbours(queries, corpus, k, "ip", minsim, block, exclude_self, cells)
    return _mean_value(queries, hits)


def knn_dist_predict(queries: DataFrame, corpus: DataFrame, k: int = 5, maxdist: float = 4.0,
                     block: str | None = None, exclude_self: bool = False, cells: int | None = None) -> DataFrame:
    """Mean value of those among the k nearest rows whose squared distance is below ``maxdist``; else NULL.

    Neighbours are counted by the predicate, so one at distance 0 counts like any other.
    """
    hits = neighbours(queries, corpus, k, "l2", maxdist, block, exclude_self, cells)
    return _mean_value(queries, hits)


def _mean_value(queries: DataFrame, hits: DataFrame) -> DataFrame:
    means = hits.groupBy("qid").agg(F.avg("value").alias("prediction"), F.count(F.lit(1)).alias("n_neighbours"))
    keep = [c for c in queries.columns if c != "vec"]
    return (queries.select(*keep).join(means, queries["id"] == means["qid"], "left").drop("qid")
                   .withColumn("n_neighbours", F.coalesce("n_neighbours", F.lit(0))))


def analogues(queries: DataFrame, corpus: DataFrame, k: int = 5, block: str | None = None,
              exclude_self: bool = False, cells: int | None = None) -> DataFrame:
    """The k nearest rows of each query as a list of (rank, id, weight, value) with the mean value."""
    hits = neighbours(queries, corpus, k, "ip", None, block, exclude_self, cells)
    one = F.struct("rank", F.col("cid").alias("id"), F.col("score").alias("weight"), "value")
    return hits.groupBy(F.col("qid").alias("id")).agg(
        F.sort_array(F.collect_list(one)).alias("analogues"), F.avg("value").alias("mean_value"))


def triplets(emb: DataFrame, label: str = "label", cls: str = "cls", k: int = 5, anchors: int = 150,
             seed: int = 42) -> DataFrame:
    """Per anchor the k nearest rows of its own class and of the other class, inside its label.

    The anchor itself is no positive of its own.
    """
    digest = emb.withColumn("_d", seeded_digest(seed, "id"))
    chosen = top_n(digest, [label], ["_d", "id"], anchors, spread=["id"])
    cell = F.concat_ws(":", F.col(label).cast("string"), F.col("_k").cast("string"))
    both = chosen.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1))))
    q = both.select("id", "vec", cell.alias("_cell"))
    c = emb.withColumn("_k", F.col(cls)).select("id", "vec", F.col(cls).cast("double").alias("value"), cell.alias("_cell"))
    hits = block_join(q, c, _topk_kernel(k, "ip", None, True), _HITS, most=MOST_ROWS)
    rank = F.row_number().over(W.partitionBy("qid", "value").orderBy(F.col("score").desc(), "cid"))
    hits = hits.withColumn("rank", rank).filter(F.col("rank") <= k)
    own = chosen.select(F.col("id").alias("qid"), label, F.col(cls).alias("anchor_cls"))
    kind = F.when(F.col("value") == F.col("anchor_cls"), F.lit("positive")).otherwise(F.lit("negative"))
    return hits.join(own, "qid").select(label, "qid", "cid", kind.alias("kind"), "rank", "score")


def triplet_gap(found: DataFrame, label: str = "label") -> DataFrame:
    """Mean (1 + cos) / 2 of positive and negative pairs per label, and their gap."""
    near = (1 + F.col("score")) / 2
    return found.groupBy(label).agg(
        F.avg(F.when(F.col("kind") == "positive", near)).alias("pos_sim"),
        F.avg(F.when(F.col("kind") == "negative", near)).alias("neg_sim"),
    ).withColumn("gap", F.col("pos_sim") - F.col("neg_sim"))


def words(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(c, "[ \\n]+"), lambda w: w != "")


def fingerprint(df: DataFrame, col: str, out: str = "bits", shingle: int = 3, n_bits: int = 1 << 60) -> DataFrame:
    """Hashed set fingerprint of the whole text: the sorted distinct hashes of its word shingles.

    The hash has 60 bits, so that unrelated long texts share nothing; a small ``n_bits`` folds it
    into buckets, which fill up with the length of the text.
    """
    # shifted word lists are zipped: a list looked up inside the lambda could be inlined there and split once per word
    w = F.col("_w")
    parts = w
    for shift in range(1, shingle):
        later = F.slice(w, F.lit(shift + 1), F.greatest(F.size(w) - shift, F.lit(0)))
        parts = F.zip_with(parts, later, lambda x, y: F.concat_ws(" ", x, y))
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(w) - shingle + 1, F.lit(1)))
    bit = F.transform(parts, lambda s: F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint") % F.lit(n_bits))
    return df.withColumn("_w", words(col)).withColumn(out, F.sort_array(F.array_distinct(bit))).drop("_w")


def distinct_sets(fp: DataFrame, id_col: str, bits: str = "bits") -> DataFrame:
    """Equal fingerprints once, with their smallest id and number of copies.

    Stored, because a block join reads its input several times and hashing whole texts is the dear part.
    """
    digest = F.sha2(F.array_join(F.col(bits), " "), 256)  # the group key; the set itself comes along once
    sets = fp.groupBy(digest.alias("_digest")).agg(
        F.min(id_col).alias("id"), F.count(F.lit(1)).alias("copies"), F.first(bits).alias("bits")).drop("_digest")
    return materialise(sets.withColumn("n", F.size("bits")), "fingerprints")


def _packed(n_bits: int) -> Callable:
    """A set of numbers below ``n_bits`` as that many bits."""
    @F.pandas_udf("binary")
    def packed(bits):
        import numpy as np
        import pandas as pd

        def one(b):
            m = np.zeros(n_bits, dtype="uint8")
            m[np.asarray(b, dtype="int64")] = 1
            return np.packbits(m).tobytes()
        return pd.Series([one(b) for b in bits], dtype="object")
    return packed


def _unpacked(bits, n_bits: int):
    import numpy as np

    raw = np.frombuffer(b"".join(bits), dtype="uint8").reshape(len(bits), -1)
    return np.unpackbits(raw, axis=1, count=n_bits).astype("float32")


def dealt_entries(rows: DataFrame, beside: str, bits: str, buckets: int) -> DataFrame:
    """(bucket, entries, beside): the entries of all sets by bucket, with a value of their row; a list per bucket and batch.

    Packed, an entry crosses the shuffle as its number and the value, and no task sums entries before.
    """
    kind = rows.schema[beside].dataType.simpleString()

    def dealt(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            sets, entries = b.column("entries"), b.column("entries").flatten()
            if not len(entries):
                continue
            of = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False))
            mixed = entries.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(at))
            ends = pa.array(np.append(at[some], len(order)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(some.astype(np.int32)), pa.ListArray.from_arrays(ends, entries.take(pa.array(order))),
                pa.ListArray.from_arrays(ends, b.column("beside").take(pa.array(of[order])))], names=["bucket", "entries", "beside"])

    return rows.select(F.col(bits).cast("array<bigint>").alias("entries"), F.col(beside).alias("beside")).mapInArrow(
        dealt, f"bucket int, entries array<bigint>, beside array<{kind}>")


def _by_entry(table):
    """(values, order, first): the entries of a bucket, their order and where each different one begins in it."""
    import numpy as np

    entries = table.column("entries").combine_chunks().flatten().to_numpy()
    order = np.argsort(entries, kind="stable")
    ordered = entries[order]
    return ordered, order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def shared_entries(sets: DataFrame, id_col: str = "id", bits: str = "bits") -> DataFrame:
    """(id, bit, often) of the entries that more than one set has."""
    kind = sets.schema[id_col].dataType.simpleString()

    def shared(key, table):
        import numpy as np
        import pyarrow as pa

        ordered, order, first = _by_entry(table)
        often = np.diff(np.append(first, len(order)))
        often = np.repeat(often, often)
        kept = np.flatnonzero(often > 1)
        ids = table.column("beside").combine_chunks().flatten().take(pa.array(order[kept]))
        return pa.table({"id": ids, "bit": pa.array(ordered[kept]), "often": pa.array(often[kept])})

    buckets = max(ENTRY_BUCKETS, bucket_count(sets))
    return dealt_entries(sets, id_col, bits, buckets).groupBy("bucket").applyInArrow(shared, f"id {kind}, bit bigint, often bigint")


def tanimoto_pairs(fp: DataFrame, id_col: str, threshold: float = 0.5) -> DataFrame:
    """Pairs of different fingerprints with Tanimoto similarity at or above ``threshold``: an exact prefix-filter join.

    Entries are put in one order, rarest first. Two sets of similarity t share one of the first
    n - ceil(t n) + 1 entries of each, so only those are joined; sizes must agree within t.
    Frequent entries come last and are seldom among them. The true overlap then decides.
    """
    sets = distinct_sets(fp, id_col)
    ranked = sets.select("id", "n").join(
        shared_entries(sets).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "bit"))).alias("shared")), "id")
    # entries of one set alone are its rarest: they use up the prefix without being joined
    alone = F.col("n") - F.size("shared")
    length = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1 - alone
    prefix = ranked.filter(length > 0).select("id", "n", F.explode(F.slice("shared", F.lit(1), length.cast("int"))).alias("e"))
    prefix = materialise(prefix.select("id", "n", F.col("e.bit").alias("bit")), "prefixes")
    other = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "bit")
    smaller = (F.col("n") < F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("id") < F.col("b")))
    near = prefix.join(other, "bit").filter(smaller & (F.col("n") >= F.col("nb") * threshold - 1e-9))
    pairs = near.select(F.col("id").alias("a"), "b").distinct()
    side = lambda x: sets.select(F.col("id").alias(x), F.col("bits").alias(f"bits_{x}"), F.col("copies").alias(f"copies_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("bits_a", "bits_b"))
    score = F.round(shared / (F.size("bits_a") + F.size("bits_b") - shared), 6)
    return both.select("a", "b", "copies_a", "copies_b", score.alias("tanimoto")).filter(F.col("tanimoto") >= threshold)


def set_diversity(fp: DataFrame, bits: str = "bits") -> DataFrame:
    """Mean cosine of the sets over all pairs of rows, from one sum per entry: linear in the input.

    A set is the vector of its entries scaled to length 1; the squared length of the sum of all
    vectors is the sum of all their inner products.
    """
    def summed(key, table):
        import numpy as np
        import pyarrow as pa

        _, order, first = _by_entry(table)
        w = 1 / np.sqrt(table.column("beside").combine_chunks().flatten().to_numpy()[order].astype(float))
        total = np.add.reduceat(w, first)
        return pa.table({"square": [float(total @ total)], "sets": [float(w @ w)]})

    buckets = max(ENTRY_BUCKETS, bucket_count(fp))
    rows = fp.select(bits, F.size(bits).alias("_size"))
    # the squares of a set's entries sum to 1, so their total is the number of sets
    bit = dealt_entries(rows, "_size", bits, buckets).groupBy("bucket").applyInArrow(summed, "square double, sets double")
    n = F.round(F.sum("sets")).cast("bigint")
    return bit.agg(F.sum("square").alias("square"), n.alias("n")).select(
        "n", F.when(F.col("n") > 1, (F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def tanimoto_diversity(fp: DataFrame, id_col: str, n_bits: int = 2048, bins: int = 20) -> DataFrame:
    """Distribution of the Tanimoto similarity over all pairs of rows: pairs and similarity sum per bin.

    Each block returns a histogram, never pairs; copies enter as weights. ``fp`` must be folded
    to ``n_bits`` buckets; a set travels as ``n_bits`` bits and is sent a fixed number of times. A distribution over all pairs costs all pairs; for the mean alone,
    ``set_diversity`` is linear.
    """
    sets = distinct_sets(fp, id_col)
    sets = materialise(sets.select("id", "copies", "n", _packed(n_bits)("bits").alias("bits")), "packed-sets").withColumn("_cell", F.lit(0))

    def kernel(key, lp, rp):
        import numpy as np
        import pandas as pd

        if len(lp) == 0 or len(rp) == 0:
            return pd.DataFrame({"bin": pd.Series(dtype="int32"), "n_pairs": pd.Series(dtype="int64"),
                                 "sim_sum": pd.Series(dtype="float64")})
        # a similarity follows from the shared entries and the sum of both sizes: pairs are counted by these two numbers
        lp, rp = (p.sort_values("n", kind="stable") for p in (lp, rp))
        n, s = np.zeros(bins), np.zeros(bins)
        single = bool((lp["copies"] == 1).all() and (rp["copies"] == 1).all())
        for i in range(0, len(lp), ROWS_PER_CHUNK):
            x = lp.iloc[i:i + ROWS_PER_CHUNK]
            dense, nx, idx = _unpacked(x["bits"], n_bits), x["n"].to_numpy().astype("int32"), x["id"].to_numpy()
            for j in range(0, len(rp), ROWS_PER_CHUNK):
                y = rp.iloc[j:j + ROWS_PER_CHUNK]
                ny = y["n"].to_numpy().astype("int32")
                least = int(nx[0]) + int(ny[0])
                wide = min(int(nx[-1]), int(ny[-1])) + 1
                codes = (int(nx[-1] - nx[0]) + int(ny[-1] - ny[0]) + 1) * wide
                code = (dense @ _unpacked(y["bits"], n_bits).T).astype("int32" if codes < 1 << 31 else "int64")
                code += ((nx - nx[0])[:, None] + (ny - ny[0])[None, :]).astype(code.dtype) * code.dtype.type(wide)
                if key[1] == key[2]:
                    kept = idx[:, None] < y["id"].to_numpy()[None, :]
                    w = None if single else (x["copies"].to_numpy()[:, None] * y["copies"].to_numpy()[None, :])[kept]
                    code = code[kept]
                else:
                    w = None if single else (x["copies"].to_numpy()[:, None] * y["copies"].to_numpy()[None, :]).ravel()
                    code = code.ravel()
                if codes <= 1 << 23:
                    often = np.bincount(code, weights=w)
                    at = np.flatnonzero(often)
                    often = often[at]
                else:
                    at, often = np.unique(code, return_inverse=True)
                    often = np.bincount(often, weights=w)
                total, both = np.divmod(at, wide)
                sim = np.round(both / (total + least - both), 6)
                at, often = np.minimum((sim * bins + 1e-9).astype(int), bins - 1), often
                n += np.bincount(at, weights=often, minlength=bins)
                s += np.bincount(at, weights=often * sim, minlength=bins)
        hit = np.nonzero(n)[0]
        return pd.DataFrame({"bin": hit.astype("int32"), "n_pairs": n[hit].astype("int64"), "sim_sum": s[hit]})

    blocks = block_join(sets, sets, kernel, "bin int, n_pairs bigint, sim_sum double", triangle=True, most=MOST_ROWS)
    same = sets.filter(F.col("copies") > 1).select(
        F.lit(bins - 1).alias("bin"), (F.col("copies") * (F.col("copies") - 1) / 2).cast("bigint").alias("n_pairs"))
    same = same.withColumn("sim_sum", F.col("n_pairs").cast("double"))
    return blocks.unionByName(same).groupBy("bin").agg(F.sum("n_pairs").alias("n_pairs"),
                                                      (F.sum("sim_sum") / F.sum("n_pairs")).alias("mean_sim"))


def unit(vec: str | Column) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""
    v = F.col(vec) if isinstance(vec, str) else vec
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def cosine_neighbours(rows: DataFrame, k: int = 5) -> DataFrame:
    """(qid, cid, distance, rank): the k rows of a pivot table nearest to each by cosine distance."""
    x = rows.select("id", unit("vec").alias("vec"))
    hits = neighbours(x, x, k, "ip", exclude_self=True)
    return hits.select("qid", "cid", F.round(1 - F.col("score"), 6).alias("distance"), "rank")


def pivot_column_distances(rows: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(a, b, distance): cosine distance of every two columns of the pivot of mean values; a missing cell is 0.

    The pivot is never made: columns meet in the rows that hold both, each row once, and a
    row has no more cells than there are columns (a dimension). Pairs without a common row
    have distance 1; a column of zeros has none.
    """
    cells = materialise(rows.groupBy(row, column).agg(F.avg(value).alias("v")).filter("v <> 0"), "pivot-cells")
    length = cells.groupBy(column).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    left = cells.select(row, F.col(column).alias("a"), F.col("v").alias("va"))
    right = cells.select(row, F.col(column).alias("b"), F.col("v").alias("vb"))
    dots = left.join(right, row).filter("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    one, two = (length.select(F.col(column).alias(n), F.col("len").alias(f"len_{n}")) for n in "ab")
    names = [r[0] for r in length.select(column).collect()]  # a dimension
    every = one.withColumn("b", F.explode(F.array(*[F.lit(n) for n in names]))).filter("a < b") if names else one.withColumn("b", F.col("a")).limit(0)
    return every.join(two, "b").join(dots, ["a", "b"], "left").select(
        "a", "b", (1 - F.coalesce("dot", F.lit(0.0)) / (F.col("len_a") * F.col("len_b"))).alias("distance"))


def knn_lsh(queries: DataFrame, corpus: DataFrame, k: int = 5, tables: int = 24, bits: int = 4, seed: int = 5,
            exclude_self: bool = False) -> DataFrame:
    """(qid, cid, score, value, rank): approximate nearest rows by inner product of unit vectors.

    Each of ``tables`` tables cuts the space by ``bits`` random planes; rows of a query's cell
    are compared with it, cell by cell in chunks like the exact search. More tables raise the
    recall, more bits make the cells smaller.
    """
    import numpy as np

    width = corpus.select(F.size("vec")).first()
    planes = np.random.default_rng(seed).standard_normal((tables * bits, width[0] if width else 1))

    @F.pandas_udf("array<int>")
    def codes(v):
        import pandas as pd

        up = (np.stack(v.to_list()).astype("float64") @ planes.T > 0).reshape(len(v), tables, bits)
        return pd.Series(list((up * (1 << np.arange(bits))).sum(axis=2).astype("int32")))

    def celled(df: DataFrame, *more: Column) -> DataFrame:
        at = df.select("id", "vec", *more, F.posexplode(codes("vec")).alias("_t", "_c"))
        return at.withColumn("_cell", F.concat_ws(":", "_t", "_c")).drop("_t", "_c")

    value = F.col("value").cast("double") if "value" in corpus.columns else F.lit(None).cast("double")
    hits = block_join(celled(queries), celled(corpus, value.alias("value")), _topk_kernel(k, "ip", None, exclude_self), _HITS, most=MOST_ROWS)
    once = hits.groupBy("qid", "cid").agg(F.max("score").alias("score"), F.first("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "cid"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found, and their number."""
    hit = exact.select("qid", "cid").join(found.select("qid", "cid").withColumn("_hit", F.lit(1)), ["qid", "cid"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall"))
