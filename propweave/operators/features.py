"""Co-occurring properties: pair counts, entropy, conditional tables, information gain.

One pass serves all target properties at once. Each substance's consistent values are a
list no longer than the number of properties; substances with the same list are counted
once with a weight, so copies cost nothing. Lists are cut by buckets of properties and packed
before they are shuffled; the pairs of two buckets meet in one task, which forms and counts them
in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from propweave.functions.packing import numbered, pack, plain, spread_codes, steps, taken, unpack
from propweave.operators.dataset import nest_pairs
from propweave.operators.ordering import bucket_count
from propweave.session import importable
from propweave.sources.scratch import materialise


#: Properties are dealt to so many buckets at least, more with the third root of the rows above BUCKET_ROWS; each two of them are
#: counted by one task.
BUCKETS, BUCKET_ROWS = 8, 1 << 23
#: Entries of lists that are packed, or counted, at once, in steps of PAIR_BLOCK lists; pairs that a task forms at once, rows it hands on.
ENTRIES_AT_ONCE, PAIR_BLOCK, PAIRS_AT_ONCE, ROWS_OUT = 1 << 19, 64, 1 << 18, 1 << 15
#: Sums of fewer keys are kept in one array.
DENSE_KEYS = 1 << 20
#: Rows that a task nests, about: more rows make more tasks. Tasks that the substances of one profile are dealt to.
NEST_ROWS, DEALS = 1 << 17, 16


def profiles(cons: DataFrame, key: str = "sid", prop: str = "assay", value: str = "value") -> DataFrame:
    """(assay_val_pairs, weight): distinct value profiles and how many substances have each."""
    nested = nest_pairs(cons, key, prop, value)
    return nested.groupBy("assay_val_pairs").agg(F.count(F.lit(1)).alias("weight"))


def dealt_profiles(cons: DataFrame, rows: int, key: str = "sid", prop: str = "assay", value: str = "value") -> DataFrame:
    """``profiles`` by the number of ``rows``, so that the parts grow in number and not in size.

    Substances are dealt to DEALS, and a profile has a row for each deal that it stands in.
    """
    parts = max(bucket_count(cons), -(-rows // NEST_ROWS))
    nested = nest_pairs(cons.repartition(parts, key), key, prop, value)
    by = ["assay_val_pairs", F.pmod(F.xxhash64(key), F.lit(DEALS)).alias("deal")]
    return nested.select(*by).repartition(parts, "assay_val_pairs", "deal").groupBy("assay_val_pairs", "deal").agg(
        F.count(F.lit(1)).alias("weight")).drop("deal")


def frequent(cons: DataFrame, min_rows: int, prop: str = "assay") -> DataFrame:
    """Rows of properties with more than ``min_rows`` values: rarer ones cannot reach a pair count above it."""
    if min_rows <= 0:
        return cons
    kept = cons.groupBy(prop).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_rows)
    # stored, so that its size is known when the join is planned: the rows are not shuffled to meet a small list
    return cons.join(materialise(kept.select(prop), "frequent-properties"), prop, "left_semi")


def checked_values(cons: DataFrame, key: str = "sid", prop: str = "assay", value: str = "value") -> tuple[DataFrame, int]:
    """The observations as a stored table, and how many they are. A value that is not 0 or 1 stops the job."""
    bad = F.raise_error(F.lit("property values must be 0 or 1")).cast("int")
    checked = cons.withColumn(value, F.when(F.col(value).isin(0, 1), F.col(value)).otherwise(bad)).select(key, prop, value)
    seen: dict = {}
    return materialise(checked, "pair-values", seen=seen), seen["n"]  # counted on the way


def pair_counts(cons: DataFrame, key: str = "sid", prop: str = "assay", value: str = "value",
                min_rows: int = 0, exclude_self: bool = False, least: int = 0) -> DataFrame:
    """(x, y, n00, n01, n10, n11): how many substances have x = 0/1 together with y = 0/1.

    One row per ordered property pair, the pair (x, x) included unless ``exclude_self``; only pairs of more
    than ``least`` substances. Only x <= y is formed and counted; the other half is mirrored afterwards. With the four counts in one
    row, entropies, conditionals and gains are plain column arithmetic: no further shuffle.
    Values must be 0 or 1; anything else stops the job rather than being left out.
    """
    return counted_pairs(*checked_values(cons, key, prop, value), key, prop, value, min_rows, exclude_self, least)


def counted_pairs(stored: DataFrame, rows: int, key: str = "sid", prop: str = "assay", value: str = "value",
                  min_rows: int = 0, exclude_self: bool = False, least: int = 0) -> DataFrame:
    """``pair_counts`` of ``checked_values``.

    A property belongs to one bucket, and the pairs of two buckets are counted in one place: a task keeps the
    counts of its pairs of buckets and no others, and they are not shuffled again. Lists cross the shuffle packed,
    those of many substances in one row, and the pairs exist in the task only, PAIRS_AT_ONCE at a time.
    """
    importable(stored.sparkSession)
    prof = dealt_profiles(frequent(stored, min_rows, prop), rows, key, prop, value)
    kind = stored.schema[prop].dataType
    buckets = max(BUCKETS, ceil(BUCKETS * (rows / BUCKET_ROWS) ** (1 / 3)))
    units = prof.select("assay_val_pairs", "weight").mapInArrow(
        _dealt_pairs(buckets), "bx int, by int, left_names binary, left binary, right_names binary, right binary, weights binary")
    counted = units.repartition(4 * buckets * buckets, "bx", "by").groupBy("bx", "by").applyInArrow(
        _pair_counter(exclude_self, least, to_arrow_type(kind)), StructType([StructField("x", kind), StructField("y", kind), *(
            StructField(c, LongType()) for c in CELLS)]))
    return counted


def _dealt_pairs(buckets: int):
    """A row for each two buckets and some ENTRIES_AT_ONCE entries: what the lists hold of both, packed."""
    def units(lists: pa.ListArray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes, flat = pc.list_value_length(lists).to_numpy(), lists.flatten()
        prop, value = (flat.flatten()[i] for i in (0, 1))
        code = prop.dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(code.dictionary)
        names, place = code.dictionary.take(order), np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        bucket = spread_codes(names, buckets)
        number, value = place[code.indices.to_numpy()], value.to_numpy()
        owner, of = np.repeat(np.arange(len(sizes)), sizes), bucket[number]
        by = np.argsort(of.astype(np.uint16) if buckets < 1 << 16 else of, kind="stable")
        ends = np.searchsorted(of[by], np.arange(buckets + 1))
        heavy = b"" if (weights == 1).all() else pack(weights)
        sides = {}
        for b in np.flatnonzero(np.diff(ends)).tolist():
            own, here = np.flatnonzero(bucket == b), by[ends[b]:ends[b + 1]]
            place[own] = np.arange(len(own))
            sides[b] = pack(plain(names.take(pa.array(own)))), pack(
                np.bincount(owner[here], minlength=len(sizes)), steps(place[number[here]]), value[here])
        two = [(x, y) for x in sides for y in sides if x <= y]
        column = lambda i, k: pa.array([sides[t[i]][k] if i == 0 or t[0] != t[1] else None for t in two], pa.binary())
        yield pa.RecordBatch.from_arrays([
            *(pa.array([t[i] for t in two], pa.int32()) for i in (0, 1)), column(0, 0), column(0, 1), column(1, 0), column(1, 1),
            pa.array([heavy] * len(two), pa.binary())], names=["bx", "by", "left_names", "left", "right_names", "right", "weights"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for b in batches:
            for at in range(0, len(b), PAIR_BLOCK):
                part = b.slice(at, PAIR_BLOCK)
                held.append(part)
                entries += pc.sum(pc.list_value_length(part.column(0))).as_py() or 0
                if entries >= ENTRIES_AT_ONCE:
                    yield from flush(held)
                    held, entries = [], 0
        if entries:
            yield from flush(held)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield from units(whole.column(0).chunk(0), whole.column(1).to_numpy())
    return dealt


class Tally:
    """Sums by key: in one array where the keys are few, else sorted and merged now and then.

    A key and its sum are one number where both fit, so that a plain sort brings equal keys together.
    """

    def __init__(self, keys: int):
        self.dense = np.zeros(keys, np.int64) if keys <= DENSE_KEYS else None
        self.shift = 63 - keys.bit_length()
        self.fits, self.total = True, 0
        self.held, self.pending, self.waiting = [np.zeros(0, np.int64)] * (1 if self.fits else 2), [], 0

    def add(self, keys: np.ndarray, n: np.ndarray | None) -> None:
        if self.dense is not None:
            self.dense += (np.bincount(keys, minlength=len(self.dense)) if n is None
                           else np.round(np.bincount(keys, n, len(self.dense))).astype(np.int64))
            return
        self.total += len(keys) if n is None else int(n.sum())
        if self.fits and self.total.bit_length() > self.shift:  # a sum could become too large for its place
            self._merge()
            self.held, self.fits = list(self.sums()), False
        if self.fits:
            keys <<= self.shift
            keys += 1 if n is None else n
            self.pending.append([keys])
        else:
            self.pending.append([keys, np.ones(len(keys), np.int64) if n is None else n])
        self.waiting += len(keys)
        if self.waiting > max(2 * PAIRS_AT_ONCE, len(self.held[0])):
            self._merge()

    def _merge(self) -> None:
        held = [np.concatenate([h, *(p[i] for p in self.pending)]) for i, h in enumerate(self.held)]
        self.pending, self.waiting = [], 0
        if not len(held[0]):
            return
        if self.fits:
            held[0].sort()
            keys, n = held[0] >> self.shift, held[0] & ((1 << self.shift) - 1)
        else:
            order = np.argsort(held[0], kind="stable")
            keys, n = (h[order] for h in held)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[first], np.add.reduceat(n, first)
        self.held = [(keys << self.shift) + n] if self.fits else [keys, n]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys in order, sums)."""
        if self.dense is not None:
            keys = np.flatnonzero(self.dense)
            return keys, self.dense[keys]
        self._merge()
        if not self.fits:
            return tuple(self.held)
        return self.held[0] >> self.shift, self.held[0] & ((1 << self.shift) - 1)


def _pair_counter(exclude_self: bool, least: int, kind: pa.DataType):
    """The counts of two buckets' pairs, of both orders."""
    def entries(rows: list, x_at: list, y_at: list, width: int, same: bool) -> Iterator[tuple]:
        """(key, first pair, pairs, weight) of the left entries of some rows in the order of their keys, and the keys of the right ones."""
        held, much = [], 0
        for i, (_, left, _, right, weights) in enumerate(rows):
            sizes, code, value = unpack(left)
            sizes, code, value = sizes.astype(np.int64), x_at[i][np.cumsum(code, dtype=np.int64)], value.astype(np.int64)
            owner, x = np.repeat(np.arange(len(sizes)), sizes), code * width + 2 * value
            if same:  # a list with itself
                y = 4 * code + value
                begin = np.arange(len(owner)) + int(exclude_self)
                n = np.cumsum(sizes)[owner] - begin
            else:
                many, code, value = unpack(right)
                many, y = many.astype(np.int64), 4 * y_at[i][np.cumsum(code, dtype=np.int64)] + value.astype(np.int64)
                n, begin = many[owner], (np.cumsum(many) - many)[owner]
            base = sum(len(h[4]) for h in held)
            held.append((x, begin + base, n, np.ones(1, np.int64)[:0] if not weights else unpack(weights)[0].astype(np.int64)[owner], y))
            much += len(x) + len(y)
            if much >= ENTRIES_AT_ONCE or i + 1 == len(rows):
                heavy = any(len(h[3]) for h in held)
                weight = np.concatenate([h[3] if len(h[3]) else np.ones(len(h[0]), np.int64) for h in held]) if heavy else None
                x, begin, n, y = (np.concatenate([h[j] for h in held]) for j in (0, 1, 2, 4))
                held, much = [], 0
                order = np.argsort(x, kind="stable")
                yield x[order], begin[order], n[order], None if weight is None else weight[order], y

    def add(tally: Tally, x: np.ndarray, begin: np.ndarray, n: np.ndarray, weight: np.ndarray | None, y: np.ndarray, width: int) -> None:
        cum = np.cumsum(n)
        total = int(cum[-1]) if len(cum) else 0
        cuts = np.unique(np.searchsorted(cum, np.arange(PAIRS_AT_ONCE, total + PAIRS_AT_ONCE, PAIRS_AT_ONCE), side="right"))
        a = 0
        for b in [*cuts.tolist(), len(n)]:
            part = n[a:b]
            much = int(part.sum())
            if much:
                at = np.repeat(begin[a:b] - (np.cumsum(part) - part), part)
                at += np.arange(much)
                keys = np.repeat(x[a:b], part)
                keys += y[at]
                w = None if weight is None else np.repeat(weight[a:b], part)
                span = int(x[b - 1] - x[a]) + width
                if tally.dense is None and span <= 4 * much and (w is None or int(w.sum()) < 1 << 50):  # they lie close together
                    sums = np.bincount(keys - x[a], w)
                    some = np.flatnonzero(sums)
                    keys, w = some + x[a], np.round(sums[some]).astype(np.int64)
                tally.add(keys, w)
            a = b

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("left_names", "left", "right_names", "right", "weights")))]
        same = rows[0][2] is None
        x_names, x_at = numbered([unpack(r[0])[0] for r in rows])
        y_names, y_at = (x_names, x_at) if same else numbered([unpack(r[2])[0] for r in rows])
        width = 4 * len(y_names)
        tally = Tally(len(x_names) * width)
        for part in entries(rows, x_at, y_at, width, same):
            add(tally, *part, width)
        keys, n = tally.sums()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] >> 2 != keys[:-1] >> 2])) if len(keys) else np.zeros(0, np.int64)
        cells = np.zeros((len(first), 4), np.int64)
        cells[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys)))), keys & 3] = n
        pair = keys[first] >> 2
        kept = cells.sum(axis=1) > least
        pair, cells = pair[kept], cells[kept]
        for at in range(0, len(pair), ROWS_OUT):
            x, y = np.divmod(pair[at:at + ROWS_OUT], len(y_names))
            some = cells[at:at + ROWS_OUT]
            yield pa.RecordBatch.from_arrays([taken(x_names, x, kind), taken(y_names, y, kind), *(pa.array(c) for c in some.T)], names=["x", "y", *CELLS])
            other = x != y if same else np.ones(len(x), bool)
            back = some[other][:, [0, 2, 1, 3]]
            yield pa.RecordBatch.from_arrays([taken(y_names, y[other], kind), taken(x_names, x[other], kind), *(pa.array(c) for c in back.T)],
                                             names=["x", "y", *CELLS])
    return counted


CELLS = ["n00", "n01", "n10", "n11"]


def total() -> Column:
    return F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")


def cooccurrence(cons: DataFrame, min_count: int = 30, **names: str) -> DataFrame:
    """(target, feature) seen together more than ``min_count`` times: number of substances and value agreement."""
    return pair_counts(cons, min_rows=min_count, least=min_count, **names).select(F.col("x").alias("target"), F.col("y").alias("feature"),
                                             total().alias("n"), (F.col("n00") + F.col("n11")).alias("n_same"))


def plogp(part: Column, whole: Column, over: Column | None = None) -> Column:
    """part / whole * log2(part / over), 0 for an empty part."""
    return F.when(part > 0, part / whole * F.log2(part / (whole if over is None else over))).otherwise(0.0)


def pair_entropy(cons: DataFrame, min_count: int = 30, exclude_self: bool = False, conditional: bool = False,
                 **names: str) -> DataFrame:
    """Entropy of the feature's values among the target's substances, for pairs seen more than ``min_count`` times.

    ``conditional``: entropy of the feature given the target's value.
    """
    pc = pair_counts(cons, min_rows=min_count, exclude_self=exclude_self, least=min_count, **names)
    n00, n01, n10, n11 = (F.col(c) for c in CELLS)
    if conditional:
        h = -(plogp(n00, total(), n00 + n01) + plogp(n01, total(), n00 + n01)
              + plogp(n10, total(), n10 + n11) + plogp(n11, total(), n10 + n11))
    else:
        h = -(plogp(n00 + n10, total()) + plogp(n01 + n11, total()))
    return pc.select(F.col("x").alias("target"), F.col("y").alias("feature"), total().alias("n"),
                     F.greatest(h, F.lit(0.0)).alias("entropy"))


def useful_features(cons: DataFrame, min_count: int = 30, h_min: float = 0.025, h_max: float = 0.9,
                    exclude_self: bool = False, **names: str) -> DataFrame:
    """Informative, non-redundant features of every target."""
    h = pair_entropy(cons, min_count, exclude_self, **names)
    return h.filter((F.col("entropy") > h_min) & (F.col("entropy") <= h_max))


def conditional_table(cons: DataFrame, alpha: float = 1.0, min_count: int = 30, **names: str) -> DataFrame:
    """If ``feature`` has value v, how likely is ``target`` = 1? With support, smoothing, prior and lift,
    and the log-likelihood ratio used by the scorer."""
    stored, n = checked_values(cons, **names)
    pc = counted_pairs(stored, n, min_rows=min_count, exclude_self=True, least=min_count, **names)
    # from the stored values, and stored, so that its size is known when the join is planned: the pairs are not shuffled to meet it
    prior = materialise(priors(stored, alpha, names.get("prop", "assay"), names.get("value", "value")).select("target", "prior"), "priors")
    per_value = F.array(*[F.struct(F.lit(v).alias("fvalue"), F.col(f"n0{v}").alias("n0"), F.col(f"n1{v}").alias("n1"),
                                   (F.col("n00") + F.col("n01")).alias("all0"), (F.col("n10") + F.col("n11")).alias("all1"))
                          for v in (0, 1)])
    cell = pc.select(F.col("x").alias("target"), F.col("y").alias("feature"), F.inline(per_value))
    support = F.col("n0") + F.col("n1")
    p = (F.col("n1") + alpha) / (support + 2 * alpha)
    llr = (F.log((F.col("n1") + alpha) / (F.col("all1") + 2 * alpha))
           - F.log((F.col("n0") + alpha) / (F.col("all0") + 2 * alpha)))
    return (cell.filter(support > 0).join(prior.select("target", "prior"), "target")
                .select("target", "feature", "fvalue", support.alias("support"), "n1", p.alias("p1"), "prior",
                        (p / F.col("prior")).alias("lift"), llr.alias("llr")))


def priors(cons: DataFrame, alpha: float = 1.0, prop: str = "assay", value: str = "value") -> DataFrame:
    one = F.sum(F.col(value).cast("bigint"))
    n = F.count(F.lit(1))
    return cons.groupBy(F.col(prop).alias("target")).agg(
        ((one + alpha) / (n + 2 * alpha)).alias("prior"), n.alias("n_known"))


def information_gain(cons: DataFrame, min_count: int = 30, **names: str) -> DataFrame:
    """Most predictive properties: H(target) - H(target | feature) among substances with both."""
    pc = pair_counts(cons, min_rows=min_count, exclude_self=True, least=min_count, **names)
    n00, n01, n10, n11 = (F.col(c) for c in CELLS)
    alone = plogp(n00 + n01, total()) + plogp(n10 + n11, total())
    given = (plogp(n00, total(), n00 + n10) + plogp(n10, total(), n00 + n10)
             + plogp(n01, total(), n01 + n11) + plogp(n11, total(), n01 + n11))
    return pc.select(F.col("x").alias("target"), F.col("y").alias("feature"), total().alias("support"),
                     F.greatest(given - alone, F.lit(0.0)).alias("gain"))


def pair_count_distribution(act: DataFrame, keys: tuple[str, ...] = ("sid", "assay")) -> DataFrame:
    """How many (substance, property) pairs stand in how many raw rows."""
    per = act.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))
    return per.groupBy("n_values").agg(F.count(F.lit(1)).alias("n_items"))


def holdout_features(trn: DataFrame, hld: DataFrame, **kw) -> DataFrame:
    """Held-out targets with the held-out values of their useful features (learned on the training part)."""
    useful = useful_features(trn, **kw).select("target", "feature")
    t = hld.select("sid", F.col("assay").alias("target"), F.col("value").alias("target_value"))
    # each held-out row first meets its target's feature list, then the substance's own value of that feature
    want = t.join(useful, "target")
    f = hld.select("sid", F.col("assay").alias("feature"), F.col("value").alias("feature_value"))
    return want.join(f, ["sid", "feature"])
