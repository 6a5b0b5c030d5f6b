"""N-gram Jaccard self-join by chosen paths.

A text is its set of five-word shingles. Texts with equal sets are one representative with a
count. A representative is embedded as 128 tokens (i, i-th MinHash), which two sets share in
proportion to their similarity. A node of a search tree is a bucket of representatives; it
samples tokens, each with probability 1 / (threshold * 128), and every sampled token makes a
child of those that share it. So a pair at the threshold survives a level once on average
while unlike pairs die out. Small buckets, and those that a split no longer shrinks, are
compared by brute force. Independent runs repeat this until a pair at the threshold has been
met with the target probability.

What brute force yields are candidates by sketch, with a margin of four standard deviations.
They go on as groups, not as pairs: a bucket whose members are all in one group already is
not looked at in later runs, for only connections matter here. Inside a connected group the
true shingle sets are compared and exact Jaccard decides.

A small group is compared in one unit of work. A large one is first held against its leader,
one of its members. Jaccard distance is a metric: members within half the greatest distance of
a link from the leader are all linked to each other, without being compared. The others meet
each other and those in blocks; what travels is not a set but its difference from the leader's,
which is small for near copies and tells the size of every intersection:
    |x & y| = |L| - |L-x| - |L-y| + |(L-x) & (L-y)| + |(x-L) & (y-L)|.
So a group of near copies costs its rows, and only members far from the leader cost blocks of
differences. Counts of links and a spanning forest leave the tasks, so no list of all pairs of
a large group is ever written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from propweave.llm.bytetext import Words, _splitmix, mix, pieces, shingles
from propweave.llm.components import connected_components
from propweave.llm.tables import fresh
from propweave.sources.scratch import materialise

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
TOKENS = 128
#: Four standard deviations of a similarity estimated from TOKENS matches, at the threshold.
MARGIN = 4 * (THRESHOLD * (1 - THRESHOLD) / TOKENS) ** 0.5
#: A bucket of more rows is split; rows compared by sketch at once.
LEAF, BLOCK = 4096, 3072
#: Members and shingles of a group that is compared in one unit; members and numbers of a block of differences.
SET_BLOCK, SET_NUMBERS, DELTA_BLOCK, DELTA_NUMBERS = 256, 1 << 22, 2048, 1 << 21
#: Levels of splits; a split that leaves more of a bucket than this is the last; runs before known groups are left alone.
DEPTH, DENSE, FIRST_RUNS = 4, 0.7, 4
_A = (_splitmix(TOKENS, 101) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_splitmix(TOKENS, 103) >> np.uint64(32)).astype(np.uint32)


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with this probability, even ``depth`` levels down."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - exp(-alive)
    return ceil(log(1 - recall) / log(1 - alive))


def text_sets(data: np.ndarray, text_at: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(data, text_at)
    s, at = shingles(w.hashes(), w.word_at, n)
    return [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:])]


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS MinHashes of each set, as a matrix; a set without members has none of meaning."""
    out = np.zeros((len(sets), TOKENS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])])[:-1]
        for k in range(TOKENS):
            out[full, k] = np.minimum.reduceat(x * _A[k] + _B[k], at)
    return out


SKETCH = "key {key}, h1 bigint, h2 bigint, size int, digest binary, sketch binary"


def sketches(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(row, key, h1, h2, size, digest, sketch) of every document; h1 and h2 are hashes of the text."""
    body = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = body.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(4), "text")})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, at in pieces(b):
                sets = text_sets(data, at, n)
                m = minhashes(sets)
                yield pa.RecordBatch.from_arrays([
                    part.column("key"), part.column("h1"), part.column("h2"), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in m], pa.binary())], names=["key", "h1", "h2", "size", "digest", "sketch"])

    made = body.mapInArrow(apply, SKETCH.format(key=body.schema["key"].dataType.simpleString()))
    return materialise(made.withColumn("row", F.monotonically_increasing_id()), "sketches")


def _matrix(column: pa.Array, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _token_keys(nodes: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit word for each node and token position."""
    return mix(nodes[:, None] ^ _splitmix(TOKENS, 107)[None, :])


def split(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Children of buckets: (node, rep, known, parent) from (node, rep, known, n, sketch)."""
    bar = np.uint64(int(2**64 / (threshold * TOKENS)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                draw = _token_keys(part.column("node").to_numpy(zero_copy_only=False).view(np.uint64))
                r, k = np.nonzero(draw < bar)
                value = _matrix(part.column("sketch"))[r, k].astype(np.uint64)
                child = mix(mix(draw[r, k]) ^ mix(value + np.uint64(1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), *(part.column(c).take(pa.array(r)) for c in ("rep", "known", "n"))],
                    names=["node", "rep", "known", "parent"])

    return rows.select("node", "rep", "known", "n", "sketch").mapInArrow(apply, "node bigint, rep bigint, known bigint, parent bigint")


def first_split(reps: DataFrame, runs: range, threshold: float = THRESHOLD) -> DataFrame:
    """Children of the roots of the runs: each run samples its own tokens of every representative."""
    bar = np.uint64(int(2**64 / (threshold * TOKENS)))
    roots = _splitmix(runs.stop, 109)[runs.start :]
    draw = _token_keys(roots)
    chosen = list(zip(*np.nonzero(draw < bar)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("sketch")).astype(np.uint64)
            for r, k in chosen:
                child = mix(mix(draw[r, k]) ^ mix(m[:, k] + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("rep"), b.column("known")],
                                                 names=["node", "rep", "known"])

    return reps.select("rep", "known", "sketch").mapInArrow(apply, "node bigint, rep bigint, known bigint")


def _counted(children: DataFrame) -> DataFrame:
    """Rows of buckets of two or more known groups, with their size; of buckets with the same members one is kept."""
    extra = [F.max("parent").alias("parent")] if "parent" in children.columns else [F.lit(None).cast("bigint").alias("parent")]
    size = children.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64(F.lit(5), "rep")).alias("x"), F.min("known").alias("k1"), F.max("known").alias("k2"), *extra).filter("k1 < k2")
    one = size.groupBy("n", "s", "x").agg(F.min("node").alias("node"), F.max("parent").alias("parent"))
    return children.select("node", "rep", "known").join(one.select("node", "n", "parent"), "node")


def buckets(reps: DataFrame, runs: range, threshold: float = THRESHOLD, depth: int = DEPTH) -> DataFrame:
    """(node, rep, known, n): the buckets to compare by brute force. ``known`` of a representative is the group it is in."""
    done = []
    live = materialise(_counted(first_split(reps, runs, threshold)), "paths")
    for _ in range(depth - 1):
        large = (F.col("n") > LEAF) & (F.col("parent").isNull() | (F.col("n") <= DENSE * F.col("parent")))
        done.append(live.filter(~large))
        rest = live.filter(large)
        if not rest.take(1):
            live = None
            break
        live = materialise(_counted(split(rest.join(reps.select("rep", "sketch"), "rep"), threshold)), "paths")
    if live is not None:
        done.append(live)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("node", "rep", "known", "n")


def in_blocks(rows: DataFrame, group: str, member: str, size: int, n: str = "n") -> DataFrame:
    """Adds (lo, hi, side): every two members of a group meet in exactly one (group, lo, hi).

    A group of more than ``size`` members is cut into blocks, and each pair of blocks is one unit
    of work; ``side`` tells which block of the two a row belongs to.
    """
    blocks = F.ceil(F.col(n) / size).cast("int")
    own = F.pmod(F.xxhash64(F.lit(8), F.col(member)), blocks).cast("int")
    cut = rows.withColumns({"_blocks": blocks, "_own": own})
    return cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        *rows.columns, F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal (g, lo, hi) together, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "lo", "hi")])
        cuts = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1, [b.num_rows]])
        for a, e in zip(cuts[:-1], cuts[1:]):
            this = tuple(ids[:, a])
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, e - a))
            last = this
    if held:
        yield pa.Table.from_batches(held)


def _forest(similar: np.ndarray) -> np.ndarray:
    """Root of each row under a symmetric boolean matrix: the first row of its component."""
    root = np.full(len(similar), -1)
    for i in range(len(similar)):
        if root[i] < 0:
            root[i] = i
            todo = [i]
            while todo:
                new = np.flatnonzero(similar[todo].any(0) & (root < 0))
                root[new] = i
                todo = new.tolist()
    return root


def candidate_edges(rows: DataFrame, reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): edges that connect, in each bucket, what pairs that may reach the threshold connect, by sketch and by size.

    Members of one known group are connected already and not compared. The number of edges
    follows the rows of a bucket, not its pairs: a block gives a spanning forest, two blocks an
    edge for each part of one that the other ties to something else.
    """
    low = threshold - MARGIN
    small = reps.select("rep", "size", "sketch")
    units = in_blocks(rows.withColumnRenamed("node", "g"), "g", "rep", BLOCK).join(small, "rep")
    units = units.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out, b_out = [], []
        for t in _units(batches):
            rep, size = t["rep"].to_numpy(), t["size"].to_numpy().astype(float)
            _, head, group = np.unique(t["known"].to_numpy(), return_index=True, return_inverse=True)
            m = _matrix(t["sketch"].combine_chunks()).astype(np.uint8)  # the low byte tells as much
            side = t["side"].to_numpy()
            cross = t["lo"][0].as_py() != t["hi"][0].as_py()
            near = np.zeros((len(head), len(head)), bool)  # between known groups
            for i in range(len(rep) - 1):
                fits = np.minimum(size[i + 1 :], size[i]) >= threshold * np.maximum(size[i + 1 :], size[i])
                at = i + 1 + np.flatnonzero(fits & (group[i + 1 :] != group[i]))
                if len(at):
                    at = at[(m[at] == m[i]).sum(1) >= low * TOKENS]
                    near[group[i], group[at]] = near[group[at], group[i]] = True
            root = _forest(near)
            tied = np.flatnonzero(root != np.arange(len(head)))
            if cross and len(head) == len(rep):  # each block ties its own rows in its own unit: what joins the two is left
                own = side[head]
                tied = tied[_forest(near & (own[:, None] == own[None, :]))[tied] == tied]
            a_out.append(rep[head[tied]])
            b_out.append(rep[head[root[tied]]])
            if len(a_out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])
                a_out, b_out = [], []
        if a_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])

    return units.select("g", "lo", "hi", "side", "rep", "known", "size", "sketch").mapInArrow(apply, "a bigint, b bigint")


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all pairs: a product of incidence matrices over the members that two sets share."""
    sets = left if right is None else left + right
    out = np.zeros((len(left), len(left if right is None else right)))
    if not len(out) or not out.shape[1]:
        return out
    sizes = [len(x) for x in sets]
    number, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, (1 << 22) // len(sets))
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        i, j = np.searchsorted(column, [a, a + width])
        x = np.zeros((len(sets), min(width, int(number[-1]) + 1 - a)), np.float32)
        x[row[i:j], column[i:j] - a] = 1
        out += x @ x.T if right is None else x[: len(left)] @ x[len(left) :].T
    if right is None:
        out[np.arange(len(left)), np.arange(len(left))] = sizes
    return out


VERIFIED = "rep bigint, root bigint, links bigint, texts bigint, parts boolean"


def _links(rep: np.ndarray, copies: np.ndarray, linked: np.ndarray, parts: bool) -> pa.RecordBatch:
    root = _forest(linked)
    return pa.RecordBatch.from_arrays(
        [pa.array(rep), pa.array(rep[root]), pa.array((linked @ copies).astype(np.int64)), pa.array(linked.sum(1).astype(np.int64)),
         pa.array(np.full(len(rep), parts))], names=["rep", "root", "links", "texts", "parts"])


def verified(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, root, links, texts, parts): exact Jaccard inside groups of (g, rep, n, total, copies, shingles).

    ``total`` counts the shingles of a group. ``root`` is a connected member (itself if none),
    ``links`` the documents behind the linked representatives, ``texts`` their number. ``parts``:
    the group has further rows, whose counts add up and whose roots are to be connected.
    """
    one = (F.col("n") <= SET_BLOCK) & (F.col("total") <= SET_NUMBERS)
    small = members.filter(one).select("g", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "rep", "copies", "shingles")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _units(batches):
            rep, copies = (t[c].to_numpy() for c in ("rep", "copies"))
            sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
            size = np.array([len(s) for s in sets], float)
            both = intersections(sets)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            yield _links(rep, copies, linked, False)

    units = small.repartition("g").sortWithinPartitions("g")
    return units.mapInArrow(apply, VERIFIED).unionByName(verified_by_leader(members.filter(~one), threshold))


def differences(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(g, rep, copies, head, base, ball, size, minus, plus): each member against the leader of its group.

    ``head`` is the leader, ``base`` the size of its set, ``minus`` what the member lacks of it,
    ``plus`` what it has beside; ``ball``: all such members are linked to each other.
    """
    first = members.groupBy("g").agg(F.min("rep").alias("head"))
    heads = members.join(first, "g").filter("rep = head").select("g", "head", F.col("shingles").alias("own"))
    near = (1 - threshold) / 2

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "rep", "copies", "head", "base", "ball", "size", "minus", "plus"]
        for b in batches:
            for i in range(len(b)):
                x, own = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in ("shingles", "own"))
                minus, plus = np.setdiff1d(own, x, True), np.setdiff1d(x, own, True)
                apart = (len(minus) + len(plus)) / max(len(own) + len(plus), 1)
                row = [b.column(c)[i].as_py() for c in ("g", "rep", "copies", "head")]
                row += [len(own), bool(apart <= near - 1e-9), len(x), minus.tobytes(), plus.tobytes()]
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return members.join(heads, "g").select("g", "rep", "copies", "head", "shingles", "own").mapInArrow(
        apply, "g bigint, rep bigint, copies bigint, head bigint, base bigint, ball boolean, size bigint, minus binary, plus binary")


def verified_by_leader(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``verified`` for large groups."""
    told = materialise(differences(members, threshold), "differences")
    numbers = (F.octet_length("minus") + F.octet_length("plus")) / 8
    sums = told.groupBy("g").agg(
        F.sum(F.when(F.col("ball"), F.col("copies"))).alias("ball_copies"), F.count(F.when(F.col("ball"), 1)).alias("ball_texts"),
        *[F.greatest(F.ceil(F.count(F.when(side, 1)) / DELTA_BLOCK), F.ceil(F.coalesce(F.sum(F.when(side, numbers)), F.lit(0)) / DELTA_NUMBERS)).cast("int").alias(name)
          for name, side in (("outs", ~F.col("ball")), ("balls", F.col("ball")))])
    rows = told.join(sums, "g")
    inside = rows.filter("ball").select(
        "rep", F.col("head").alias("root"), (F.col("ball_copies") - F.col("copies")).alias("links"), (F.col("ball_texts") - 1).alias("texts"),
        F.lit(True).alias("parts"))
    # blocks 0 to outs - 1 are members outside the ball, those behind them are inside: two inside never meet
    own = F.pmod(F.xxhash64(F.lit(8), "rep"), F.when(F.col("ball"), F.col("balls")).otherwise(F.col("outs"))).cast("int")
    cut = rows.filter("outs > 0").withColumn("mine", own + F.when(F.col("ball"), F.col("outs")).otherwise(0))
    last = F.when(F.col("ball"), F.col("outs")).otherwise(F.col("outs") + F.col("balls")) - 1
    meet = cut.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        "g", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
        (F.col("mine") > F.col("other")).alias("side"), "rep", "copies", "base", "size", "minus", "plus")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _units(batches):
            rep, copies, size, side = (t[c].to_numpy() for c in ("rep", "copies", "size", "side"))
            minus, plus = ([np.frombuffer(s, np.uint64) for s in t[c].to_pylist()] for c in ("minus", "plus"))
            lack, base = np.array([len(x) for x in minus]), t["base"][0].as_py()
            two = t["lo"][0].as_py() != t["hi"][0].as_py()
            a = np.flatnonzero(~side.astype(bool)) if two else np.arange(len(rep))
            b = np.flatnonzero(side.astype(bool)) if two else a
            pick = lambda sets: intersections([sets[i] for i in a], [sets[i] for i in b] if two else None)
            both = base - lack[a][:, None] - lack[b][None, :] + pick(minus) + pick(plus)
            near = both >= threshold * (size[a][:, None] + size[b][None, :] - both) - 1e-9
            linked = np.zeros((len(rep), len(rep)), bool)
            linked[np.ix_(a, b)] = near
            linked[np.ix_(b, a)] |= near.T
            np.fill_diagonal(linked, False)
            yield _links(rep, copies, linked, True)

    units = meet.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")
    return inside.unionByName(units.mapInArrow(apply, VERIFIED))


def candidate_groups(reps: DataFrame, runs: int, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root): connected groups of representatives that may be similar, from all runs.

    The first runs find most groups; the others only look at buckets that hold more than one.
    For that it is enough to know some connections: each representative follows its smallest
    neighbour, twice.
    """
    first = min(FIRST_RUNS, runs)
    edges = candidate_edges(buckets(reps.withColumn("known", F.col("rep")), range(first), threshold), reps, threshold)
    edges = materialise(edges, "first-edges")
    if runs > first:
        down = edges.select(F.greatest("a", "b").alias("rep"), F.least("a", "b").alias("low")).groupBy("rep").agg(F.min("low").alias("low"))
        down = materialise(down, "low")
        twice = down.join(down.select(F.col("rep").alias("low"), F.col("low").alias("lower")), "low", "left")
        marked = reps.join(twice.select("rep", F.coalesce("lower", "low").alias("known")), "rep", "left")
        marked = materialise(marked.select("rep", "sketch", F.coalesce("known", "rep").alias("known")), "marked")
        edges = edges.unionByName(candidate_edges(buckets(marked, range(first, runs), threshold), reps, threshold))
    return materialise(connected_components(edges, "candidates"), "groups")


def shingle_rows(docs: DataFrame, wanted: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(rep, g, n, total, copies, shingles) of the wanted representatives, found again by key and text hashes."""
    body = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = body.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(4), "text")})
    w = wanted.select(F.col("key").alias("_key"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "rep", "g", "n", "total", "copies")
    found = body.join(w, F.col("key").eqNullSafe(F.col("_key")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, at in pieces(b):
                sets = pa.array([s.tobytes() for s in text_sets(data, at, n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "g", "n", "total", "copies")), sets],
                                                 names=["rep", "g", "n", "total", "copies", "shingles"])

    sets = found.select("rep", "g", "n", "total", "copies", "text").mapInArrow(
        apply, "rep bigint, g bigint, n bigint, total bigint, copies bigint, shingles binary")
    return sets.dropDuplicates(["rep"])  # equal rows of one key


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, n: int = WORDS,
                    recall: float = RECALL) -> DataFrame:
    """One row per document: key, class_id, class_size, n_links, n_similar_texts, kept, and the text's h1, h2.

    Two documents are linked when the Jaccard similarity of their sets of n-word shingles
    (A-Z lower-cased) is at least the threshold; classes are connected documents. ``class_id``
    is the smallest key of a class (null only if all are), whose first row is ``kept``.
    ``n_links`` counts all linked documents, copies among them; ``n_similar_texts`` the linked
    shingle sets. A text of fewer than n words is one shingle of all its words. A text without
    words (null, empty, spaces) is linked to nothing and a class of its own. Repeated rows are
    copies of each other. An empty table gives an empty result; further columns are ignored.
    """
    rows = sketches(docs, key, text, n)
    full = rows.filter("size > 0")
    same = full.groupBy("digest", "size").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = full.join(same.select(F.col("rep").alias("row"), "copies"), "row").withColumnRenamed("row", "rep").drop("digest")
    reps = materialise(reps, "representatives")
    groups = candidate_groups(reps, runs_for(recall), threshold)
    grouped = groups.select(F.col("node").alias("rep"), F.col("root").alias("g")).join(reps.select("rep", "key", "h1", "h2", "copies", "size"), "rep")
    wanted = grouped.join(grouped.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("bigint").alias("total")), "g")
    sets = materialise(shingle_rows(docs, wanted, key, text, n), "shingles")
    found = materialise(verified(sets, threshold), "verified")
    # a group compared in one unit is final; only those of several units have their parts to connect
    split_ = connected_components(found.filter("parts").select(F.col("rep").alias("a"), F.col("root").alias("b")), "classes")
    classes = found.filter("not parts").select(F.col("rep").alias("node"), "root").unionByName(split_)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    of_rep = same.join(links, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", "size", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"),
        F.coalesce("root", "rep").alias("class"))
    light = rows.drop("sketch")
    out = light.filter("size > 0").join(of_rep, ["digest", "size"]).select(
        "row", "key", "h1", "h2", "class", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("n_similar_texts"))
    zero = F.lit(0).cast("bigint")
    out = out.unionByName(light.filter("size = 0").select(
        "row", "key", "h1", "h2", F.col("row").alias("class"), zero.alias("n_links"), zero.alias("n_similar_texts")))
    out = materialise(out, "linked")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("row").alias("row")))
    head = out.groupBy("class").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    return out.join(head, "class").select(
        F.col("key").alias(key), F.col("first.key").alias("class_id"), "class_size", "n_links", "n_similar_texts",
        (F.col("row") == F.col("first.row")).alias("kept"), "h1", "h2")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, with all its columns."""
    a, b, *own = fresh(docs, "a", "b", "key", "h1", "h2")
    kept = jaccard_classes(docs, key, text, **options).filter("kept").select(*(F.col(c).alias(n) for c, n in zip((key, "h1", "h2"), own)))
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumns({a: F.xxhash64(body), b: F.xxhash64(F.lit(4), body)})
    stay = marked.join(kept, F.col(key).eqNullSafe(F.col(own[0])) & (F.col(a) == F.col(own[1])) & (F.col(b) == F.col(own[2])), "left_semi")
    return stay.dropDuplicates([key, a, b]).drop(a, b)
