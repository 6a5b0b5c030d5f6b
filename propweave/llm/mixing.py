"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power alpha, normalised. The exponent is
bisected: the largest one whose weights still have the wanted entropy, or a larger one
where that would repeat a source more often than allowed. The token budget times the weight
is a source's quota; it is filled by whole passes over the source and a part of one more.
In every pass the source's blocks (documents dealt by a hash of their key) come in an order
of their own; the last pass stops inside a block where the quota ends.

A source's part of the plan is one row: passes, and where the last one ends. So documents
meet the plan in one join on the source and are never sorted or moved by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propweave.sources.scratch import materialise

BLOCK_TOKENS = 1 << 18
#: Share of the largest possible entropy, log(sources), and passes over a source at most.
TARGET_ENTROPY, MAX_PASSES = 0.98, 2.0
#: Bisection steps taken in one pass over the source table, and passes.
STEPS, ROUNDS = 4, 6
SEED = 3


def token_count(text: str = "text") -> Column:
    """Words of a text: runs without spaces and control spaces; a null text has none."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


@dataclass
class Exponent:
    alpha: float
    entropy: float  # share of log(sources)
    passes: float   # of the source repeated most, when the largest source is used once


def _measures(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy share, most passes) of each exponent, in one aggregate over the sources."""
    x = F.col("share")
    aggs = [F.count(F.lit(1)).alias("n"), F.min("share").alias("lo"), F.max("share").alias("hi")]
    for i, a in enumerate(exponents):
        aggs += [F.sum(F.pow(x, F.lit(a))).alias(f"s{i}"), F.sum(F.pow(x, F.lit(a)) * F.ln(x)).alias(f"e{i}")]
    r = shares.agg(*aggs).first()
    if not r["n"]:
        return [(1.0, 1.0)] * len(exponents)
    from math import log

    out = []
    for i, a in enumerate(exponents):
        entropy = log(r[f"s{i}"]) - a * r[f"e{i}"] / r[f"s{i}"]
        out.append((entropy / log(r["n"]) if r["n"] > 1 else 1.0, (r["lo"] / r["hi"]) ** (a - 1)))
    return out


def choose_exponent(shares: DataFrame, entropy: float = TARGET_ENTROPY, passes: float = MAX_PASSES) -> Exponent:
    """Bisect alpha in [0, 1]: as near to 1 as the entropy allows, but not below what the pass limit needs.

    Both measures are monotone: with alpha growing, the entropy falls and the largest number
    of passes falls to 1. Where the two contradict each other, the pass limit wins. ``shares``
    has one row per source of a positive share.
    """
    def bisect(good_at_low, lo=0.0, hi=1.0) -> tuple[float, float]:
        for _ in range(ROUNDS):
            n = 1 << STEPS
            grid = [lo + (hi - lo) * j / n for j in range(1, n)]
            fits = [good_at_low(m) for m in _measures(shares, grid)]
            j = sum(fits)  # monotone: the first j points fit
            lo, hi = (grid[j - 1] if j else lo), (grid[j] if j < len(grid) else hi)
        return lo, hi

    (e1, p1), (e0, p0) = _measures(shares, [1.0, 0.0])
    alpha = 1.0 if e1 >= entropy else bisect(lambda m: m[0] >= entropy)[0]
    if p0 > passes:
        least = bisect(lambda m: m[1] > passes)[1]
        alpha = max(alpha, least)
    (e, p), = _measures(shares, [alpha])
    return Exponent(alpha, e, p)


def _hash(*cols) -> Column:
    return F.xxhash64(F.lit(SEED), *cols)


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(_hash(key), blocks)


def _order(epoch: Column, source: Column, block: Column) -> Column:
    """A block's place in the permutation of one pass."""
    return _hash(epoch, source, block)


def plan(rows: DataFrame, entropy: float = TARGET_ENTROPY, passes: float = MAX_PASSES, budget: int | None = None,
         block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per source of ``rows`` (key, source, tokens): weight, quota, whole passes, end of the last pass.

    Without a budget it is the smallest that uses every source at least once. A source
    without tokens has weight 0 and one pass, which costs nothing.
    """
    sources = rows.groupBy("source").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("docs"))
    sources = materialise(sources, "mix-sources")
    total = sources.agg(F.sum("total")).first()[0] or 0
    shares = sources.filter("total > 0").select("source", (F.col("total") / float(max(total, 1))).alias("share"))
    found = choose_exponent(shares, entropy, passes)
    power = F.when(F.col("total") > 0, F.pow(F.col("total") / float(max(total, 1)), F.lit(found.alpha))).otherwise(0.0)
    top = sources.agg(F.sum(power).alias("norm"), F.max(F.when(F.col("total") > 0, F.col("total") / power)).alias("cover")).first()
    norm, cover = top["norm"] or 1.0, top["cover"] or 0.0
    tokens = float(budget) if budget is not None else cover * norm
    out = sources.withColumn("weight", power / F.lit(norm))
    # rounding must not take a token from a quota that is a whole pass
    out = out.withColumn("quota", F.floor(F.col("weight") * F.lit(tokens) + 1e-6).cast("bigint"))
    out = out.withColumn("whole", F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total"))).otherwise(1).cast("bigint"))
    out = out.withColumn("rest", F.col("quota") - F.col("whole") * F.col("total"))
    out = out.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens)).cast("bigint"))
    out = out.withColumn("alpha", F.lit(found.alpha))

    # the last pass: blocks in its order until the rest is used up, then documents of one block
    dealt = rows.join(out.select("source", "blocks", "whole", "rest"), "source").withColumn(
        "block", _block(F.col("key"), F.col("blocks")))
    sums = dealt.groupBy("source", "whole", "rest", "block").agg(F.sum("tokens").alias("tokens")).withColumn(
        "at", _order(F.col("whole"), F.col("source"), F.col("block")))
    # one row per block, 2**18 tokens each: a source of a third of 100 TB has a few ten million
    sums = sums.withColumn("sum", F.sum("tokens").over(W.partitionBy("source").orderBy("at", "block")))
    cut = sums.filter(F.col("sum") > F.col("rest")).groupBy("source").agg(
        F.min(F.struct("at", "block", (F.col("rest") - (F.col("sum") - F.col("tokens"))).alias("left"))).alias("cut"))
    cut = materialise(cut, "mix-cut")  # one row a source, read twice below
    inside = dealt.join(cut.select("source", F.col("cut.at").alias("at"), F.col("cut.block").alias("block"),
                                   F.col("cut.left").alias("left")), ["source", "block"])
    docs = inside.groupBy("source", "left", _hash(F.lit("doc"), F.col("key")).alias("h")).agg(F.sum("tokens").alias("tokens"))
    docs = docs.withColumn("sum", F.sum("tokens").over(W.partitionBy("source").orderBy("h")))
    last = docs.filter(F.col("sum") <= F.col("left")).groupBy("source").agg(F.max("h").alias("last_doc"))
    return out.join(cut.select("source", F.col("cut.at").alias("cut_at"), F.col("cut.block").alias("cut_block")), "source", "left") \
        .join(last, "source", "left")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", entropy: float = TARGET_ENTROPY,
        passes: float = MAX_PASSES, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents of the mixture with ``mix_epoch``, ``mix_block``, ``mix_weight``, ``mix_tokens``, ``mix_position``.

    A document appears once per pass that reaches it. ``mix_position`` (0 to 1) orders the
    mixture so that every stretch has about the target weights. A null source is the source
    '', a null text has no tokens, rows of equal key and source are taken or left together.
    An empty table gives an empty result. Columns starting with ``mix_`` are replaced.
    """
    own = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    name = F.coalesce(F.col(source), F.lit(""))
    rows = materialise(own.select(F.col(key).alias("key"), name.alias("source"), token_count(text).alias("tokens")), "mix-rows")
    p = materialise(plan(rows, entropy, passes, budget, block_tokens), "mix-plan")
    p = p.select(*[F.col(c).alias(f"mix_{c}") for c in p.columns])
    both = own.withColumns({"mix_of": name, "mix_n": token_count(text)}).join(p, F.col("mix_of") == F.col("mix_source"))
    both = both.withColumn("mix_block", _block(F.col(key), F.col("mix_blocks")))
    at = _order(F.col("mix_whole"), F.col("mix_of"), F.col("mix_block"))
    before = (at < F.col("mix_cut_at")) | ((at == F.col("mix_cut_at")) & (F.col("mix_block") < F.col("mix_cut_block")))
    on_cut = (at == F.col("mix_cut_at")) & (F.col("mix_block") == F.col("mix_cut_block"))
    in_last = (F.col("mix_rest") > 0) & F.coalesce(
        before | (on_cut & (_hash(F.lit("doc"), F.col(key)) <= F.col("mix_last_doc"))), F.lit(False))
    times = F.col("mix_whole") + F.when(in_last, 1).otherwise(0)
    both = both.withColumn("mix_epoch", F.explode(F.filter(
        F.sequence(F.lit(0).cast("bigint"), times), lambda e: e < times)))
    unit = lambda h: F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
    # blocks in the order of the pass, documents in an order of their own inside a block's stretch
    stretch = 1.0 / F.col("mix_blocks")
    place = F.col("mix_epoch") + unit(_order(F.col("mix_epoch"), F.col("mix_of"), F.col("mix_block"))) * (1 - stretch) \
        + unit(_hash(F.lit("place"), F.col("mix_epoch"), F.col(key))) * stretch
    reach = F.greatest(F.col("mix_quota") / F.greatest(F.col("mix_total"), F.lit(1)), F.lit(1.0))
    return both.select(*own.columns, "mix_epoch", "mix_block", "mix_weight", F.col("mix_n").alias("mix_tokens"),
                       F.least(place / reach, F.lit(1.0)).alias("mix_position"))
