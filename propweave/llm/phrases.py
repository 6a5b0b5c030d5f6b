r"""Phrase collocations by best-first branch-and-bound growth.

Texts are cut at punctuation and line ends into pieces and these at blanks into words. A
phrase of 2 to 4 words inside a piece is scored by the worst of its cuts in two: occurrences
of the phrase against those of its two parts. Phrases grow from their prefixes. A longer
phrase starts as often as its prefix p at most, its first word stands there, and its rest
stands at least as often as itself, so no extension of p scores above a / (f(first word) + a)
with a = f(p): the bound. The counts of words and of word pairs are taken first. Then the
frontier is opened best first: a floor score is set for each language, all prefixes whose
bound reaches it are grown, and all phrases of at least the floor are scored and held against
the longer phrases that may displace them. When at least as many survive as are asked for,
the language is settled, ties at the floor included; otherwise its floor is lowered and it
goes another round. A floor of zero opens everything, so the search always ends.

Counts are exact. Words travel as 64-bit hashes of language and word; the table of words
shows whether two share a hash, and then all starts again with another seed. The tasks learn
which prefixes to grow from a bit table of fixed size: a bit that is set by chance costs a
count that is thrown away, never a wrong one, since the count of a phrase is taken whole or
not at all. Every count is a partial sum in the task first, so no language, however large,
meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from propweave.llm.bytetext import Words, mix, pieces
from propweave.llm.tallies import NamedCounts, Partial, bit_table
from propweave.sources.scratch import materialise

#: Most words of a phrase (the growth below is written out for it), factor of scores, share at which a longer phrase displaces.
WORDS, SCALE, SHARE = 4, 2_000_000, (100, 80)
#: log2 of the bits of the table of prefixes; phrases of two words aimed at in the first round, as a multiple of those asked for.
BITS, AIM, MORE = 27, 2, 4
#: Words of more bytes are hashed one by one; under another seed than 0 all are.
SHORT = 64

BREAK = np.zeros(256, dtype=bool)
BREAK[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
BETWEEN = BREAK.copy()
BETWEEN[[9, 32]] = True


class Text:
    """Words of a run of texts: hashes of language and word, and whether each word and the next stand in one piece."""

    def __init__(self, data: np.ndarray, text_at: np.ndarray, langs: pa.Array, seed: int):
        self.words = w = Words(data, text_at, BETWEEN)
        self.langs = langs.dictionary.to_pylist()
        salt = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in self.langs], np.uint64)
        text = np.repeat(np.arange(len(w)), w.counts())
        self.lang = langs.indices.to_numpy()[text]
        h = w.hashes()
        for i in np.flatnonzero(w.end - w.start > (0 if seed else SHORT)):
            h[i] = xxhash.xxh3_64_intdigest(w.data[w.start[i] : w.end[i]].tobytes(), seed)
        with np.errstate(over="ignore"):
            self.hash = mix(mix(h + np.uint64(seed)) + salt[self.lang]) if len(h) else h
        breaks = np.concatenate([[0], np.cumsum(BREAK[data], dtype=np.int64)])
        at = breaks[w.start]
        self.joined = (text[1:] == text[:-1]) & (at[1:] == at[:-1])

    def grams(self, size: int) -> list[np.ndarray]:
        """Hashes of the words of all runs of ``size`` words inside pieces, one array for each place."""
        n = max(len(self.hash) - size + 1, 0)
        inside = np.ones(n, bool)
        for k in range(size - 1):
            inside &= self.joined[k : k + n]
        return [self.hash[k : k + n][inside] for k in range(size)]


def texts_of(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Text]:
    for b in batches:
        for rows, data, at in pieces(b):
            yield Text(data, at, rows.column("lang").cast(pa.string()).fill_null("und").dictionary_encode(), seed)


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """(w1, lang, word, n) of all words, and whether tasks know several words by one hash."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = NamedCounts()

        def rows(found):
            for keys, n, word, lang in found:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), lang, word, pa.array(n)], names=["w1", "lang", "word", "n"])

        for t in texts_of(batches, seed):
            langs = pa.array(t.langs, pa.string())
            yield from rows(counts.add(t.hash, t.words.start, t.words.end, t.words.data, lambda at: langs.take(pa.array(t.lang[at]))))
        yield from rows(counts.take())

    return texts.mapInArrow(apply, "w1 bigint, lang string, word string, n bigint").groupBy("w1").agg(
        F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("n").alias("n"),
        ((F.min("lang") != F.max("lang")) | (F.min("word") != F.max("word"))).alias("clash"))


def names(size: int, first: int = 1) -> list[str]:
    return [f"w{k}" for k in range(first, first + size)]


def count_phrases(texts: DataFrame, seed: int, size: int, least: int, wanted) -> DataFrame:
    """(w1, .., a) of the phrases of ``size`` words that ``wanted`` lets through and that stand at least ``least`` times.

    ``wanted`` takes one array of hashes for each place and says which occurrences count; it
    must say the same of all occurrences of a phrase.
    """
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial = Partial(size)

        def rows(found):
            for columns, n in found:
                for i in range(0, len(n), 1 << 17):
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[i : i + (1 << 17)].view(np.int64)) for c in columns),
                                                      pa.array(n[i : i + (1 << 17)])], names=[*names(size), "n"])

        for t in texts_of(batches, seed):
            columns = t.grams(size)
            keep = wanted(*columns)
            yield from rows(partial.add([c[keep] for c in columns]))
        yield from rows(partial.take())

    schema = ", ".join(f"{n} bigint" for n in [*names(size), "n"])
    return texts.mapInArrow(apply, schema).groupBy(*names(size)).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def _ratio(a: Column | str, parts: Column) -> Column:
    """floor(SCALE * a / parts) in exact arithmetic; products may pass 64 bits."""
    a = F.col(a) if isinstance(a, str) else a
    whole = a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(8,0)")
    return F.call_function("div", whole, parts.cast("decimal(20,0)"))


def _with_scores(phrases: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """Adds l, r and score of the cut of the least score, the first of equal ones, and the bound; ``cuts`` name the parts' counts."""
    made = [F.struct(_ratio("a", F.col(left) + F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
            for k, (left, right) in enumerate(cuts)]
    return phrases.withColumn("cut", F.least(*made) if len(made) > 1 else made[0]).withColumns({
        "l": F.col("cut.l"), "r": F.col("cut.r"), "score": F.col("cut.score"), "bound": _ratio("a", F.col("f1") + F.col("a"))}).drop("cut")


def _lookup(phrases: DataFrame, table: DataFrame, size: int, count: str, at: int, name: str) -> DataFrame:
    """Joins the count of the words ``at`` to ``at + size - 1`` under ``name``; phrases whose part is not there go."""
    part = table.select(*(F.col(f"w{k + 1}").alias(f"w{at + k}") for k in range(size)), F.col(count).alias(name))
    return phrases.join(part, names(size, at))


def _floors(scores: DataFrame, wanted: int) -> DataFrame:
    """(lang, floor): the least score of the band at which a language has ``wanted`` phrases from the top; 0 where it never has."""
    band = F.floor(F.log2(F.col("score") + 1) * 16).cast("int")
    bands = scores.groupBy("lang", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("band")))  # a few hundred bands
    return bands.withColumn("above", above).groupBy("lang").agg(
        F.coalesce(F.max(F.when(F.col("above") >= wanted, F.col("low"))), F.lit(0)).alias("floor"))


def _displaced(phrases: DataFrame, longer: DataFrame, size: int) -> DataFrame:
    """Without the phrases that stand in a phrase longer by one word about as often as at all.

    Two words more need no look: the phrase between stands at least as often as the longest.
    """
    inside = [F.struct(*(F.col(f"w{at + k}").alias(f"w{k + 1}") for k in range(size))) for at in (1, 2)]
    most = longer.select("a", F.explode(F.array(*inside)).alias("p")).groupBy("p").agg(F.max("a").alias("longer"))
    of = most.select(*(F.col(f"p.w{k}").alias(f"w{k}") for k in range(1, size + 1)), "longer")
    wide = "decimal(24,0)"
    drop = F.col("longer").cast(wide) * SHARE[0] >= F.col("a").cast(wide) * SHARE[1]
    return phrases.join(of, names(size), "left").filter(~F.coalesce(drop, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, bits: int = BITS,
                 aim: int = AIM) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language, best first.

    Score, then ``a`` descending, then the phrase ascending in byte order. ``a`` is how often
    the phrase stands, ``l`` and ``r`` how often the parts of its worst cut do, ``n`` how many
    words the language has. Phrases of fewer than ``least`` occurrences, and those of which a
    longer one has 80 % of the occurrences, do not count. A null language is ``und``, a null
    text the empty one; repeated rows count each; an empty table, or none frequent enough,
    gives no rows. Other columns do not matter, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))
    for seed in range(8):
        seen: dict = {}
        every = materialise(count_words(texts, seed), "phrase-words", also={"clash": F.count(F.when(F.col("clash"), 1))}, seen=seen)
        if not seen["clash"]:
            break
    else:
        raise RuntimeError("words share hashes under every seed")
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    words = every.filter(F.col("n") >= least).select("w1", "lang", "word", F.col("n").alias("f"))
    shared = []

    def told(phrases: DataFrame, columns: list[str]):
        shared.append(spark.sparkContext.broadcast(bit_table(phrases, columns, bits)))
        return shared[-1]

    frequent = told(words, ["w1"])
    pairs = count_phrases(texts, seed, 2, least, lambda a, b: frequent.value(a) & frequent.value(b))
    pairs = _lookup(pairs, words.select("w1", "f"), 1, "f", 2, "f2").join(words.select("w1", "lang", F.col("f").alias("f1")), "w1")
    pairs = materialise(_with_scores(pairs, [("f1", "f2")]), "phrase-pairs")
    shared.pop().destroy()

    done, open_langs, wanted = [], None, aim * top
    while True:
        own = pairs if open_langs is None else pairs.join(open_langs, "lang", "left_semi")
        floors = materialise(_floors(own, wanted), "phrase-floors")
        if not floors.take(1):
            break
        settled, rest = _round(texts, seed, least, top, words, pairs, floors, told)
        done.append(settled)
        while shared:
            shared.pop().destroy()
        if not rest.take(1):
            break
        open_langs, wanted = rest, wanted * MORE
    if not done:
        return spark.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return _ranked(found, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _round(texts: DataFrame, seed: int, least: int, top: int, words: DataFrame, pairs: DataFrame, floors: DataFrame, told):
    """(surviving phrases of the languages settled at these floors, the other languages)."""
    own = texts.join(floors.select("lang"), "lang", "left_semi")
    best = lambda phrases, score: phrases.join(floors, "lang").filter(F.col(score) >= F.col("floor")).drop("floor")
    one, keys = words.select("w1", "f"), names(2)
    two = pairs.select(*keys, "a")
    grown, good = told(best(pairs, "bound"), keys), told(best(pairs, "score"), keys)
    threes = count_phrases(own, seed, 3, least, lambda a, b, c: grown.value(a, b) | good.value(b, c))
    threes = _lookup(_lookup(threes, one, 1, "f", 3, "f3"), two, 2, "a", 2, "f23")
    threes = _lookup(threes, two, 2, "a", 1, "f12").join(words.select("w1", "lang", F.col("f").alias("f1")), "w1")
    threes = materialise(_with_scores(threes, [("f1", "f23"), ("f12", "f3")]), "phrase-threes")

    open3, good3 = best(threes, "bound"), best(threes, "score")
    grown3, good3_bits, middle = told(open3, names(3)), told(good3, names(3)), told(open3, ["w2", "w3"])
    fours = materialise(count_phrases(own, seed, 4, least, lambda a, b, c, d: grown3.value(a, b, c) | good3_bits.value(b, c, d)), "phrase-fours")
    # the last three words of a phrase that grew: their own prefix may never have been opened
    ends = count_phrases(own, seed, 3, least, lambda a, b, c: middle.value(a, b))
    scored = _lookup(_lookup(fours, open3, 3, "a", 1, "f123"), ends, 3, "a", 2, "f234")
    scored = _lookup(_lookup(scored, two, 2, "a", 1, "f12"), two, 2, "a", 3, "f34")
    scored = _lookup(scored, one, 1, "f", 4, "f4").join(words.select("w1", "lang", F.col("f").alias("f1")), "w1")
    scored = _with_scores(scored, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")])

    kept = [_displaced(best(pairs, "score"), threes, 2), _displaced(good3, fours, 3), best(scored, "score")]
    out = None
    for size, found in zip((2, 3, 4), kept):
        for k in range(1, size + 1):
            found = found.join(words.select(F.col("w1").alias(f"w{k}"), F.col("word").alias(f"text{k}")), f"w{k}")
        found = found.select("lang", F.concat_ws(" ", *(f"text{k}" for k in range(1, size + 1))).alias("phrase"), "a", "l", "r", "score")
        out = found if out is None else out.unionByName(found)
    out = materialise(out, "phrase-kept")
    count = out.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    state = floors.join(count, "lang", "left")
    settled = (F.coalesce("kept", F.lit(0)) >= top) | (F.col("floor") == 0)
    rest = materialise(state.filter(~settled).select("lang"), "phrase-open")
    return out.join(state.filter(settled).select("lang"), "lang", "left_semi"), rest


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language: of each part of it first, since ties at the floor may be many."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    few = found.withColumn("rank", first).filter(F.col("rank") <= top)
    return few.withColumn("rank", rank).filter(F.col("rank") <= top)
