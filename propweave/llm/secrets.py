"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Positions come from the texts alone: splitting a text by a pattern gives the gaps between
its matches, so the match starts are sums of gap and match lengths, in code points. All of
it happens inside the row; nothing is shuffled, and the scan needs no document key. The work
grows with the text, whatever the number of matches and the length of a candidate.

The window over a candidate moves by one character: one enters, one leaves, and only their
terms of sum(c * log2 c) change, by how often the two stand in the window.

The allow list has two parts. Patterns that know a whole string for harmless (a UUID, a path,
a number) suppress it. Words that mark an example only speak for themselves: before the
entropy is taken they are blanked by one repeated character, so a window on them is calm and
a secret elsewhere in the string is still found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from propweave.llm.arrays import bound, starts
from propweave.llm.tables import fresh

#: Patterns of the base scan: name, pattern, counted group, least length of it. (Fixed values.)
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so the least length can stand in the pattern
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, narrowest first: name, pattern, alphabet, least entropy in bits of a window. A window of 20
#: random characters has about 3.3 bits from 16 characters, 3.8 from 36 and 4.1 from 64. Letters alone are mostly words,
#: paths and identifiers, whose windows stay below 3.9 (one case) and 4.1 bits (both), where random ones come up to 4.0 and 4.3.
CLASSES = [
    ("hex", "^(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 2.8),
    ("letters", "^(?:[a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", 3.9),
    ("base36", "^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 3.4),
    ("base52", "^[^0-9]*$", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 4.1),
    ("base64", "", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.7),
]
#: Classes in which upper and lower case are one alphabet.
FOLDED = ("hex", "letters", "base36")
#: Strings that look random and are none, told by the whole string. (Fixed values.)
ALLOW = [
    r"^[0-9+/_=-]*$",                                                           # no letter: numbers, dates, rulers
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",   # UUID
    r"^[A-Za-z0-9]+(?:[/_-][A-Za-z]+){2,}$",                                    # paths and slugs
    r"(?i)^(?:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855|da39a3ee5e6b4b0d3255bfef95601890afd80709|d41d8cd98f00b204e9800998ecf8427e)$",  # digests of nothing
]
#: Words of examples; each is blanked where it stands. (Fixed values.)
WORDS = ["placeholder", "changeme", "abcdefgh", "12345678", "00000000", "example", "sample", "qwerty", "xxxxxx", "dummy"]
SPAN = "array<struct<start:int,rank:int,end:int,hit:string>>"


def _spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """(start, end, hit) of the leftmost non-overlapping matches whose group is long enough, in order."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    found = F.zip_with(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("g"), h.alias("h"))), parts, lambda x, p: F.struct(
        F.length(x["g"]).alias("gap"), F.length(x["h"]).alias("size"), x["h"].alias("hit"), (F.length(p) >= least).alias("ok")))
    placed = bound(F.filter(found, lambda x: x["hit"].isNotNull()), lambda f: F.zip_with(
        f, starts(F.transform(f, lambda x: x["gap"] + x["size"])), lambda x, at: F.struct(
            (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["hit"].alias("hit"), x["ok"].alias("ok"))))
    return F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["end"], x["hit"]))


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
                                                 s["hit"].alias("hit")))


def _term(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))


def hot_range(string: Column, alphabet: str, least: float, window: int = WINDOW) -> Column:
    """struct(first, last): from the first window with at least that entropy to the end of the last; null if none."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def folded(codes: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            i = x["i"]
            full = i >= window  # one character leaves
            seen = F.slice(codes, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)) + 1)  # it and the window
            times = lambda c: F.size(F.filter(seen, lambda v: v == c))
            return bound(F.struct(times(x["come"]).alias("up"), F.when(full, times(x["leave"])).otherwise(0).alias("down")), lambda n: bound(
                acc["sum"] + _term(n["up"]) - _term(n["up"] - 1) + F.when(full, _term(n["down"] - 1) - _term(n["down"])).otherwise(0.0),
                lambda total: bound((i >= window - 1) & (F.lit(window) * F.log2(F.lit(float(window))) - total >= least * window), lambda hot: F.struct(
                    total.alias("sum"), F.when(hot & acc["first"].isNull(), i - (window - 1)).otherwise(acc["first"]).alias("first"),
                    F.when(hot, i + 1).otherwise(acc["last"]).alias("last")))))

        left = F.concat(F.array_repeat(F.lit(0), window), codes)
        moves = F.slice(F.zip_with(codes, left, lambda c, v: F.struct(c.alias("come"), v.alias("leave"))), 1, F.size(codes))
        return F.aggregate(F.transform(moves, lambda m, i: F.struct(i.alias("i"), m["come"].alias("come"), m["leave"].alias("leave"))), zero, step,
                           lambda acc: F.when(acc["first"].isNotNull(), F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))

    return bound(F.transform(F.split(string, ""), lambda c: F.instr(F.lit(alphabet), c)), folded)


def _blanked(string: Column, words: list[str]) -> Column:
    """The string with the words blanked, character for character."""
    return reduce(lambda s, w: F.regexp_replace(s, f"(?i){w}", "-" * len(w)), words, string)


def _entropy_spans(candidates: Column, allow: list[str], words: list[str]) -> Column:
    """Hot ranges of the candidates that the allow list does not suppress."""
    def rated(c: Column) -> Column:
        s = c["hit"]
        calm = reduce(lambda a, b: a | b, [s.rlike(p) for p in allow], F.lit(False))

        def ranged(own: Column) -> Column:
            name = lambda cls: s.rlike(cls[1]) if cls[1] else F.lit(True)
            at = lambda cls: hot_range(F.lower(own) if cls[0] in FOLDED else own, cls[2], cls[3])
            return reduce(lambda w, cls: w.when(name(cls), at(cls)), CLASSES, F.when(calm, F.lit(None)))
        return F.struct(c["start"].alias("start"), s.alias("hit"), bound(_blanked(s, words), ranged).alias("range"))
    hot = F.filter(F.transform(candidates, rated), lambda c: c["range"].isNotNull())
    return F.transform(hot, lambda c: F.struct(
        (c["start"] + c["range"]["first"]).alias("start"), F.lit(len(KINDS)).alias("rank"), (c["start"] + c["range"]["last"]).alias("end"),
        F.substr(c["hit"], c["range"]["first"] + 1, c["range"]["last"] - c["range"]["first"]).alias("hit")))


def scan(docs: DataFrame, text: str = "text", allow: list[str] | None = None, words: list[str] | None = None) -> DataFrame:
    """The documents with ``found``: their secrets as array<struct<kind, start, end, secret>>.

    ``start`` and ``end`` (exclusive) count code points from 0, ordered by start, then kind:
    assign, access, hex, entropy. ``allow`` holds patterns of whole strings without entropy
    spans, ``words`` those that are blanked in them. A null text is an empty text and has none.
    Each row is scanned by itself, so repeated rows, null keys and further columns change
    nothing; a column called ``found`` is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    helper = fresh(docs, "base", "strings")
    base = [F.when(body.rlike(p), _ranked(_spans(body, p, g, least), rank)).otherwise(none)
            for rank, (_, p, g, least) in enumerate(KINDS)]
    strings = F.when(body.rlike(CANDIDATE), _spans(body, CANDIDATE, 0, 20)).otherwise(
        F.array().cast("array<struct<start:int,end:int,hit:string>>"))
    rows = docs.withColumns(dict(zip(helper, (F.concat(*base), strings))))
    entropy = F.when(F.size(helper[1]) > 0, _entropy_spans(F.col(helper[1]), ALLOW if allow is None else allow, WORDS if words is None else words)).otherwise(none)
    kinds = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("entropy"))
    rows = rows.withColumn("found", F.array_sort(F.concat(helper[0], entropy)))
    return rows.withColumn("found", F.transform("found", lambda s: F.struct(
        F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("secret")))).drop(*helper)
