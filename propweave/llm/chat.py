r"""Chat formatting with typed content parts.

A turn's content is an array of parts: text, image, audio, document. A visitor flattens the
parts in order: text is escaped, anything else becomes a placeholder, with a record of its
reference and of the tokens it will expand to. Turns are then joined by the template

    <|im_start|>role\n content <|im_end|>\n

Escaping: ``ESC`` becomes ``ESC0`` and every control string ``ESC`` plus its letter. ``ESC``
stands in no control string, so each ``ESC`` of an escaped text starts exactly one pair and
replacing the pairs, ``ESC0`` last, gives the text back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from propweave.llm.arrays import bound, starts

PART = "struct<type:string,text:string,ref:string,units:bigint>"
ESC = "␛"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Tokens of one unit: image tiles, seconds of audio, document pages. (Fixed values.)
TOKENS = {"image": 256, "audio": 25, "document": 512}
#: Control strings that may not stand in a text. (Fixed values of common chat templates.)
CONTROLS = [OPEN, CLOSE, "<|image|>", "<|audio|>", "<|document|>", "<|unknown|>", "<|endoftext|>", "<s>", "</s>",
            "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
PAIRS = [(c, ESC + chr(ord("a") + i)) for i, c in enumerate(CONTROLS)]


def escape(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), PAIRS, F.replace(text, F.lit(ESC), F.lit(ESC + "0")))


def unescape(text: Column) -> Column:
    return F.replace(reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), PAIRS, text), F.lit(ESC + "0"), F.lit(ESC))


def _role(role: Column) -> Column:
    """A role ends at a newline, so its own newlines are written as a pair too."""
    return F.replace(escape(role), F.lit("\n"), F.lit(ESC + "1"))


def text_parts(text: Column) -> Column:
    """A plain text as an array of one part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            none.cast("string").alias("ref"), none.cast("bigint").alias("units")))


def visit(parts: Column) -> dict[str, Column]:
    """Flattened content, attachments and expanded token count of an array of parts.

    An attachment's ``at`` is its index among the parts. Text tokens are its words. A null
    array or part gives nothing; an unknown type becomes an ``unknown`` placeholder of no
    tokens, with its reference recorded.
    """
    kept = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    kind = lambda p: F.when(p["type"].isin("text", *TOKENS), p["type"]).otherwise("unknown")
    rate = lambda p: reduce(lambda c, t: c.when(p["type"] == t[0], F.lit(t[1])), list(TOKENS.items())[1:],
                            F.when(p["type"] == "image", F.lit(TOKENS["image"])))
    one = lambda p: F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), kind(p), F.lit("|>")))
    words = lambda p: F.regexp_count(F.coalesce(p["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    tokens = lambda p: F.when(p["type"] == "text", words(p).cast("bigint")).otherwise(
        F.coalesce(rate(p) * F.coalesce(p["units"], F.lit(1)), F.lit(0)).cast("bigint"))
    placed = F.transform(kept, lambda p, i: F.struct(
        i.alias("at"), kind(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    return {
        "content": F.array_join(F.transform(kept, one), ""),
        "attachments": F.filter(placed, lambda a: a["type"] != "text"),
        "tokens": F.aggregate(placed, F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]),
    }


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                learn: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, loss spans, attachments, expanded tokens.

    ``loss`` lists (start, end) in code points of the formatted text, and where that begins and how
    long it is in bytes of UTF-8: the contents of the ``learn`` role. Turns are ordered by number (null first), equal numbers by role and
    content; a null role is the empty role. A conversation is one output string, so its turns
    meet in one row; conversations are spread over the tasks. An empty table gives no row.
    """
    seen = visit(F.col(parts))
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        seen["content"].alias("content"), seen["attachments"].alias("attachments"), seen["tokens"].alias("tokens"))
    rows = rows.select("conv_id", F.struct("turn", "role", "content", "attachments", "tokens").alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), _role(t["role"]), F.lit("\n"))
    tail = CLOSE + "\n"
    # positions are running sums of the sizes, in code points and in bytes; texts are joined once
    sized = convs.withColumn("sizes", F.transform("turns", lambda t: bound(head(t), lambda h: F.struct(
        F.length(h).alias("head"), F.length(t["content"]).alias("body"), F.octet_length(h).alias("head_bytes"),
        F.octet_length(t["content"]).alias("body_bytes"), (t["role"] == learn).alias("learn")))))
    at = starts(F.transform("sizes", lambda s: s["head"] + s["body"] + len(tail)))
    at_byte = starts(F.transform("sizes", lambda s: s["head_bytes"] + s["body_bytes"] + len(tail)))
    placed = F.zip_with(F.zip_with("sizes", at, lambda s, a: F.struct(s.alias("s"), a.alias("a"))), at_byte, lambda x, b: F.struct(
        (x["a"] + x["s"]["head"]).alias("start"), (x["a"] + x["s"]["head"] + x["s"]["body"]).alias("end"),
        (b + x["s"]["head_bytes"]).alias("byte"), x["s"]["body_bytes"].alias("bytes"), x["s"]["learn"].alias("learn")))
    spans = F.transform(F.filter(placed, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["end"], s["byte"], s["bytes"]))
    return sized.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["content"], F.lit(tail))), "").alias("formatted"),
        spans.alias("loss"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(
            i.alias("turn"), a["at"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"),
            a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + t["tokens"]).alias("expanded_tokens"))


def parse_chat(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text), read from the formatted text alone, and ``loss_text``, read from it by the spans."""
    pieces = F.slice(F.split("formatted", r"\Q" + OPEN + r"\E", -1), 2, 1 << 30)
    # bytes are found without counting the characters before them
    loss = bound(F.encode("formatted", "UTF-8"), lambda raw: F.array_join(F.transform("loss", lambda s: unescape(
        F.decode(F.substring(raw, s["byte"] + 1, s["bytes"]), "UTF-8"))), ""))
    return formatted.withColumn("turns", F.transform(pieces, _turn)).withColumn("loss_text", loss)


def _turn(piece: Column) -> Column:
    role = F.substring_index(piece, "\n", 1)
    body = F.length(piece) - F.length(role) - 1 - len(CLOSE) - 1
    return F.struct(unescape(F.replace(role, F.lit(ESC + "1"), F.lit("\n"))).alias("role"),
                    unescape(F.substr(piece, F.length(role) + 2, body)).alias("text"))
