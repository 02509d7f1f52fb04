"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them into text
with ordered placeholders, and records each attachment and the tokens its placeholder expands to. Texts
are escaped so that no control string of the template can come from a text; reading back undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The template: <s>[role]body</s> for each turn, <image>, <audio> and <document> for attachments. Every
# control string begins with < or [, and no escaped text has either.
OPEN, CLOSE = "<s>", "</s>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))

PART = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
ATTACHMENT = "struct<turn:bigint,number:bigint,kind:string,ref:string,n_tokens:bigint>"

# Tokens of an attachment: one for each patch of an image and each step of a sound, so many for a page.
PATCH = 14
STEPS_A_SECOND = 25
PAGE_TOKENS = 1024


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A content of one text part; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))).cast(
        "array<struct<type:string,text:string>>"
    )


def full_parts(content: Column) -> Column:
    """Text-only parts as parts of every type."""
    none = {"ref": "string", "width": "bigint", "height": "bigint", "seconds": "double", "pages": "bigint"}
    return F.transform(
        content,
        lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in none.items()]),
    )


def part_body(part: Column) -> Column:
    """What stands in the turn for a part: escaped text, or a placeholder by its type."""
    kinds = ("image", "audio", "document")
    placeholder = F.concat(F.lit("<"), part["type"], F.lit(">"))
    return F.when(part["type"].isin(*kinds), placeholder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def part_tokens(part: Column) -> Column:
    """Tokens an attachment's placeholder expands to; unknown sizes count as one patch, step or page."""

    def steps(value: Column, size: float) -> Column:
        return F.greatest(F.ceil(F.coalesce(value.cast("double"), F.lit(0.0)) / size), F.lit(1))

    return (
        F.when(part["type"] == "image", steps(part["width"], PATCH) * steps(part["height"], PATCH))
        .when(part["type"] == "audio", steps(part["seconds"], 1 / STEPS_A_SECOND))
        .when(part["type"] == "document", steps(part["pages"], 1) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content") -> DataFrame:
    """(conv, formatted, attachments, expanded_tokens): one row per conversation.

    `content` is an array of parts (see PART); a part of an unknown type counts as text. Null roles,
    contents and texts count as empty, and a null conversation is one of its own. Turns are in the order
    of their numbers, nulls first; equal numbers go by role and then body, and repeated rows are repeated
    turns. Attachments are numbered within the conversation in the order of their placeholders. An empty
    table gives no rows; other columns are left out.

    Turns are flattened before the shuffle; a conversation, being one text, ends in one row.
    """
    content = F.coalesce(F.col(content_col), F.array().cast(f"array<{PART}>"))
    media = F.filter(content, lambda p: p["type"].isin("image", "audio", "document"))
    flat = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.array_join(F.transform(content, part_body), "").alias("body"),
            F.transform(media, lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("n_tokens"))).alias("media"),
        ).alias("t"),
    )
    ordered = flat.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turn_text = lambda t: F.concat(F.lit(OPEN + "["), escape(t["role"]), F.lit("]"), t["body"], F.lit(CLOSE))
    loose = F.flatten(F.transform(F.col("turns"), lambda t: F.transform(t["media"], lambda m: F.struct(t["turn"].alias("turn"), m.alias("m")))))
    attachments = F.transform(
        loose,
        lambda x, i: F.struct(
            x["turn"].alias("turn"), (i + 1).cast("long").alias("number"), x["m"]["kind"].alias("kind"), x["m"]["ref"].alias("ref"), x["m"]["n_tokens"].alias("n_tokens")
        ),
    )
    return ordered.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("turns", turn_text), "").alias("formatted"),
        attachments.cast(f"array<{ATTACHMENT}>").alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text, body_start, body_end>> of a formatted conversation; places in code points of it.

    Placeholders stay in the text as they are written.
    """
    pieces = F.filter(F.split(formatted, OPEN, -1), lambda p: p != "")  # before the first turn there is nothing
    split = F.transform(
        pieces,
        lambda p: F.struct(
            F.substring_index(F.substring(p, 2, 1 << 30), "]", 1).alias("role"),
            F.char_length(p).alias("n"),
            p.alias("p"),
        ),
    )
    opened = F.lit(len(OPEN) + 2)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<role:string,text:string,body_start:bigint,body_end:bigint>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + opened + F.char_length(t["role"])
        size = t["n"] - 2 - F.char_length(t["role"]) - len(CLOSE)
        body = F.substring(t["p"], F.char_length(t["role"]) + 3, size)
        turn = F.struct(unescape(t["role"]).alias("role"), unescape(body).alias("text"), begin.alias("body_start"), (begin + size).alias("body_end"))
        return F.struct((acc["at"] + len(OPEN) + t["n"]).alias("at"), F.concat(acc["out"], F.array(turn)).alias("out"))

    return F.aggregate(split, start, step, lambda acc: acc["out"])


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """array<struct<start, end>>: where the loss counts in the formatted text, the bodies of that role's turns."""
    return F.transform(
        F.filter(turns, lambda t: t["role"] == role), lambda t: F.struct(t["body_start"].alias("start"), t["body_end"].alias("end"))
    )


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped text under each span."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
