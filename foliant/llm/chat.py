"""Chat formatting: turns of typed content parts as one marked-up text.

A visitor over the parts of each turn flattens text, image, audio and document
parts into text and ordered placeholders; attachments are recorded with their
reference, place and expanded token count. Everything is DataFrame functions.

Template of a turn: ``<|im_start|>`` role newline content ``<|im_end|>`` newline.
Inside a content every ``<``, any number of backslashes and ``|`` get one
backslash more, so that no control string occurs in it and the escape can be
taken back. Text parts that follow each other are joined before they are escaped,
so it does not matter where a text is cut into parts; placeholders and marks start
with ``<|`` and end with ``>``, and can be no part of such a run. Percent sign, newline
and ``<`` in a role are percent-encoded.

Defined cases: null text or null parts count as empty, a null role as an empty
role, an unknown part type as an empty text; turns order by (turn, role,
content), nulls first, so ties and repeated rows have one order; a null
conversation id is a conversation of its own; an empty table gives no rows.
Input columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: A part: text for "text"; ref and the measures for the others.
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,duration_ms:bigint,pages:int>>"
#: Pixels on each side of an image patch, milliseconds of an audio frame, tokens of a document page.
PATCH, FRAME_MS, PAGE_TOKENS = 28, 40, 256


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(_text(text))


def text_parts(text: Column, cut: str) -> Column:
    """A text as parts, cut where a pattern matches (which should match no characters)."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), cut), _text)


def _text(text: Column) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(F.lit("text").alias("type"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("bigint").alias("duration_ms"), none("int").alias("pages"))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 0 for text, 1 at least otherwise."""
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / PATCH)
    count = (
        F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["duration_ms"], F.lit(0)) / FRAME_MS))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("bigint") * PAGE_TOKENS)
    )
    return F.when(part["type"].isin("image", "audio", "document"), F.greatest(count.cast("bigint"), F.lit(1).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def visit(parts: Column) -> Column:
    """Parts in their order as one content: runs of text parts escaped, placeholders between them."""
    media = lambda p: p["type"].isin("image", "audio", "document")

    def step(state: Column, p: Column) -> Column:
        shown = F.concat(state["done"], escape(state["text"]), F.lit("<|"), p["type"], F.lit("|>"))
        return F.struct(
            F.when(media(p), shown).otherwise(state["done"]).alias("done"),
            F.when(media(p), F.lit("")).otherwise(F.concat(state["text"], F.coalesce(p["text"], F.lit("")))).alias("text"),
        )

    # null parts, and parts whose type is null, count as empty texts
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"))
    whole = F.transform(parts, lambda p: F.struct(F.coalesce(p["type"], F.lit("text")).alias("type"), p["text"].alias("text")))
    return F.aggregate(whole, start, step, lambda state: F.concat(state["done"], escape(state["text"])))


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``loss_mask`` (array of
    struct turn, offset, start, length in code points: offset counts from the
    turn's mark, start from the beginning of ``formatted``), ``attachments``
    (array of struct turn, part, type, ref, n_tokens) and ``n_turns``."""
    rows = df.select(
        F.col(conv).alias("__conv"),
        F.col(turn).alias("__turn"),
        F.coalesce(F.col(role), F.lit("")).alias("__role"),
        F.coalesce(F.col(parts), F.array().cast(PARTS)).alias("__parts"),
    ).withColumn("__content", visit(F.col("__parts")))
    files = F.filter(
        F.transform("__parts", lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("n_tokens"))),
        lambda a: a["n_tokens"] > 0,
    )
    rows = rows.withColumn("__head", F.concat(F.lit(START), escape_role(F.col("__role")), F.lit("\n"))).withColumn("__files", files)
    rows = rows.withColumn("__text", F.concat("__head", "__content", F.lit(END + "\n"))).drop("__parts")
    order = ["__turn", "__role", "__content"]
    w = Window.partitionBy("__conv").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    rows = rows.withColumn("__no", F.row_number().over(w) - 1)
    rows = rows.withColumn("__at", F.sum(F.length("__text").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("__text"))
    one = F.struct("__no", "__at", "__role", "__text", "__head", "__content", "__files")
    whole = rows.groupBy("__conv").agg(F.sort_array(F.collect_list(one)).alias("__t"))
    lost = F.filter("__t", lambda t: t["__role"] == loss_role)
    return whole.select(
        F.col("__conv").alias(conv),
        F.array_join(F.transform("__t", lambda t: t["__text"]), "").alias("formatted"),
        F.transform(lost, lambda t: F.struct(t["__no"].alias("turn"), F.length(t["__head"]).alias("offset"), (t["__at"] + F.length(t["__head"])).alias("start"), F.length(t["__content"]).alias("length"))).alias("loss_mask"),
        F.flatten(F.transform("__t", lambda t: F.transform(t["__files"], lambda a: F.struct(t["__no"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens"))))).alias("attachments"),
        F.size("__t").cast("bigint").alias("n_turns"),
    )


def split_turns(formatted: Column) -> Column:
    """The turns of a formatted text, each with its mark, in order."""
    return F.transform(F.filter(F.split(formatted, r"<\|im_start\|>"), lambda t: t != ""), lambda t: F.concat(F.lit(START), t))


def parse_turns(formatted: Column) -> Column:
    """Array of struct role, text as they were before formatting."""

    def one(t: Column) -> Column:
        break_at = F.instr(t, "\n")
        role = F.substr(t, F.lit(len(START) + 1), break_at - 1 - len(START))
        content = F.substr(t, break_at + 1, F.length(t) - break_at - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(content).alias("text"))

    return F.transform(split_turns(formatted), one)


def masked_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text under a loss mask, span after span."""
    turns = split_turns(formatted)
    spans = F.transform(mask, lambda m: unescape(F.substr(F.element_at(turns, m["turn"] + 1), m["offset"] + 1, m["length"])))
    return F.array_join(spans, "")
