"""Chat formatting from typed content parts, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import let

#: Control strings of the default template.
START, END = "<|im_start|>", "<|im_end|>"

#: What texts may not say unescaped: these fixed forms of control strings, placeholders included.
CONTROL = r"<(?=/?s>|<SYS>>|</SYS>>|\|[0-9A-Za-z_.-]+\|>)|\[(?=/?INST\])"

#: Placeholder of each kind of attachment and how many tokens it expands to: a fixed number for
#: each unit of the part's ``units`` (image tiles, audio seconds, document pages).
PLACEHOLDERS = {"image": ("<|image|>", 256), "audio": ("<|audio|>", 25), "document": ("<|document|>", 512)}

PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    r"""Backslashes are doubled; a backslash follows the first character of a control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))).cast(PARTS)


def visit(parts: Column) -> Column:
    """A turn's parts as struct(text, attachments).

    Every known part but text becomes its placeholder and an attachment (type, ref,
    expanded_tokens), in order. Texts between two placeholders are joined before they are escaped,
    so no control string comes of two parts. Null text is empty, null units count as one, and
    parts of other types (or null parts) are left out.
    """
    kind = lambda p: p["type"]
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))

    def shown(s: Column, p: Column) -> Column:
        out = F.when(kind(p) == "text", state(s["done"], F.concat(s["open"], F.coalesce(p["text"], F.lit("")))))
        for name, (mark, _) in PLACEHOLDERS.items():
            out = out.when(kind(p) == name, state(F.concat(s["done"], escape(s["open"]), F.lit(mark)), F.lit("")))
        return out.otherwise(s)

    def expanded(p: Column) -> Column:
        out = None
        for name, (_, each) in PLACEHOLDERS.items():
            value = F.coalesce(p["units"], F.lit(1)) * F.lit(each)
            out = F.when(kind(p) == name, value) if out is None else out.when(kind(p) == name, value)
        return out.cast("long")

    held = F.filter(parts, lambda p: kind(p).isin(*PLACEHOLDERS))
    attachments = F.transform(held, lambda p: F.struct(kind(p).alias("type"), p["ref"].alias("ref"), expanded(p).alias("expanded_tokens")))
    text = F.aggregate(parts, state(F.lit(""), F.lit("")), shown, lambda s: F.concat(s["done"], escape(s["open"])))
    return F.struct(text.alias("text"), attachments.alias("attachments"))


def format_chats(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, parts).

    Columns: conv_id, formatted, loss_spans (0-based byte start and byte length in the UTF-8 of
    formatted, one for each turn of a role in ``learn``), attachments (turn_no, type, ref,
    expanded_tokens), expanded_tokens.

    A turn is START, role, newline, content, END, newline. Roles are URL-encoded and contents
    escaped, so neither can hold a control string, and reading back gives them unchanged.
    Turns are in order of turn, role and content, nulls first; repeated turns repeat. A null
    role is empty; null parts are an empty turn. Conversations with a null id are one.
    """
    seen = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit(F.coalesce("parts", F.array().cast(PARTS))).alias("v"))
    made = seen.select(
        "conv_id",
        F.struct(F.col("turn"), F.col("role"), F.col("v.text").alias("text")).alias("place"),
        F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")).alias("head"),
        F.col("v.text").alias("content"),
        F.col("v.attachments").alias("attachments"),
        F.col("role").isin(*learn).alias("learn"),
    )
    tail = F.lit(END + "\n")
    size = F.octet_length("head") + F.octet_length("content") + F.lit(len(END) + 1)
    order = Window.partitionBy("conv_id").orderBy("place")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = made.withColumn("no", F.row_number().over(order)).withColumn("end", F.sum(size.cast("long")).over(until))
    start = F.col("end") - F.lit(len(END) + 1) - F.octet_length("content")
    span = F.when(F.col("learn"), F.struct(start.alias("start"), F.octet_length("content").cast("long").alias("length")))
    tagged = F.transform("attachments", lambda a: F.struct(F.col("no").alias("turn_no"), a["type"].alias("type"), a["ref"].alias("ref"), a["expanded_tokens"].alias("expanded_tokens")))
    folded = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("no", F.concat("head", "content", tail).alias("text"), span.alias("span"), tagged.alias("attachments")))).alias("t")
    )
    spans = F.transform(F.filter("t", lambda x: x["span"].isNotNull()), lambda x: x["span"])
    attachments = F.flatten(F.transform("t", lambda x: x["attachments"]))
    folded = folded.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"))
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["expanded_tokens"])
    return folded.select("*", total.alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted conversation, in order."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    head = len(START)

    def one(p: Column) -> Column:
        stop = F.locate("\n", p)
        return F.struct(
            F.url_decode(F.substring(p, F.lit(head + 1), stop - F.lit(head + 1))).alias("role"),
            unescape(F.substring(p, stop + 1, F.length(p))).alias("text"),
        )

    return F.transform(pieces, one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask."""
    pair = F.struct(formatted.cast("binary").alias("b"), spans.alias("s"))
    piece = lambda b, s: unescape(F.decode(F.substring(b, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))
    return let(pair, lambda v: F.transform(v["s"], lambda s: piece(v["b"], s)))
