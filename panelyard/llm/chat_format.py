"""Chat formatting of typed content parts, in DataFrame functions only.

A turn is a list of parts. A visitor goes over them in order: text is escaped and appended, an image, audio or
document becomes a numbered placeholder, its reference and the tokens it expands to are recorded. Turns are then
joined under the template ``<|turn|>role<|text|>content<|end|>``. In roles and texts ``\\`` is written ``\\b`` and
``<`` is written ``\\l``, so every ``<`` of the output belongs to the template and both are restored exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: Fields of a part; those that its type has no use for are null.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

PATCH = 28  # pixels of an image's side that make one token
AUDIO_TOKENS = 25  # a second
PAGE_TOKENS = 256  # a page of a document


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A text as a list of one part; null is the empty text."""
    none = lambda kind: F.lit(None).cast(kind)
    fields = [("type", F.lit("text")), ("text", F.coalesce(text, F.lit(""))), ("ref", none("string")), ("width", none("int")), ("height", none("int")), ("seconds", none("double")), ("pages", none("int"))]
    return F.array(F.struct(*[c.alias(name) for name, c in fields]))


def _tokens(part: Column) -> Column:
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(PATCH)) / PATCH)
    return (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(1))
        .cast("long")
    )


def flatten_parts(parts: Column) -> Column:
    """struct(content, attachments): the parts in order; attachments are (number, type, ref, tokens), numbered from 1 in the turn.

    Null lists and null parts add nothing, null texts are empty. Parts of an unknown or null type are attachments of
    one token. Images without a size count as one patch, audio without a length as no token, documents without a
    count as one page.
    """
    seen = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    is_text = lambda p: F.coalesce(p["type"] == "text", F.lit(False))
    others = F.filter(seen, lambda p: ~is_text(p))
    attachments = F.transform(others, lambda p, i: F.struct((i + 1).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    step = lambda acc, p: F.struct(
        F.concat(
            acc["content"],
            F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), F.coalesce(escape(p["type"]), F.lit("unknown")), F.lit(" "), acc["number"].cast("string"), F.lit("|>"))),
        ).alias("content"),
        (acc["number"] + F.when(is_text(p), 0).otherwise(1)).alias("number"),
    )
    content = F.aggregate(seen, F.struct(F.lit("").alias("content"), F.lit(1).alias("number")), step, lambda acc: acc["content"])
    return F.struct(content.alias("content"), attachments.alias("attachments"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_col, formatted, loss_spans (start, end in code points), attachments (with their turn), expanded_tokens.

    Turns are ordered by turn number, nulls first; ties by role and content, so repeated rows are repeated turns.
    A null role is empty. A row with a null conversation id is a conversation of its own: nothing says that
    two such rows belong together, and there is no bound on how many there are. Very long texts are kept whole, other
    columns are not read, an empty table gives an empty result. loss_spans cover the content of
    the turns whose role is in learned. A conversation is one row of the result, so its turns meet in one task; the
    offsets are running sums, and a conversation takes memory in proportion to its own length.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), flatten_parts(F.col(parts_col)).alias("p"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.select("conv", "turn", "role", head.alias("head"), "p.content", "p.attachments")
    own = F.length("head") + F.length("content") + len(END)
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    places = {"n": F.row_number().over(order), "start": F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("content") - len(END)}
    turn = F.struct("n", "turn", "role", "head", "content", "attachments", "start")
    together = rows.filter("conv is not null").withColumns(places).groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    alone = rows.filter("conv is null").withColumns({"n": F.lit(1), "start": F.length("head").cast("long")}).select("conv", F.array(turn).alias("t"))
    spans = F.filter("t", lambda x: x["role"].isin(*learned))
    tokens = lambda x: F.aggregate(x["attachments"], F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"])
    attached = F.flatten(F.transform("t", lambda x: F.transform(x["attachments"], lambda a: F.struct(x["turn"].alias("turn"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return together.unionByName(alone).select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["content"], F.lit(END))), "").alias("formatted"),
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["content"])).alias("end"))).alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda acc, x: acc + tokens(x)).alias("expanded_tokens"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped; placeholders stay in the text."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x, i: i > 0)

    def read(turn: Column) -> Column:
        two = F.split(turn, r"<\|text\|>")
        return F.struct(unescape(two[0]).alias("role"), unescape(F.substr(two[1], F.lit(1), F.length(two[1]) - len(END))).alias("text"))

    return F.transform(turns, read)


def under_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss spans, unescaped, joined without anything between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
