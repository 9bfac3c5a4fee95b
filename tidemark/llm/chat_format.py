"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it are its context and its reply alone
is trainable. The turns of a conversation are written once as ``formatted``; an example is a prefix
of that text, given by two lengths, so a conversation of n turns costs n parts and not n prefixes
until somebody asks for the texts (``expand_examples``).

Template: ``### User: text</turn>\\n`` for each turn. Inside texts ``\\`` becomes ``\\b``, ``###``
becomes ``\\h`` and ``</turn>`` becomes ``\\t``. An escaped text holds neither control string and a
backslash only before one of those letters, so splitting at ``</turn>\\n`` and replacing back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>"
TRAINABLE = "assistant"
#: Roles with a heading of their own; any other is written as ``role=`` and its escaped name.
HEADINGS = {"system": "System", "user": "User", "assistant": "Assistant"}
ESCAPES = (("\\", "\\b"), ("###", "\\h"), (TURN_END, "\\t"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def heading(role: Column) -> Column:
    out = F.concat(F.lit("role="), F.replace(escape(role), F.lit(":"), F.lit("\\c")))
    for name, shown in HEADINGS.items():
        out = F.when(role == name, F.lit(shown)).otherwise(out)
    return out


def role_of(shown: Column) -> Column:
    out = unescape(F.replace(F.substring(shown, 6, 2**31 - 1), F.lit("\\c"), F.lit(":")))
    for name, text in HEADINGS.items():
        out = F.when(shown == text, F.lit(name)).otherwise(out)
    return out


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, text).

    Returns conv_id, formatted (all turns) and examples: for each assistant turn the struct
    (turn_no, context_chars, reply_chars). Example text is the first ``context_chars +
    reply_chars`` code points of formatted; the last ``reply_chars`` of them are under the loss
    mask (the turn's end mark is not). If turns follow the last reply, or there is no reply, a last
    example with turn_no null and no trainable text covers the whole, so that no turn is lost.

    Null role or text: empty. Null conv_id: a conversation of its own. Rows with the same turn are
    ordered by role and text; repeated rows stay. Null turn comes first. An empty table gives no row.
    Other columns are ignored.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"),
            F.col("turn"),
            F.coalesce(F.col("role"), empty).alias("role"),
            F.coalesce(F.col("text"), empty).alias("text"),
        ).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    parts = ordered.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t: F.struct(
                (t["role"] == TRAINABLE).alias("trainable"),
                F.concat(F.lit("### "), heading(t["role"]), F.lit(": ")).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("ps"),
    )
    zero = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.lit(0).alias("no"),
        F.array().cast("array<struct<turn_no:int,context_chars:bigint,reply_chars:bigint>>").alias("found"),
    )

    def step(acc: Column, p: Column) -> Column:
        context = acc["at"] + F.length(p["head"])
        reply = F.length(p["body"]).cast("long")
        span = F.struct(acc["no"].alias("turn_no"), context.alias("context_chars"), reply.alias("reply_chars"))
        return F.struct(
            (context + reply + F.lit(len(TURN_END) + 1)).alias("at"),
            (acc["no"] + 1).alias("no"),
            F.when(p["trainable"], F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"),
        )

    spans = F.aggregate("ps", zero, step)
    tail = F.struct(
        F.lit(None).cast("int").alias("turn_no"), F.col("spans.at").alias("context_chars"), F.lit(0).cast("long").alias("reply_chars")
    )
    return parts.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END + "\n"))), "").alias("formatted"),
        spans.alias("spans"),
        F.element_at("ps", -1)["trainable"].alias("closed"),
    ).select(
        "conv_id",
        "formatted",
        F.when(F.col("closed"), F.col("spans.found")).otherwise(F.array_append(F.col("spans.found"), tail)).alias("examples"),
    )


def expand_examples(conversations: DataFrame) -> DataFrame:
    """The training rows of ``format_conversations``: conv_id, turn_no, context, reply, and ``last`` for
    the example that takes in all turns of its conversation.

    The reply is the text under the loss mask. The texts of one conversation grow with the square
    of its turns, as the method wants it; rows are made one by one.
    """
    rows = conversations.select("conv_id", "formatted", (F.size("examples") - 1).alias("n"), F.posexplode("examples").alias("at", "e"))
    return rows.select(
        "conv_id",
        F.col("e.turn_no").alias("turn_no"),
        F.substring(F.col("formatted"), F.lit(1), F.col("e.context_chars").cast("int")).alias("context"),
        F.substring(F.col("formatted"), (F.col("e.context_chars") + 1).cast("int"), F.col("e.reply_chars").cast("int")).alias("reply"),
        (F.col("at") == F.col("n")).alias("last"),
    )


def read_examples(examples: DataFrame) -> DataFrame:
    """What the training rows of ``expand_examples`` tell, one row per conversation: conv_id, formatted (all
    turns, from the last example), losses (the unescaped texts under the mask, in order) and
    example_chars (the length of all example texts)."""
    reply = F.when(F.col("turn_no").isNotNull(), F.struct("turn_no", unescape(F.col("reply")).alias("text")))
    whole = F.concat("context", "reply", F.when(F.col("turn_no").isNotNull(), F.lit(TURN_END + "\n")).otherwise(""))
    told = examples.select("conv_id", reply.alias("r"), F.when(F.col("last"), whole).alias("whole"), (F.length("context") + F.length("reply")).cast("long").alias("chars"))
    read = told.groupBy("conv_id").agg(F.max("whole").alias("formatted"), F.array_sort(F.collect_list("r")).alias("rs"), F.sum("chars").alias("example_chars"))
    return read.select("conv_id", "formatted", F.col("rs.text").alias("losses"), "example_chars")


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs that a formatted conversation was made from."""
    pieces = F.split(formatted, TURN_END + "\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def back(piece: Column) -> Column:
        colon = F.instr(piece, ": ")
        return F.struct(
            role_of(F.substring(piece, F.lit(5), colon - 5)).alias("role"),
            unescape(F.substring(piece, colon + 2, F.lit(2**31 - 1))).alias("text"),
        )

    return F.transform(pieces, back)


def read_losses(formatted: Column, examples: Column) -> Column:
    """The unescaped text under each example's loss mask, in order."""
    trained = F.filter(examples, lambda e: e["turn_no"].isNotNull())
    return F.transform(
        trained,
        lambda e: unescape(F.substring(formatted, (e["context_chars"] + 1).cast("int"), e["reply_chars"].cast("int"))),
    )
