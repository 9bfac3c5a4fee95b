from pyspark.sql import functions as F

from tidemark.llm import q_chat_format
from tidemark.llm.chat_format import expand_examples, format_conversations, read_examples, read_losses, read_turns

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, examples string"


def conversations(spark, rows):
    return format_conversations(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))


def test_texts_come_back_whatever_they_hold(spark):
    texts = ["", "\\", "\\b\\h\\t", "### User: ", "</turn>", "</turn>\n### Assistant: x", "####", "a\\### b", "##", "\n", ": ", "é😀", "\\</turn>", r"\### Assistant: </turn> ok"]
    roles = ["user", "assistant", "system", "tool: x", "", "role=", "###"]
    rows = [(1, k, roles[k % len(roles)], t) for k, t in enumerate(texts * 2)]
    made = conversations(spark, rows)
    turns, losses = made.select(read_turns(F.col("formatted")), read_losses(F.col("formatted"), F.col("examples"))).first()
    assert [(t.role, t.text) for t in turns] == [(r, t) for _, _, r, t in rows]
    assert losses == [t for _, _, r, t in rows if r == "assistant"]


def test_each_reply_is_an_example_with_all_before_it(spark):
    rows = [(1, 2, "assistant", "B"), (1, 0, "user", "A"), (1, 5, "assistant", "D"), (1, 4, "user", "C"), (1, 9, "user", "E"), (2, 0, "user", "only")]
    made = conversations(spark, rows)
    got = [(r.conv_id, r.turn_no, r.context, r.reply) for r in expand_examples(made).orderBy("conv_id", F.col("turn_no").asc_nulls_last()).collect()]
    assert got == [
        (1, 1, "### User: A</turn>\n### Assistant: ", "B"),
        (1, 3, "### User: A</turn>\n### Assistant: B</turn>\n### User: C</turn>\n### Assistant: ", "D"),
        (1, None, "### User: A</turn>\n### Assistant: B</turn>\n### User: C</turn>\n### Assistant: D</turn>\n### User: E</turn>\n", ""),
        (2, None, "### User: only</turn>\n", ""),
    ]


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(None, 0, "user", None), (3, None, "user", "first"), (3, 1, "user", "b"), (3, 1, "assistant", "a"), (3, 1, "user", "b"), (4, 0, None, None)]
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in conversations(spark, rows).select("conv_id", read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {None: [("user", "")], 3: [("user", "first"), ("assistant", "a"), ("user", "b"), ("user", "b")], 4: [("", "")]}
    assert conversations(spark, []).count() == 0


def test_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", "x" * 50) for k in range(600)]
    r = conversations(spark, rows).first()
    assert len(r.examples) == 300 and r.examples[-1].context_chars + r.examples[-1].reply_chars + 8 == len(r.formatted)


def test_query_has_the_probe(spark, data):
    r = q_chat_format.query(spark, data).where("conv_id = -7").first()
    assert (r.n_turns, r.loss_chars) == (2, len(q_chat_format.PROBE))


def test_query_reads_the_expanded_examples(spark, data, monkeypatch):
    """A query that takes its digests from the examples sees what is done to them."""
    expand = q_chat_format.expand_examples
    monkeypatch.setattr(q_chat_format, "expand_examples", lambda made: expand(made).withColumn("reply", F.lit("x")))
    r = q_chat_format.query(spark, data).where("conv_id = -7").first()
    assert (r.n_turns, r.loss_chars) == (2, 1)


def test_examples_tell_all_of_a_conversation(spark):
    rows = [(1, 1, "assistant", "###"), (1, 0, "user", "A"), (1, 2, "user", ""), (1, 3, "assistant", "\\b"), (2, 0, "user", "only"), (2, 1, "tool", "more"), (None, 0, "assistant", None)]
    made = conversations(spark, rows)
    told = {r.conv_id: (r.formatted, r.losses, r.example_chars) for r in read_examples(expand_examples(made)).collect()}
    assert told == {
        r.conv_id: (r.formatted, r.losses, sum(e.context_chars + e.reply_chars for e in r.examples))
        for r in made.withColumn("losses", read_losses(F.col("formatted"), F.col("examples"))).collect()
    }
