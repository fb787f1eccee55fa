"""Rows that an operator once left out: conversations without an id, patterns beyond a number."""

from pyspark.sql import functions as F

from quern.llm import chat, toxicity


def test_turns_without_a_conversation_are_one(spark):
    rows = [(None, 2, "assistant", "b"), (None, 1, "user", "a"), (5, 1, "user", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.formatted(chat.reply_chain(df)).select("tree.conv_id", "n_turns", chat.read_back(F.col("formatted")).alias("turns")).collect()
    got = {r["conv_id"]: (r["n_turns"], [(t["role"], t["text"]) for t in r["turns"]]) for r in out}
    assert got == {None: (3, [("", ""), ("user", "a"), ("assistant", "b")]), 5: (1, [("user", "x")])}


def test_cover_takes_all_patterns_that_are_worth_it():
    """Three thousand patterns, each in toxic rows of its own: none is dropped by its number."""
    names = [f"w{i:04d}x " for i in range(3000)]
    rows = [[k] for k in range(3000) for _ in range(2)]
    n_pos = 133  # the share is of this, so that two rows are enough
    assert len(toxicity._cover(names, [0.0] * 3000, rows, n_pos)) == 3000
