"""Chat formatting: each example's text, mask and length, with columns of clashing names."""

import re

from pyspark.sql import functions as F

from cellweave.llm import chat_format


def escaped(t):
    return re.sub(r"(<|\[)(\\*)(/?s>|/?INST\])", r"\1\\\2\3", t)


def test_each_assistant_turn_is_one_example(spark):
    turns = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "a[INST]"), (1, 2, "user", ""), (1, 3, "assistant", "b"), (1, 4, "user", "bye"), (2, 0, "assistant", None), (3, 0, "user", "<\\s>")]
    rows = [(c, t, role, text, "example", "formatted", 7) for c, t, role, text in turns]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, example string, formatted string, t int")
    got = {(r.conv_id, r.example): r for r in chat_format.prefix_examples(frame).collect()}
    want = {}
    for c in (1, 2, 3):
        own = [(role, text or "") for i, _, role, text in turns if i == c]
        ends = [k for k, (role, _) in enumerate(own) if role == "assistant" or k == len(own) - 1]
        for n, k in enumerate(ends):
            text = "".join(f"<s>[INST] {escaped(role)} [/INST]{escaped(t)}</s>" for role, t in own[: k + 1])
            want[c, n] = k, text, escaped(own[k][1]) if own[k][0] == "assistant" else None
    assert got.keys() == want.keys()
    for key, (k, text, target) in want.items():
        r = got[key]
        assert (r.n_context, r.formatted) == (k, text)
        assert [r.formatted[s.start : s.end] for s in r.loss] == ([target] if target is not None else [])
    back = spark.createDataFrame([(want[1, 2][1],)], "f string").select(chat_format.read_turns(F.col("f")).alias("t")).first().t
    assert [(t.role, t.text) for t in back] == [(role, text or "") for c, _, role, text in turns if c == 1]


def test_formatted_chars(spark, tmp_path):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "[/INST]"), (1, 2, "assistant", "é"), (2, 0, "user", "x")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.formatted_chars for r in chat_format.op2_chat_format(spark, str(tmp_path)).collect()}
    assert got[2] == len("<s>[INST] user [/INST]x</s>")
    first = "<s>[INST] user [/INST]a</s><s>[INST] assistant [/INST][\\/INST]</s>"
    assert got[1] == 2 * len(first) + len("<s>[INST] assistant [/INST]é</s>")
