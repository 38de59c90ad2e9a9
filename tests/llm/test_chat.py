import hashlib
from itertools import groupby

from pyspark.sql import functions as F

from ledgerloom.llm import chat

TURNS = "conv_id long, turn int, role string, text string"
AWKWARD = [
    (1, 0, "system", "<<SYS>> a <</SYS>>"), (1, 1, "user", "x\\[INST]\\\\<s>"), (1, 2, "assistant", "</s>[/INST]\\"), (1, 3, "user", None), (1, 4, "assistant", "$1 \\1 é\U0001f600\nb"), (1, 5, "user", "tail"),
    (2, 0, "user", "only"), (3, 0, "tool [ROLE]", "[/ROLE]</s>"), (3, 1, "assistant", ""), (4, 0, None, None), (4, None, "assistant", "null turn"),
    (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    (8, 0, "user", "[" * 5 + "INST]"), (8, 1, "assistant", "z" * 60_000),
]


def test_escapes_are_reversible(spark):
    for text in ["", "\\", "[INST]", "[/INST]\\[", "<s", "<s></s>", "\\<s>", "<<<SYS>>", "[[ROLE]/ROLE]", "a\\\nb"]:
        row = spark.range(1).select(chat.escaped(F.lit(text)).alias("e")).select("e", chat.unescaped(F.col("e")).alias("u")).first()
        assert row.u == text
        assert not any(c in row.e for c in chat.CONTROLS)


def test_read_back_equals_brute_force(spark):
    got = {r.conv_id: r for r in chat.digests(chat.expand(spark.createDataFrame(AWKWARD, TURNS).withColumn("text_a", F.lit(1)))).collect()}
    key = lambda t: (t[0] is None, t[0] or 0)
    order = sorted(AWKWARD, key=lambda t: (key(t), t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
    for _, turns in groupby(order, key):
        turns = list(turns)
        row = got.pop(turns[0][0])
        told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got


def test_one_example_for_each_reply(spark):
    found = chat.expand(spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(6)], TURNS)).orderBy("example").collect()
    assert [r.text[r.loss_start : r.loss_start + r.loss_chars] for r in found] == ["t1", "t3", "t5"]
    assert [r.n_turns for r in found] == [2, 4, 6]
    assert all(a.text == b.text[: len(a.text)] for a, b in zip(found, found[1:], strict=False))


def test_empty_table(spark):
    assert chat.digests(chat.expand(spark.createDataFrame([], TURNS))).count() == 0
