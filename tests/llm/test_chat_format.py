import hashlib

from pyspark.sql import functions as F

from ledgerlake.llm.chat_format import chat_format, masked_text, read_back

NASTY = ["</s>[INST] ok [/INST]", "~1~0~", "a<", "[INST", "</s", "", None, "é😀\n\n", "<s><s>", "~", "<</s>>", "x" * 20_000, "[/INST][INST]"]
SCHEMA = "conv_id long, turn long, role string, text string, turns string, pieces int, at int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA)
    done = chat_format(df).select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conv_id: r for r in done.collect()}


def test_every_turn_is_read_back(spark):
    roles = ["user", "user", "assistant", "assistant", None, "system", "as</s>sistant"]
    rows = [(c, t, roles[(c + t * t) % 7], NASTY[(c * 3 + t) % len(NASTY)]) for c in range(12) for t in range(9)]
    got = run(spark, rows)
    for c in range(12):
        own = [(r or "", x or "") for cc, _, r, x in rows if cc == c]
        assert [tuple(t) for t in got[c].turns] == own
        assert got[c].loss == "".join(x for r, x in own if r == "assistant")


def test_neighbours_of_one_role_share_a_message(spark):
    got = run(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")])
    assert got[1].formatted == "[INST]user[/INST]a<s>b</s>[INST]assistant[/INST]c</s>"


def test_ties_nulls_repeats_and_empty_tables(spark):
    got = run(spark, [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, "system", "s"), (None, 0, "assistant", "n")])
    assert [tuple(t) for t in got[1].turns] == [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None].loss == "n"
    assert run(spark, []) == {}


def test_a_long_conversation(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", f"text {t}") for t in range(1500)]
    own = "".join(f"text {t}" for t in range(0, 1500, 3))
    got = run(spark, rows)[7]
    assert len(got.turns) == 1500 and hashlib.sha256(got.loss.encode()).digest() == hashlib.sha256(own.encode()).digest()
