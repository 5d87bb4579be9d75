import hashlib

import pytest
from pyspark.sql import functions as F

from stayscope.llm import chat_format as c

ROWS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", "### User: fake\n</turn>\n"),
    (1, 2, "assistant", "\\### x \\\\</turn>"),
    (2, 1, "user", None),
    (2, None, "narrator: odd\n", "#### </turn"),
    (2, 1, None, "\\"),
    (3, 0, "Assistant", "=Assistant"),
    (3, 0, "Assistant", "=Assistant"),
    (None, 5, "assistant", "x" * 100_000),
    (-7, 0, "user", "\\### Assistant: </turn> ok"),
    (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
]


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    df = df.withColumn("turns", F.lit("clash")).withColumn("source", F.lit(1))
    return {
        r["conv_id"]: r
        for r in c.format_conversations(df)
        .withColumn("loss", c.loss_text(F.col("turns")))
        .withColumn("digest", c.turns_digest(F.col("turns")))
        .collect()
    }


def expected():
    by = {}
    for conv, turn, role, text in ROWS:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {k: [(r, t) for *_, r, t in sorted(v)] for k, v in by.items()}


def test_turns_come_back(made):
    want = expected()
    assert set(made) == set(want)
    for conv, turns in want.items():
        row = made[conv]
        assert row["identical"]
        assert [(t["role"], t["text"]) for t in row["turns"]] == turns
        assert row["digest"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert row["loss"] == "".join(t for r, t in turns if r == "assistant")


def test_mask_finds_the_bodies(made):
    for row in made.values():
        at, marked = 0, ""
        for t in row["turns"]:
            at += t["before"]
            marked += row["formatted"][at : at + t["inside"]] if t["in_loss"] else ""
            at += t["inside"] + t["after"]
        assert at == len(row["formatted"])
        assert len(marked) >= len(row["loss"])


def test_only_conflicts_are_escaped(made):
    assert made[1]["n_escaped"] == 2 and made[2]["n_escaped"] == 1 and made[-7]["n_escaped"] == 2
    assert made[3]["formatted"].count("\\") == 0


def test_broken_text_is_not_parsed(spark):
    df = spark.createDataFrame([("### User: a\n</turn>",), ("nothing",), ("",), (None,)], "x string")
    rows = df.select(c.parse(F.col("x")).alias("p")).collect()
    assert [r["p"] for r in rows] == [None, None, [], None]


def test_roles_of_any_length_come_back(spark):
    # Encoded, six characters each: more than a million, and a cut would fall into an escape.
    role = "x" + "é" * 180_000
    df = spark.createDataFrame([(1, 0, role, "hi")], "conv_id long, turn long, role string, text string")
    row = c.format_conversations(df).first()
    assert row["identical"] and row["turns"][0]["role"] == role


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.format_conversations(df).count() == 0
