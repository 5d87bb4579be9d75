"""Chat formatting by a grammar that is proven on every conversation.

Rendered text is ``### Name: body\\n</turn>\\n`` per turn. Control strings are ``### `` and
``</turn>`` unless a backslash stands before them. A turn is rendered as it is, reparsed, and
compared with its source; while they differ, one backslash more is put before each control string.
The whole conversation is then parsed again, and everything that is returned comes from that parse.

Only DataFrame functions are used. Rows are escaped before they are grouped, and one conversation
is one row of the result, as its text is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "### ", "</turn>"
#: Shown names of the usual roles; any other role is shown as = and its URL encoding.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}

_CONTROL = rf"(?:{START}|{END})"
_SPLIT = rf"(?<!\\){_CONTROL}"
_TURN = r"(?s)^([^:]*): (.*)\n$"


def escape(text: Column) -> Column:
    """One backslash more before every control string; ``unescape`` takes it away again."""
    return F.regexp_replace(text, rf"(\\*{_CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{_CONTROL})", "$1")


def _shown(role: Column) -> Column:
    name = F.concat(F.lit("="), F.url_encode(role))
    for plain, shown in NAMES.items():
        name = F.when(role == plain, F.lit(shown)).otherwise(name)
    return name


def _role(name: Column) -> Column:
    role = F.url_decode(F.substr(name, F.lit(2)))
    for plain, shown in NAMES.items():
        role = F.when(name == shown, F.lit(plain)).otherwise(role)
    return role


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), _shown(role), F.lit(": "), body, F.lit(f"\n{END}\n"))


def parse(formatted: Column) -> Column:
    """Turns of a rendered text: role, text, code points before, in and after the body as it stands.

    Null when the text doesn't follow the grammar.
    """
    parts = F.split(formatted, _SPLIT, -1)
    turns = F.filter(
        F.transform(
            parts,
            lambda part, i: F.struct(
                (i % 2 == 1).alias("is_turn"),
                F.regexp_extract(part, _TURN, 1).alias("name"),
                F.regexp_extract(part, _TURN, 2).alias("body"),
            ),
        ),
        lambda p: p["is_turn"],
    )
    well_formed = (F.size(parts) % 2 == 1) & ~F.exists(
        F.transform(
            parts,
            lambda part, i: F.when(i == 0, part != "")
            .when(i % 2 == 0, part != "\n")
            .otherwise(~part.rlike(_TURN)),
        ),
        lambda bad: bad,
    )
    recovered = F.transform(
        turns,
        lambda p: F.struct(
            _role(p["name"]).alias("role"),
            unescape(p["body"]).alias("text"),
            (F.length(p["name"]) + len(START) + 2).cast("long").alias("before"),
            F.length(p["body"]).cast("long").alias("inside"),
            F.lit(len(END) + 2).cast("long").alias("after"),
            (p["name"] == NAMES["assistant"]).alias("in_loss"),
        ),
    )
    return F.when(well_formed, recovered)


def _survives(role: Column, text: Column, body: Column) -> Column:
    """Whether the one turn comes back from the parser as it went in."""
    got = F.transform(parse(render_turn(role, body)), lambda t: F.struct(t["role"], t["text"]))
    return F.coalesce(got == F.array(F.struct(role.alias("role"), text.alias("text"))), F.lit(False))


def format_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: formatted, turns (as parsed back), n_escaped, identical.

    ``turns`` of the result carries the loss mask as run lengths: per turn the code points before,
    inside and after its body, and whether the body is trained on (assistant turns).

    Null texts and roles count as empty; null conversations form one conversation; equal or null
    order values are ordered by role and text (null first). Repeated rows are repeated turns. An
    empty table gives an empty table. Other columns, whatever their names, are not read.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.col(order).alias("at"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    has_control = F.col("text").contains(START) | F.col("text").contains(END)
    once = F.when(has_control & ~_survives(F.col("role"), F.col("text"), F.col("text")), escape(F.col("text")))
    body = F.coalesce(F.col("escaped"), F.col("text"))
    again = F.when(
        F.col("escaped").isNotNull() & ~_survives(F.col("role"), F.col("text"), F.col("escaped")),
        escape(F.col("escaped")),
    ).otherwise(body)
    rendered = (
        rows.withColumn("escaped", once)
        .withColumn("body", again)
        .select(
            "conv_id",
            F.struct("at", "role", "text", render_turn(F.col("role"), F.col("body")).alias("shown")).alias("turn"),
            (F.col("body") != F.col("text")).cast("long").alias("was_escaped"),
        )
    )
    grouped = rendered.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("turn")).alias("source"), F.sum("was_escaped").alias("n_escaped")
    )
    formatted = grouped.withColumn("formatted", F.array_join(F.transform("source", lambda t: t["shown"]), ""))
    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    same = F.transform("turns", lambda t: F.struct(t["role"], t["text"])) == F.transform(
        "source", lambda t: F.struct(t["role"], t["text"])
    )
    return parsed.select(
        F.col("conv_id").alias(conversation),
        "formatted",
        "turns",
        "n_escaped",
        F.coalesce(same, F.lit(False)).alias("identical"),
    )


def loss_text(turns: Column) -> Column:
    """The text under the loss mask: bodies of the trained turns, unescaped, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["in_loss"]), lambda t: t["text"]), "")


def turns_digest(turns: Column) -> Column:
    """Lower-case hex SHA-256 of role, line break, text, line break of each turn."""
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)
