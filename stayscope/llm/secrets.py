"""Secret scan: fixed patterns, and two Markov models of characters that tell random strings apart.

One model gives the chance of each character after the one before it in random strings, the other in
ordinary identifiers. A run of token characters is a secret if the mean log-likelihood ratio of its
characters is high enough. Both models are counted over labelled samples: whatever the caller brings,
or runs of the texts themselves, labelled by the patterns. Only DataFrame functions are used. The
models are one row of a fixed size, and a text is scanned within its row, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"([A-Za-z0-9+/_.=-]+)"
# Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN, ACCESS, HEX = _ASSIGNED + _VALUE, "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
ASSIGN_CHARS = 12
#: Runs that the models learn from and judge; an assignment before them is passed over as a whole.
RUN_CHARS = 12
RUN = _ASSIGNED + _VALUE + f"|[A-Za-z0-9+/_-]{{{RUN_CHARS},}}={{0,2}}"

#: Codes of the models' characters: 0 stands before the first one, printable ASCII is 1 to 94.
CODES = 95
_PIECE = 64


def _once(value: Column, use) -> Column:
    """``use(value)``, computed once; an expression inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums of a non-empty array up to each element; in pieces, as long arrays of growing sums are dear."""
    total = lambda piece: F.aggregate(piece, F.lit(0), lambda a, b: a + b)
    first = lambda array, n: F.slice(array, F.lit(1), n)
    n_pieces = lambda v: F.floor((F.size(v) - 1) / _PIECE).cast("int")
    cut = lambda v: F.transform(
        F.sequence(F.lit(0), n_pieces(v)), lambda p: F.slice(v, p * _PIECE + 1, F.lit(_PIECE))
    )
    joined = lambda pieces, offsets: F.flatten(
        F.zip_with(
            pieces, offsets, lambda piece, offset: F.transform(piece, lambda _, i: offset + total(first(piece, i + 1)))
        )
    )
    offsets = lambda totals: F.transform(totals, lambda _, p: total(first(totals, p)))
    return _once(
        values,
        lambda v: _once(cut(v), lambda pieces: joined(pieces, _once(F.transform(pieces, total), offsets))),
    )


def _with_matches(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """Column ``name``: (start, end, value) of every leftmost match in ``text``, in code points."""
    found, ends = f"{name}_found", f"{name}_ends"
    rows = rows.withColumn(found, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    steps = F.zip_with(F.split("text", pattern, -1), found, lambda gap, hit: F.length(gap) + F.length(hit))
    rows = rows.withColumn(f"{name}_steps", F.when(F.size(found) > 0, F.slice(steps, F.lit(1), F.size(found))))
    rows = rows.withColumn(ends, F.when(F.size(found) > 0, running_sums(F.col(f"{name}_steps"))))
    spans = F.zip_with(
        found, ends, lambda hit, end: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("value"))
    )
    return rows.withColumn(name, spans).drop(found, ends, f"{name}_steps")


def _kind(name: str, keep=lambda hit: F.lit(True)) -> Column:
    spans = F.transform(
        F.filter(name, lambda s: keep(s["value"])),
        lambda s: F.struct(s["start"], F.lit(KINDS.index(name)).alias("kind"), s["end"], s["value"]),
    )
    return F.coalesce(spans, F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def _assigned(hit: Column) -> Column:
    """The value behind an assignment; empty if there is none."""
    return F.regexp_extract(hit, f"^{ASSIGN}", 1)


def _is_run(hit: Column) -> Column:
    """No assignment and nothing that a pattern finds by itself."""
    return ~F.coalesce(hit.rlike(f"^{ASSIGN}") | hit.rlike(f"{ACCESS}|{HEX}"), F.lit(True))


def label_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, random) over all texts: values that the patterns find are random, other runs are not.

    Each different token counts once, however often it is repeated, so that no copied text decides.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    runs = docs.select(F.explode(F.regexp_extract_all(whole, F.lit(f"{ACCESS}|{HEX}|{RUN}"), F.lit(0))).alias("hit"))
    value = F.when(_assigned(F.col("hit")) != "", _assigned(F.col("hit"))).otherwise(F.col("hit"))
    return (
        runs.select(value.alias("token"), (~_is_run(F.col("hit"))).alias("random"))
        .where(F.length("token") >= RUN_CHARS)
        .distinct()
    )


def fit_models(samples: DataFrame, smoothing: float = 0.5, characters: int = 68) -> DataFrame:
    """One row, ``ratios``: log P(next | before, random) - log P(next | before, ordinary), by codes.

    ``samples`` holds ``token`` and the boolean ``random``. Every pair of characters starts with
    ``smoothing`` counts over an alphabet of ``characters``; without samples of a kind its model is
    uniform. Characters beyond printable ASCII and null tokens or labels are passed over.
    """
    token = F.regexp_replace("token", "[^!-~]", "")
    known = samples.where((token != "") & F.col("random").isNotNull())
    # Pairs are counted in the tasks: at most 95 * 95 rows leave each of them.
    counts = (
        known.select("random", F.split(token, "").alias("chars"))
        .select("random", F.transform("chars", lambda c: F.ascii(c) - 32).alias("codes"))
        .select(
            "random",
            F.explode(
                F.transform("codes", lambda c, i: F.when(i > 0, F.get("codes", i - 1)).otherwise(0) * CODES + c)
            ).alias("pair"),
        )
        .groupBy("pair")
        .agg(*[F.count(F.when(F.col("random") == value, 1)).alias(name) for name, value in (("r", True), ("o", False))])
    )
    every = samples.sparkSession.range(CODES * CODES).select(F.col("id").cast("int").alias("pair"))
    filled = every.join(counts, "pair", "left").select("pair", *[F.coalesce(c, F.lit(0)).alias(c) for c in "ro"])
    before = F.floor(F.col("pair") / CODES).alias("before")
    totals = filled.groupBy(before).agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))
    share = lambda n, of: (F.col(n) + smoothing) / (F.col(of) + smoothing * characters)
    ratios = filled.withColumn("before", before).join(totals, "before").select(
        F.struct("pair", (F.log(share("r", "rs")) - F.log(share("o", "os"))).alias("ratio")).alias("x")
    )
    return ratios.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["ratio"]).alias("ratios"))


def mean_ratio(token: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio of the token's characters; 0 without any."""
    chars = F.split(F.regexp_replace(token, "[^!-~]", ""), "")
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    read = lambda acc, c: F.struct(
        (F.ascii(c) - 32).alias("before"),
        (acc["sum"] + F.get(ratios, acc["before"] * CODES + F.ascii(c) - 32)).alias("sum"),
        (acc["n"] + 1).alias("n"),
    )
    whole = lambda acc: F.when(acc["n"] > 0, acc["sum"] / acc["n"]).otherwise(0.0)
    return F.aggregate(F.filter(chars, lambda c: c != ""), start, read, whole)


def scan_secrets(
    docs: DataFrame,
    models: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = 16,
    margin: float = 0.05,
) -> DataFrame:
    """Per row: key, base and secrets, both arrays of (start, kind, end, value) by start and kind.

    ``base`` is what the patterns find, matches that are too short dropped; ``kind`` is a place in
    ``KINDS``. ``secrets`` adds runs of at least ``min_chars`` token characters whose mean ratio under
    ``models`` (one row of ``fit_models``) exceeds ``margin``. Runs that hold a key or a long
    hexadecimal number aren't judged again. Places are code points, ends exclusive.

    Null and empty texts have no spans. Every row is scanned by itself, so repeated rows and keys,
    null keys and other columns change nothing; equal starts are listed in the order of the kinds.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", RUN)):
        rows = _with_matches(rows, name, pattern)
    rows = rows.withColumn("ratios", models.select("ratios").scalar())
    base = F.concat(_kind("assign", lambda hit: F.length(_assigned(hit)) >= ASSIGN_CHARS), _kind("access"), _kind("hex"))
    judged = _kind(
        "random",
        lambda hit: _is_run(hit) & (F.length(hit) >= min_chars) & (mean_ratio(hit, F.col("ratios")) > margin),
    )
    rows = rows.withColumn("base", F.array_sort(base)).withColumn("more", judged)
    return rows.select(
        F.col("key").alias(key),
        "base",
        F.when(F.size("more") > 0, F.array_sort(F.concat("base", "more"))).otherwise(F.col("base")).alias("secrets"),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def n_of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
