"""Quality rules: a decision list learned by sequential covering, applied as Spark conditions.

Statistics of whole texts are counted in Arrow batches. On a bounded sample of labelled rows the
learner grows one conjunction of thresholds after another on two thirds of the rows, prunes each on
the rest, and takes the rows it covers away. The list is a readable table of rules; Spark evaluates
it as one ordered conditional expression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .text import few_rows

#: What is counted of a text.
COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_digits",
    "n_marks",
    "n_chars",
)
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?"
_BLANKS = b" \t\n\r\x0b\x0c"


def _repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, free = 0, 0
    for at, window in enumerate(windows):
        if often[window] > 1:
            covered += at + 3 - max(at, free)
            free = at + 3
    return covered


def count_text(text: bytes) -> tuple[int, ...]:
    """The counts of one text in the order of COUNTS. Words are runs without ASCII blanks."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    blanks = len(text) - len(text.translate(None, _BLANKS))
    lines = [line for line in text.split(b"\n") if line.strip(_BLANKS)]
    return (
        len(words),
        points - blanks,
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, _UPPER)),
        len(text) - len(text.translate(None, _DIGITS)),
        len(text) - len(text.translate(None, _MARKS)),
        points,
    )


def text_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Per row: kept (a struct of the ``keep`` columns) and the counts. Null counts as no text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows = np.array([count_text(t or b"") for t in texts], np.int64).reshape(-1, len(COUNTS))
            columns = [batch.column("kept"), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))]
            yield pa.RecordBatch.from_arrays(columns, ["kept", *COUNTS])

    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    rows = docs.select(kept, F.col(text).cast("string").alias("text"))
    fields = [rows.schema["kept"], *(StructField(c, LongType()) for c in COUNTS)]
    return rows.mapInArrow(count, StructType(fields))


def features() -> dict[str, tuple]:
    """Feature name: (numerator, denominator or None); the same for the learner and for Spark."""
    return {
        "n_words": ("n_words", None),
        "chars_per_word": ("word_chars", "n_words"),
        "symbols_per_word": ("n_symbols", "n_words"),
        "dup_line_share": ("n_dup_lines", "n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "words_per_line": ("n_words", "n_lines"),
        "upper_share": ("n_upper", "word_chars"),
        "digit_share": ("n_digits", "word_chars"),
        "marks_per_word": ("n_marks", "n_words"),
    }


def feature_column(name: str) -> Column:
    over, under = features()[name]
    if under is None:
        return F.col(over).cast("double")
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = feature_column(self.feature)
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        value = values[self.feature]
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _mask(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(values)
    return out


def _candidates(value: np.ndarray, cuts: int) -> np.ndarray:
    """Thresholds halfway between neighbouring quantiles, short enough to read."""
    points = np.unique(np.quantile(value, np.linspace(0, 1, cuts + 1)))
    return np.unique([float(f"{x:.5g}") for x in (points[1:] + points[:-1]) / 2])


def _grow(values, bad, cuts: int, max_conditions: int) -> Rule:
    """Add the condition of highest information gain until no good row is covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        base, best, chosen = np.log2(p0 / (p0 + n0)), 0.0, None
        for name, value in values.items():
            for cut in _candidates(value[inside], cuts) if inside.any() else ():
                above = value >= cut
                for up, side in ((True, above), (False, ~above)):
                    p, n = (inside & side & bad).sum(), (inside & side & ~bad).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - base)
                        if gain > best + 1e-9:
                            best, chosen = gain, Condition(name, up, float(cut))
        if chosen is None:
            break
        rule += (chosen,)
        inside &= chosen.holds(values)
    return rule


def _prune(rule: Rule, values, bad) -> Rule:
    """The beginning of the rule with the best (bad - good) / all on rows it was not grown on."""

    def worth(part: Rule) -> float:
        covered = _mask(part, values, len(bad))
        n = covered.sum()
        return (2 * (covered & bad).sum() - n) / n if n else -1.0

    parts = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(parts, key=lambda part: (round(worth(part), 9), -len(part))) if parts else ()


def learn_rules(
    values: dict[str, np.ndarray],
    bad: np.ndarray,
    min_precision: float = 0.9,
    min_covered: int = 5,
    max_rules: int = 20,
    max_conditions: int = 4,
    cuts: int = 40,
) -> list[Rule]:
    """Ordered rules for bad rows. Rows should come in an order that tells nothing about them.

    A rule needs ``min_precision`` on the rows kept for pruning and on all rows together, and
    ``min_covered`` rows. The list ends at the first rule that fails, so it may be empty.
    """
    left = np.ones(len(bad), bool)
    to_grow = np.arange(len(bad)) % 3 != 2
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = left & to_grow, left & ~to_grow
        if not (grow & bad).any():
            break
        rule = _grow({k: v[grow] for k, v in values.items()}, bad[grow], cuts, max_conditions)
        if rule and prune.any():
            rule = _prune(rule, {k: v[prune] for k, v in values.items()}, bad[prune])
        if not rule:
            break
        covered = _mask(rule, values, len(bad)) & left
        held_out = covered & prune
        sure = (covered & bad).sum() >= min_precision * covered.sum()
        sure_held_out = (held_out & bad).sum() >= min_precision * held_out.sum()
        if covered.sum() < min_covered or not (sure and sure_held_out):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_rows: int = 20_000,
    **options,
) -> list[Rule]:
    """Learn the list from at most about ``max_rows`` labelled rows, chosen by a hash of the key.

    That bound is the same at every size. A row is bad when its label is 0; a key with several
    labels counts by the smallest; null keys and labels are left out. Only sampled texts are read by
    the statistics. Without labels, or with labels of one kind, the list is empty.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("labelled"))
        .agg(F.min(label).alias("label"))
    )
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    below = int(share * 2**53)
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("labelled"), 11) < below)
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(
        F.broadcast(chosen), F.col("doc") == F.col("labelled")
    )
    counted = text_counts(rows.select("doc", "label", "text"), ["doc", "label"])
    # Repeats of a key could be many; the sample stays bounded.
    table = (
        counted.select(F.xxhash64("kept.doc").alias("at"), (F.col("kept.label") == 0).alias("bad"), *COUNTS)
        .limit(2 * max_rows)
        .toArrow()
    )
    if not table.num_rows:
        return []
    columns = {c: np.asarray(table[c]) for c in table.column_names}
    order = np.lexsort(tuple(columns[c] for c in COUNTS) + (columns["at"],))
    counts = {c: columns[c][order].astype(np.float64) for c in COUNTS}
    values = {
        name: counts[over] / np.maximum(counts[under], 1) if under else counts[over]
        for name, (over, under) in features().items()
    }
    return learn_rules(values, columns["bad"][order].astype(bool), **options)


def rule_column(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that holds, null if none does: one ordered condition."""
    out = None
    for number, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        out = F.when(holds, F.lit(number)) if out is None else out.when(holds, F.lit(number))
    return F.lit(None).cast("int") if out is None else out


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], keep: list[str], text: str = "text") -> DataFrame:
    """Per row: kept (a struct of the ``keep`` columns), counts, base_failed, rule, passed.

    Null and empty texts have no words and fail the base. Rows are judged each by itself: repeated
    rows, ties and null keys keep their own verdicts, and columns named like a result are safe
    inside ``kept``. An empty table gives an empty table.
    """
    counted = text_counts(docs, keep, text)
    return counted.select("*", base_failed().alias("base_failed"), rule_column(rules).alias("rule")).withColumn(
        "passed", ~F.col("base_failed") & F.col("rule").isNull()
    )


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows that pass the base and meet no rule, with the columns of ``docs``."""
    return judge(docs, rules, docs.columns, text).where("passed").select("kept.*")
