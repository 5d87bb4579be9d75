"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayscope.schema import NULL_TOKENS, PYTHON_WHITESPACE


def strip(c: Column) -> Column:
    """Trim every Unicode blank on both ends (Spark's ``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(PYTHON_WHITESPACE))


def title_case(c: Column) -> Column:
    """Python's ``str.title``: any character without case starts a new word.

    ``initcap`` breaks words at spaces only, so every other such character gets a marker
    ending in a space first, removed again afterwards.
    """
    caseless = r"([^\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase} ])"
    marked = F.regexp_replace(c, caseless, "$1\x01 ")
    return F.replace(F.initcap(marked), F.lit("\x01 "), F.lit(""))


def null_tokens_to_null(c: Column) -> Column:
    return F.when(~c.isin(NULL_TOKENS), c)
