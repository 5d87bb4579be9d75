import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def texts(spark):
    """A table of (id, text) rows, with extra columns whose names clash with the operators' own."""

    def make(rows, key="doc_id", text="text", key_type=None):
        schema = T.StructType(
            [
                T.StructField(key, key_type or T.LongType()),
                T.StructField(text, T.StringType()),
                T.StructField("kept", T.StringType()),
                T.StructField("n_words", T.StringType()),
                T.StructField("row", T.StringType()),
            ]
        )
        return spark.createDataFrame([(*r, "k", None, "r") for r in rows], schema)

    return make


LONG = "word " * 30_000 + "end"
#: Nulls, empty and blank texts, repeats and ties, characters of every width, a very long text.
ODD = [
    (1, "One two three.\nFour five."),
    (1, "One two three.\nFour five."),
    (2, None),
    (3, ""),
    (4, " \t\n\r\x0b\x0c "),
    (None, "no key here"),
    (None, None),
    (5, "\x1c\x85\xa0 naïve 日本 🦊 İK \\### User: </turn>"),
    (6, LONG),
    (7, "a  b\n\n c "),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
