"""The corpus pipeline: quality rules, near duplicates, benchmark passages, encoding.

Every stage works on all rows that the one before it kept. What a stage returns is written as Parquet
and read again by the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.llm import decontaminate, jaccard_join, prefix_bpe, quality_rules
from stayscope.llm.queries import read
from stayscope.sources.staging import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list and the base rules don't reject."""
    rules = quality_rules.fit_rules(docs, read(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, rules)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard of 0.8 or more."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian, 32 bits each) of every document, with proof that they decode."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = prefix_bpe.encode_texts(docs, path, public_tokenizers.PATTERN, ["doc_id", "text"], decode=True)
    return done.select(
        "kept.doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.encode(F.coalesce("kept.text", F.lit("")), "UTF-8")).alias("decodes"),
    )


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]
#: Learned rules and token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
