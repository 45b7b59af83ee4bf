"""From raw documents to packed training sequences: five stages, each one of the operators.

Every stage takes the documents its predecessor kept and returns documents, the last one
the pieces of packed sequences. Stages are written as Parquet and read again in between.
A stage that takes documents away keeps all columns of the others as they were; only
``repeats`` changes texts (and ``n_chars`` with them).

Nulls, empty texts, repeated rows and empty tables are treated as each operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlens.llm import language_id, packing, quality_rules, simhash, suffix_dedup
from stationlens.session import written

TOKENIZER_JSON = public_tokenizers.path("byte_bpe_50k.json")
#: Documents whose best language has a lower mean probability are rejected.
MIN_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: not ``und`` and predicted with at least ``MIN_SCORE``."""
    model = language_id.learn(docs)
    judged = language_id.identify(docs, model)
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_rules.verdicts(quality_rules.base_counts(docs)).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id.

    Of rows with that same id the first by text, language and source stays; a group
    without any id keeps its first row by these.
    """
    found = simhash.near_duplicates(docs, width=3, max_bits=3, keep=COLUMNS)
    # The rows of one id, of which there may be several copies.
    named = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rest = ("text", "lang", "source", "n_chars")
    first = F.min(F.struct(F.xxhash64(*rest), *rest)).alias("r")
    return named.groupBy("group_print", "doc_id").agg(first).select("doc_id", *[F.col(f"r.{c}") for c in rest])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes and more that smaller documents hold."""
    cut = suffix_dedup.remove_repeats(docs, length=50).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    with open(TOKENIZER_JSON, encoding="utf-8") as file:
        return packing.pack(docs, file.read(), with_ids=False)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", pack)]

#: Training a network and packing in reading order cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
