"""The operators as queries over the sample tables, whole tables each time."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlens.llm import hard_negatives, odd_sketch, source_divergence, suffix_dedup, warc
from stationlens.llm.common import table
from stationlens.session import new_path

#: Where the tokenizer files lie; a parameter, they are not part of the repository.
TOKENIZER_JSON = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def _tokenizer() -> str:
    with open(TOKENIZER_JSON, encoding="utf-8") as file:
        return file.read()


@query("op1_token_store")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a token store and read back from it."""
    from stationlens.llm.token_store import read_store, write_store

    path = new_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), path, _tokenizer())
    return read_store(spark, path, with_ids=False)


@query("op2_warc_derivatives")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages, with the hash of each complete record."""
    from stationlens.llm.warc import derivatives, responses_of_pages

    records = derivatives(responses_of_pages(table(spark, sf_dir, "pages")).select("page_id", "record"))
    return records.withColumn("record_sha256", F.sha2(F.encode("record", "UTF-8"), 256)).drop("record")


ORACLES["op2_warc_derivatives"] = warc.oracle()


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents and the verdict of the robust outlier test."""
    from stationlens.llm.quality_rules import base_counts, verdicts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return verdicts(base_counts(docs).drop("text")).drop("lang", "source")


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learned from those not held out."""
    from stationlens.llm.language_id import identify, learn

    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (part == 2).alias("held_out"))
    model = learn(docs.filter("not held_out"))
    return identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_prefix_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the prefix tables and decoded again."""
    from stationlens.llm.prefix_bpe import encode_documents

    with open(TOKENIZER_RANKS, encoding="ascii") as file:
        ranks = file.read()
    return encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


@query("op6_kmeans_tree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest rows of every vector whose id is divisible by 20."""
    from stationlens.llm.kmeans_tree import search

    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=20)


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that smaller documents hold."""
    from stationlens.llm.suffix_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=50, with_text=False)


ORACLES["op7_suffix_dedup"] = suffix_dedup.oracle()


@query("op8_kneser_ney")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those not held out."""
    from stationlens.llm.kneser_ney import learn, score

    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (part == 2).alias("held_out"))
    return score(docs, learn(docs.filter("not held_out")))


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups they form at three bits."""
    from stationlens.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=3).drop("simhash", "group_print")


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    from stationlens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer(), with_ids=False)


@query("op11_hard_negatives")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50, labels of every seventh changed."""
    from stationlens.llm.hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


ORACLES["op11_hard_negatives"] = hard_negatives.oracle()


@query("op12_odd_sketch")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents whose four-word shingles agree in four fifths."""
    from stationlens.llm.odd_sketch import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLES["op12_odd_sketch"] = odd_sketch.oracle()


@query("op13_source_divergence")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between all sources of a language and the terms that set each source apart."""
    from stationlens.llm.source_divergence import audit

    return audit(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = source_divergence.oracle()


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
