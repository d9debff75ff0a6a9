"""Five stages from raw documents to packed training sequences. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.exact_dedup import drop_exact_duplicates
from tidegauge.llm.language_id import UNKNOWN, identify
from tidegauge.llm.near_dedup import drop_near_duplicates
from tidegauge.llm.packing import pack
from tidegauge.llm.queries import held_out, tokenizer_path
from tidegauge.llm.suffix_dedup import repeated_substrings
from tidegauge.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language must be likelier than all others together.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those of no clear language go; a missing language is filled in."""
    found = identify(docs, learn_on=~held_out(4, 2), keep=("text", "lang", "source", "n_chars"))
    found = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return drop_exact_duplicates(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 80 percent of their five-word shingles the document with the smallest id stays."""
    return drop_near_duplicates(docs, shingle=5, percent=80).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that start earlier in another place are cut out, in whole characters. Every document stays."""
    cut = repeated_substrings(docs, width=100, keep=("lang", "source"), whole_characters=True)
    text = F.decode("kept", "UTF-8")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("bigint").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two ids, each from one document."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), largest=4096)


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]
#: Learned languages, hashing and tokenizing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
