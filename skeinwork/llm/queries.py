"""Queries of the text problems 7 to 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from . import packing, subjects, tokens

#: Tokens that a container holds.
CAPACITY = 2_048


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Per language: documents, and those whose decoded ids are not the text they came from."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    back = tokens.decode(tokens.encode(docs)).select("doc_id", F.xxhash64("text").alias("back"))
    return docs.join(back, "doc_id").groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.xxhash64(F.coalesce("text", F.lit(""))) != F.col("back")).alias("changed")
    )


def p7_words(spark: SparkSession, d: str) -> DataFrame:
    """The distinct-word table: word, occurrences, number of tokens."""
    return tokens.word_table(table(spark, d, "documents")).select("word", "occurrences", F.size("ids").cast("long").alias("n_tokens"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, d, "documents")), CAPACITY)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(materialize(p8_containers(spark, d), "packed"), CAPACITY)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mean share of each subject in the corpus."""
    return _subjects(spark, d).groupBy("subject").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("share"), 6).alias("mean_share")
    )


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.coalesce("status", F.lit(subjects.DELIVERED)) == subjects.DELIVERED)
    return subjects.assign_subjects(
        docs.select("doc_id", "text"), table(spark, d, "subject_areas"), table(spark, d, "subject_examples")
    )


QUERIES = {f.__name__: f for f in (p7_ids, p7_roundtrip, p7_words, p8_containers, p8_report, p9_found, p9_composition)}
ORACLES: dict[str, str] = {}
