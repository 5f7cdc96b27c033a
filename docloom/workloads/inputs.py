"""How the test tables map onto the engine's relations.

Retrieval units are whole documents (``doc_idx`` = ``doc_id``), queries are the
benchmark passages.  Fields the tables do not have are derived from the ones
they do: ``source`` stands for the section, ``lang`` for the document type, long
capitalised words for entities.  Each rule has an SQL twin in ``sqltext``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.corpus import Corpus, build_corpus
from docloom.sources.io import spread

ENTITY_WORD = "[A-Z][a-z]{7,}"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), rows=2**17)  # texts: a shuffle of them costs more than a long task


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Units with text only (what plain lexical operators need)."""
    return documents(spark, d).select(F.col("doc_id").alias("doc_idx"), "text")


def derived_entities() -> Column:
    """Entity structs from long capitalised words of the text."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(ENTITY_WORD), F.lit(0))))
    n = lambda w: F.length(w)
    kind = lambda w: (
        F.when(n(w) % 4 == 0, "medication_candidate").when(n(w) % 4 == 1, "diagnosis_or_problem_candidate")
        .when(n(w) % 4 == 2, "vital").otherwise("lab_result"))
    return F.transform(words, lambda w: F.struct(
        kind(w).alias("entity_type"), w.alias("text"), F.lower(w).alias("normalized_value"),
        (0.5 + (n(w) % 5) / 10.0).alias("confidence"), F.lit(None).cast("string").alias("section_name"),
        (n(w) % 3 == 0).alias("is_negated")))


def units(spark: SparkSession, d: str) -> DataFrame:
    """Wide units: metadata, flags, quality, entities."""
    lab = table(spark, d, "labels").select("doc_id", "quality")
    doc = documents(spark, d).join(lab, "doc_id", "left")
    has = lambda p: F.col("text").rlike(p)
    return doc.select(
        F.col("doc_id").alias("doc_idx"), F.col("doc_id").alias("document_id"), F.lit(0).cast("bigint").alias("chunk_id"),
        F.lit("document").alias("chunk_strategy_name"), F.col("lang").alias("document_type"),
        F.col("source").alias("primary_section"), F.array("source", "lang").alias("section_names"),
        F.lit(0).cast("bigint").alias("start_index"), F.col("n_chars").alias("end_index"), F.col("n_chars").alias("token_length"),
        (F.col("doc_id") % 7).cast("int").alias("page_start"), (F.col("doc_id") % 7 + F.col("n_chars") % 3).cast("int").alias("page_end"),
        has("@").alias("contains_patient_id"), has("[0-9]").alias("contains_lab"), has("[A-Z][a-z]{9}").alias("contains_medication"),
        has("\\?").alias("contains_diagnosis"), has("http").alias("contains_vital"), has("(^|[^a-z])(not|nicht|pas|no)([^a-z]|$)").alias("contains_negation"),
        F.coalesce("quality", F.lit(0)).cast("double").alias("clinical_quality_score"),
        derived_entities().alias("entities"), "text",
    )


def corpus(spark: SparkSession, d: str) -> Corpus:
    return build_corpus(documents(spark, d))
