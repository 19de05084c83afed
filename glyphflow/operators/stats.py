"""Corpus and index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index


def totals(index: Index) -> DataFrame:
    """One row: documents, terms, postings, characters, languages; each counted in one pass over its table."""
    docs = index.docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length("searchable")), F.lit(0)).cast("long").alias("characters"), F.count_distinct("language").alias("languages"))
    return docs.join(index.terms.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("postings")))  # one row each


def by_language(docs: DataFrame) -> DataFrame:
    return docs.groupBy("language").agg(F.count("*").alias("documents")).orderBy("language")


def languages(docs: DataFrame) -> DataFrame:
    return docs.select("language").distinct().orderBy("language")
