"""The inverted index: postings with offsets, the dictionary, and retrieval by terms or by containment."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def build_postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions), one row for a term in a document.

    All tokens of a document are in one batch, so they are counted there and nothing is shuffled.
    """

    def count(batches):
        for batch in T.text_slices(batches):
            terms, start, upto = T.token_runs(batch.column(1))
            coded = pc.dictionary_encode(terms)
            words = coded.dictionary
            pair = np.repeat(np.arange(batch.num_rows), np.diff(upto)) * max(1, len(words)) + coded.indices.to_numpy()
            order = np.argsort(pair, kind="stable")  # starts stay ascending
            first = np.flatnonzero(np.diff(pair[order], prepend=-1))
            key = pair[order][first]
            offsets = np.append(first, len(pair)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(key % max(1, len(words)))), batch.column(0).take(pa.array(key // max(1, len(words)))), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(start[order].astype(np.int32)))],
                names=["term", "doc_id", "tf", "positions"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "searchable").mapInArrow(count, f"term string, doc_id {kind}, tf int, positions array<int>")


def build_dictionary(docs: DataFrame) -> DataFrame:
    """(term, df) from documents; each batch sends a term once, with its number of documents."""

    def count(batches):
        for batch in T.text_slices(batches):
            terms, _, upto = T.token_runs(batch.column(1))
            coded = pc.dictionary_encode(terms)
            pair = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(upto)) * max(1, len(coded.dictionary)) + coded.indices.to_numpy())
            df = np.bincount(pair % max(1, len(coded.dictionary)), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df.astype(np.int64))], names=["term", "df"])

    return docs.select("id", "searchable").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def dictionary(postings: DataFrame) -> DataFrame:
    """(term, df) from postings."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


@dataclass
class Index:
    """Documents with their postings and dictionary; built aside, then swapped in as one object."""

    docs: DataFrame
    postings: DataFrame = field(init=False)
    terms: DataFrame = field(init=False)
    stored: bool = field(init=False, default=False)

    def __post_init__(self):
        self.postings = build_postings(self.docs)
        self.terms = build_dictionary(self.docs)

    def persist(self) -> Index:
        self.docs, self.postings = self.docs.persist(), self.postings.persist()
        self.terms = dictionary(self.postings).persist()
        self.stored = True
        return self

    def unpersist(self) -> None:
        for df in (self.docs, self.postings, self.terms):
            df.unpersist()


def docs_of_term(postings: DataFrame, term: str) -> DataFrame:
    return postings.where(F.col("term") == term).select("doc_id")


def docs_of_any(postings: DataFrame, terms: list[str]) -> DataFrame:
    return postings.where(F.col("term").isin(list(terms))).select("doc_id").distinct()


def docs_of_all(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with every term as a whole word; one shuffle whatever the number of terms."""
    terms = list(dict.fromkeys(terms))
    hits = postings.where(F.col("term").isin(terms)).select("doc_id", "term")
    return hits.groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms)).where(F.lit(bool(terms))).select("doc_id")


def terms_containing(terms: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, term): dictionary terms that hold a keyword, which a request bounds to fifty."""
    asked = [k for k in dict.fromkeys(keywords) if k]
    if not asked:
        return terms.where("false").select(F.col("term").alias("keyword"), "term")
    inside = F.filter(F.array(*map(F.lit, asked)), lambda k: F.contains(F.col("term"), k))
    return terms.select(F.explode(inside).alias("keyword"), "term")


def sorted_terms_containing(terms: DataFrame, keywords: list[str]) -> DataFrame:
    """terms_containing() in the order of the keywords, then of the terms."""
    order = F.array_position(F.array(*map(F.lit, dict.fromkeys(keywords))), F.col("keyword")) if keywords else F.lit(0)
    return terms_containing(terms, keywords).orderBy(order, "term")


def dictionary_contains(terms: DataFrame, keyword: str) -> bool:
    if not keyword:
        return False
    return not terms.where(F.col("term") == keyword).limit(1).isEmpty() or not terms.where(F.contains("term", F.lit(keyword))).limit(1).isEmpty()


def dictionary_held(terms: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, held) for every keyword: whether a dictionary term holds it; one pass for all of them."""
    asked = list(dict.fromkeys(keywords))
    if not asked:
        return terms.select(F.col("term").alias("keyword"), F.lit(False).alias("held")).where("false")
    flags = terms.agg(*[F.coalesce(F.max(F.contains("term", F.lit(k))), F.lit(False)).alias(f"k{i}") for i, k in enumerate(asked)])
    return flags.select(F.inline(F.array(*[F.struct(F.lit(k).alias("keyword"), (F.col(f"k{i}") & F.lit(k != "")).alias("held")) for i, k in enumerate(asked)])))


def _held(postings: DataFrame, asked: list[str]) -> DataFrame:
    """(doc_id, held): a bit for each keyword (fifty at most) that a term of the document holds; one shuffle, of hits only."""
    bits = [F.when(F.contains("term", F.lit(k)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, k in enumerate(asked)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return postings.select("doc_id", mask.alias("held")).where("held <> 0").groupBy("doc_id").agg(F.bit_or("held").alias("held"))


def _named(asked: list[str]):
    """The keywords whose bits are set in held."""
    return F.filter(F.array(*[F.when(F.col("held").bitwiseAND(F.lit(1 << i)) != 0, F.lit(k)) for i, k in enumerate(asked)]), lambda k: k.isNotNull())


def docs_containing(postings: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, doc_id): documents with a term that holds the keyword."""
    asked = [k for k in dict.fromkeys(keywords) if k]
    if not asked:
        return postings.where("false").select(F.col("term").alias("keyword"), "doc_id")
    return _held(postings, asked).select(F.explode(_named(asked)).alias("keyword"), "doc_id")


def docs_containing_all(postings: DataFrame, keywords: list[str]) -> DataFrame:
    asked = list(dict.fromkeys(keywords))
    if not asked or "" in asked:
        return postings.where("false").select("doc_id")
    return _held(postings, asked).where(F.col("held") == F.lit((1 << len(asked)) - 1)).select("doc_id")


def _counts(flags: DataFrame, asked: list[str]) -> DataFrame:
    """(keyword, documents) from one row with a count for each keyword."""
    return flags.select(F.inline(F.array(*[F.struct(F.lit(k).alias("keyword"), F.coalesce(F.col(f"k{i}"), F.lit(0)).cast("long").alias("documents")) for i, k in enumerate(asked)])))


def keyword_doc_counts(postings: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, documents) over all languages; keywords in no document have 0."""
    asked = list(dict.fromkeys(keywords))
    if not asked:
        return postings.where("false").select(F.col("term").alias("keyword"), F.lit(0).cast("long").alias("documents"))
    held = _held(postings.where(F.lit(any(asked))), asked)
    return _counts(held.agg(*[F.count_if((F.col("held").bitwiseAND(F.lit(1 << i)) != 0) & F.lit(k != "")).alias(f"k{i}") for i, k in enumerate(asked)]), asked)


def keyword_doc_counts_by_scan(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """keyword_doc_counts() from the documents: of tokens' characters only, a keyword is in a term where it is in the text."""
    asked = list(dict.fromkeys(keywords))
    if not asked:
        return docs.where("false").select(F.col("id").cast("string").alias("keyword"), F.lit(0).cast("long").alias("documents"))
    return _counts(docs.agg(*[F.count_if(F.contains("searchable", F.lit(k)) & F.lit(k != "")).alias(f"k{i}") for i, k in enumerate(asked)]), asked)


def prefix_terms(terms: DataFrame, prefix: str) -> DataFrame:
    return terms.where(F.startswith("term", F.lit(prefix)))
