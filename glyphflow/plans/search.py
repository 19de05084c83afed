"""The search: request checks and correction on the driver, everything about documents as one lazy plan."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import searchable, tokenize
from ..operators import fuzzy, index as ix, match, rank, snippet
from ..operators.flow import of_language, within_language

MOST_KEYWORDS = 50


@dataclass
class SearchResponse:
    query: str
    language: str = "all"
    algorithm: str = ""
    requested_algorithm: str = ""
    algorithm_note: str | None = None
    mode: str = "single"
    search_mode: str = "exact"
    execution_time_ms: float = 0.0
    documents_scanned: int = 0
    total_documents: int = 0
    total_results: int = 0
    keyword_count: int = 0
    keywords: list[str] = field(default_factory=list)
    keyword_document_counts: dict[str, int] = field(default_factory=dict)
    corrections: list[dict] = field(default_factory=list)
    suggestions: dict[str, list[dict]] = field(default_factory=dict)
    message: str | None = None
    error: str | None = None
    results: DataFrame | None = None


def matches(docs: DataFrame, keywords: list[str], language: str = "all", with_snippet: bool = False) -> DataFrame:
    """Documents that hold every keyword, scored; unordered.

    The cheap containment test comes first and filters; counts and scores are computed for what is left.
    """
    docs = of_language(docs, language)
    for k in keywords:
        docs = docs.where(F.contains("searchable", F.lit(k)))
    counts = [match.count_overlapping(F.col("searchable"), k).cast("int") for k in keywords]
    total, title, exact = F.lit(0), F.lit(False), F.lit(True)
    for k, n in zip(keywords, counts, strict=True):
        total = total + n
        title = title | F.contains("searchable_title", F.lit(k))
        exact = exact & match.whole_word(F.col("searchable"), k)
    out = docs.select(
        F.col("id").alias("doc_id"), "title", "language", total.cast("int").alias("match_count"), rank.score(total, title, exact).alias("score"),
        F.create_map(*[x for k, n in zip(keywords, counts, strict=True) for x in (F.lit(k), n)]).alias("keyword_frequencies"), F.array(*map(F.lit, keywords)).alias("matched_keywords"),
        *([snippet.snippet(F.col("normalized"), F.col("searchable"), keywords).alias("snippet")] if with_snippet else []),
    )
    return out


def matches_by_index(index: ix.Index, keywords: list[str], language: str = "all") -> DataFrame:
    """The same rows by way of the postings: candidates first, then only their texts."""
    hits = ix.docs_containing_all(index.postings, keywords)
    return matches(index.docs.join(hits, index.docs["id"] == hits["doc_id"], "left_semi"), keywords, language)


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("score"), F.desc("match_count"), "title", "doc_id")


def counted(docs: DataFrame, keywords: list[str], language: str = "all") -> tuple[int, int, dict[str, int]]:
    """In one pass: all documents, those of the language that hold every keyword, and for each keyword those that hold it."""
    holds = [F.contains("searchable", F.lit(k)) for k in keywords]
    every = within_language(language)
    for h in holds:
        every = every & h
    row = docs.agg(F.count("*").alias("total"), F.count_if(every).alias("every"), *[F.count_if(h).alias(f"k{i}") for i, h in enumerate(holds)]).first()
    return row["total"], row["every"], {k: row[f"k{i}"] for i, k in enumerate(keywords)}


def _message(response: SearchResponse, absent: list[str]) -> str | None:
    if response.total_results:
        return "Showing results for " + ", ".join(f"{c['original']} -> {c['corrected']} (edit distance {c['editDistance']})" for c in response.corrections) if response.corrections else None
    if absent:
        said = ", ".join(absent) + (" does" if len(absent) == 1 else " do") + " not appear in the indexed dictionary."
        return said + (" See the suggestions or use fuzzy search." if any(response.suggestions.get(k) for k in absent) else "")
    where = "" if response.language.strip().lower() in ("", "all") else " in the selected language"
    return f"No document{where} holds all of the keywords." if response.mode == "multi" else f"No document{where} holds the keyword."


def search(index: ix.Index, query: str | None, language: str | None = "all", algorithm: str | None = "auto", search_mode: str | None = "exact") -> SearchResponse:
    began = time.perf_counter()
    fuzzily = (search_mode or "").strip().lower() == "fuzzy"
    words = tokenize(query)
    response = SearchResponse(query or "", language or "all", requested_algorithm=algorithm or "auto", search_mode="fuzzy" if fuzzily else "exact")
    response.algorithm = match.resolve_algorithm(algorithm, 1)
    if not words:
        response.message = "Enter at least one keyword."
        return response
    if len(words) > MOST_KEYWORDS:
        response.error = f"The query has {len(words)} keywords; the maximum is {MOST_KEYWORDS}."
        return response
    keywords = list(dict.fromkeys(words))
    #: Keywords are of tokens' characters only, so one is in a dictionary term where it is in a text.
    total, found, counts = counted(index.docs, keywords, language)
    absent = [k for k in keywords if not counts[k]]
    if absent:
        for r in fuzzy.suggest(index.terms, absent).orderBy("keyword", "rank").collect():  # five a keyword
            response.suggestions.setdefault(r["keyword"], []).append({"term": r["term"], "distance": r["distance"], "documentFrequency": r["df"]})
    if fuzzily:
        for i, k in enumerate(keywords):
            if near := response.suggestions.get(k) if k in absent else None:
                response.corrections.append({"original": k, "corrected": near[0]["term"], "editDistance": near[0]["distance"], "alternatives": [s["term"] for s in near[1:]]})
                keywords[i] = near[0]["term"]
        absent = [k for k in absent if k in keywords]
        keywords = list(dict.fromkeys(keywords))
    response.keywords, response.keyword_count = keywords, len(keywords)
    response.mode = "single" if len(keywords) == 1 else "multi"
    response.algorithm = match.resolve_algorithm(algorithm, len(keywords))
    if len(keywords) > 1 and response.algorithm != "ahocorasick":
        response.algorithm_note = f"{response.algorithm} finds one keyword; Aho-Corasick is used for {len(keywords)}."
        response.algorithm = "ahocorasick"
    if response.corrections:
        total, found, counts = counted(index.docs, keywords, language)
    response.keyword_document_counts = counts
    response.results = ordered(matches(index.docs, keywords, language, with_snippet=True))
    response.total_documents, response.documents_scanned, response.total_results = total, found, found
    response.message = _message(response, absent)
    response.execution_time_ms = round((time.perf_counter() - began) * 1e3, 4)
    return response


def compare(index: ix.Index, query: str, language: str = "all") -> list[dict]:
    """The five matchers over their candidates: matches, documents scanned and time."""
    if not (query or "").strip():
        raise ValueError("enter a keyword")
    keywords = list(dict.fromkeys(tokenize(query))) or [searchable(query).strip()]
    total, out = index.docs.count(), []
    for name in ("naive", "kmp", "rabinkarp", "zalgorithm", "ahocorasick"):
        many = name == "ahocorasick"
        asked = keywords if many else keywords[:1]
        docs = of_language(index.docs, language)
        for k in asked:
            docs = docs.where(F.contains("searchable", F.lit(k)))
        began = time.perf_counter()
        places = match.all_positions(F.col("searchable"), asked) if many else F.create_map(F.lit(asked[0]), match.positions(F.col("searchable"), asked[0], name))
        n = F.aggregate(F.map_values(places), F.lit(0), lambda a, p: a + F.size(p))
        row = docs.select(n.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.count("*").alias("docs")).first()
        out.append({
            "algorithm": name, "executionTimeMs": round((time.perf_counter() - began) * 1e3, 4), "matches": int(row["matches"]), "documentsScanned": row["docs"], "totalDocuments": total,
            "patternLength": len(asked) if many else len(asked[0]), "scope": "all keywords" if many else "first keyword",
        })
    return out
