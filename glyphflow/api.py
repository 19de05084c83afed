"""The service's requests as Python functions, and a small HTTP server over them."""

from __future__ import annotations

import json
from dataclasses import asdict, replace
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import unquote_plus

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import tokenize
from .operators import flow, fuzzy, stats
from .operators import index as ix
from .plans import search as plan
from .sources.corpus import load_corpus

NAMES = {"requested_algorithm": "requestedAlgorithm", "algorithm_note": "algorithmNote", "search_mode": "searchMode", "execution_time_ms": "executionTimeMs", "documents_scanned": "documentsScanned", "total_documents": "totalDocuments", "total_results": "totalResults", "keyword_count": "keywordCount", "keyword_document_counts": "keywordDocumentCounts"}


#: What the statistics list as algorithms.
ALGORITHMS = ["Naive", "KMP", "Rabin-Karp", "Z-Algorithm", "Aho-Corasick", "Trie", "Levenshtein (DP)", "Ford-Fulkerson", "Edmonds-Karp", "Dinic", "Min-Cut"]


class NotFound(Exception):
    pass


class Service:
    """Requests over one index, which a rebuild replaces as a whole."""

    def __init__(self, spark: SparkSession, root: str | None = None, docs=None):
        self.spark, self.root, self.searches, self.lock = spark, root, 0, Lock()
        self.index, self.built = None, None
        self.rebuild(docs)

    def rebuild(self, docs=None) -> dict:
        new = ix.Index(load_corpus(self.spark, self.root) if docs is None else docs).persist()
        count = new.docs.count()
        old, self.index, self.built = self.index, new, datetime.now(UTC).isoformat()
        if old is not None:
            old.unpersist()
        return {"status": "rebuilt", "documentCount": count}

    def search(self, query: str = "", language: str = "all", algorithm: str = "auto", mode: str = "", searchMode: str = "exact") -> dict:  # noqa: N803
        out = self.search_stream(query, language, algorithm, mode, searchMode)
        return out | {"results": list(out["results"])}

    def search_stream(self, query: str = "", language: str = "all", algorithm: str = "auto", mode: str = "", searchMode: str = "exact") -> dict:  # noqa: N803
        """A search whose results are an iterator: they come from the executors a partition at a time."""
        with self.lock:
            self.searches += 1
        found = plan.search(self.index, query, language, algorithm, searchMode)
        if found.error:
            return {"error": found.error, "results": iter(())}
        rows = iter(()) if found.results is None else (
            {"documentId": r["doc_id"], "title": r["title"], "language": r["language"], "matchCount": r["match_count"], "score": r["score"], "snippet": r["snippet"], "matchedKeywords": r["matched_keywords"], "keywordFrequencies": r["keyword_frequencies"]}
            for r in found.results.toLocalIterator()
        )
        return {NAMES.get(k, k): v for k, v in asdict(replace(found, results=None)).items() if k not in ("results", "error")} | {"results": rows}

    def suggest(self, term: str = "", limit: str | int = 5) -> dict:
        words = tokenize(term)
        if not words:
            raise ValueError("enter a term")
        try:
            most = min(20, max(1, int(limit)))
        except (TypeError, ValueError):
            most = 5
        rows = fuzzy.suggest(self.index.terms, words[:1], most).orderBy("rank").collect()
        return {
            "term": words[0], "existsInDictionary": ix.dictionary_contains(self.index.terms, words[0]), "maxDistance": fuzzy.max_distance_for(words[0]),
            "suggestions": [{"term": r["term"], "distance": r["distance"], "documentFrequency": r["df"]} for r in rows],
        }

    def flow(self, query: str = "", language: str = "all", algorithm: str = "dinic", demand: str | int = 1) -> dict:
        try:
            wanted = int(demand)
        except (TypeError, ValueError):
            wanted = 1
        report = flow.analyze(self.index.docs, query, language, algorithm, wanted)
        shown = report.matching.limit(flow.MATCHING_SHOWN).collect()
        return report.values | {"matching": [{"keyword": r["keyword"], "documentId": r["doc_id"], "title": r["title"]} for r in shown]}

    def statistics(self) -> dict:
        row = stats.totals(self.index).first()
        by = {r["language"]: r["documents"] for r in stats.by_language(self.index.docs).collect()}
        return {
            "languages": list(by), "languageCount": len(by), "documentsByLanguage": by, "documentCount": row["documents"], "indexedTerms": row["terms"], "totalPostings": row["postings"], "totalCharacters": row["characters"],
            "indexStatus": "Ready", "totalSearches": self.searches, "lastIndexBuild": self.built, "maxKeywordsPerQuery": plan.MOST_KEYWORDS, "algorithms": ALGORITHMS,
        }

    def languages(self) -> dict:
        return {"languages": [r["language"] for r in stats.languages(self.index.docs).collect()]}

    def document(self, id: str) -> dict:
        row = self.index.docs.where(F.col("id") == id).select("id", "title", "language", F.col("original").alias("content")).first()
        if row is None:
            raise NotFound(id)
        return row.asDict()

    def performance(self, query: str = "", language: str = "all") -> dict:
        return {"query": query, "language": language, "comparison": plan.compare(self.index, query, language)}


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def parse_query(raw: str) -> dict[str, str]:
    """Parameters of a query string; the last of a name wins, parts without "=" are dropped."""
    return {unquote_plus(k): unquote_plus(v) for k, eq, v in (p.partition("=") for p in raw.split("&")) if eq}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    routes = {"search": service.search_stream, "suggest": service.suggest, "flow": service.flow, "statistics": service.statistics, "languages": service.languages, "performance": service.performance, "index/rebuild": service.rebuild}

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _head(self, code: int, *more: tuple[str, str]) -> None:
            self.send_response(code)
            for k, v in (("Content-Type", "application/json; charset=utf-8"), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type"), *more):
                self.send_header(k, v)
            self.end_headers()

        def _send(self, code: int, value=None) -> None:
            body = b"" if value is None else to_json(value).encode()
            self._head(code, ("Content-Length", str(len(body))))
            self.wfile.write(body)

        def _stream(self, value: dict) -> None:
            """A search's answer in chunks; its results never are in memory together."""
            rows = value.pop("results")
            first = next(rows, None)  # an error comes before the head
            self._head(200, ("Transfer-Encoding", "chunked"))

            def chunk(text: str) -> None:
                raw = text.encode()
                self.wfile.write(b"%x\r\n%s\r\n" % (len(raw), raw))

            chunk(to_json(value)[:-1] + ', "results": [' + ("" if first is None else to_json(first)))
            for r in rows:
                chunk(", " + to_json(r))
            chunk("]}")
            self.wfile.write(b"0\r\n\r\n")

        def do_OPTIONS(self) -> None:  # noqa: N802
            self._send(204)

        def do_GET(self) -> None:  # noqa: N802
            path, _, query = self.path.partition("?")
            name = path.removeprefix("/api/")
            try:
                if name.startswith("documents/"):
                    out = service.document(unquote_plus(name.removeprefix("documents/")))
                elif name in routes:
                    call = routes[name]
                    wanted = call.__func__.__code__.co_varnames[1 : call.__func__.__code__.co_argcount]
                    out = call(**{k: v for k, v in parse_query(query).items() if k in wanted and k != "docs"})
                else:
                    raise NotFound(name)
                if out.get("error"):
                    self._send(400, {"error": out["error"]})
                elif name == "search":
                    self._stream(out)
                else:
                    self._send(200, out)
            except NotFound as e:
                self._send(404, {"error": f"not found: {e}"})
            except ValueError as e:
                self._send(400, {"error": str(e)})
            except Exception as e:  # a request must not end the server
                self._send(500, {"error": str(e)})

        do_POST = do_GET

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(service: Service, port: int = 8080) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(service))
