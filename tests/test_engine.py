"""The text search engine: units, in-memory corpora, and properties against plain Python."""

import json
import os
import random
import unicodedata
from collections import Counter
from datetime import datetime
from threading import Thread
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from glyphflow import api, catalogue
from glyphflow.functions import text as T
from glyphflow.operators import flow, fuzzy, match, snippet, stats
from glyphflow.operators import index as ix
from glyphflow.plans import search as plan
from glyphflow.sources import corpus
from glyphflow.streaming import ingest

FX = [
    ("tea", "Green Tea", "english", "Green tea grows in the hills.\nA green Teahouse serves tea.\n\nTea and rain and roads of the north."),
    ("pots", "Teapots", "english", "Hot tea needs time."),
    ("hi", "भारत", "hindi", "भारत एक देश है। भारतीय"),
    ("te", "తెలుగు", "telugu", "తెలుగు భాష‌లో దేశ"),
    ("many", "Numbered words", "english", " ".join(f"n{i}q" for i in range(50)) + " "),
    ("fewer", "One word less", "english", " ".join(f"n{i}q" for i in range(49)) + " "),
]


@pytest.fixture(scope="module")
def index(spark):
    return ix.Index(corpus.from_rows(spark, FX)).persist()


def index_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_fold_keeps_length_and_only_folds_latin():
    assert len(T.UPPER) == len(T.LOWER) == 222
    assert T.fold("İÀŽABC") == "iàžabc" and T.fold("ΣБ") == "ΣБ" and T.fold("ǅ") == "ǅ"


def test_tokens(spark):
    texts = ["Hello, wörld! x‌y", "", None, "a𝒜b", "भारत है।", "  two  words ", "123abc_4"]
    docs = corpus.from_rows(spark, [(str(i), "t", "x", t) for i, t in enumerate(texts)])
    got = {}
    for r in T.tokens(docs).collect():
        got.setdefault(r["id"], []).append((r["start"], r["term"]))
    for i, t in enumerate(texts):
        s = T.searchable(t)
        found = [w for _, w in sorted(got.get(str(i), []))]
        assert found == T.tokenize(t)
        assert all(s[a : a + len(w)] == w for a, w in got.get(str(i), []))


def test_text_helpers(spark):
    row = spark.createDataFrame([("é  a\tb \n", "a,b। c．(d)", "తెతెab", "")], "a string, b string, c string, d string").select(
        T.preprocess(F.col("a")).alias("a"), T.strip_punctuation(F.col("b")).alias("b"), T.detect_script(F.col("c")).alias("c"), T.detect_script(F.col("d")).alias("d"), T.normalize(F.lit(None).cast("string")).alias("e")
    ).first()
    assert row["a"] == "é a b" and row["b"].startswith("a b c") and row["c"] == "telugu" and row["d"] == "unknown" and row["e"] == ""


def test_load_corpus(spark, tmp_path):
    for path, content in {"english/document1.txt": "TITLE:  One \n\n Body é\n", "english/document10.txt": "plain\n", "english/document2.txt": "TITLE: alone", "hindi/document1.txt": "भारत\n", "english/skip.md": "x", "hindi/deep/document9.txt": "x", "top.txt": "x"}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(content, encoding="utf-8")
    rows = corpus.load_corpus(spark, str(tmp_path)).orderBy("language", "ord").collect()
    assert [(r["id"], r["title"], r["original"]) for r in rows] == [
        ("english-document1", "One", "Body é\n"), ("english-document10", "English Document 10", "plain\n"), ("english-document2", "alone", ""), ("hindi-document1", "Hindi Document 1", "भारत\n"),
    ]
    with pytest.raises(FileNotFoundError):
        corpus.load_corpus(spark, str(tmp_path / "none"))
    (tmp_path / "english/document3.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception):  # noqa: B017
        corpus.load_corpus(spark, str(tmp_path)).collect()


def test_kernels_agree():
    r = random.Random(42)
    for _ in range(400):
        text = "".join(r.choice("aab") for _ in range(r.randrange(30)))
        p = "".join(r.choice("ab") for _ in range(r.randrange(5)))
        want = [i for i in range(len(text)) if p and text.startswith(p, i)]
        for name, kernel in match.KERNELS.items():
            assert kernel(text, p) == want, name
    assert match.kmp("banana", "ana") == [1, 3] and match.naive("aaaa", "aa") == [0, 1, 2]
    assert match.z_array("aabcaabxaaaz") == [12, 1, 0, 0, 3, 1, 0, 0, 2, 2, 1, 0] and match.z_array("") == []


def test_aho_corasick_and_trie():
    machine = match.AhoCorasick(["he", "she", "his", "hers"])
    assert set(machine.search_all("ushers")) == {"he", "she", "hers"} and machine.count_all("hehe") == {"he": 2}
    assert not machine.contains_all("ushers") and match.AhoCorasick(["a"]).contains_all("ba") and not match.AhoCorasick([]).contains_all("x")
    assert len(match.AhoCorasick(["a"]).search_all("banana")["a"]) == 3
    trie = match.Trie(["car", "cart", "dog"])
    assert trie.search("car") and not trie.search("ca") and trie.starts_with("ca") and trie.words_with_prefix("car") == ["car", "cart"] and trie.words_with_prefix("x") == []


def test_algorithm_names():
    assert [match.resolve_algorithm(a, n) for a, n in ((None, 1), ("auto", 2), ("Z-algo", 1), ("R K", 1), ("aho", 1), ("odd", 3))] == ["kmp", "ahocorasick", "zalgorithm", "rabinkarp", "ahocorasick", "kmp"]
    assert [flow.resolve_solver(a) for a in ("Ford-Fulkerson", "ek", None, "x")] == ["fordfulkerson", "edmondskarp", "dinic", "dinic"]


def test_counts_and_positions(spark):
    docs = spark.createDataFrame([("banana",), ("aaaa",), ("a.a.a",), ("",)], "s string")
    rows = docs.select(match.count_overlapping(F.col("s"), "ana"), match.count_overlapping(F.col("s"), "aa"), match.count_overlapping(F.col("s"), "."), match.positions(F.col("s"), "a")).collect()
    assert [tuple(r)[:3] for r in rows] == [(2, 0, 0), (0, 3, 0), (0, 0, 2), (0, 0, 0)] and rows[0][3] == [1, 3, 5]


def test_edit_distance(spark):
    assert fuzzy.dp_table("kitten", "sitting")[-1][-1] == 3
    assert fuzzy.edit_script("cat", "cart") == ["MATCH c", "MATCH a", "INSERT r", "MATCH t"] and fuzzy.edit_script("", "ab") == ["INSERT a", "INSERT b"]
    row = spark.createDataFrame([("kitten", "sitting")], "a string, b string").select(fuzzy.distance(F.col("a"), F.col("b")), fuzzy.distance_bounded(F.col("a"), F.col("b"), 2), fuzzy.distance(F.lit("भारत"), F.lit("भरत"))).first()
    assert tuple(row) == (3, 3, 1)
    assert [fuzzy.max_distance_for("x" * n) for n in (2, 4, 8, 9)] == [0, 1, 2, 3]


def test_search(spark, index):
    found = plan.search(index, "Tea green")
    rows = found.results.collect()
    assert [r["doc_id"] for r in rows] == ["tea"] and rows[0]["match_count"] == 6 and rows[0]["score"] == 65.71  # (24 + 20 + 10 + 15) / 105
    assert rows[0]["snippet"] == "[[Green]] [[tea]] grows in the hills.\nA [[green]] [[Tea]]house serves [[tea]].\n[[Tea]] and rain and roads of the north."
    assert found.mode == "multi" and found.algorithm == "ahocorasick" and found.keyword_document_counts == {"tea": 2, "green": 1} and found.message is None
    one = plan.search(index, "TEA", algorithm="naive")
    assert {r["doc_id"]: r["score"] for r in one.results.collect()}["pots"] == 46.67 and one.algorithm == "naive"  # (4 + 20 + 10 + 15) / 105
    assert one.total_results == 2 and one.total_documents == 6
    assert plan.search(index, "tea green", algorithm="kmp").algorithm_note


def test_search_edges(spark, index):
    assert plan.search(index, " ,.! ").message and plan.search(index, None).error is None
    assert "maximum is 50" in plan.search(index, " ".join(["x"] * 51)).error
    assert ids(plan.search(index, " ".join(f"n{i}q" for i in range(50))).results) == {"many"}
    assert plan.search(index, "भारत", "hindi").total_results == 1 and plan.search(index, "भारत", "english").total_results == 0
    assert "selected language" in plan.search(index, "भारत", "english").message
    assert plan.search(index, unicodedata.normalize("NFD", "తెలుగు"), "all").total_results == 1
    typo = plan.search(index, "gren")
    assert typo.total_results == 0 and typo.suggestions["gren"][0]["term"] == "green" and "suggestions" in typo.message
    mended = plan.search(index, "gren", search_mode="fuzzy")
    assert mended.total_results == 1 and mended.corrections[0]["editDistance"] == 1 and "gren -> green" in mended.message and mended.keyword_document_counts == {"green": 1}
    assert plan.search(index, "gree").suggestions == {}


def test_random_queries_match_containment(spark, index):
    texts = {i: T.searchable(t) for i, _, _, t in FX}
    r = random.Random(42)
    for _ in range(12):
        words = r.sample(T.tokenize(" ".join(t for *_, t in FX)), r.randrange(1, 4))
        words = list(dict.fromkeys(w[: r.randrange(1, len(w) + 1)] for w in words))
        want = {i for i, t in texts.items() if all(w in t for w in words)}
        assert ids(plan.matches(index.docs, words)) == want == ids(ix.docs_containing_all(index.postings, words)) == ids(plan.matches_by_index(index, words))


def test_postings_and_stats(spark, index):
    texts = {i: T.searchable(t) for i, _, _, t in FX}
    rows = index.postings.collect()
    assert sum(r["tf"] for r in rows) == sum(len(T.tokenize(t)) for t in texts.values())
    assert all(texts[r["doc_id"]][p : p + len(r["term"])] == r["term"] for r in rows for p in r["positions"])
    row = stats.totals(index).first()
    assert (row["documents"], row["languages"], row["postings"], row["characters"]) == (6, 3, len(rows), sum(map(len, texts.values())))
    held = ix.dictionary_held(index.terms, ["gree", "", "qqq"]).collect()
    assert [(r["keyword"], r["held"]) for r in held] == [("gree", True), ("", False), ("qqq", False)] and ix.dictionary_held(index.terms, []).count() == 0
    assert ix.dictionary_contains(index.terms, "gree") and not ix.dictionary_contains(index.terms, "") and ix.docs_containing(index.postings, []).count() == 0
    assert sorted(map(tuple, ix.build_dictionary(index.docs).collect())) == sorted(map(tuple, index.terms.collect()))
    asked = ["tea", "ea", "", "qqq", "tea", "भारत"]
    want = [(k, sum(k != "" and k in t for t in texts.values())) for k in dict.fromkeys(asked)]
    for counts in (ix.keyword_doc_counts(index.postings, asked), ix.keyword_doc_counts_by_scan(index.docs, asked)):
        assert [tuple(r) for r in counts.collect()] == want
    assert ix.keyword_doc_counts(index.postings, []).count() == ix.keyword_doc_counts_by_scan(index.docs, []).count() == 0
    assert [tuple(r) for r in ix.sorted_terms_containing(index.terms, ["te", "ea"]).collect()] == [("te", "tea"), ("te", "teahouse"), ("ea", "tea"), ("ea", "teahouse")]
    assert "Exchange" not in index_plan(ix.build_postings(index.docs))


def test_snippets():
    assert snippet.build("aaaa", {"aa": [0, 1, 2]}) == "[[aaaa]]" and snippet.build("abcd", {"ab": [0], "cd": [2]}) == "[[ab]][[cd]]"
    long = "x" * 200 + "key" + "y" * 300
    assert snippet.build(long, {"key": [200]}) == "... " + "x" * 80 + "[[key]]" + "y" * 157 + " ..."
    assert snippet.build("one\r\ntwo key\r\n", {"key": [9]}) == "two [[key]]" and snippet.head("z" * 201) == "z" * 200 + "..."
    assert snippet.extract("A Key here", ["KEY"]) == "A [[Key]] here"


def brute_flow(docs, keywords, demand):
    best = None
    for m in range(1 << len(keywords)):
        inside = [k for i, k in enumerate(keywords) if m >> i & 1]
        cap = demand * (len(keywords) - len(inside)) + sum(any(k in t for k in inside) for t in docs)
        best = cap if best is None else min(best, cap)
    return best


def test_flow(spark, index):
    r = random.Random(5)
    for n in range(4):
        rows = [(str(i), "t", "x", " ".join(r.sample(["aa", "bb", "cc", "dd"], r.randrange(4)))) for i in range(12)]
        report = flow.analyze(corpus.from_rows(spark, rows), "aa bb cc dd", demand=n + 1)
        v = report.values
        assert v["algorithmsAgree"] and v["minCut"]["equalsMaxFlow"] and v["maxFlow"] == brute_flow([t for *_, t in rows], ["aa", "bb", "cc", "dd"], n + 1)
        pairs = report.matching.collect()
        assert len(pairs) == v["maxFlow"] == len({p["doc_id"] for p in pairs}) and all(p["keyword"] in dict((i, t) for i, _, _, t in rows)[p["doc_id"]] for p in pairs)
        assert all(sum(p["keyword"] == k for p in pairs) <= n + 1 for k in v["keywords"])
    report = flow.analyze(index.docs, "tea green", algorithm="ek", demand=5).values
    assert not report["fullyMatched"] and report["unmatchedKeywords"] and report["algorithm"] == "Edmonds-Karp"
    assert [r["augmentationsOrPhases"] for r in report["algorithmRuns"][:2]] == [2, 2] and report["keywordDegrees"] == {"tea": 2, "green": 1} and report["totalEdges"] == 2 + 2 + 3
    cut = report["minCut"]
    assert cut["sourceSideKeywords"] == ["tea", "green"] and cut["cutEdges"] == [{"from": "tea", "to": "SINK", "capacity": 1}, {"from": "tea", "to": "pots", "capacity": 1}]
    for bad in ("", " ".join(f"k{i}" for i in range(51))):
        with pytest.raises(ValueError):
            flow.analyze(index.docs, bad)
    assert flow.analyze(index.docs, "rain " * 60).values["keywordNodes"] == 1


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_flow_of_many_classes(spark, monkeypatch, most):
    """Beyond MOST_CLASSES sets of keywords the kernel has the same flow, cut and matching size."""
    monkeypatch.setattr(flow, "MOST_CLASSES", most)
    r = random.Random(9)
    words = ["aa", "bb", "cc", "dd", "ee"]
    for demand in (1, 2, 3):
        rows = [(f"{i:03d}", "t", "x", " ".join(w for w, p in zip(words, (0.9, 0.6, 0.1, 0.08, 0.05), strict=True) if r.random() < p)) for i in range(40)]
        report = flow.analyze(corpus.from_rows(spark, rows), " ".join(words), demand=demand)
        v, texts, pairs = report.values, dict((i, t) for i, _, _, t in rows), report.matching.collect()
        assert v["maxFlow"] == brute_flow(texts.values(), words, demand) == len(pairs) == len({p["doc_id"] for p in pairs}) == v["matchingSize"]
        assert v["minCut"]["equalsMaxFlow"] and v["algorithmsAgree"] and all(p["keyword"] in texts[p["doc_id"]] for p in pairs)
        assert all(sum(p["keyword"] == k for p in pairs) <= demand for k in words)
        top = v["minCut"]["sourceSideKeywords"]
        assert v["minCut"]["capacity"] == len(v["minCut"]["cutEdges"]) if demand == 1 else sum(e["capacity"] for e in v["minCut"]["cutEdges"])
        assert {e["to"] for e in v["minCut"]["cutEdges"] if e["from"] == "SOURCE"} == set(words) - set(top)


def test_comparison(spark, index):
    rows = plan.compare(index, "tea green")
    assert len(rows) == 5 and {r["matches"] for r in rows[:4]} == {5} and rows[4]["matches"] == 6 and rows[4]["patternLength"] == 2
    with pytest.raises(ValueError):
        plan.compare(index, " ")


def test_api(spark):
    service = api.Service(spark, docs=corpus.from_rows(spark, FX))
    found = service.search(query="gren", searchMode="fuzzy")
    assert found["totalResults"] == 1 and found["results"][0]["documentId"] == "tea" and json.loads(api.to_json(found))
    assert found["algorithmNote"] is None and service.search(query="tea")["message"] is None
    assert service.suggest("gren x", "99")["suggestions"][0]["term"] == "green" and service.suggest("green", "odd")["existsInDictionary"]
    with pytest.raises(ValueError):
        service.suggest(" ")
    assert service.statistics()["documentCount"] == 6 and service.languages() == {"languages": ["english", "hindi", "telugu"]}
    assert service.document("pots")["content"] == "Hot tea needs time."
    with pytest.raises(api.NotFound):
        service.document("none")
    assert service.flow("rain", demand="x")["demand"] == 1 and service.performance("tea")["comparison"][0]["algorithm"] == "naive"
    assert service.rebuild(corpus.from_rows(spark, FX[:2])) == {"status": "rebuilt", "documentCount": 2}
    assert api.parse_query("a=1&a=2&b&c=%E0%A4%AD+x") == {"a": "2", "c": "भ x"}


def test_http(spark):
    service = api.Service(spark, docs=corpus.from_rows(spark, FX))
    server = api.serve(service, 0)
    Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, method="GET"):
        try:
            with urlopen(Request(f"http://127.0.0.1:{server.server_address[1]}{path}", method=method), timeout=120) as r:
                raw = r.read()
                return r.status, json.loads(raw) if raw else None, r.headers
        except HTTPError as e:
            return e.code, json.loads(e.read()), e.headers

    try:
        code, found, head = ask("/api/search?query=tea&language=english")
        assert code == 200 and [x["documentId"] for x in found["results"]] == ["tea", "pots"] and head["Access-Control-Allow-Origin"] == "*" and "message" in found and "algorithmNote" in found
        assert ask("/api/search?query=")[1]["results"] == [] and ask("/api/search?query=" + "+".join(f"k{i}" for i in range(51)))[0] == 400
        assert ask("/api/search?query=" + quote("भारत"))[1]["totalResults"] == 1
        assert ask("/api/languages")[1] == {"languages": ["english", "hindi", "telugu"]}
        code, said, _ = ask("/api/performance?query=tea")
        assert code == 200 and said["query"] == "tea" and said["language"] == "all" and len(said["comparison"]) == 5 and ask("/api/performance?query=")[0] == 400
        code, said, _ = ask("/api/flow?query=tea+green&demand=1")
        assert code == 200 and {"query", "language", "keywords", "demand", "algorithm", "keywordNodes", "documentNodes", "totalNodes", "keywordDocumentEdges", "totalEdges", "keywordDegrees", "requestedFlow", "maxFlow", "fullyMatched", "matchingSize", "matching", "unmatchedKeywords", "minCut", "algorithmRuns", "algorithmsAgree", "executionTimeMs", "totalTimeMs"} == set(said)
        assert said["maxFlow"] == 2 and {r["algorithm"] for r in said["algorithmRuns"]} == {"Ford-Fulkerson", "Edmonds-Karp", "Dinic"} and ask("/api/flow?query=")[0] == 400
        said = ask("/api/statistics")[1]
        assert said["indexStatus"] == "Ready" and said["algorithms"][0] == "Naive" and said["totalSearches"] == 4
        assert ask("/api/suggest?term=gren")[1]["suggestions"][0]["term"] == "green"
        assert ask("/api/documents/pots")[1]["title"] == "Teapots" and ask("/api/documents/none")[0] == 404 and ask("/api/none")[0] == 404
        assert ask("/api/search", "OPTIONS")[0] == 204
    finally:
        server.shutdown()


def test_streaming_ingest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one two one", "en"), (2, "two", "de"), (3, "gone", "en")], "doc_id long, text string, lang string")
    rows.write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.ingest(read(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([(2, "three", "de"), (3, "", "en")], rows.schema).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest(read(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r["term"], r["doc_id"], r["tf"]) for r in ingest.stored_postings(spark, f"{tmp_path}/out").collect()}
    assert got == {("one", "1", 2), ("two", "1", 1), ("three", "2", 1)}
    assert {tuple(r) for r in ingest.stored_counts(spark, f"{tmp_path}/out").collect()} == {("1", 2, 3), ("2", 1, 1)}


def test_flow_takes_each_text_once(spark, monkeypatch):
    """Texts are folded once in a pass; a matching of few documents a keyword is one pass and has the documents that numbering by slices gives."""
    docs = corpus.from_rows(spark, [(str(i), "t", "x", " ".join(w for b, w in enumerate(["alpha", "beta", "gamma"]) if i >> b & 1) + " É") for i in range(200)])
    plan_of = docs.sparkSession._jvm.PythonSQLUtils.explainString
    assert plan_of(flow.signatures(docs, ["alpha", "beta", "gamma"])._jdf.queryExecution(), "simple").count("translate(") == 1
    for demand in (1, 7, 60):
        at_once = flow.analyze(docs, "alpha beta gamma", demand=demand)
        monkeypatch.setattr(flow, "MOST_AT_ONCE", 0)
        by_slices = flow.analyze(docs, "alpha beta gamma", demand=demand)
        monkeypatch.undo()
        got, want = ([tuple(r) for r in x.matching.collect()] for x in (at_once, by_slices))
        assert got == want and len(got) == at_once.values["maxFlow"]
        assert at_once.values["keywordDegrees"] == dict.fromkeys(["alpha", "beta", "gamma"], 100) and at_once.values["documentNodes"] == 175


def test_words_and_texts_go_by_slices():
    """A batch is taken in slices: no more than a slice's results are held at once, and rows stay in order."""
    words = pa.array([f"w{i:06d}" for i in range(50_000)] + [None, ""])
    parts = list(T.by_slices(fuzzy.dp_table, pa.list_(pa.list_(pa.int32())), fuzzy.WORD_BYTES)(iter([(words, pa.array(["tion"] * len(words)))])))
    assert len(parts) > 5 and max(map(len, parts)) < 10_000
    got = pa.concat_arrays(parts)
    assert len(got) == len(words) and got[50_000].as_py() is None and all(got[i].as_py() == fuzzy.dp_table(words[i].as_py(), "tion") for i in (0, 31_777, 49_999, 50_001))
    assert T.TEXT_BYTES <= 1 << 20  # token_runs() takes fifty times that


def test_texts_reach_python_by_slices(spark):
    """Snippets and places come from functions that take their batches piece by piece, and rows stay with their texts over several pieces."""
    texts = [f"line {i}\n" + "haha the road " * (i % 5) + "x" * (T.TEXT_BYTES // 8) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    t = F.col("t")
    df = docs.select("i", snippet.snippet(t, t, ["haha"]).alias("s"), match.positions(t, "haha", "kmp").alias("p"), match.all_positions(t, ["haha", "the"]).alias("a"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}") >= 3
    for r in df.collect():
        x = texts[r["i"]]
        assert r["s"] == snippet.extract(x, ["haha"]) and r["p"] == match.find_all(x, "haha") and r["a"] == {k: match.find_all(x, k) for k in ("haha", "the") if k in x}


def test_matchers_are_compared_in_one_pass(spark, tmp_path):
    texts = ["haha hahaha", "Haha the haha", "the", "", None, "thethe HAHA"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.matcher_comparison(spark, str(tmp_path))
    assert df._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, df.collect())) == [("ahocorasick", 6, 2), *((k, 6, 3) for k in ("kmp", "naive", "rabinkarp", "zalgorithm"))]
    spark.createDataFrame([(1, "none", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert {tuple(r)[1:] for r in catalogue.matcher_comparison(spark, f"{tmp_path}/none").collect()} == {(None, 0)}


def test_quick_kernels_find_what_slow_search_finds(monkeypatch):
    """Texts over several of Rabin-Karp's parts, a pattern too long to be hashed at once, letters that mean something to a regular expression."""
    monkeypatch.setattr(match, "HASHED", 7)
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.choice(["ab", "ab^]-\\", "aé😀"])
        text, pattern = ("".join(rng.choice(letters) for _ in range(rng.randrange(n))) for n in (90, 5))
        assert all(f(text, pattern) == match.find_all(text, pattern) for f in match.KERNELS.values())
    long = "ab" * 40
    assert all(f("x" + long * 3, long) == match.find_all("x" + long * 3, long) for f in match.KERNELS.values())


def test_streams_of_tables_in_folders(spark, tmp_path):
    """The queries that stream a table take it as a single file and as a folder of files."""
    docs = spark.createDataFrame([(i, "one two one" if i % 2 else "two", "en") for i in range(6)], "doc_id long, text string, lang string")
    events = spark.createDataFrame([(datetime(2024, 1, 1, h), "ab"[h % 2]) for h in range(6)], "ts timestamp, event_type string")
    for name, df, query in (("documents", docs, catalogue.ingested_postings), ("events", events, catalogue.event_windows)):
        df.repartition(3).write.parquet(f"{tmp_path}/many/{name}.parquet")
        df.coalesce(1).write.parquet(f"{tmp_path}/one-{name}")
        (tmp_path / "one").mkdir(exist_ok=True)
        next((tmp_path / f"one-{name}").glob("*.parquet")).rename(tmp_path / f"one/{name}.parquet")
        many, one = (sorted(map(tuple, query(spark, f"{tmp_path}/{d}").collect())) for d in ("many", "one"))
        assert len(many) == 6 and many == one
        if name == "documents":
            assert many == [(str(i), 1 + i % 2, 1 + 2 * (i % 2)) for i in range(6)]


def test_window_counts(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, m), "a" if m % 2 else "b") for h in range(3) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string")
    df.write.parquet(f"{tmp_path}/in")
    ingest.write_counts(ingest.counts_by_window(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r["start"].hour, r["kind"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == dict(Counter((t.hour, k) for t, k in rows))


def test_normal_form(spark):
    texts = ["e\u0301", "é", "plain", None, "\u1100\u1161", "भ\u093c", "\u212b x", "a" * 5000 + "\u030a"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.normalize(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: unicodedata.normalize("NFC", t or "") for i, t in enumerate(texts)}


def test_sql_functions(spark):
    T.register(spark)
    row = spark.sql("select nfc('e\u0301') as a, searchable('ÀB') as b, tokenize('Hello, wörld! x') as c, edit_script('cat', 'cart') as d").first()
    assert tuple(row) == ("é", "àb", ["hello", "wörld", "x"], ["MATCH c", "MATCH a", "INSERT r", "MATCH t"])


def test_edit_scripts_rebuild(spark):
    pairs = [("kitten", "sitting"), ("", "abc"), ("abc", ""), ("भारत", "भरत"), ("😀a", "a😀"), ("INSERT", "DELETE")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.edit_script_udf("a", "b").alias("s"))
    assert all((r["a"], r["b"]) == (r["x"], r["y"]) for r in df.select("a", "b", fuzzy.source_of(F.col("s")).alias("x"), fuzzy.target_of(F.col("s")).alias("y")).collect())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
