"""Queries over the documents table and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import flow, fuzzy, match, rank, snippet, stats
from .operators import index as ix
from .plans import search as plan
from .sources.corpus import from_documents_table, register_views, to_json
from .streaming import ingest

TYPOS = ["teh", "andd", "tionn", "thatt", "ovver"]
FLOW = ["queue", "mente", "haha", "the"]
TARGET = "tion"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents_table(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.build_postings(documents(spark, sf_dir))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.build_dictionary(documents(spark, sf_dir))


def _search(*keywords: str, language: str = "all"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = plan.matches(documents(spark, sf_dir), list(keywords), language)
        return plan.ordered(found).select("doc_id", F.col("match_count").cast("long").alias("match_count"), "score")

    return run


def _positions(kernel: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = documents(spark, sf_dir)
        return docs.select(F.col("id").alias("doc_id"), F.array_join(match.positions(F.col("searchable"), "haha", kernel), ",").alias("positions"))

    return run


def tokens_offsets(spark, sf_dir):
    t = T.tokens(documents(spark, sf_dir))
    n = F.length("term")
    return t.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("tokens"), F.sum(F.col("start").cast("long")).alias("starts"), F.sum(F.col("start").cast("long") * n).alias("weighted"))


def count_all(spark, sf_dir):
    docs = documents(spark, sf_dir)
    counts = [match.count_overlapping(F.col("searchable"), k).cast("long").alias(k) for k in ("the", "tion", "haha")]
    return docs.select(F.col("id").alias("doc_id"), *counts)


def match_all(spark, sf_dir):
    found = F.map_entries(match.all_positions(F.col("searchable"), ["he", "she", "his", "hers"]))
    rows = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.explode(found).alias("e"))
    return rows.select("doc_id", F.col("e.key").alias("keyword"), F.size("e.value").cast("long").alias("n"))


def rank_title_bonus(spark, sf_dir):
    found = plan.matches(documents(spark, sf_dir), ["en"])
    return found.select("doc_id", F.col("match_count").cast("long").alias("match_count"), "score")


def suggest_topk(spark, sf_dir):
    found = fuzzy.suggest(terms(spark, sf_dir), TYPOS, 5)
    return found.select("keyword", F.col("rank").cast("long").alias("rank"), "term", F.col("distance").cast("long").alias("distance"), "df")


def levenshtein_bounded(spark, sf_dir):
    return terms(spark, sf_dir).select("term", fuzzy.distance(F.col("term"), F.lit("tion")).cast("long").alias("distance"), fuzzy.distance_bounded(F.col("term"), F.lit("tion"), 2).cast("long").alias("bounded"))


def max_distance(spark, sf_dir):
    return terms(spark, sf_dir).select("term", fuzzy.max_distance(F.col("term")).cast("long").alias("most"))


def fuzzy_correct(spark, sf_dir):
    best = fuzzy.suggest(terms(spark, sf_dir), TYPOS, 1)
    return best.select(F.col("keyword").alias("original"), F.col("term").alias("corrected"), F.col("distance").cast("long").alias("edit_distance"))


def edit_scripts(spark, sf_dir):
    """The steps from every term to TARGET: how many change something, and what they make of the term."""
    script = terms(spark, sf_dir).select("term", fuzzy.edit_script_udf("term", F.lit(TARGET)).alias("script"))
    changes = F.size(F.filter("script", lambda x: ~F.startswith(x, F.lit("MATCH")))).cast("long")
    return script.select("term", changes.alias("changes"), fuzzy.target_of(F.col("script")).alias("target"), fuzzy.source_of(F.col("script")).alias("source"))


def dp_tables(spark, sf_dir):
    """Of every term's distance table with TARGET: its rows, its last cell, and the sums of its first row and column."""
    t = terms(spark, sf_dir).select("term", fuzzy.dp_table_udf("term", F.lit(TARGET)).alias("t"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x).cast("long")
    last = F.element_at(F.element_at("t", -1), -1).cast("long")
    return t.select("term", F.size("t").cast("long").alias("n_rows"), last.alias("distance"), total(F.col("t")[0]).alias("first_row"), total(F.transform("t", lambda r: r[0])).alias("first_column"))


def snippets(spark, sf_dir):
    docs = documents(spark, sf_dir).where(F.contains("searchable", F.lit("haha")))
    return docs.select(F.col("id").alias("doc_id"), snippet.snippet(F.col("normalized"), F.col("searchable"), ["haha"]).alias("snippet"))


def stats_totals(spark, sf_dir):
    return stats.totals(ix.Index(documents(spark, sf_dir)))


def matcher_comparison(spark, sf_dir):
    """One pass over the texts for all algorithms; each scans the documents that hold all its keywords."""
    asked = {name: ["haha", "the"] if name == "ahocorasick" else ["haha"] for name in ("naive", "kmp", "rabinkarp", "zalgorithm", "ahocorasick")}
    some = documents(spark, sf_dir).where(F.contains("searchable", F.lit("haha")))
    sums = some.select(match.comparison(F.col("searchable"), asked).alias("n"))
    sums = sums.agg(*[f(F.col("n")[i]).alias(f"{of}{i}") for i in range(len(asked)) for of, f in (("n", F.sum), ("d", F.count))])
    rows = [F.struct(F.lit(name).alias("algorithm"), F.col(f"n{i}").alias("matches"), F.col(f"d{i}").alias("documents_scanned")) for i, name in enumerate(asked)]
    return sums.select(F.inline(F.array(*rows)))


def _flow(demand: int):
    def run(spark, sf_dir):
        v = flow.analyze(documents(spark, sf_dir), " ".join(FLOW), demand=demand).values
        cut = v["minCut"]
        row = (v["maxFlow"], v["requestedFlow"], v["totalNodes"], v["totalEdges"], cut["capacity"], ",".join(cut["sourceSideKeywords"]), cut["sourceSideDocuments"], cut["cutEdgeCount"])
        return spark.createDataFrame([row], "max_flow long, requested long, nodes long, edges long, cut_capacity long, source_keywords string, source_documents long, cut_edges long")

    return run


def flow_matching(spark, sf_dir):
    """For each keyword its documents in the matching, those that hold it, and those that serve another one too."""
    found = flow.analyze(documents(spark, sf_dir), " ".join(FLOW), demand=50).matching.select("keyword", "doc_id").collect()  # 50 a keyword at most
    pairs = F.broadcast(spark.createDataFrame(found, "keyword string, doc_id string"))
    uses = F.broadcast(pairs.groupBy("doc_id").agg(F.count("*").alias("uses")))
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = from_documents_table(table.where(F.col("doc_id").isNotNull()).join(uses.withColumnRenamed("doc_id", "key"), F.col("doc_id").cast("string") == F.col("key"), "left_semi"))
    rows = docs.select(F.col("id").alias("doc_id"), "searchable").join(pairs, "doc_id").join(uses, "doc_id")
    return rows.groupBy("keyword").agg(F.count("*").alias("assigned"), F.count_if(F.contains("searchable", F.col("keyword"))).alias("held"), F.count_if(F.col("uses") > 1).alias("shared"))


def search_counts(spark, sf_dir):
    total, every, counts = plan.counted(documents(spark, sf_dir), ["the", "haha", "qqqzzz"], "all")
    return spark.createDataFrame([(total, every, *counts.values())], "total long, every long, the long, haha long, qqqzzz long")


def sql_functions(spark, sf_dir):
    T.register(spark)
    raw(spark, sf_dir).createOrReplaceTempView("glyphflow_raw")
    return spark.sql("select doc_id, md5(searchable(text)) as digest, cast(size(tokenize(text)) as bigint) as n_tokens from glyphflow_raw")


def sql_views(spark, sf_dir):
    register_views(documents(spark, sf_dir), "glyphflow_")
    return spark.sql("select d.term, d.df, sum(p.tf) as occurrences from glyphflow_dictionary d join glyphflow_postings p on p.term = d.term group by d.term, d.df")


def ingested_postings(spark, sf_dir):
    """The documents table as a stream, through the ingest's batches."""
    at = ingest.work_folder(spark)
    ingest.ingest(ingest.table_stream(spark, f"{sf_dir}/documents.parquet"), f"{at}/out", f"{at}/state").awaitTermination()
    return ingest.stored_counts(spark, f"{at}/out")


def event_windows(spark, sf_dir):
    """Events as a stream, counted by hour and type."""
    at = ingest.work_folder(spark)
    events = ingest.table_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ingest.write_counts(ingest.counts_by_window(events), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "kind", "n")


def normalize_nfc(spark, sf_dir):
    return raw(spark, sf_dir).select("doc_id", T.normalize(F.regexp_replace("text", "e", "é")).alias("text")).select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


def documents_json(spark, sf_dir):
    return to_json(documents(spark, sf_dir).select("id", "title", "language"))


def text_query(column):
    return lambda spark, sf_dir: raw(spark, sf_dir).select("doc_id", column(F.col("text")).alias("value"))


def queries() -> dict:
    index = postings
    return {
        "search_single": _search("haha"),
        "search_and2": _search("the", "tion"),
        "search_and5": _search("the", "and", "tion", "of", "er"),
        "search_and_lang": _search("the", "tion", language="EN"),
        "search_by_index": lambda s, d: plan.matches_by_index(ix.Index(documents(s, d)), ["the", "tion"]).select("doc_id", F.col("match_count").cast("long").alias("match_count"), "score"),
        "rank_title_bonus": rank_title_bonus,
        "rank_exact_bonus": _search("queue"),
        "rank_formula": lambda s, d: s.range(0, 20).select(F.col("id").alias("n"), F.explode(F.array(F.lit(True), F.lit(False))).alias("hit")).select("n", "hit", rank.score(F.col("n"), F.col("hit"), ~F.col("hit")).alias("score")),
        "fold_case": text_query(lambda t: F.md5(T.fold_case(t))),
        "tokens_offsets": tokens_offsets,
        "postings": lambda s, d: index(s, d).select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions")),
        "dictionary_df": terms,
        "exact_term_docs": lambda s, d: ix.docs_of_term(index(s, d), "queue"),
        "exact_any": lambda s, d: ix.docs_of_any(index(s, d), ["queue", "mente", "the"]),
        "exact_all": lambda s, d: ix.docs_of_all(index(s, d), ["the", "of", "and"]),
        "terms_containing": lambda s, d: ix.terms_containing(terms(s, d), ["haha", "queue"]),
        "docs_containing": lambda s, d: ix.docs_containing(index(s, d), ["haha", "queue"]),
        "docs_containing_all": lambda s, d: ix.docs_containing_all(index(s, d), ["the", "tion"]),
        "dictionary_contains": lambda s, d: ix.dictionary_held(terms(s, d), ["the", "tionth", "qqqzzz"]),
        "keyword_doc_counts": lambda s, d: ix.keyword_doc_counts(index(s, d), ["the", "haha", "queue", "qqqzzz"]),
        "prefix_terms": lambda s, d: ix.prefix_terms(terms(s, d), "tion"),
        "match_positions": _positions("find"),
        "match_naive": _positions("naive"),
        "match_kmp": _positions("kmp"),
        "match_rabin_karp": _positions("rabinkarp"),
        "match_z": _positions("zalgorithm"),
        "match_aho": _positions("ahocorasick"),
        "match_all": match_all,
        "count_all": count_all,
        "matcher_comparison": matcher_comparison,
        "suggest_topk": suggest_topk,
        "levenshtein_bounded": levenshtein_bounded,
        "max_distance": max_distance,
        "fuzzy_correct": fuzzy_correct,
        "edit_script": edit_scripts,
        "dp_table": dp_tables,
        "snippet": snippets,
        "snippet_head": text_query(snippet.head_column),
        "stats_totals": stats_totals,
        "stats_by_language": lambda s, d: stats.by_language(documents(s, d)),
        "languages": lambda s, d: stats.languages(documents(s, d)),
        "document_by_id": lambda s, d: documents(s, d).where(F.col("id") == "17").select("id", "title", "language", "original"),
        "documents_json": documents_json,
        "flow_incidence": lambda s, d: flow.incidence(documents(s, d), FLOW),
        "flow_degrees": lambda s, d: flow.degrees(documents(s, d), FLOW).select("keyword", F.col("documents").cast("long").alias("documents")),
        "flow_summary": _flow(50),
        "flow_min_cut": _flow(400),
        "flow_matching": flow_matching,
        "search_counts": search_counts,
        "doc_counts_by_scan": lambda s, d: ix.keyword_doc_counts_by_scan(documents(s, d), ["the", "haha", "queue", "qqqzzz"]),
        "sorted_terms": lambda s, d: ix.sorted_terms_containing(terms(s, d), ["haha", "queue"]),
        "sql_functions": sql_functions,
        "sql_views": sql_views,
        "ingested_postings": ingested_postings,
        "event_windows": event_windows,
        "detect_script": text_query(T.detect_script),
        "preprocess": text_query(T.preprocess),
        "strip_punctuation": text_query(T.strip_punctuation),
        "normalize_nfc": normalize_nfc,
    }


def oracle_sql() -> dict[str, str]:
    t = r"[\p{L}\p{Nd}\p{M}\x{200C}\x{200D}]"
    base = f"""base as (select cast(doc_id as varchar) as doc_id, coalesce(text, '') as original, translate(coalesce(text, ''), '{T.UPPER}', '{T.LOWER}') as s,
        coalesce(lang, '') as language, upper(substr(coalesce(lang, ''), 1, 1)) || substr(coalesce(lang, ''), 2) || ' Document ' || doc_id as title from documents)"""
    runs = f"""runs as (select doc_id, unnest(regexp_extract_all(s, '{t}+|[^\\p{{L}}\\p{{Nd}}\\p{{M}}\\x{{200C}}\\x{{200D}}]+')) as run, generate_subscripts(regexp_extract_all(s, '{t}+|[^\\p{{L}}\\p{{Nd}}\\p{{M}}\\x{{200C}}\\x{{200D}}]+'), 1) as i from base),
        offs as (select doc_id, run, cast(coalesce(sum(length(run)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as start from runs),
        toks as (select doc_id, run as term, start from offs where regexp_matches(run, '^{t}'))"""
    words = f"words as (select distinct doc_id, unnest(regexp_extract_all(s, '{t}+')) as term from base)"
    dic = "dic as (select term, count(*) as df from words group by term)"

    def n(k: str) -> str:
        bordered = any(k[:i] == k[-i:] for i in range(1, len(k)))
        return f"len(list_filter(range(0, greatest(length(s) - {len(k)} + 1, 0)), lambda i: substr(s, cast(i as bigint) + 1, {len(k)}) = '{k}'))" if bordered else f"((length(s) - length(replace(s, '{k}', ''))) // {len(k)})"

    def search(*ks: str, where: str = "true") -> str:
        total = " + ".join(map(n, ks))
        exact = " and ".join(f"list_contains(regexp_extract_all(s, '{t}+'), '{k}')" for k in ks)
        title = " or ".join(f"contains(translate(title, '{T.UPPER}', '{T.LOWER}'), '{k}')" for k in ks)
        held = " and ".join(f"contains(s, '{k}')" for k in ks)
        return f"""with {base}, m as (select doc_id, cast({total} as bigint) as match_count, ({title}) as th, ({exact}) as ex from base where {held} and {where})
            select doc_id, match_count, round(least((4 * least(match_count, 15) + case when th then 20 else 0 end + case when ex then 10 else 0 end + 15.0) / cast(105 as double) * 100, 100), 2) as score from m"""

    places = f"with {base} select doc_id, case when contains(s, 'haha') then array_to_string(list_filter(range(0, length(s) - 3), lambda i: substr(s, cast(i as bigint) + 1, 4) = 'haha'), ',') else '' end as positions from base"
    #: DuckDB's levenshtein counts bytes, so every letter of the tables gets one of its own; terms have no capitals.
    odd = "ßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
    single = "translate(term, '" + odd + "', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&')"
    far, to_target = f"levenshtein({single}, keyword)", f"cast(levenshtein({single}, '{TARGET}') as bigint)"
    typos = ", ".join(f"('{k}', {fuzzy.max_distance_for(k)})" for k in TYPOS)
    near = f"""with {base}, {words}, {dic}, k(keyword, most) as (values {typos}),
        c as (select keyword, term, cast({far} as bigint) as distance, df from dic, k where abs(length(term) - length(keyword)) <= most and {far} <= most),
        r as (select *, row_number() over (partition by keyword order by distance, df desc, term) as rank from c)"""
    sig = " + ".join(f"(case when contains(s, '{k}') then {1 << i} else 0 end)" for i, k in enumerate(FLOW))

    def cut(demand: int) -> str:
        names = " || ".join(f"(case when m & {1 << i} > 0 then ',{k}' else '' end)" for i, k in enumerate(FLOW))
        return f"""with {base}, c as (select sig, count(*) as n from (select {sig} as sig from base) where sig > 0 group by 1),
            sub as (select range as m, cast(bit_count(cast(range as bigint)) as bigint) as size from range(0, {1 << len(FLOW)})),
            v as (select m, size, {demand} * ({len(FLOW)} - size) + coalesce((select sum(n) from c where c.sig & m > 0), 0) as cap from sub),
            b as (select * from v order by cap, size, m limit 1),
            d as (select sum(n) as docs, sum(n * cast(bit_count(cast(sig as bigint)) as bigint)) as inc from c),
            s2 as (select coalesce(sum(case when cast(bit_count(cast(sig & m as bigint)) as bigint) >= 2 then n end), 0) as shared, coalesce(sum(case when sig & m > 0 then n end), 0) as held from c, b)
            select cast(cap as bigint) as max_flow, cast({demand * len(FLOW)} as bigint) as requested, cast(2 + {len(FLOW)} + docs as bigint) as nodes, cast({len(FLOW)} + docs + inc as bigint) as edges,
              cast(cap as bigint) as cut_capacity, ltrim({names}, ',') as source_keywords, cast(shared as bigint) as source_documents, cast({len(FLOW)} - size + held as bigint) as cut_edges from b, d, s2"""

    def text(value: str) -> str:
        return f"with {base} select doc_id, {value} as value from base"

    space = r"[\x09-\x0d ]+"
    script = {name: f"len(regexp_extract_all(original, '[\\x{{{a:04X}}}-\\x{{{b:04X}}}]'))" for name, a, b in T.SCRIPTS}
    script["english"] = r"len(list_filter(regexp_extract_all(original, '\p{L}'), lambda c: unicode(c) < 592))"
    most = f"greatest({', '.join(script.values())})"
    cases = " ".join(f"when {x} = {most} then '{name}'" for name, x in script.items())
    out = {
        "search_single": search("haha"),
        "search_and2": search("the", "tion"),
        "search_and5": search("the", "and", "tion", "of", "er"),
        "search_and_lang": search("the", "tion", where="lower(language) = 'en'"),
        "search_by_index": search("the", "tion"),
        "rank_title_bonus": search("en"),
        "rank_exact_bonus": search("queue"),
        "rank_formula": "select range as n, hit, round(least((4 * least(range, 15) + case when hit then 20 else 0 end + case when hit then 0 else 10 end + 15.0) / cast(105 as double) * 100, 100), 2) as score from range(0, 20), (values (true), (false)) t(hit)",
        "fold_case": text("md5(s)"),
        "tokens_offsets": f"with {base}, {runs} select doc_id, count(*) as tokens, cast(sum(start) as bigint) as starts, cast(sum(start * length(term)) as bigint) as weighted from toks group by 1",
        "postings": f"with {base}, {runs} select term, doc_id, count(*) as tf, string_agg(cast(start as varchar), ',' order by start) as positions from toks group by 1, 2",
        "dictionary_df": f"with {base}, {words}, {dic} select term, df from dic",
        "exact_term_docs": f"with {base}, {words} select doc_id from words where term = 'queue'",
        "exact_any": f"with {base}, {words} select distinct doc_id from words where term in ('queue', 'mente', 'the')",
        "exact_all": f"with {base}, {words} select doc_id from words where term in ('the', 'of', 'and') group by 1 having count(*) = 3",
        "terms_containing": f"with {base}, {words}, {dic} select keyword, term from dic, (values ('haha'), ('queue')) k(keyword) where contains(term, keyword)",
        "docs_containing": f"with {base} select keyword, doc_id from base, (values ('haha'), ('queue')) k(keyword) where contains(s, keyword)",
        "docs_containing_all": f"with {base} select doc_id from base where contains(s, 'the') and contains(s, 'tion')",
        "dictionary_contains": f"with {base} select keyword, (select bool_or(contains(s, keyword)) from base) as held from (values ('the'), ('tionth'), ('qqqzzz')) k(keyword)",
        "keyword_doc_counts": f"with {base} select keyword, (select count(*) from base where contains(s, keyword)) as documents from (values ('the'), ('haha'), ('queue'), ('qqqzzz')) k(keyword)",
        "prefix_terms": f"with {base}, {words}, {dic} select term, df from dic where starts_with(term, 'tion')",
        "match_all": f"with {base}, m as ({' union all '.join(f'''select doc_id, '{k}' as keyword, cast({n(k)} as bigint) as n from base''' for k in ('he', 'she', 'his', 'hers'))}) select * from m where n > 0",
        "count_all": f"with {base} select doc_id, cast({n('the')} as bigint) as the, cast({n('tion')} as bigint) as tion, cast({n('haha')} as bigint) as haha from base",
        "matcher_comparison": f"with {base}, one as (select cast(sum({n('haha')}) as bigint) as matches, count(*) as documents_scanned from base where contains(s, 'haha')), two as (select cast(sum({n('haha')} + {n('the')}) as bigint) as matches, count(*) as documents_scanned from base where contains(s, 'haha') and contains(s, 'the')) select algorithm, matches, documents_scanned from one, (values ('naive'), ('kmp'), ('rabinkarp'), ('zalgorithm')) a(algorithm) union all select 'ahocorasick', matches, documents_scanned from two",
        "suggest_topk": near + " select keyword, rank, term, distance, df from r where rank <= 5",
        "fuzzy_correct": near + " select keyword as original, term as corrected, distance as edit_distance from r where rank = 1",
        "levenshtein_bounded": f"with {base}, {words}, {dic} select term, {to_target} as distance, least({to_target}, 3) as bounded from dic",
        "edit_script": f"with {base}, {words}, {dic} select term, {to_target} as changes, '{TARGET}' as target, term as source from dic",
        "dp_table": f"with {base}, {words}, {dic} select term, length(term) + 1 as n_rows, {to_target} as distance, cast({sum(range(len(TARGET) + 1))} as bigint) as first_row, (length(term) * (length(term) + 1)) // 2 as first_column from dic",
        "flow_matching": f"with {base}, v as (select keyword, (select count(*) from base where contains(s, keyword)) as n from (values {', '.join(f'''('{k}')''' for k in FLOW)}) k(keyword)) select keyword, least(n, 50) as assigned, least(n, 50) as held, cast(0 as bigint) as shared from v where n > 0",
        "search_counts": f"with {base} select count(*) as total, count(*) filter (contains(s, 'the') and contains(s, 'haha') and contains(s, 'qqqzzz')) as every, count(*) filter (contains(s, 'the')) as the, count(*) filter (contains(s, 'haha')) as haha, count(*) filter (contains(s, 'qqqzzz')) as qqqzzz from base",
        "doc_counts_by_scan": f"with {base} select keyword, (select count(*) from base where contains(s, keyword)) as documents from (values ('the'), ('haha'), ('queue'), ('qqqzzz')) k(keyword)",
        "sorted_terms": f"with {base}, {words}, {dic} select keyword, term from dic, (values ('haha'), ('queue')) k(keyword) where contains(term, keyword)",
        "sql_functions": f"with {base} select doc_id, md5(s) as digest, len(regexp_extract_all(s, '{t}+')) as n_tokens from base",
        "sql_views": f"with {base}, {runs} select term, count(distinct doc_id) as df, count(*) as occurrences from toks group by 1",
        "ingested_postings": f"with {base}, {runs} select doc_id, count(distinct term) as terms, count(*) as tokens from toks group by 1",
        "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type as kind, count(*) as n from events group by 1, 2",
        "max_distance": f"with {base}, {words}, {dic} select term, cast(case when length(term) <= 2 then 0 when length(term) <= 4 then 1 when length(term) <= 8 then 2 else 3 end as bigint) as most from dic",
        "snippet_head": text("case when length(regexp_replace(original, '^\\s+|\\s+$', '', 'g')) > 200 then substr(regexp_replace(original, '^\\s+|\\s+$', '', 'g'), 1, 200) || '...' else regexp_replace(original, '^\\s+|\\s+$', '', 'g') end"),
        "stats_totals": f"with {base}, {words} select (select count(*) from base) as documents, (select cast(sum(length(s)) as bigint) from base) as characters, (select count(distinct language) from base) as languages, (select count(distinct term) from words) as terms, (select count(*) from words) as postings",
        "stats_by_language": f"with {base} select language, count(*) as documents from base group by 1",
        "languages": f"with {base} select distinct language from base",
        "document_by_id": f"with {base} select doc_id as id, title, language, original from base where doc_id = '17'",
        "documents_json": f"""with {base} select '{{"id":"' || doc_id || '","title":"' || title || '","language":"' || language || '"}}' as json from base""",
        "flow_incidence": f"with {base} select keyword, doc_id from base, (values {', '.join(f'''('{k}')''' for k in FLOW)}) k(keyword) where contains(s, keyword)",
        "flow_degrees": f"with {base} select keyword, (select count(*) from base where contains(s, keyword)) as documents from (values {', '.join(f'''('{k}')''' for k in FLOW)}) k(keyword)",
        "flow_summary": cut(50),
        "flow_min_cut": cut(400),
        "detect_script": text(f"case when {most} = 0 then 'unknown' {cases} else 'unknown' end"),
        "preprocess": text(f"regexp_replace(regexp_replace(original, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '{space}', ' ', 'g')"),
        "strip_punctuation": text(f"trim(regexp_replace(regexp_replace(original, '[[:punct:]।॥，。]', ' ', 'g'), '{space}', ' ', 'g'))"),
        "normalize_nfc": "select cast(doc_id as varchar) as doc_id, md5(nfc_normalize(replace(coalesce(text, ''), 'e', 'e' || chr(769)))) as digest, length(nfc_normalize(replace(coalesce(text, ''), 'e', 'e' || chr(769)))) as n from documents",
    }
    return out | {k: places for k in ("match_positions", "match_naive", "match_kmp", "match_rabin_karp", "match_z", "match_aho")}
