"""Queries of the training-data operators: one for each, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_sliced, chat, decontaminate, lattice_lm, license_scan, ngram_join, packing, quality, token_bins, url_rules

#: The fixed rules of the URL filter: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bad_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, bad): quality 0 or toxic 1."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages whose path's first number is a labelled document's id."""
    number = F.regexp_extract(url_rules.url_path(F.col("url")), r"/(\d{1,18})(?!\d)", 1)
    ids = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null")
    return ids.join(bad_labels(labels).groupBy("doc_id").agg(F.max("bad").alias("bad")), "doc_id").select("url", "bad")


def document_sites(pages: DataFrame) -> DataFrame:
    """(doc_id, host, path): a page's URL holds its document's number; path is its first part, the rest names the document."""
    url = F.col("url").cast("string")
    number = F.regexp_extract(url_rules.url_path(url), r"/(\d{1,18})(?!\d)", 1)
    first = F.regexp_extract(url_rules.url_path(url), r"^/[^/]*/", 0)
    return pages.select(F.when(number != "", number.cast("long")).alias("doc_id"), url_rules.url_host(url).alias("host"), first.alias("path")).where("doc_id is not null")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judged(pages, labelled_urls(pages, _read(spark, sf_dir, "labels")), URL_RULES)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths, so documents are laid out as source/lang/number.txt, and every tenth is a notice of its folder or of its source."""
    docs, number, notice = _read(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), F.concat(F.lit("NOTICE-"), F.col("doc_id").cast("string"))
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    place = F.when(F.pmod("doc_id", F.lit(20)) == 0, F.concat_ws("/", source, notice)).when(F.pmod("doc_id", F.lit(20)) == 10, F.concat_ws("/", source, lang, notice))
    path = F.concat(place.otherwise(F.concat_ws("/", source, lang, number)), F.lit(".txt"))
    return license_scan.license_scan(docs.select(path.alias("path"), "text", "doc_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    #: The SQL has three columns, so the number of links, found with all else, isn't among them.
    return ngram_join.ngram_links(_read(spark, sf_dir, "documents"), n=3, num=90, den=100).drop("n_links")


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scored(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digest(chat.examples(turns))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = document_sites(_read(spark, sf_dir, "pages"))
    return quality.judged(_read(spark, sf_dir, "documents"), bad_labels(_read(spark, sf_dir, "labels")), F.col("source"), F.col("lang"), sites).drop("key_a", "key_b")


def op8_token_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_bins.read_store(token_bins.write_store(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end=2))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), short=True)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(_read(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


def queries() -> dict:
    import corpus_pipeline

    own = [op1_url_filter, op2_license_scan, op3_ngram_join, op4_lattice_lm, op5_chat_format, op6_best_fit, op7_quality, op8_token_bins, op9_decontaminate, op10_top_k]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_TEMPLATES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(license_scan.TEMPLATES))

_FIXED = sorted(URL_RULES, key=lambda r: (-len(r[1]) - len(r[2]), r))
_FITS = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in _FIXED]
_RULE = "case " + " ".join(f"when {f} then '{h}{p}'" for f, (_, h, p) in zip(_FITS, _FIXED, strict=True)) + " end"
_VERDICT = "case " + " ".join(f"when {f} then '{kind}'" for f, (kind, _, _) in zip(_FITS, _FIXED, strict=True)) + " when mined_bad then 'block' else 'allow' end"

#: DuckDB's SQL for the queries it can express.
ORACLE: dict[str, str] = {
    #: Every combination of every labelled URL's tokens is counted.
    "op1_url_filter": rf"""
        with u as (select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
        v as (select page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
        k as (select *, list_filter(list_distinct(list_concat(list_transform(string_split(host, '.'), lambda x: 'host=' || x),
            list_transform(regexp_split_to_array(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{M}}]+'), lambda x: 'path=' || x),
            list_transform(regexp_extract_all(coalesce(url, ''), '[?&]([^=&#]+)=', 1), lambda x: 'key=' || x))), lambda x: not ends_with(x, '=')) as tokens from v),
        b as (select doc_id, max((coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1)::int) as bad from labels group by 1),
        l as (select list_sort(tokens) as ts, bad from k join b on b.doc_id = try_cast(regexp_extract(path, '/(\d+)', 1) as bigint) where len(tokens) > 0),
        n as (select count(*) as n from l),
        s as (select ts, bad, unnest(range(1, 1 << len(ts))) as m from l),
        c as (select list_filter(ts, lambda x, i: (m >> (i - 1)) & 1 = 1) as combination, count(*) as held, sum(bad) as hits from s group by 1),
        r as (select combination from c, n where hits >= ceil(greatest(0.001 * n, 10)) and hits >= 0.6 * held),
        z as (select page_id, host, path, exists (select 1 from r where list_has_all(k.tokens, r.combination)) as mined_bad from k)
        select page_id, host, path, {_RULE} as rule, {_VERDICT} as verdict, mined_bad from z
    """,
    "op2_license_scan": rf"""
        with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as top, coalesce(source, '') || case when doc_id % 20 = 0 then '' else '/' || coalesce(lang, '') end as dir,
            case when doc_id % 10 = 0 then 'NOTICE-' else '' end || doc_id || '.txt' as name from documents),
        t as (select k, license, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as ws from (values {_TEMPLATES}) v(k, license, text)),
        c as (select k, license, f, count(*) as tf from (select k, license, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from t) group by 1, 2, 3),
        h as (select distinct doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+')) as word from d),
        n as (select count(*) as files from d),
        fw as (select distinct f, unnest(string_split(f, ' ')) as word from c),
        w1 as (select word, ln((files + 1) / (count(doc_id) + 1)) + 0.001 as idf from (select distinct word from fw) left join h using (word), n group by word, files),
        f as (select f, max(idf) as idf from fw join w1 using (word) group by 1),
        m as (select k, sqrt(sum(tf * idf * tf * idf)) as size from c join f using (f) group by 1),
        w as (select k, license, f, tf * idf / size as weight from c join f using (f) join m using (k)),
        u as (select doc_id, unnest(list_distinct(list_concat([text], regexp_split_to_array(text, '\r\n|[\n\r]'),
            regexp_split_to_array(text, '(?:\r\n|[\n\r])[^\p{{L}}\p{{N}}\r\n]*(?:\r\n|[\n\r])'), regexp_split_to_array(text, '[.!?][ \t\r\n]+')))) as part from d),
        ps as (select doc_id, part, list_filter(regexp_split_to_array(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') as ws from u),
        p as (select doc_id, part, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from ps),
        q as (select doc_id, part, f, coalesce(count(*) * any_value(idf), any_value(ln(files + 1)) + 0.001) as value from p left join f using (f), n group by 1, 2, 3),
        s as (select doc_id, part, sqrt(sum(value * value)) as size from q group by 1, 2),
        x as (select doc_id, part, k, license, sum(value * weight) as dot from q join w using (f) group by 1, 2, 3, 4),
        y as (select doc_id, license, max(round(dot / size, 6)) as score from x join s using (doc_id, part) where round(dot / size, 6) >= {license_scan.THRESHOLD} group by 1, 2),
        z as (select *, row_number() over (partition by doc_id order by score desc, license) as place, max(score) over (partition by doc_id) as best from y),
        o as (select doc_id, max(license) filter (place = 1) as license, max(score) as score, coalesce(string_agg(license, ',' order by license) filter (place > 1 and score >= round(best - {license_scan.NEAR}, 6)), '') as near from z group by 1),
        g as (select dir, license, score from (select dir, license, score, row_number() over (partition by dir order by score desc, license) as place from o join d using (doc_id) where name like 'NOTICE%') where place = 1)
        select d.doc_id, d.dir || '/' || name as path, coalesce(o.license, g2.license, g1.license) as license, coalesce(o.score, g2.score, g1.score) as score, near,
            case when o.license is not null then 'own' when coalesce(g2.license, g1.license) is not null then 'inherited' else 'none' end as origin
        from d left join o using (doc_id) left join g g2 on g2.dir = d.dir left join g g1 on g1.dir = d.top
    """,
    "op3_ngram_join": r"""
        with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
        g as (select distinct doc_id, unnest(case when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda k: array_to_string(ws[k:k+2], ' ')) end) as g from w where len(ws) > 0),
        n as (select doc_id, count(*) as n from g group by 1),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as m from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
        l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * m >= 90 * (nx.n + ny.n - m)),
        e as (select x as a, y as b from l union all select y, x from l),
        r(node, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.node),
        c as (select node, min(root) as root from r group by 1)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, c.root as component_id from documents d left join n using (doc_id) join c on c.node = d.doc_id
    """,
    "op5_chat_format": r"""
        with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
        x as (select *, row_number() over (partition by conv_id order by turn, role, text) as i, role = 'assistant' as reply, replace(text, '\', '\\') as et, replace(role, '\', '\\') as er from t),
        s as (select *, 8 + length(et) + len(regexp_extract_all(et, '\[INST\]|\[/INST\]|\[ASST\]|<s>|</s>')) + length(er) + len(regexp_extract_all(er, '\[INST\]|\[/INST\]|\[ASST\]|<s>|</s>|\n')) + case when reply then 4 else 7 end as size from x),
        u as (select *, sum(size) over (partition by conv_id order by i) as upto, i = count(*) over (partition by conv_id) as last from s)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
          cast(coalesce(sum(length(text)) filter (reply), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by i) filter (reply), '')) as loss_sha256,
          cast(sum(upto) filter (reply or last) as bigint) as formatted_chars, count(*) filter (reply or last) as n_examples from u group by 1
    """,
    "op9_decontaminate": r"""
        with w as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents where text is not null),
        i as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from benchmark where text is not null),
        q as (select distinct item_id, unnest(case when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k+4], ' ')) end) as g from i where len(ws) > 0),
        n as (select item_id, count(*) as n_item from q group by 1),
        d as (select distinct doc_id, unnest(case when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k+4], ' ')) end) as g from w where len(ws) > 0),
        h as (select doc_id, item_id, count(*) as n_shared from d join q using (g) group by 1, 2)
        select doc_id, item_id, n_item, n_shared from h join n using (item_id) where n_shared * 100 >= 80 * n_item
    """,
    "op10_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, v.vec_id, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: q.x[i] * v.x[i])) as score
              from v q join v on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id and len(q.x) = len(v.x)),
        r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
        select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= 5
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
