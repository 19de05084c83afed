"""The corpus pipeline on a small folder of tables, against plain versions of its stages."""

import random

import corpus_pipeline
import public_tokenizers
from glyphflow.llm import queries, token_bins
from test_operators import DOCS, brute_groups, quality_rows, shingles


def test_pipeline(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, t) for i, t, _ in quality_rows(90, 3)]
    item = " ".join(f"b{j}" for j in range(30))
    rows[1] = (1, rows[1][1] + " " + item)
    rows[2] = (2, rows[2][1] + " " + " ".join(item.split()[:15]))
    w = rows[4][1].split() + [f"w{r.randrange(200)}" for _ in range(80)]
    rows[4] = (4, " ".join(w))
    rows[5] = (5, " ".join([*w[:-1], "changed"]))
    rows += [(7, rows[7][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(b)) for i, _, b in quality_rows(90, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(0, item), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lengths = {(r.doc_id, r.length) for r in token_bins.token_lengths(spark.read.parquet(f"{tmp_path}/documents.parquet"), public_tokenizers.path(queries.TOKENIZER)).collect()}
    clean = [(i, t) for i, t in rows if i % 3]
    groups = {i: c for i, _, c in brute_groups(clean, 5, 80, 100)}
    kept = {i: t for i, t in clean if groups[i] == i and 100 * len(shingles(t, 5) & shingles(item, 5)) < 80 * len(shingles(item, 5))}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.piece_length) for x in out} == {(i, n) for i, n in lengths if i in kept}
    assert 1 not in kept and 2 in kept and 5 not in kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_duplicates", "decontamination", "best_fit_packing"]


def folder(spark, path, docs, labels=(), benchmark=(), pages=()):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, spark.createDataFrame([], DOCS))).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls anywhere, no labels that teach anything, repeated rows, and columns with the names used inside."""
    text = " ".join(f"w{i}" for i in range(60))
    item = " ".join(f"b{i}" for i in range(20))
    rows = [(1, text, "en", "s"), (2, None, None, None), (None, text + " more", "en", None), (None, None, None, "s"), (3, "", "", ""), (3, "other text under the id", "en", "s"), (4, " ".join(f"x{i}" for i in range(40)) + " " + item, "en", "s"), (None, item, "en", "s"), (5, "alone", "en", "s"), (5, "alone", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'k' as key_a", "1 as host", "2 as n", "3 as row", "'c' as component", "struct(1 as x) as stays", "4 as `a.b`")
    path = folder(spark, tmp_path, docs, [(1, None, None), (None, 0, 1)], [(0, item), (None, None)], [(1, None, None), (2, "http://h.org/en/1", "x"), (3, "http://h.org/", "x")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.written(out, name)
        kept.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
    assert kept[0] == sorted(((i, t) for i, t, *_ in rows), key=str)
    gone = [(None, text + " more"), (5, "alone")]  # a near copy without an id, and one of two equal rows
    for x in gone:
        kept[0].remove(x)
    assert kept[1] == kept[0]
    assert kept[2] == [x for x in kept[1] if item not in (x[1] or "")]
    assert {r.key_a for r in docs.collect()} == {"k"} and {r["a.b"] for r in docs.collect()} == {4}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted((i for i, _ in kept[2]), key=str)


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert set(queries.oracle_sql()) <= set(names)
