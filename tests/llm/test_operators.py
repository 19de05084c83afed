"""The training-data operators against plain versions, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from glyphflow.llm import bit_sliced, chat, decontaminate, lattice_lm, license_scan, license_texts, ngram_join, packing, quality, scratch, token_bins, url_rules
from glyphflow.llm.components import components
from glyphflow.llm.wordhash import shingle_hashes, word_hashes
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(AZ))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = words(r.choice(rows)[1])
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 30, 80, 200]))]
        rows.append((i * 3, " ".join(w)))
    return rows


ODD = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (None, "w1 w2 w3"), (1005, "long " * 60000), (1006, "x" * 300000), (1007, "a\x0bb\x0cc é\u00a0É 😀")]


def test_word_hashes_follow_the_rule():
    texts = [t for _, t in ODD] + ["a b", "b", "", "A B c\x1fd"]
    hashes, at = word_hashes(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        w = words(t)
        assert at[i + 1] - at[i] == len(w)
        for x, h in zip(w, hashes[at[i] : at[i + 1]].tolist(), strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(shingle_hashes(hashes[:2], 5)) == 1 and len(shingle_hashes(hashes[:0], 5)) == 0


def brute_groups(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if (x and y and den * len(x & y) >= num * len(x | y)) or a == b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {(i, len(s), find(i)) for i, s in sets} | {(None, len(shingles(t, n)), None) for i, t in rows if i is None}


@pytest.mark.parametrize(("n", "num", "blocks"), [(3, 90, 512), (3, 60, 2), (2, 80, 3)])
def test_ngram_links(spark, monkeypatch, n, num, blocks):
    monkeypatch.setattr(ngram_join, "PAIR_ROWS", blocks)
    monkeypatch.setattr(ngram_join, "PAIR_CELLS", 64)
    monkeypatch.setattr(ngram_join, "MOST_FILTER_BITS", 1 << 12)
    monkeypatch.setattr(ngram_join, "LEAST_FILTER_BITS", 1 << 10)
    base = [f"v{i}" for i in range(80)]
    near = [(2000 + i, " ".join([*base[:i], "changed", *base[i + 1 :]])) for i in range(12)]  # one group, not one text
    rows = corpus(n + blocks, 40) + ODD + near + [(0, corpus(n + blocks, 40)[0][1]), (3, "w5 w6 w7 w8 other text"), (2003, ""), (None, near[0][1])]
    groups = {i: c for i, _, c in brute_groups(rows, n, num, 100)}
    sets = [(i, shingles(t, n)) for i, t in rows]
    want = []
    for k, (i, x) in enumerate(sets):
        links = sum(bool(j is not None and x and y and 100 * len(x & y) >= num * len(x | y)) for m, (j, y) in enumerate(sets) if m != k)
        want.append((i, len(x), groups[i], links if i is not None else None))
    got = [tuple(r) for r in ngram_join.ngram_links(table(spark, rows), n, num, 100).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    if n == 3 and num == 60:
        assert {c for i, _, _, c in got if i == 2005} == {11}


def brute_distinct(rows, n, num, den):
    """The ids that stay, in any order: one of each group of linked texts, and all blank texts."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return [min(g, key=lambda i: (i is None, i or 0)) for g in groups.values()]


@pytest.mark.parametrize(("n", "num", "blocks"), [(5, 80, 256), (3, 60, 2)])
def test_distinct_documents(spark, monkeypatch, n, num, blocks):
    monkeypatch.setattr(ngram_join, "PAIR_ROWS", blocks)
    base = [f"v{i}" for i in range(80)]
    near = [(2000 + i, " ".join([*base[:i], "changed", *base[i + 1 :]])) for i in range(12)]
    first = corpus(5, 30)
    rows = first + near + ODD + [first[0], first[0], (0, "other words under an id that is taken"), (None, near[3][1]), (None, "alone without an id"), (None, "alone without an id"), (500, None)]
    docs = table(spark, rows).withColumnsRenamed({"source": "component", "n_chars": "key_a"}).withColumns({"stays": F.lit(1), "a.b": F.lit("x")})
    out = ngram_join.distinct_documents(docs, n, num, 100)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(brute_distinct(rows, n, num, 100), key=str)
    assert {r.key_a for r in got if r.doc_id == 1006} == {300000}


@pytest.mark.parametrize("connect", [False, True])
def test_chains_of_texts_that_share_little(spark, monkeypatch, connect):
    """A large family whose texts share a shingle with the next only is split by shingle; no link is lost."""
    monkeypatch.setattr(ngram_join, "PAIR_ROWS", 4)
    rows = [(i, " ".join(f"w{3 * i + k}" for k in range(6))) for i in range(12)] + [(100 + i, " ".join(f"w{3 * i + k}" for k in range(5))) for i in range(0, 12, 5)]
    if connect:
        assert sorted(r.doc_id for r in ngram_join.distinct_documents(table(spark, rows), 1, 30, 100).collect()) == sorted(brute_distinct(rows, 1, 30, 100)) == [0]
        return
    sets = dict((i, shingles(t, 1)) for i, t in rows)
    want = {i: sum(j != i and 100 * len(x & y) >= 30 * len(x | y) for j, y in sets.items()) for i, x in sets.items()}
    assert {r.doc_id: r.n_links for r in ngram_join.ngram_links(table(spark, rows), 1, 30, 100).collect()} == want


@pytest.mark.parametrize("connect", [False, True])
def test_join_of_more_shingles_than_filters_hold(spark, monkeypatch, connect):
    """Neither texts that link with none nor families by chance are kept because the bounded filters and lists are full."""
    monkeypatch.setattr(ngram_join, "MOST_FILTER_BITS", 1 << 12)
    monkeypatch.setattr(ngram_join, "LEAST_FILTER_BITS", 1 << 10)
    monkeypatch.setattr(ngram_join, "HEAVY", 1)
    monkeypatch.setattr(ngram_join, "TOLD_SHINGLES", 500)
    made = {}

    def written(df, name):
        made.setdefault(name, out := scratch.written(df, name))
        made[f"{name} rows"] = max(made.get(f"{name} rows", 0), out.count())
        if name == "whole":
            made["largest"] = out.agg(F.max("rows")).first()[0]
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    r = random.Random(3)
    texts = [[f"t{i}w{k}" for k in range(100)] for i in range(160)]
    for i in range(60):  # these have a near copy, and quarters that stand in two others as well
        texts[i][25:50] = texts[(i + 1) % 60][:25]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, " ".join([*texts[i][:97], "n1", "n2", f"n{i}"])) for i in range(60)]
    r.shuffle(rows)
    if connect:
        assert sorted(x.doc_id for x in ngram_join.distinct_documents(table(spark, rows), 3, 80, 100).collect()) == list(range(160))
    else:
        got = {x.doc_id: (x.component_id, x.n_links) for x in ngram_join.ngram_links(table(spark, rows), 3, 80, 100).collect()}
        assert got == {i: (i % 1000, int(i % 1000 < 60)) for i, _ in rows}
    assert made["found rows"] <= 130 and made["maybe rows"] <= 130
    assert made["largest"] == 2


@pytest.mark.parametrize("connect", [False, True])
def test_join_ships_a_large_family_in_rounds(spark, monkeypatch, connect):
    """Texts of lines that others hold too, a family of many blocks: no join ships all pairs of blocks at once."""
    monkeypatch.setattr(ngram_join, "PAIR_ROWS", 12)
    monkeypatch.setattr(ngram_join, "ROUND_SHINGLES", 3600, raising=False)  # as many as all texts have
    shipped, joined = [], ngram_join._joined

    def counted(placed, *args):
        shipped.append(placed.count())
        return joined(placed, *args)

    monkeypatch.setattr(ngram_join, "_joined", counted)
    r = random.Random(7)
    lines = [" ".join(f"l{i}w{k}" for k in range(6)) for i in range(40)]
    rows = [(i, "\n".join(r.sample(lines, 5))) for i in range(100)]
    rows += [(1000 + i, t.replace("w5", "w0", 1)) for i, t in rows[:20]]
    if connect:
        got = [x.doc_id for x in ngram_join.distinct_documents(table(spark, rows), 1, 70, 100).collect()]
        assert sorted(got) == sorted(brute_distinct(rows, 1, 70, 100))
    else:
        sets = {i: shingles(t, 1) for i, t in rows}
        want = {i: sum(j != i and 100 * len(x & y) >= 70 * len(x | y) for j, y in sets.items()) for i, x in sets.items()}
        assert {x.doc_id: x.n_links for x in ngram_join.ngram_links(table(spark, rows), 1, 70, 100).collect()} == want
    assert max(shipped) <= 3 * len(rows)


def test_prefix_tree():
    r = random.Random(8)
    for _ in range(40):
        values = r.choice([5, 30])
        sets = [np.array(sorted(r.sample(range(values), r.randint(0, min(values, 12)))), np.int64) for _ in range(r.randint(1, 25))]
        size = np.array([len(s) + r.randint(0, 3) for s in sets])
        label = np.array([r.randrange(6) for _ in sets])
        tree = ngram_join.PrefixTree(sets, size, label)
        num = r.choice([30, 60, 90])
        p, k = tree.search(sets, size, label, values, num, 100)
        p, k = p[label[p] != label[k]], k[label[p] != label[k]]  # it leaves out whole subtrees only
        both = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
        want = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if label[i] != label[j] and both[i][j] * (100 + num) >= num * (size[i] + size[j])}
        assert set(zip(p.tolist(), k.tolist(), strict=True)) == want and len(p) == len(want)


def test_empty_tables(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, bad boolean")
    assert ngram_join.ngram_links(none).count() == 0
    assert ngram_join.distinct_documents(none).count() == 0
    assert decontaminate.contained_items(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert packing.packed(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert quality.judged(none, labels, F.col("source"), F.col("lang")).count() == 0
    assert quality.kept(none, labels, F.col("source"), F.col("lang")).count() == 0
    assert token_bins.read_store(token_bins.write_store(none, public_tokenizers.path("word_bpe_49k.json"))).count() == 0
    assert bit_sliced.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert lattice_lm.scored(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert chat.digest(chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert license_scan.license_scan(spark.createDataFrame([], "path string, text string, row long")).count() == 0
    assert url_rules.judged(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string, bad boolean"), []).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_contained_items(spark):
    rows = corpus(9, 40) + ODD
    r = random.Random(4)
    items = [(i, " ".join(words(r.choice(rows[:40])[1])[: r.choice([1, 3, 4, 5, 12, 40])])) for i in range(40)] + [(99, None), (None, "One"), (98, ""), (97, "W1 w2 w3")]
    got = {tuple(x) for x in decontaminate.contained_items(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for (d, t), (i, q) in itertools.product(rows, items):
        a, b = shingles(t, 5), shingles(q, 5)
        if b and 100 * len(a & b) >= 80 * len(b):
            want.add((d, i, len(b), len(a & b)))
    assert got == want and {(None, 97, 1, 1), (1003, None, 1, 1)} <= want
    docs = table(spark, rows).withColumns({"key_a": F.lit(1), "item_id": F.lit("x"), "a.b": F.lit(2)})
    kept = decontaminate.clean_documents(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted((x.text or "") for x in kept.collect()) == sorted((t or "") for d, t in rows if d not in {d for d, *_ in want})


def test_short_items_in_long_documents(spark):
    rows = [(1, "one two three four five six seven"), (2, "Three four"), (3, "four three two one zero"), (4, "x"), (5, None), (6, "five six")]
    items = [(1, "three four"), (2, "six"), (3, "two three four FIVE"), (4, "one three"), (5, "four three two one zero x"), (6, ""), (7, "x")]
    got = {tuple(x) for x in decontaminate.contained_items(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), short=True).collect()}
    assert got == {(1, 1, 1, 1), (2, 1, 1, 1), (1, 2, 1, 1), (6, 2, 1, 1), (1, 3, 1, 1), (4, 7, 1, 1)}
    kept = decontaminate.clean_documents(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), short=True)
    assert {x.doc_id for x in kept.collect()} == {3, 5}


def test_contained_items_in_parts(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 50))) for i in range(20)]
    items = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 20))) for i in range(20)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contained_items(table(spark, rows), items).collect()))
    monkeypatch.setattr(decontaminate, "PART_SHINGLES", 40)
    assert sorted(map(tuple, decontaminate.contained_items(table(spark, rows), items).collect())) == whole


@pytest.mark.parametrize("local", [True, False])
def test_token_store(spark, monkeypatch, local):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_bins, "RANGE_DOCS", 7)
    monkeypatch.setattr(token_bins, "READ_IDS", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = corpus(2, 30) + ODD + [(7, "It's <|endoftext|> a\u00a0b!! 's Ünï\u0301 Σας ΣΑΣ x<|startoftext|>y"), (8, "e\u0301 \u0301x 12 3"), (7, "again"), (None, "z"), (-5, "z")]
    docs = table(spark, rows).withColumns({"part": F.lit(1), "name": F.lit("x"), "a.b": F.lit(0)})
    manifest = token_bins.write_store(docs, path, 2, parts=3)
    if not local:  # read by offsets, as from a store that can't be mapped
        init = token_bins.Reader.__init__

        class Remote(token_bins.Reader):
            def __init__(self, *a):
                init(self, *a)
                self.local = False

        monkeypatch.setattr(token_bins, "Reader", Remote)
    got = [tuple(r) for r in token_bins.read_store(manifest).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    ids = {}
    for i, x in rows:
        ids.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 2])
    start = 0
    for d, at, n, crc in got:
        assert at == start
        assert (n, crc) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[d]]
        start += n
    lengths = sorted(((r.doc_id, r.length) for r in token_bins.token_lengths(docs, path).collect()), key=str)
    assert lengths == sorted(((i, len(x)) for i, xs in ids.items() for x in xs), key=str)


def brute_top(rows, every, k, scale=256):
    ok = []
    for i, v in rows:
        if i is None or not v or not all(x is not None and math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(scale * float(np.float32(x))) for x in v)
        if max(map(abs, q)) < 2**29:
            ok.append((i, q))
    want = []
    for i, q in set((i, q) for i, q in ok if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in ok if j != i and len(x) == len(q))[:k]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(want)


@pytest.mark.parametrize(("block", "pack"), [(1 << 16, 1 << 13), (64, 2)])
def test_top_k(spark, monkeypatch, block, pack):
    monkeypatch.setattr(bit_sliced, "BLOCK", block)
    monkeypatch.setattr(bit_sliced, "PACK", pack)
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[100][1]) for i in range(300, 330)] + [rows[150], rows[150]]
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (450, [float("inf")] + [0.0] * 5), (None, [0.5] * 6), (500, [0.25] * 6), (50, [0.75] * 6)]
    rows += [(550, []), (600, [1.0, 2.0]), (601, [1.0, 2.0]), (602, [0.5, -2.0]), (650, [1e30, 0.0]), (700, [7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "dim": F.lit("x"), "query": F.lit(0)})
    assert sorted(map(tuple, bit_sliced.top_k(df).collect())) == brute_top(rows, 50, 5)


@pytest.mark.parametrize("rows", [[(0, [1.0, 0.5])], [(0, [0.5, 0.25]), (1, [0.5, 0.75])], [(0, [0.0, 0.0]), (50, [0.0, 0.0])], [(i, [1.0, -0.5]) for i in range(101)]])
def test_top_k_of_few_and_of_equal_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, bit_sliced.top_k(df).collect())) == brute_top(rows, 50, 5)


def test_bit_slices_of_any_sign():
    r = np.random.default_rng(6)
    for low, high in ((-300, 300), (0, 9), (-9, -1)):
        x = r.integers(low, high, (70, 5))
        ids = r.permutation(70)
        for q in x[:10].tolist():
            best = sorted((-int(np.dot(q, v)), int(i)) for i, v in zip(ids, x, strict=True))[:7]
            assert sorted(bit_sliced.BitSlices(ids, x).top(q, 7, -1), key=lambda t: (-t[1], t[0])) == [(i, -s) for s, i in best]


@pytest.mark.parametrize("rows", [[[3, -2]], [[3, -2]] * 4, [[7, 1], [7, 5], [7, -3]], [[1, 7], [5, 7], [-3, 7]], [[0, 0], [0, 1]]])
def test_bit_slices_of_constant_attributes(rows):
    x = np.array(rows)
    for q in ([256, 1], [1, 256], [-256, 1], [1, -256], [-256, -256], [0, 0], [0, 512]):
        best = sorted((-int(np.dot(q, v)), i) for i, v in enumerate(x))[:2]
        assert sorted(bit_sliced.BitSlices(np.arange(len(x)), x).top(q, 2, -1), key=lambda t: (-t[1], t[0])) == [(i, -s) for s, i in best]


def check_places(out, want, sizes):
    """Every document's pieces cover it, every sequence is filled from its start, in the smallest size that holds it."""
    got, bins = {}, {}
    for p in out:
        bins.setdefault((p.bin_id, p.bin_used, p.bin_capacity), []).append((p.bin_place, p.piece_length))
        got.setdefault(p.doc_id if p.doc_id is not None else -1, []).append((p.piece_start, p.piece_length))
    assert {d for d, _ in want} == set(got)
    for d, n in want:
        at = 0
        for start, size in sorted(got[d]):
            assert start == at
            at += size
        assert at == n
    assert len({b for b, *_ in bins}) == len(bins)
    for (_, used, capacity), pieces in bins.items():
        at = 0
        for place, size in sorted(pieces):
            assert place == at
            at += size
        assert at == used <= capacity and capacity in sizes and all(c >= capacity or c < used for c in sizes)


def test_packing(spark):
    rows = corpus(7, 50) + ODD
    docs = table(spark, rows).withColumns({"length": F.lit("x"), "row": F.lit(1), "shard": F.lit(2), "a.b": F.lit(3)})
    want = sorted(((d if d is not None else -1), len(words(t)) + 1) for d, t in rows)
    count = F.size(F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)")) + 1
    check_places(packing.packed(docs, None, (16, 64, 128), 8, 256, length=count).collect(), want, (16, 64, 128))
    path = public_tokenizers.path("word_bpe_49k.json")
    lengths = {(r.doc_id if r.doc_id is not None else -1): r.length for r in token_bins.token_lengths(docs, path).collect()}
    out = packing.packed(docs, path).collect()
    check_places(out, sorted(lengths.items()), (512, 1024, 2048, 4096))


def test_trial_fill_against_a_plain_loop():
    r = random.Random(3)
    for _ in range(200):
        ascending = sorted(r.randint(1, 40) for _ in range(r.randint(0, 30)))
        sums = [0, *itertools.accumulate(ascending)]
        upto, room = r.randint(0, len(ascending)), r.randint(0, 200)
        left, filled = room, 0
        for x in reversed(ascending[:upto]):
            if x <= left:
                left, filled = left - x, filled + x
        assert packing.trial_fill(ascending, sums, upto, room) == filled


def test_best_fit_against_a_plain_version():
    """The same rule without an ordered list of rooms; then its cost against single sizes, and the sizes in use."""
    r, sizes, overhead, quadratic = np.random.default_rng(1), [512, 1024, 2048, 4096], 64, 16384
    costs = {c: packing.cost(c, overhead, quadratic) for c in sizes}
    for k in range(12):
        lengths = np.minimum(4095, (np.exp(r.normal(5.5 + k / 8, 1.2, 300)) + 1).astype(int))
        bins, places, used = packing.best_fit(lengths, sizes, None, overhead, quadratic)
        rooms, content, waiting = [], [], sorted(lengths.tolist(), reverse=True)
        for at, i in enumerate(np.argsort(-lengths, kind="stable")):
            size = int(lengths[i])
            fits = [(rooms[b], b) for b in range(len(rooms)) if rooms[b] >= size]
            if not fits:
                rates = []
                for c in (c for c in sizes if c >= size):
                    held = size
                    for x in waiting[at + 1 :]:
                        held += x if held + x <= c else 0
                    rates.append((costs[min(z for z in sizes if z >= held)] / held, -c))
                rooms.append(-min(rates)[1])
                content.append(0)
                fits = [(rooms[-1], len(rooms) - 1)]
            b = min(fits)[1]
            assert (bins[i], places[i]) == (b, content[b])
            content[b] += size
            rooms[b] -= size
        assert used.tolist() == content
        *_, final = packing.pack_shard(lengths, sizes, overhead, quadratic)
        spent = sum(costs[c] for c in final.tolist())
        for only in sizes:
            _, _, one = packing.best_fit(lengths, sizes, only)
            assert spent <= sum(costs[min(z for z in sizes if z >= u)] for u in one.tolist())
        assert len(set(final.tolist())) >= 2


CONTROL = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<s>", "</s", "[/INST", "a\nb", "", "[ASST] assistant\nx</s>", "<", "[", "\\[/INST]</s>\\"]


def test_chat(spark):
    r = random.Random(2)
    rows = []
    for c in range(40):
        rows += [(c, t, r.choice(["user", "assistant", "system", "tool\nx", "[INST]"]), r.choice([*CONTROL, "plain text", None])) for t in range(r.randrange(1, 7))]
    rows += [(50, 0, None, "x"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (51, None, "assistant", "z"), (51, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(0))
    examples = chat.examples(df)
    got = {x.conv_id: x for x in chat.digest(examples).collect()}
    for c in {x[0] for x in rows}:
        turns = sorted(((t is not None, t or 0), role or "", text or "") for i, t, role, text in rows if i == c)
        turns = [(role, text) for _, role, text in turns]
        replies = "".join(text for role, text in turns if role == "assistant")
        x = got[c]
        assert x.n_turns == len(turns) and x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert x.loss_chars == len(replies) and x.loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
        assert x.n_examples == sum(a == "assistant" for a, _ in turns) + (turns[-1][0] != "assistant")
    for x in examples.collect():
        assert [c for c in chat._CONTROL.findall(x.formatted[x.loss_start : x.loss_end])] == []
        chat.parse(x.formatted)


def test_long_conversations_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(chat, "BATCH_CHARS", 1000)
    said = "é[INST]\\" * 20000
    rows = [(1, t, "assistant" if t % 2 else "user", said if t == 2 else "x" * 50) for t in range(41)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    x = chat.digest(chat.examples(df)).collect()[0]
    assert (x.n_turns, x.n_examples, x.loss_chars) == (41, 21, 20 * 50)
    assert x.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


def test_escape_round_trip():
    r = random.Random(8)
    for _ in range(500):
        text = "".join(r.choice(["\\", "[INST]", "</s>", "<", "/", "s>", "x", "\n", "[", "[/INST]"]) for _ in range(r.randrange(9)))
        assert chat.unescape(chat.escape(text)) == text
        assert not chat._CONTROL.search(chat.escape(text))


def brute_marginal(word, logs, pieces):
    a = [0.0] + [None] * len(word)
    for j in range(1, len(word) + 1):
        terms = [a[i] + logs[pieces[word[i:j]]] for i in range(j) if a[i] is not None and word[i:j] in pieces]
        if word[j - 1] not in pieces and a[j - 1] is not None:
            terms.append(a[j - 1] + sum(logs[pieces[f"<0x{b:02X}>"]] for b in word[j - 1].encode()))
        a[j] = np.logaddexp.reduce(terms) if terms else None
    return a[-1]


def test_lattice():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)}
    plain = {k: v for k, v in pieces.items() if not model.is_byte(v)} | {f"<0x{b:02X}>": pieces[f"<0x{b:02X}>"] for b in range(256)}
    p = lattice_lm.Pieces(path)
    some = ["the", "thereabouts", "😀x", "ünïcode", "a", "q" * 40, "\ue000"]
    got, expected = p.run(some, np.array([1.0, 2, 1, 1, 3, 1, 1]))
    for w, x in zip(some, got, strict=True):
        assert x == pytest.approx(brute_marginal("▁" + w, p.log, plain), rel=1e-9)
    spelt = sum(len(model.id_to_piece(i)) * e for i, e in enumerate(expected) if not model.is_byte(i) and e)
    known = sum(n * sum(c in plain for c in "▁" + w) for w, n in zip(some, [1, 2, 1, 1, 3, 1, 1], strict=True))
    assert spelt == pytest.approx(known)  # expected pieces spell each known character once


def test_long_words_have_the_same_lattice(monkeypatch):
    p = lattice_lm.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    some = ["thereabouts" * 12, "😀x\ue000" * 30, "q" * 90, "the", "ünïcode" * 9]
    counts = np.array([1.0, 2, 1, 4, 3])
    log, expected = p.run(some, counts)
    monkeypatch.setattr(lattice_lm, "LONG", 8)
    monkeypatch.setattr(lattice_lm, "LONG_STEP", 17)
    log_long, expected_long = p.run(some, counts)
    assert log_long == pytest.approx(log, rel=1e-9) and expected_long == pytest.approx(expected, rel=1e-6, abs=1e-12)
    assert p.run(some)[0] == pytest.approx(log, rel=1e-9)


def test_lattice_lm(spark, monkeypatch):
    monkeypatch.setattr(lattice_lm, "HOT", 20)
    rows = corpus(11, 60) + ODD
    got = lattice_lm.scored(table(spark, rows).withColumn("row", F.lit(1)).withColumn("n", F.lit(2)), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows)
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in rows}
    count = {}
    for i, t in rows:
        if not out[i]:
            for w in [*words(t), None]:
                count[w] = count.get(w, 0) + 1
    total, kinds = sum(count.values()), len(count)
    text = dict(rows)
    for x in got:
        w = [*words(text[x.doc_id]), None]
        assert (x.held_out, x.n_tokens, x.train_tokens) == (out[x.doc_id], len(w), total)
        assert x.n_known == sum(v in count for v in w)
        assert x.base_score == pytest.approx(sum(math.log10((count.get(v, 0) + 1) / (total + kinds + 1)) for v in w))
        assert x.score < 0
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)}
    p, known = lattice_lm.Pieces(path), [w for w in count if w is not None]
    for _ in range(lattice_lm.ROUNDS):
        expected = p.run(known, np.array([float(count[w]) for w in known]))[1]
        p.weigh(expected)
    ends = (count[None] + 1) / (count[None] + expected.sum() + 2)
    log = p.log + math.log1p(-ends)
    for x in got:
        if len(text[x.doc_id] or "") < 2000:
            want = math.log(ends) + sum(brute_marginal("▁" + w, log, plain) for w in words(text[x.doc_id]))
            assert x.score == pytest.approx(want / math.log(10), rel=1e-6)
    held = [x for x in got if x.held_out and x.doc_id < 1000]
    assert sum(x.score for x in held) > sum(-3.2 * (len(text[x.doc_id]) + 1) for x in held)


def test_url_rules(spark):
    fixed = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    urls = ["http://A.Example.com/en/71?x=1", "https://example.com/en/8", "https://xexample.com/en/7", "com/en/", None, "", "://net/de/", "http://net#/de/", "http://example.net/de/8", "http://b.net/de/8", "http://org?/es/", "http://spam-farm.example.org/fr/2?page=1", "http://spam-farm.example.org/buy/2", "x://y://z/p", "http://İ.com/en/"]
    r = random.Random(1)
    labelled = [(f"http://{'spam-farm' if bad else 'fine'}.example.org/{r.choice(['buy', 'fr'])}/{i}", bad) for i, bad in enumerate([True] * 30 + [False] * 90)] + [(None, True), ("", None)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.org/es/")], "page_id long, url string").withColumn("rule", F.lit(5))
    table_ = spark.createDataFrame(labelled, "url string, bad boolean")
    for limit in (50_000, 0):
        url_rules.BROADCAST_RULES, before = limit, url_rules.BROADCAST_RULES
        got = {x.page_id: x for x in url_rules.judged(pages, table_, fixed).collect()}
        url_rules.BROADCAST_RULES = before
        assert len(got) == len(urls) + 1
        for i, u in enumerate(urls):
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            host = re.match(r"[^/?#]*", rest)[0].translate(AZ)
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
            fits = [(len(h + p), h + p, v) for v, h, p in fixed if (host == h or host.endswith("." + h)) and path.startswith(p)]
            bad = "spam-farm" in host
            want = max(fits)[1:] if fits else (None, "block" if bad else "allow")
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want), u
        assert got[None].verdict == "block"


def test_mined_rules_against_all_combinations(spark):
    r = random.Random(3)
    rows = [(f"http://{r.choice('abc')}.{r.choice('xyz')}.org/{r.choice(['p', 'q'])}", r.random() < 0.3) for _ in range(150)]
    rows += [("http://a.x.org/p", True)] * 30
    got = {(tuple(x.antecedent), round(x.confidence, 9)) for x in url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"), 0.02, 0.5, 1)[0].collect()}
    sets = [({f"host={h}" for h in u.split("/")[2].split(".")} | {f"path={u.split('/')[3]}"}, b) for u, b in rows]
    found = {}
    for k in range(1, 5):
        for c in itertools.combinations(sorted({t for s, _ in sets for t in s}), k):
            have = [b for s, b in sets if s >= set(c)]
            if have and sum(have) >= 0.02 * len(rows) and sum(have) / len(have) >= 0.5:
                found[c] = sum(have) / len(have)
    want = {(c, round(p, 9)) for c, p in found.items() if not any(set(d) < set(c) and q >= p for d, q in found.items())}
    assert got == want


@pytest.mark.parametrize("limit", [50_000, 0])
def test_tokens_that_always_come_together(spark, monkeypatch, limit):
    """Forty tokens of one set of URLs would have 2^40 combinations; each of them still blocks."""
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", limit)
    many = "/".join("bad" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(40))
    labelled = spark.createDataFrame([(f"http://h.org/{many}/{i}", True) for i in range(20)] + [(f"http://h.org/good/{i}", False) for i in range(60)], "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://h.org/badac/x"), (2, "http://h.org/good/x"), (3, "http://other.net/badbn?y=1"), (4, "http://h.org/"), (5, None)], "page_id long, url string")
    got = {x.page_id: x.verdict for x in url_rules.judged(pages, labelled, []).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}


def test_license_scan(spark):
    files = [
        ("a/LICENSE", "MIT\n\nReleased under the MIT License.\n"), ("a/b/c/x.py", "print()"), ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/y.py", "import x\n# Licensed under the Apache License, Version 2.0.\nrest"), ("z/q.py", "no licence here, released later"), ("top.py", None), (None, "Licensed under CC BY-NC 4.0."), ("a/b/c/x.py", "print()"),
        ("w/LICENSE", "nothing known"), ("w/v.py", "x"), ("deep/" * 40 + "f", "word " * 5000), ("a/late.py", "text\n" * 3000 + "Released under the MIT License."),
    ]
    rows = [(p, t, i) for i, (p, t) in enumerate(files)]
    got = {x.row: (x.license, x.origin) for x in license_scan.license_scan(spark.createDataFrame(rows, "path string, text string, row long").withColumns({"license": F.lit(0), "a.b": F.lit(1), "key_a": F.lit("x")})).collect()}
    want = ["MIT own", "GPL-3.0 inherited", "GPL-3.0 own", "Apache-2.0 own", "None none", "None none", "CC-BY-NC-4.0 own", "GPL-3.0 inherited", "None none", "None none", "None none", "MIT own"]
    assert [" ".join(map(str, got[i])) for i in range(len(rows))] == want


#: Notices as they stand in files: the licence that each should have.
REAL_NOTICES = [
    ("GPL-2.0", "/*\n * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n */\nint main;"),
    ("GPL-3.0", "# Copyright (C) 2019 Jane Doe\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of"),
    ("AGPL-3.0", "# This program is free software: you can redistribute it and/or modify it under the terms of the\n# GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n"),
    ("LGPL-2.1", "   This library is free software; you can redistribute it and/or\n   modify it under the terms of the GNU Lesser General Public\n   License as published by the Free Software Foundation; either\n   version 2.1 of the License, or (at your option) any later version.\n\n   This library is distributed"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation."),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"),
    ("AGPL-3.0", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n"),
    ("LGPL-3.0", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n"),
    ("LGPL-2.1", "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n"),
    ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\npackage x"),
    ("MIT", "# SPDX-License-Identifier: MIT\nimport os\n"),
    ("ISC", "// SPDX-License-Identifier: ISC"),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later\n"),
    ("GPL-3.0", "/* SPDX-License-Identifier: GPL-3.0-only */"),
    ("BSD-3-Clause", "# SPDX-License-Identifier: BSD-3-Clause"),
    ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2015 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software"),
    ("MIT", "MIT License\n\nCopyright (c) 2020 X\n\n" + license_texts.MIT_GRANT + "\n\n" + license_texts.MIT_REST),
    ("ISC", "Copyright (c) 2011, Jane Doe\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED"),
    ("0BSD", "Copyright (c) 2011, Jane Doe\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED"),
    ("BSD-2-Clause", "Copyright 2012 Jane Doe. All rights reserved.\n\n" + license_texts.BSD_TWO + license_texts.BSD_REST),
    ("BSD-3-Clause", "Copyright (c) 2012 Jane Doe. All rights reserved.\n\n" + license_texts.BSD_TWO + "\n\n3. " + license_texts.BSD_THIRD + "\n\n" + license_texts.BSD_REST),
    ("Apache-2.0", "Copyright (c) 2020 Jane Doe. Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", '/*\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */'),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy"),
    ("CC-BY-SA-4.0", "Text here. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. More."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "## License\n\nThis project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details\n"),
    ("Zlib", license_texts.ZLIB.replace(". ", ".\n")),
    (None, "# SPDX-License-Identifier: Foo"),
    (None, "All rights reserved. No part of this software may be used without written permission."),
    (None, "The licence of the driver was released by the public office under version 2.0 of the form."),
    (None, "This program is free and you can use it"),
    (None, "Copyright (c) 2011, Jane Doe"),
]


def test_real_notices(spark):
    """Of the licences found none is wrong, and of the notices none is missed; among other files, which give the weights."""
    r = random.Random(5)
    other = [(f"o/{i}", " ".join(r.choice(["the", "of", "software", "public", "a", "use", "in", "version", "general", f"w{r.randrange(900)}"]) for _ in range(60)), None) for i in range(400)]
    rows = [(f"n/{i}", t, w) for i, (w, t) in enumerate(REAL_NOTICES)] + other
    got = license_scan.license_scan(spark.createDataFrame(rows, "path string, text string, want string")).collect()
    assert [(x.path, x.want, x.license, x.score, x.near) for x in got if x.want != x.license] == []


def test_license_cosine_by_hand(spark):
    texts = ["Released under the MIT License.", "released under the mit license by the author", "the mit", "Licensed under CC BY-NC 4.0. or so", "under the"]
    got = {x.row: x for x in license_scan.license_scan(spark.createDataFrame([(str(i), t, i) for i, t in enumerate(texts)], "path string, text string, row long"), threshold=0.5).collect()}
    units = [dict.fromkeys([t, *re.split(r"[.!?][ \t\r\n]+", t)]) for t in texts]
    bags = [license_scan.template_words(t) for t in texts]
    known = {f for _, t in license_scan.TEMPLATES for f in license_scan.features(license_scan.template_words(t))}

    def idf(f):
        df = [sum(w in b for b in bags) for w in f.split()]
        return math.log((len(texts) + 1) / (min(df) + 1 if f in known else 1)) + 1e-3

    for i in range(len(texts)):
        best = {}
        for unit, (name, t) in itertools.product(units[i], license_scan.TEMPLATES):
            fs, ft = (license_scan.features(license_scan.template_words(x)) for x in (unit, t))
            a, b = ({f: (x.count(f) if f in known else 1) * idf(f) for f in x} for x in (fs, ft))
            cos = sum(a[f] * b.get(f, 0) for f in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a else 0
            if cos >= 0.5:
                best[name] = max(best.get(name, 0), round(cos, 6))
        if best:
            top = min(best, key=lambda n: (-best[n], n))
            assert (got[i].license, got[i].score) == (top, pytest.approx(best[top], abs=2e-6))
            assert got[i].near == ",".join(sorted(n for n, x in best.items() if n != top and x >= round(best[top] - license_scan.NEAR, 6)))
        else:
            assert got[i].license is None


def quality_rows(n=300, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{r.randrange(200)}" for _ in range(40)]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(["nasty", "awful,", "vile."])
        rows.append((i, " ".join(w), bad))
    return rows


def test_quality(spark):
    rows = quality_rows()
    docs = table(spark, [(i, t) for i, t, _ in rows] + ODD).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a").otherwise(F.lit(None)))
    docs = docs.withColumns({"_host": F.lit("mine"), "key_a": F.lit(1), "row_key": F.lit("x"), "a.b": F.lit(2)})
    labels = spark.createDataFrame([(i, b) for i, _, b in rows[:200]] + [(None, True), (5, None)], "doc_id long, bad boolean")
    got = quality.judged(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(rows) + len(ODD)
    keep = {x.doc_id: x.keep for x in got}
    assert sum(keep[i] == b for i, _, b in rows[200:]) <= 2
    out = quality.kept(docs, labels, F.col("source"), F.col("lang"))
    assert out.columns == docs.columns
    out, key = out.collect(), lambda x: -1 if x is None else x
    assert {(x._host, x.key_a, x.row_key) for x in out} == {("mine", 1, "x")}
    assert sorted((x.doc_id for x in out), key=key) == sorted((x.doc_id for x in got if x.keep), key=key)
    one = spark.createDataFrame([(0, True)], "doc_id long, bad boolean")
    assert all(x.keep for x in quality.judged(docs, one, F.col("source"), F.col("lang")).collect())


def test_quality_tells_null_sites_apart(spark):
    """One id and text with host null and path "a", and the other way round: a rejection concerns its row only."""
    rows = [(1, "t", None, "a"), (1, "t", "a", None), (None, "t", "a", None), (1, None, "t", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    values = [F.col(c) for c in docs.columns]
    keys = docs.select("*", *quality.identity(*values)).collect()
    assert len({(x.key_a, x.key_b) for x in keys}) == 4
    gone = spark.createDataFrame([(keys[0].key_a, keys[0].key_b)], "key_a long, key_b long")
    assert sorted(map(tuple, quality.without(docs, values, gone).collect()), key=str) == sorted(rows[1:], key=str)


def brute_strength(groups):
    """(n, total, parent) rows."""
    groups = [g for g in groups if g[0] > 1]
    found = sum(n * (t / n - m) ** 2 for n, t, m in groups)
    chance, more = sum(m * (1 - m) for _, _, m in groups), sum((n - 1) * m * (1 - m) for n, _, m in groups)
    rho = (found - chance) / more if more else 0
    return min(1e6, max(2.0, 1 / rho - 1)) if rho > 1e-6 else 1e6


def test_posteriors_against_plain_sums(spark):
    """Many sites of few documents and a few large ones that differ; a site table overrides the columns."""
    r = random.Random(11)
    bad_hosts = {"h0": 0.9, "h1": 0.6}
    rows, sites, labels = [], [], []
    for i in range(400):
        host = r.choice(["h0", "h1", "h2", "h3", None]) if r.random() < 0.8 else f"rare{r.randrange(30)}"
        path = r.choice(["/a/", "/b/", None])
        bad = r.random() < bad_hosts.get(host, 0.1)
        w = [f"w{r.randrange(60)}" for _ in range(30)] + (["nasty"] * r.randint(0, 3) if bad else [])
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 1))
        labels.append((i, bad))
        if i % 5:
            sites += [(i, host, path), (i, host, path)]
    sites += [(None, "h0", "/a/"), (7000, "h0", "/a/")]
    site = {i: (h, p) for i, h, p in sites}
    docs = spark.createDataFrame(rows, DOCS)
    got = quality.judged(docs, spark.createDataFrame(labels[:300], "doc_id long, bad boolean"), F.col("source"), F.col("lang"), spark.createDataFrame(sites, "doc_id long, host string, path string")).collect()
    at = {x.doc_id: site.get(x.doc_id, (f"s{x.doc_id % 3}", "en")) for x in got}
    assert {x.doc_id: (x.host, x.path) for x in got} == at and len(got) == 400
    own = {x.doc_id: x.p_document for x in got}
    paths, hosts = {}, {}
    for i, (h, p) in at.items():
        paths.setdefault((h, p), []).append(own[i])
        hosts.setdefault(h, []).append(own[i])
    overall = sum(own.values()) / 400
    k = brute_strength([(len(v), sum(v), overall) for v in hosts.values()])
    parent = {h: (sum(v) + k * overall) / (len(v) + k) for h, v in hosts.items()}
    k2 = brute_strength([(len(v), sum(v), parent[h]) for (h, _), v in paths.items()])
    assert k < 100 and got[0].k_host == pytest.approx(k) and got[0].k_path == pytest.approx(k2, rel=1e-6)
    rates = []
    for x in got:
        h, p = at[x.doc_id]
        rest = (sum(own.values()) - x.p_document) / 399
        up = (sum(hosts[h]) - x.p_document + k * rest) / (len(hosts[h]) - 1 + k)
        want = (sum(paths[h, p]) - x.p_document + k2 * up) / (len(paths[h, p]) - 1 + k2)
        assert x.p_site == pytest.approx(want, rel=1e-9) and x.p_all == pytest.approx(rest, rel=1e-9) and x.site_docs == len(paths[h, p])
        odds = math.log(x.p_document / (1 - x.p_document)) + math.log(want / (1 - want)) - math.log(rest / (1 - rest))
        assert x.p_bad == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-6) and x.keep == (x.p_bad < quality.THRESHOLD)
        rates.append(x.p_site)
    assert max(rates) > 2 * overall > 4 * min(rates)


def test_sites_are_shrunk(spark):
    groups = spark.createDataFrame([("a", 1000, 500.0, 0.1), ("b", 1000, 20.0, 0.1), ("c", 10, 1.0, 0.1)], "host string, n long, total double, parent double")
    assert 2 <= quality._strength(groups) < 20
    same = spark.createDataFrame([("a", 1000, 100.0, 0.1), ("b", 1000, 100.0, 0.1)], "host string, n long, total double, parent double")
    assert quality._strength(same) == 1e6
