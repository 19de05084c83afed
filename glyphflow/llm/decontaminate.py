"""Benchmark decontamination: short test items found inside long documents.

An item is in a document when the document holds at least ``num / den`` of the item's distinct
n-word shingles (with fewer words than n, the whole item as one shingle; a document has one shingle
too then only if it is that short; with short, an item of fewer words than n is looked up among all
runs of its own length of the document).  The search is a MinHash containment index:

* items are partitioned by size, each size class covering a factor of two;
* an item is sketched by the ``q - ceil(q * num / den) + 1`` smallest of its q shingle hashes.  A
  document that holds num / den of the item holds at least one of these, whatever its own length, so
  no containment is missed;
* a document looks its hashes up in the sketches of those classes only that are not too large for it,
  and every candidate is verified by the exact number of the item's shingles it holds.

The index goes to the executors in parts of about PART_SHINGLES shingles, one after the other; a larger
benchmark takes several passes over the documents, each of which is written before the next part is sent.
There is no shuffle.

Defined cases: null or blank texts hold nothing and are in nothing; an item without an id is searched like
all others and named null; a document without an id is searched too, its pairs have a null doc_id, and
clean_documents() removes it if it holds an item, with or without an id; repeated rows give repeated pairs
for documents and one for items of one id and text; other columns are ignored, or kept by clean_documents().
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, identity, without, written
from .wordhash import shingle_hashes, slices, word_hashes

PART_SHINGLES = 1 << 22


def _item_sets(items: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            words, at = word_hashes(batch.column("text"))
            sets = [np.unique(shingle_hashes(words[at[i] : at[i + 1]], n)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(np.minimum(np.diff(at), n).astype(np.int64))],
                names=["item_id", "n_item", "shingles", "width"],
            )

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, n_item long, shingles binary, width long").where("n_item > 0").distinct()


class SketchIndex:
    """Size-partitioned bottom-k sketches of items and their whole shingle sets."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], num: int, den: int):
        self.ids, self.sets, self.num, self.den = ids, sets, num, den
        parts: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            parts.setdefault(len(s).bit_length(), []).append(i)
        self.parts = []
        for size in sorted(parts):
            of = parts[size]
            sketches = [sets[i][: len(sets[i]) - -(-num * len(sets[i]) // den) + 1] for i in of]
            value, owner = np.concatenate(sketches), np.repeat(of, [len(s) for s in sketches])
            order = np.argsort(value, kind="stable")
            self.parts.append((min(len(sets[i]) for i in of), value[order], owner[order]))

    def search(self, s: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its size, shingles held) of all items contained in the ascending set s."""
        out = []
        for least, value, owner in self.parts:
            if len(s) * self.den < least * self.num:
                break
            low, high = np.searchsorted(value, s, "left"), np.searchsorted(value, s, "right")
            hit = np.flatnonzero(high > low)
            for i in sorted({int(o) for h in hit for o in owner[low[h] : high[h]]}):
                item = self.sets[i]
                held = int((s[np.minimum(np.searchsorted(s, item), len(s) - 1)] == item).sum())
                if held * self.den >= self.num * len(item):
                    out.append((self.ids[i], len(item), held))
        return out


def _doc_set(words: np.ndarray, n: int, widths: list[int]) -> np.ndarray:
    """The n-word shingles of a text and, of more than that, its runs of these smaller widths."""
    return np.unique(np.concatenate([shingle_hashes(words, n), *(shingle_hashes(words, k) for k in widths if k < len(words))]))


def _hits(docs: DataFrame, items: DataFrame, n: int, num: int, den: int, short: bool) -> DataFrame:
    """(key_a, key_b, doc_id, item_id, n_item, n_shared) of docs (key_a, key_b, doc_id, text): a written table."""
    spark = docs.sparkSession
    sets = written(_item_sets(items, n), "items")
    total = sets.agg(F.sum("n_item")).first()[0] or 0
    parts = -(-total // PART_SHINGLES)
    widths = sorted(r["width"] for r in sets.where(F.col("width") < n).select("width").distinct().collect()) if short else []  # n - 1 rows at most
    names = ["key_a", "key_b", "doc_id", "item_id", "n_item", "n_shared"]
    schema, kind = ", ".join(f"{x} long" for x in names), pa.schema([(x, pa.int64()) for x in names])

    def one(part: int) -> DataFrame:
        held = sets.where(F.pmod(F.xxhash64("shingles"), F.lit(parts)) == part).orderBy("item_id", "shingles").select("item_id", "shingles").toArrow()  # about PART_SHINGLES
        shared = spark.sparkContext.broadcast(SketchIndex(held["item_id"].to_pylist(), [np.frombuffer(x, np.uint64) for x in held["shingles"].to_pylist()], num, den))

        def run(batches):
            index = shared.value
            for batch in slices(batches):
                words, at = word_hashes(batch.column("text"))
                found = []
                for i in range(batch.num_rows):
                    s = _doc_set(words[at[i] : at[i + 1]], n, widths)
                    if len(s) and (hits := index.search(s)):
                        doc = [batch.column(k)[i].as_py() for k in range(3)]
                        found += [dict(zip(names, (*doc, *hit), strict=True)) for hit in hits]
                yield pa.RecordBatch.from_pylist(found, schema=kind)

        out = written(docs.select("key_a", "key_b", "doc_id", "text").mapInArrow(run, schema), "hits")
        shared.unpersist()
        return out

    out = reduce(DataFrame.union, [one(p) for p in range(parts)]) if parts else spark.createDataFrame([], schema)
    dropped(sets)
    return out


def _plain(docs: DataFrame) -> tuple[Column, Column]:
    return F.col("doc_id").cast("long"), F.col("text").cast("string")


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100, short: bool = False) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) of all pairs where the document holds the item."""
    doc_id, text = _plain(docs)
    none = F.lit(None).cast("long")
    return _hits(docs.select(none.alias("key_a"), none.alias("key_b"), doc_id.alias("doc_id"), text.alias("text")), items, n, num, den, short).drop("key_a", "key_b")


def clean_documents(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100, short: bool = False) -> DataFrame:
    """docs without those that hold an item."""
    doc_id, text = _plain(docs)
    hits = _hits(docs.select(*identity(doc_id, text), doc_id.alias("doc_id"), text.alias("text")), items, n, num, den, short)
    return without(docs, [doc_id, text], written(hits.select("key_a", "key_b").distinct(), "contaminated"))
