"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to integers ``floor(scale * x)``.  An index block holds some thousands of
vectors as bitmaps: for each attribute one bitmap for every binary digit of ``value - least`` (one bit
a row).  A query adds its attributes' slices, shifted by the digits of its own values, with carry
logic on whole bitmaps into the slices of the score.  Then rows are selected from the most significant
slice downward: rows with the digit set win while they are k at most, else the search stays among
them.  Rows that are still equal after the last slice are the boundary; they have exactly equal scores
and are taken by ascending vec_id.

Every block is built once and kept in a written table.  Queries go to the blocks in packs of PACK, one
pack after the other, each a broadcast of fixed size; a task takes its blocks one by one and keeps k rows
a query.  With few blocks each is read by several tasks, which share the pack.  All queries meet all
blocks, as exact search has to, so the work grows with rows times queries.

Defined cases: vectors that are null or empty, or hold null or non-finite components, or whose id is null
take no part; nor do those with components so large that an inner product could leave 64 bits
(``dim * x * x >= 2^62``); vectors of another length than the query are no candidates of it; rows that repeat
a vec_id are candidates of their own, except for queries of that id; rows that repeat a query's id and vector
are one query, other vectors under its id are queries with ranks of their own.  Other columns are ignored.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import dropped, written

BLOCK = 1 << 16
PACK = 1 << 13


def quantised(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, x array<bigint>, dim) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    dim = F.size("embedding")
    most = F.sqrt(F.lit(2.0**62) / dim)
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & (dim > 0)
    ok &= F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) + 1 < most))
    return rows.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("x"), dim.alias("dim"))


class BitSlices:
    """Bitmaps of one block of integer vectors (rows sorted by id)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], x[order]
        self.rows = len(x)
        self.least = x.min(axis=0)
        shifted = (x - self.least).astype(np.uint64)
        self.slices = []
        for d in range(x.shape[1]):
            top = int(shifted[:, d].max()).bit_length()
            self.slices.append([self._packed((shifted[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(top)])
        self.all = self._packed(np.ones(self.rows, np.uint8))

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        bits = np.concatenate([bits.astype(np.uint8), np.zeros(-len(bits) % 64, np.uint8)])
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def scores(self, q: list[int]) -> list[np.ndarray]:
        """Slices of sum(q[d] * x[d]) plus a constant of the query, least significant first."""
        up, down = [], []
        for weight, slices in zip(q, self.slices, strict=True):
            if not slices:  # an attribute of one value is in the constant
                continue
            into, size = (up, weight) if weight >= 0 else (down, -weight)
            for j in range(size.bit_length()):
                if size >> j & 1:
                    _add(into, slices, j)
        if not down:
            return up
        width = max(len(up), len(down)) + 1
        ones = np.full_like(self.all, ~np.uint64(0))
        up += [np.zeros_like(self.all) for _ in range(width - len(up))]
        flip = [x ^ ones for x in down] + [ones] * (width - len(down))  # two's complement: up - down, then the sign's digit turned
        carry = ones
        out = []
        for a, b in zip(up, flip, strict=True):
            ab = a ^ b
            out.append(ab ^ carry)
            carry = (a & b) | (carry & ab)
        out[-1] = out[-1] ^ ones
        return out

    def top(self, q: list[int], k: int, own: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best rows, ties to smaller ids, without rows of the id own."""
        slices = self.scores(q)
        live = self.all.copy()
        a, b = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        if b > a:
            mine = np.zeros(self.rows, np.uint8)
            mine[a:b] = 1
            live &= ~self._packed(mine)
        sure = np.zeros_like(live)
        want = min(k, int(np.bitwise_count(live).sum()))
        have = 0
        for s in reversed(slices):
            high = live & s
            n = int(np.bitwise_count(high).sum())
            if have + n > want:
                live = high
            else:
                sure |= high
                have += n
                live &= ~s
        chosen = np.concatenate([self._at(sure), self._at(live)[: want - have]])
        value = np.zeros(len(chosen), np.int64)
        for i, s in enumerate(slices):
            value += ((s[chosen >> 6] >> (chosen & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i
        offset = sum(w * int(x) for w, x in zip(q, self.least, strict=True))
        if any(w < 0 and x for w, x in zip(q, self.slices, strict=True)):
            offset -= 1 << (len(slices) - 1)
        return [(int(self.ids[i]), int(v) + offset) for i, v in zip(chosen, value, strict=True)]

    @staticmethod
    def _at(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _add(into: list[np.ndarray], slices: list[np.ndarray], shift: int) -> None:
    """Adds a number in slices, shifted, to the number in into."""
    while len(into) < shift + len(slices):
        into.append(np.zeros_like(slices[0]))
    carry = None
    at = shift
    for s in slices:
        a = into[at]
        ab = a ^ s
        if carry is None:
            into[at], carry = ab, a & s
        else:
            into[at], carry = ab ^ carry, (a & s) | (carry & ab)
        at += 1
    while carry is not None and carry.any():
        if at == len(into):
            into.append(carry)
            return
        into[at], carry = into[at] ^ carry, into[at] & carry
        at += 1


def _matrix(column) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    return np.asarray(x.flatten()).reshape(len(x), -1)


def _build(table: pa.Table) -> pa.Table:
    index = BitSlices(table["vec_id"].to_numpy(), _matrix(table["x"]))
    return pa.table({"block": table["block"].slice(0, 1), "index": pa.array([pickle.dumps(index, pickle.HIGHEST_PROTOCOL)], pa.binary())})


class Best:
    """The k best (score, vec_id) of each query so far: descending scores, then ascending ids."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, query: int, hits: list[tuple[int, int]]) -> None:
        self.of[query] = sorted(self.of.get(query, []) + [(-score, vec) for vec, score in hits])[: self.k]


def _asked(index: DataFrame, queries: list[tuple[int, int, list[int]]], k: int, splits: int) -> DataFrame:
    """(query, query_id, vec_id, score): the best rows of the index's blocks for the queries (query, vec_id, x), k for each task."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        best, ids = Best(k), {}
        for batch in batches:
            for split, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = pickle.loads(blob.as_buffer())
                for query, own, x in shared.value[split::splits]:
                    ids[query] = own
                    best.add(query, block.top(x, k, own))
        out = [(query, ids[query], vec, -less) for query, hits in best.of.items() for less, vec in hits]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out, strict=True)) or [[]] * 4)], names=["query", "query_id", "vec_id", "score"])

    n = index.count()
    spread = index.select(F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), "index").repartition(min(n * splits, 1 << 16))
    out = written(spread.mapInArrow(run, "query long, query_id long, vec_id long, score long"), "best")
    shared.unpersist()
    return out


def top_k(rows: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by every, its k best others."""
    spark = rows.sparkSession
    data = written(quantised(rows, scale), "vectors")
    sizes = {r["dim"]: r["rows"] for r in data.groupBy("dim").agg(F.count("*").alias("rows")).collect()}  # a row for each length of vectors
    parts, base = [], 0
    for dim, n in sorted(sizes.items()):
        of = data.where(F.col("dim") == dim)
        blocks = -(-n // BLOCK)
        dealt = of.select("vec_id", "x", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"))
        index = written(dealt.groupBy("block").applyInArrow(_build, "block long, index binary").select("index"), "slices")
        splits = max(1, 2 * spark.sparkContext.defaultParallelism // blocks)
        queries = of.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "x").distinct()
        queries = written(queries.withColumn("pack", F.pmod(F.xxhash64("vec_id", "x"), F.lit(-(-n // (every * PACK))))), "queries")
        for pack in sorted(r["pack"] for r in queries.select("pack").distinct().collect()):  # a number for each pack
            held = queries.where(F.col("pack") == pack).select("vec_id", "x").toArrow()  # about PACK rows
            asked = list(zip(range(base, base + len(held)), held["vec_id"].to_pylist(), held["x"].to_pylist(), strict=True))
            base += len(held)
            parts.append(_asked(index, asked, k, splits))
        dropped(index, queries)
    dropped(data)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = reduce(DataFrame.union, parts)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
