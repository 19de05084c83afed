"""Variable-capacity best-fit packing of documents into training sequences.

A document's length is its number of token ids under an existing tokenizer, with an end id, or a column
the caller gives.  What exceeds the largest capacity fills sequences of its own, start by start; the rest
of every document is packed.  Rows are dealt by hash into shards of about SHARD_ROWS rows, so a task's
memory is bounded and shards need not know of each other.

A sequence of capacity c costs ``overhead + c + c * c / quadratic``: a fixed part, one that grows with its
length, and attention.  In a shard, pieces go longest first into the open bin with the least room that
still takes them.  When none does, a bin is opened, of the permitted length that costs least for each token:
for every length that takes the piece, its room is filled on trial with the longest pieces that are still
to come and fit, and the cost of the smallest length that holds the result is divided by its contents.  At
the end every bin is downsized to the smallest length that holds its contents.  The same shard is also
packed with each length as the only preferred one; the cheapest of all packings stays, so the joint choice
is never worse than one size.

Defined cases: null texts have length 1 (the end token); null doc_ids are packed as null; repeated rows
are packed each; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .token_bins import token_lengths

SHARD_ROWS = 1 << 14


def cost(capacity: int, overhead: float, quadratic: float) -> float:
    return overhead + capacity + capacity * capacity / quadratic


def trial_fill(ascending: list[int], sums: list[int], upto: int, room: int) -> int:
    """What of room the longest fitting pieces among ascending[:upto] fill; sums are their running sums from 0."""
    filled = 0
    while upto and room:
        upto = bisect_right(ascending, room, 0, upto)
        if not upto:
            break
        low = bisect_left(sums, sums[upto] - room, 0, upto)  # the longest run that ends here and fits
        filled += sums[upto] - sums[low]
        room -= sums[upto] - sums[low]
        upto = low
    return filled


def best_fit(lengths: np.ndarray, capacities: list[int], prefer: int | None = None, overhead: float = 0, quadratic: float = float("inf")) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each piece, its place in the bin, and each bin's content.

    Bins open at size prefer if that will do; without one, at the size of the least cost for each token.
    """
    room: list[tuple[int, int]] = []
    bins, places, used, cap = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), [], []
    order = np.argsort(-lengths, kind="stable")
    ascending = lengths[order[::-1]].tolist()
    sums = np.concatenate([[0], np.cumsum(ascending, dtype=np.int64)]).tolist()
    costs = [cost(c, overhead, quadratic) for c in capacities]

    def opened(size: int, rest: int) -> int:
        least = bisect_left(capacities, size)
        if prefer is not None:
            return prefer if size <= prefer else capacities[least]
        held = [size + trial_fill(ascending, sums, rest, c - size) for c in capacities[least:]]
        rate = [costs[bisect_left(capacities, h)] / h for h in held]
        return capacities[least + min(range(len(held)), key=lambda i: (rate[i], -i))]

    for done, i in enumerate(order):
        size = int(lengths[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            _, b = room.pop(at)
        else:
            b = len(used)
            used.append(0)
            cap.append(opened(size, len(lengths) - done - 1))
        bins[i], places[i] = b, used[b]
        used[b] += size
        if cap[b] > used[b]:
            insort(room, (cap[b] - used[b], b))
    return bins, places, np.array(used, np.int64)


def pack_shard(lengths: np.ndarray, capacities: list[int], overhead: float, quadratic: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each piece, each bin's content and its capacity after downsizing, at the least cost."""
    best = None
    sizes, costs = np.array(capacities), np.array([cost(c, overhead, quadratic) for c in capacities])
    for prefer in (None, *reversed(capacities)):
        bins, places, used = best_fit(lengths, capacities, prefer, overhead, quadratic)
        at = np.searchsorted(sizes, used)
        spent = float(costs[at].sum())
        if best is None or spent < best[0]:
            best = spent, bins, places, used, sizes[at]
    return best[1:]


def packed(
    docs: DataFrame, tokenizer: str | None = None, capacities: tuple[int, ...] = (512, 1024, 2048, 4096), overhead: float = 64, quadratic: float = 16384, length: Column | None = None
) -> DataFrame:
    """A row for each piece: doc_id, piece_start, piece_length, bin_id, bin_place, bin_used, bin_capacity.

    Lengths are those of the tokenizer's ids for the column text and an end id, or the column length.
    """
    if tokenizer is None and length is None:
        raise ValueError("packing needs a tokenizer or a length")
    sizes = sorted(set(capacities))
    largest = sizes[-1]
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    measured = token_lengths(docs, tokenizer) if length is None else docs.select(doc_id, length.cast("long").alias("length"))
    rows = written(measured.select("doc_id", "length", F.monotonically_increasing_id().alias("row")).where("length > 0"), "lengths")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("long"))
    full = dealt.where(F.col("length") >= largest).select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / largest) - 1)).alias("k"), "row"
    )
    whole = full.select(
        "doc_id", (F.col("k") * largest).cast("long").alias("piece_start"), F.lit(largest).cast("long").alias("piece_length"),
        F.concat_ws("-", F.lit("row"), "row", "k").alias("bin_id"), F.lit(0).cast("long").alias("bin_place"), F.lit(largest).cast("long").alias("bin_used"), F.lit(largest).cast("long").alias("bin_capacity"),
    )

    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].fill_null(-(1 << 63)).to_numpy()
        order = np.lexsort((table["row"].to_numpy(), ids, -table["rest"].to_numpy()))
        table = table.take(pa.array(order))
        bins, places, used, final = pack_shard(table["rest"].to_numpy(), sizes, overhead, quadratic)
        shard = table["shard"][0].as_py()
        return pa.table(
            {
                "doc_id": table["doc_id"], "piece_start": table["start"], "piece_length": table["rest"], "bin_id": [f"{shard}-{b}" for b in bins.tolist()],
                "bin_place": places, "bin_used": used[bins], "bin_capacity": final[bins],
            }
        )

    start = F.col("length") - F.pmod("length", F.lit(largest))
    rests = dealt.select("shard", "doc_id", "row", start.alias("start"), (F.col("length") - start).alias("rest")).where("rest > 0")
    schema = "doc_id long, piece_start long, piece_length long, bin_id string, bin_place long, bin_used long, bin_capacity long"
    return rests.groupBy("shard").applyInArrow(run, schema).unionByName(whole)
