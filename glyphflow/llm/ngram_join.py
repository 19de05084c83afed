"""N-gram Jaccard self-join: exact links and groups of documents with nearly equal shingle sets.

A document's set holds its distinct n-word shingles (with fewer words, the whole sequence as one).
Two documents link when ``den * |x & y| >= num * |x | y|``.  The steps:

1. Equal sets become one class, kept by one of its rows.
2. The shingles of classes are counted in buckets, which tell each class how many of its own occur in no
   other class.  A class with more than ``n - ceil(n * num / den)`` of them links with none and is done.
   The sets of the others are counted among themselves, every shingle exactly, and the same rule holds
   again.  Each class left posts, of its first ``n - ceil(n * num / den) + 1`` shingles in one global order
   (by that count, then by hash), rarest first, those that are repeated; linked classes share at least one.
3. Classes that share a posted shingle and are of one size or the next (sizes in steps of den / num) form
   families (connected components of star edges: each class with the smallest class of the shingle and
   size, so no pairs are written).  A large family whose classes
   share few shingles each is split by shingle: shingles are dealt into buckets of about PAIR_ROWS
   classes, and a class goes to the buckets of its own.  Families, or such buckets, are the units.
4. The sets of a unit are stored in a prefix tree, most common shingles first (in one order everywhere, of
   which a bounded list has the counts).  All
   probes go down the tree together: equal beginnings are counted once for all sets below, and a probe
   leaves a subtree as soon as the shingles that remain on either side cannot reach the overlap asked for.
5. Large units are dealt out in blocks by size; every two blocks whose sizes fit meet in a task.  So a set goes
   to many tasks, and the groups of blocks are dealt into rounds, one after the other: a round ships about an
   eighth of the shingles of all classes (ROUND_SHINGLES at least), and its shuffle files are gone before the
   next one.  So are the counts of step 2 made; the sets of candidates are written once and not copied.

ngram_links() finds every link: of classes a and b that link each adds the other's rows to its number,
once, in the first unit that both are in.  connected() finds as many links as connect what all links
connect: every block meets a pivot block first; then only the classes outside the unit's largest group
meet all blocks of a fitting size, and equal labels are pruned in the tree.

Defined cases: null or blank texts have an empty set, n_shingles 0, and are alone.  ngram_links(): a null
doc_id takes part in nothing and has a null component_id; rows that repeat a doc_id are one document: each
row is returned, with the links of all its texts.  distinct_documents() looks at rows, whatever their id.
Other columns are ignored there and kept here.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import dropped, identity, swept, without, written
from .wordhash import give_back, mix, shingle_hashes, slices, word_hashes

HEAVY = 1 << 18
BUCKET_SHINGLES = 1 << 20
LEAST_BUCKET_BITS, MOST_BUCKET_BITS = 6, 18
LEAST_FILTER_BITS, MOST_FILTER_BITS = 1 << 16, 1 << 27
SLICE_ROWS = 1 << 16
TOLD_SHINGLES = 1 << 22
PAIR_ROWS = 256
BLOCK_SHINGLES = 1 << 20
ROUND_SHINGLES = 1 << 24
PAIR_CELLS = 1 << 24


def _sets(batch: pa.RecordBatch, n: int, keep: np.ndarray | None = None) -> list[np.ndarray]:
    words, at = word_hashes(batch.column("text"))
    return [np.unique(shingle_hashes(words[at[i] : at[i + 1]], n)) for i in (range(batch.num_rows) if keep is None else np.flatnonzero(keep))]


def _prints(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum().view(np.int64)), int(mix(s ^ np.uint64(0xA0761D6478BD642F)).sum().view(np.int64))


def _fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """(key_a, key_b, doc_id, n, f1, f2) of every row: the size of its set and two 64-bit sums over it."""

    def describe(batches):
        for batch in slices(batches):
            sets = _sets(batch, n)
            prints = [_prints(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1))],
                names=["key_a", "key_b", "doc_id", "n", "f1", "f2"],
            )

    return docs.select("key_a", "key_b", "doc_id", "text").mapInArrow(describe, "key_a long, key_b long, doc_id long, n long, f1 long, f2 long")


def _bits_of(values: np.ndarray, k: int, size: int) -> np.ndarray:
    return (mix(values.view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(size - 1)).astype(np.int64)


def bit_filter(values: DataFrame, column: str, n: int) -> np.ndarray:
    """The words of a bit filter over a column of n integers: about 16 bits each, within fixed bounds.

    What it doesn't let through isn't in the column; more values than it has room for only let more through.
    """
    size = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, 1 << (16 * max(n, 1) - 1).bit_length()))

    def mark(batches):
        for batch in batches:
            bits = np.unique(np.concatenate([_bits_of(batch.column(0).to_numpy(zero_copy_only=False), k, size) for k in range(2)]))
            word, mask = bits >> 6, np.int64(1) << (bits & 63)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(mask, first) if len(word) else mask)], names=["word", "mask"])

    marks = values.select(F.col(column).cast("long").alias("value")).mapInArrow(mark, "word long, mask long")
    marks = marks.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # size / 64 rows at most
    words = np.zeros(size // 64, np.int64)
    words[marks["word"].to_numpy()] = marks["mask"].to_numpy()
    return words


def let_through(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a filter with these words lets through."""
    keep = np.ones(len(values), bool)
    for k in range(2):
        bit = _bits_of(values, k, len(words) * 64)
        keep &= (words[bit >> 6] >> (bit & 63)) & 1 == 1
    return keep


def bucket_bits(shingles: int) -> int:
    """Of a shingle's hash, the bits that name its bucket: buckets of about BUCKET_SHINGLES each."""
    return min(MOST_BUCKET_BITS, max(LEAST_BUCKET_BITS, (max(1, shingles) // BUCKET_SHINGLES).bit_length()))


def cut_hashes(s: np.ndarray, bits: int) -> np.ndarray:
    """The upper 32 + bits bits of hashes, which are those that repeated_shingles() counts."""
    return s & ~np.uint64((1 << (32 - bits)) - 1)


def spare_shingles(size, num: int, den: int):
    """Of a set of this size, the shingles that a link may leave out."""
    return size - -(-num * size // den)


def maybe_linked(docs: DataFrame, n: int, num: int, den: int, bits: int, chosen) -> DataFrame:
    """(key_a) of the chosen texts that share with other texts all shingles but those that a link may leave out.

    Every slice of texts sends each of its shingles once to the shingle's bucket, packed into four bytes (of a
    hash the upper 32 + bits bits count), with the text's place in the slice if no other of its texts has it.
    The buckets answer with the number of each text's shingles that came from nowhere else, and those numbers
    meet the slice's keys again, so nothing needs room for all shingles.  A slice is named by its contents: if
    a task that runs again cuts other slices, numbers are missing, which only lets more texts through.
    """

    def deal(batches):
        for batch in slices(batches):
            keep = np.flatnonzero(let_through(chosen.value, batch.column("key_a").to_numpy()))
            for at in range(0, len(keep), SLICE_ROWS):
                yield pack(batch, keep[at : at + SLICE_ROWS])

    def pack(batch, rows):
        keep = np.zeros(batch.num_rows, bool)
        keep[rows] = True
        sets = _sets(batch, n, keep)
        sizes = np.array([len(s) for s in sets], np.int64)
        keys = batch.column("key_a").to_numpy()[rows].astype(np.int64)
        name = int(mix(mix(keys.view(np.uint64)) + np.arange(len(keys), dtype=np.uint64)).sum().view(np.int64))
        value = cut_hashes(np.concatenate([*sets, np.zeros(0, np.uint64)]), bits)
        place = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order = np.argsort(value)
        first = np.ones(len(value), bool)
        first[1:] = value[order[1:]] != value[order[:-1]]
        last = np.append(first[1:], True)[: len(value)]
        once, often = np.sort(order[first & last]), value[order[first & ~last]]
        bucket = (value[once] >> np.uint64(64 - bits)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        once, bucket, bucket_often = once[by], bucket[by], (often >> np.uint64(64 - bits)).astype(np.int64)
        low, place, often = (value[once] >> np.uint64(32 - bits)).astype(np.uint32), place[once], (often >> np.uint64(32 - bits)).astype(np.uint32)
        full = np.unique(np.concatenate([bucket, bucket_often]))
        a, b, c, d = (np.searchsorted(x, full, side) for x in (bucket, bucket_often) for side in ("left", "right"))
        spans = list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True))
        #: The slice's keys, with what each text may leave out, go to a bucket of their own.
        return pa.RecordBatch.from_arrays(
            [
                pa.array([-1 - (name & (1 << 62) - 1), *full.tolist()], pa.int64()), pa.array([name] * (len(full) + 1), pa.int64()),
                pa.array([keys.tobytes(), *(low[i:j].tobytes() for i, j, _, _ in spans)], pa.binary()),
                pa.array([np.where(sizes > 0, spare_shingles(sizes, num, den), -1).tobytes(), *(place[i:j].tobytes() for i, j, _, _ in spans)], pa.binary()),
                pa.array([b"", *(often[i:j].tobytes() for _, _, i, j in spans)], pa.binary()),
            ],
            names=["bucket", "slice", "once", "place", "often"],
        )

    def count(batches):
        key, held, found, size = None, [], {}, 0

        def settle():
            """What only one slice has of a bucket, by slice."""
            lone = np.concatenate([once for _, once, _, _ in held])
            _, where, times = np.unique(np.concatenate([lone, *(x for _, _, _, often in held for x in (often, often))]), return_inverse=True, return_counts=True)
            alone, at = times[where[: len(lone)]] == 1, 0
            for name, once, place, _ in held:
                found.setdefault(name, []).append(place[alone[at : at + len(once)]])
                at += len(once)
            return len(lone)

        def told():
            sums = [np.unique(np.concatenate(x), return_counts=True) for x in found.values()]
            rows = [list(found), [None] * len(sums), [p.tobytes() for p, _ in sums], [t.astype(np.uint32).tobytes() for _, t in sums]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)

        names, kinds = ["slice", "keys", "place", "times"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for bucket, name, once, place, often in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(i) for i in (2, 3, 4)), strict=True):
                if bucket < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((name, once.as_py(), place.as_py(), None), kinds, strict=True)], names=names)
                    continue
                if bucket != key:
                    size += settle() if held else 0
                    key, held = bucket, []
                    if size > TOLD_SHINGLES:
                        yield told()
                        found, size = {}, 0
                held.append((name, np.frombuffer(once.as_py(), np.uint32), np.frombuffer(place.as_py(), np.uint16), np.frombuffer(often.as_py(), np.uint32)))
        if held:
            settle()
            yield told()
        give_back()

    def gather(batches):
        at, keys, spare, parts = None, None, None, []

        def left():
            if keys is None:  # of a slice that was cut again
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["key_a"])
            alone = np.zeros(len(keys), np.int64)
            for place, times in parts:
                alone[place] += times
            return pa.RecordBatch.from_arrays([pa.array(keys[alone <= spare])], names=["key_a"])

        for batch in batches:
            for name, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if name != at:
                    if at is not None:
                        yield left()
                    at, keys, spare, parts = name, None, None, []
                if row[0] is not None:
                    keys, spare = np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.int64)
                else:
                    parts.append((np.frombuffer(row[1], np.uint16), np.frombuffer(row[2], np.uint32)))
        if at is not None:
            yield left()

    parts = docs.select("key_a", "text").mapInArrow(deal, "bucket long, slice long, once binary, place binary, often binary")
    told = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "slice long, keys binary, place binary, times binary")
    return told.repartition("slice").sortWithinPartitions("slice").mapInArrow(gather, "key_a long")


class GlobalOrder:
    """The one order of all shingles in prefix trees: by the number of texts of the most common, then by hash."""

    def __init__(self, value: np.ndarray, times: np.ndarray):
        order = np.argsort(value)
        self.value, self.times = value[order], times[order]

    def counts(self, s: np.ndarray) -> np.ndarray:
        """The number of a common shingle, 1 for the rest."""
        rank = np.ones(len(s), np.int64)
        if len(self.value) and len(s):
            place = np.minimum(np.searchsorted(self.value, s), len(self.value) - 1)
            rank = np.where(self.value[place] == s, self.times[place], rank)
        return rank


def _candidates(docs: DataFrame, n: int, chosen) -> DataFrame:
    """(key_a, key_b, n, set) of the chosen texts."""

    def describe(batches):
        for batch in slices(batches):
            keep = let_through(chosen.value, batch.column("key_a").to_numpy())
            rows = [(batch.column("key_a")[i].as_py(), batch.column("key_b")[i].as_py(), len(s), s.tobytes()) for i, s in zip(np.flatnonzero(keep).tolist(), _sets(batch, n, keep), strict=True) if len(s)]
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key_a", "key_b", "n", "set"])

    return docs.select("key_a", "key_b", "text").mapInArrow(describe, "key_a long, key_b long, n long, set binary")


def _together(parts: list[DataFrame], name: str) -> DataFrame:
    """Written tables as one."""
    if len(parts) == 1:
        return parts[0]
    out = written(reduce(DataFrame.union, parts), name)
    dropped(*parts)
    return out


def _prefixes(sets: DataFrame, classes: DataFrame, num: int, den: int, room: int) -> tuple[DataFrame, GlobalOrder]:
    """(key, n, copies, prefix) of the classes (key, copies) that may still link, by the exact counts of all shingles in sets (key, n, set).

    prefix: of the first shingles, rarest first, as many as two linked sets can't both have apart, those that
    occur in another class.
    """

    rounds = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) // room))

    def posts(classes: DataFrame, part: int | None = None) -> DataFrame:
        """(key, token) of the classes: all, or a part of the shingles."""

        def spell(batches):
            for batch in batches:
                found = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
                keys, tokens = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found]), np.concatenate([*found, np.zeros(0, np.int64)])
                if part is not None:
                    keep = mix(tokens.view(np.uint64)) % np.uint64(rounds) == part
                    keys, tokens = keys[keep], tokens[keep]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(tokens, pa.int64())], names=["key", "token"])

        return classes.select("key", "set").mapInArrow(spell, "key long, token long")

    counted, parts = [], []
    for i in range(rounds):
        counted.append(written(posts(sets, i if rounds > 1 else None).groupBy("token").agg(F.count("*").alias("times")).where("times > 1"), "times"))
        if rounds > 1:
            swept(sets.sparkSession)
    times = reduce(DataFrame.union, counted)
    top = times.orderBy(F.desc("times"), "token").limit(HEAVY).toArrow()
    spare = F.expr(f"n - ({num} * n + {den - 1}) div {den}")
    left = (spare - F.col("n") + F.size("shared")).cast("int")  # without the shingles of this class only
    shares = 1 if rounds == 1 else 2 * rounds  # beside a part of the shingles, each has the shuffled counts on disk
    for i in range(shares):
        some = sets if shares == 1 else sets.where(F.pmod(F.xxhash64("key"), F.lit(shares)) == i)
        shared = posts(some).join(times, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("shared"))
        found = some.select("key", "n").join(classes.select("key", "copies"), "key").join(shared, "key")
        parts.append(written(found.where(left >= 0).select("key", "n", "copies", F.slice(F.col("shared.token"), F.lit(1), left + 1).alias("prefix")), "prefixes"))
        if rounds > 1:
            swept(sets.sparkSession)
    dropped(*counted)
    return _together(parts, "prefixes"), GlobalOrder(top["token"].to_numpy().view(np.uint64), top["times"].to_numpy())


class PrefixTree:
    """A trie over sets given as ascending arrays of ranks; nodes in lists, a parent before its children.

    size: the sets' whole sizes (an array may leave out ranks of one set only).  label: pairs of one label
    aren't asked for.
    """

    def __init__(self, sets: list[np.ndarray], size: np.ndarray, label: np.ndarray):
        keys = [s.astype(">u4").tobytes() for s in sets]  # compare like the arrays
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__), np.int64)
        self.size = size[self.order]
        label = label[self.order]
        run = [sets[i] for i in self.order]
        same = np.zeros(len(run), np.int64)
        for i in range(1, len(run)):
            m = min(len(run[i - 1]), len(run[i]))
            differ = np.flatnonzero(run[i - 1][:m] != run[i][:m])
            same[i] = differ[0] if len(differ) else m
        self.nodes = []
        stack = [(0, len(run), 0, -1)]
        while stack:
            low, high, depth, above = stack.pop()
            end = len(run[low]) if high - low == 1 else int(same[low + 1 : high].min())
            here = low
            while here < high and len(run[here]) == end:
                here += 1
            sizes = self.size[low:high]
            one = int(label[low]) if (label[low:high] == label[low]).all() else None
            at = len(self.nodes)
            self.nodes.append((run[low][depth:end], end, max(len(x) for x in run[low:high]), int(sizes.min()), int(sizes.max()), low, here, one, []))
            if above >= 0:
                self.nodes[above][-1].append(at)
            if here < high:
                cuts = [here, *(here + 1 + np.flatnonzero(same[here + 1 : high] == end)).tolist(), high]
                stack += [(a, b, end, at) for a, b in zip(cuts, cuts[1:], strict=False)]

    def search(self, sets: list[np.ndarray], size: np.ndarray, label: np.ndarray, values: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """(probe, set) of all links of the probes with the tree's sets, but for those of one label."""
        held = np.zeros((values, len(sets)), np.uint8)
        for i, s in enumerate(sets):
            held[s, i] = 1
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        flat = np.concatenate([s.astype(np.int64) + i * values for i, s in enumerate(sets)])
        found = []
        stack = [(0, np.arange(len(sets)), np.zeros(len(sets), np.int64))]
        while stack:
            at, live, got = stack.pop()
            edge, end, longest, least, most, low, here, one, below = self.nodes[at]
            z = size[live]
            fits = (den * np.minimum(z, most) >= num * z) & (num * least <= den * np.maximum(z, least))
            fits &= (least <= z) | (num * least <= den * z)
            if one is not None:
                fits &= label[live] != one
            live, got, z = live[fits], got[fits], z[fits]
            if not len(live):
                continue
            if len(edge):
                part = held[edge] if len(live) * 2 > len(sets) else held[np.ix_(edge, live)]
                more = part.sum(axis=0, dtype=np.int64)
                got = got + (more if part.shape[1] == len(live) else more[live])
                left = starts[live + 1] - np.searchsorted(flat, live * values + int(edge[-1]), "right")
                reach = (got + np.minimum(left, longest - end)) * (den + num) >= num * (z + least)
                live, got, z = live[reach], got[reach], z[reach]
                if not len(live):
                    continue
            if here > low:
                link = got[:, None] * (den + num) >= num * (z[:, None] + self.size[None, low:here])
                p, k = np.nonzero(link)
                if len(p):
                    found.append((live[p], self.order[low + k]))
            stack += [(child, live, got) for child in below]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p for p, _ in found]), np.concatenate([k for _, k in found])


def group_links(sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, order: GlobalOrder, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Both directions of all links between sets (ascending hashes): side -1 with all, else side 0 with side 1."""
    size = np.array([len(s) for s in sets])
    value, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # a shingle of one set only is in no intersection
    rank = np.empty(len(value), np.int64)
    rank[np.lexsort((value, -order.counts(value), ~shared))] = np.arange(len(value))
    values = int(shared.sum())
    ends = np.cumsum(size)
    ranked = [np.sort(r[r < values]) for r in (rank[where[e - n : e]] for e, n in zip(ends, size, strict=True))]
    index = np.flatnonzero(side != 0)
    probes = np.flatnonzero(side != 1)
    if not values or not len(index) or not len(probes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tree = PrefixTree([ranked[i] for i in index], size[index], label[index])
    step = max(1, PAIR_CELLS // values)
    a, b = [], []
    for at in range(0, len(probes), step):
        some = probes[at : at + step]
        p, k = tree.search([ranked[i] for i in some], size[some], label[some], values, num, den)
        a.append(some[p])
        b.append(index[k])
    a, b = np.concatenate(a), np.concatenate(b)
    other = label[a] != label[b]
    a, b = a[other], b[other]
    one_way = side[a] == 0  # links of two sides are found once, from side 0
    return np.concatenate([a, b[one_way]]), np.concatenate([b, a[one_way]])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links (both directions of them) lead to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _met_before(buckets: list[np.ndarray], own: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share a bucket before their own."""
    before = [x[x < own] for x in buckets]
    value, where = np.unique(np.concatenate(before), return_inverse=True)
    if not len(value) or not len(a):
        return np.zeros(len(a), bool)
    held = np.zeros((len(buckets), len(value)), np.float32)
    held[np.repeat(np.arange(len(before)), [len(x) for x in before]), where] = 1
    return (held @ held.T)[a, b] > 0


def _joined(placed: DataFrame, sets: DataFrame, order, num: int, den: int) -> DataFrame:
    """(a, b, links) of the groups in placed (grp, key, label, side, bucket, buckets, copies) with sets (key, set).

    (x, x, n): x links with other classes of n rows in all.  (x, y, 0): links, as many as connect the rest.
    """

    def run(batches):
        key, held = None, []

        def flush():
            if len(held) > 1:
                keys, labels, sides, own, buckets, copies, found = zip(*held, strict=True)
                a, b = group_links([np.frombuffer(x, np.uint64) for x in found], np.array(sides), np.array(labels), order.value, num, den)
                if len(a):
                    keys, root = np.array(keys), spanning(len(keys), a, b)
                    if own[0] is not None:
                        first = ~_met_before([np.array(x, np.int64) for x in buckets], own[0], a, b)
                        a, b = a[first], b[first]
                    total = np.bincount(a, weights=np.array(copies)[b], minlength=len(keys)).astype(np.int64)
                    some, apart = np.flatnonzero(total), np.flatnonzero(root != np.arange(len(keys)))
                    yield pa.RecordBatch.from_arrays(
                        [np.concatenate([keys[some], keys[apart]]), np.concatenate([keys[some], keys[root[apart]]]), np.concatenate([total[some], np.zeros(len(apart), np.int64)])], names=["a", "b", "links"]
                    )

        for batch in batches:
            for grp, *row, s in zip(*(batch.column(i).to_pylist() for i in range(7)), batch.column(7), strict=True):
                if grp != key:
                    yield from flush()
                    key, held = grp, []
                held.append((*row, s.as_buffer()))
        yield from flush()
        give_back()

    rows = placed.join(sets.select("key", "set"), "key").select("grp", "key", "label", "side", "bucket", "buckets", "copies", "set")
    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long, links long")


def _only(sets: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """(key, set) of sets without most of those that aren't among n keys."""
    wanted = sets.sparkSession.sparkContext.broadcast(bit_filter(keys, "key", n))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(let_through(wanted.value, batch.column(0).to_numpy())))

    return sets.select("key", "set").mapInArrow(run, "key long, set binary")


def _in_rounds(placed: DataFrame, units: _Units, order, num: int, den: int, room: int, wanted: str = "true") -> DataFrame:
    """What _joined() gives of the groups in placed (with n), where wanted holds: a written table, made in rounds."""
    spark, sent = placed.sparkSession, placed.agg(F.sum("n")).first()[0] or 0
    rounds, parts = max(1, -(-sent // room)), []
    for i in range(rounds):
        some, sets = placed, units.sets
        if rounds > 1:
            some = placed.where(F.pmod(F.xxhash64("grp"), F.lit(rounds)) == i)
            sets = _only(sets, some.select("key").distinct(), units.rows)
        parts.append(written(_joined(some, sets, order, num, den).where(wanted), "links"))
        if rounds > 1:
            swept(spark)
    return _together(parts, "links")


class _Units:
    """Classes with sets (key, set) and prefixes (key, n, copies, prefix) dealt into units, and those into blocks by size."""

    def __init__(self, sets: DataFrame, prefixes: DataFrame, num: int, den: int):
        size = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * (1 + 1e-9)))
        #: Linked classes are of one size or the next, so each posts for its own size and the next one.
        posts = prefixes.select("key", F.explode("prefix").alias("token"), size.alias("size")).select("key", "token", F.explode(F.array("size", F.col("size") + 1)).alias("slot"))
        heads = written(posts.groupBy("token", "slot").agg(F.min("key").alias("head"), F.count("*").alias("times")).where("times > 1").select("token", "slot", "head"), "heads")
        of = posts.join(heads, ["token", "slot"]).groupBy("key").agg(F.collect_set("token").alias("tokens"), F.collect_set("head").alias("heads"))  # a class' own prefix
        shared = written(of, "shared")
        families = components(shared.select(F.col("key").alias("a"), F.explode("heads").alias("b")).where("a <> b"), "families")
        members = written(families.join(prefixes.select("key", "n", "copies"), families["node"] == F.col("key")).select("key", "n", "copies", F.col("component").alias("family"), size.alias("size")), "members")
        small = (F.count("*") <= PAIR_ROWS) & (F.sum("n") <= BLOCK_SHINGLES)
        whole = members.groupBy("family").agg(small.alias("small"), F.count("*").alias("rows"))
        whole = written(whole.withColumn("deal", F.ceil(F.col("rows") / PAIR_ROWS)), "whole")
        #: A large family is split by shingle if that takes less than half of the work of all its blocks.
        large = members.join(whole.where("not small").select("family", "deal"), "family").join(shared.select("key", "tokens"), "key")
        buckets = F.array_sort(F.array_distinct(F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.col("deal"))))).alias("buckets")
        spread = written(large.select("key", "family", "deal", "n", "copies", "size", buckets), "spread")
        per = spread.select("family", "deal", F.explode("buckets").alias("bucket")).groupBy("family", "deal", "bucket").agg(F.count("*").alias("rows"))
        work = per.groupBy("family").agg(F.sum(F.col("rows").cast("double") * F.col("rows")).alias("work"), F.sum("rows").alias("sent"))
        sparse = work.join(whole, "family").select("family", (F.col("work") * 2 < F.col("rows").cast("double") * F.col("rows")).alias("sparse"))
        spread = spread.join(sparse, "family")
        none, nothing = F.lit(None).cast("long"), F.array().cast("array<long>")
        units = spread.where("sparse").select(
            "key", "n", "copies", "size", "family", F.explode("buckets").alias("bucket"), "buckets"
        ).unionByName(spread.where("not sparse").select("key", "n", "copies", "size", "family", none.alias("bucket"), nothing.alias("buckets")))
        units = units.withColumn("unit", F.concat_ws("/", "family", "bucket"))
        blocks = F.greatest(F.ceil(F.count("*") / PAIR_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
        self.cuts = written(units.groupBy("unit", "size").agg(blocks), "cuts")
        self.blocked = written(units.join(self.cuts, ["unit", "size"]).select("unit", "size", "blocks", "key", "n", "copies", "bucket", "buckets", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")), "blocked")
        self.small = members.join(whole.where("small"), "family").select(F.concat_ws("/", "family").alias("grp"), "key", "n", "copies", F.col("key").alias("label"), F.lit(-1).alias("side"), none.alias("bucket"), nothing.alias("buckets"))
        self.sets, self.rows = sets, members.count()
        self.of = [heads, shared, members, whole, spread, self.cuts, self.blocked]
        self.some_large = not self.blocked.isEmpty()

    @staticmethod
    def placed(rows: DataFrame, side, *grp) -> DataFrame:
        label = F.col("label") if "label" in rows.columns else F.col("key")
        return rows.select(F.concat_ws("/", *grp).alias("grp"), "key", "n", "copies", label.alias("label"), side.cast("int").alias("side"), "bucket", "buckets")

    def near(self, step: int) -> DataFrame:
        """(unit, size, others): the number of blocks one size class above or below."""
        return self.cuts.select("unit", (F.col("size") - step).alias("size"), F.col("blocks").alias("others"))


def _each(n: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("to")


def all_links(sets: DataFrame, prefixes: DataFrame, order, num: int, den: int, room: int) -> DataFrame:
    """(a, b, links) of all links between classes with sets (key, set) and prefixes (key, n, copies, prefix), as _joined() gives them."""
    u = _Units(sets, prefixes, num, den)
    groups = u.small
    if u.some_large:  # every two blocks of one size class meet once, and every block meets all of the next class
        own = u.blocked.select("*", _each("blocks"))
        side = F.when(F.col("block") == F.col("to"), -1).otherwise((F.col("block") > F.col("to")).cast("int"))
        up, down = u.blocked.join(u.near(1), ["unit", "size"]).select("*", _each("others")), u.blocked.join(u.near(-1), ["unit", "size"]).select("*", _each("others"))
        groups = (
            groups.unionByName(u.placed(own, side, "unit", F.lit("at"), "size", F.least("block", "to"), F.greatest("block", "to")))
            .unionByName(u.placed(up, F.lit(0), "unit", F.lit("up"), "size", "block", "to"))
            .unionByName(u.placed(down, F.lit(1), "unit", F.lit("up"), F.col("size") - 1, "to", "block"))
        )
    links = _in_rounds(groups, u, order, num, den, room)
    dropped(*u.of)
    return links


def connected(sets: DataFrame, prefixes: DataFrame, order, num: int, den: int, room: int) -> DataFrame:
    """(a, b): links between classes, as many as connect all that links connect."""
    u = _Units(sets, prefixes, num, den)
    groups = u.small
    if u.some_large:  # a block meets block 0 of its own size class and of the next; block 0 goes to all of them
        to = F.when(F.col("block") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
        own = u.blocked.select("*", F.explode(to).alias("to"))
        side = F.when(F.col("to") == 0, -1).otherwise((F.col("block") == 0).cast("int"))
        up = u.blocked.join(u.near(1).drop("others"), ["unit", "size"])
        down = u.blocked.where("block = 0").join(u.near(-1), ["unit", "size"]).select("*", _each("others"))
        groups = (
            groups.unionByName(u.placed(own, side, "unit", F.lit("at"), "size", "to"))
            .unionByName(u.placed(up, F.lit(0), "unit", F.lit("up"), "size", "block"))
            .unionByName(u.placed(down, F.lit(1), "unit", F.lit("up"), F.col("size") - 1, "to"))
        )
    links = _in_rounds(groups, u, order, num, den, room, "a <> b").select("a", "b")
    if u.some_large:
        got = components(links, "pivots")
        tagged = written(u.blocked.join(got, F.col("key") == got["node"], "left").select(*u.blocked.columns, F.coalesce("component", "key").alias("label")), "tagged")
        most = tagged.groupBy("unit", "label").agg(F.count("*").alias("rows")).groupBy("unit").agg(F.max_by("label", F.struct("rows", "label")).alias("top"))
        outside = written(tagged.join(most, "unit").where("label <> top").drop("top"), "outside")
        if not outside.isEmpty():
            packs = written(outside.groupBy("unit", "size").agg(F.ceil(F.count("*") / PAIR_ROWS).alias("packs")), "packs")
            near = F.explode(F.array(*[F.col("size") + d for d in (-1, 0, 1)])).alias("other")
            probes = outside.join(packs, ["unit", "size"]).withColumn("pack", F.pmod(F.xxhash64("key", F.lit(1)), F.col("packs"))).select("*", near)
            probes = probes.join(u.cuts.select("unit", F.col("size").alias("other"), F.col("blocks").alias("others")), ["unit", "other"]).select("*", _each("others"))
            index = tagged.select("*", near).join(packs.select("unit", F.col("size").alias("other"), "packs"), ["unit", "other"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1)).alias("pack"))
            groups = u.placed(probes, F.lit(0), "unit", "size", "pack", "other", "to").unionByName(u.placed(index, F.lit(1), "unit", "other", "pack", "size", "block"))
            links = links.union(_in_rounds(groups, u, order, num, den, room, "a <> b").select("a", "b"))
            u.of.append(packs)
        u.of += [tagged, outside, got]
    out = written(links, "all-links")
    dropped(*u.of)
    return out


def _classes(docs: DataFrame, n: int, num: int, den: int, whole: bool):
    """(prints, classes, sets, maybe, prefixes, order, room): every row's fingerprints, the classes of equal sets, those that may link.

    docs: (doc_id, text).  classes: (n, f1, f2, key, copies, doc_id, key_a, key_b), the latter of its first
    row; rows without a doc_id come last (whole) or take no part.  maybe: (key, class, copies), the key that the
    set, the prefix and the links of a class have.  room: the shingles of a round.
    """
    spark = docs.sparkSession
    keyed = docs.select(*identity(F.col("doc_id"), F.col("text")), "doc_id", "text")
    prints = written(_fingerprints(keyed, n), "prints")
    rows = prints.where("n > 0") if whole else prints.where("n > 0 and doc_id is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_a", "key_b")).alias("first")
    classes = rows.groupBy("n", "f1", "f2").agg(first, F.count("*").alias("copies"))
    classes = written(classes.select("n", "f1", "f2", "copies", "first.doc_id", "first.key_a", "first.key_b", F.monotonically_increasing_id().alias("key")), "classes")
    seen = classes.agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).first()
    chosen = spark.sparkContext.broadcast(bit_filter(classes, "key_a", seen["rows"]))
    linked = written(maybe_linked(keyed, n, num, den, bucket_bits(seen["shingles"] or 0), chosen), "linked")
    swept(spark)
    chosen = spark.sparkContext.broadcast(bit_filter(linked, "key_a", linked.count()))
    found = written(_candidates(keyed, n, chosen).withColumn("key", F.monotonically_increasing_id()), "found")
    #: Rows that repeat an id and its text are found again; one of them stands for the class.
    picked = found.select(F.col("key").alias("row"), "key_a", "key_b").join(classes.select("key", "copies", "key_a", "key_b"), ["key_a", "key_b"]).groupBy("key").agg(F.min("row").alias("row"), F.first("copies").alias("copies"))
    maybe = written(picked.select(F.col("row").alias("key"), F.col("key").alias("class"), "copies"), "maybe")
    dropped(linked)
    if found.count() > 1.25 * maybe.count():
        sets = written(found.join(maybe.select("key"), "key", "left_semi"), "sets")
        dropped(found)
        found = sets
    swept(spark)
    room = max(ROUND_SHINGLES, (seen["shingles"] or 0) // 8)
    prefixes, order = _prefixes(found, maybe, num, den, room)
    swept(spark)
    return prints, classes, found, maybe, prefixes, spark.sparkContext.broadcast(order), room


def _of_classes(links: DataFrame, maybe: DataFrame) -> DataFrame:
    """links (a, b, ...) with the keys of classes."""
    for x in ("a", "b"):
        links = links.join(maybe.select(F.col("key").alias(x), F.col("class").alias(f"class_{x}")), x).drop(x).withColumnRenamed(f"class_{x}", x)
    return written(links, "class-links")


def ngram_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of docs (doc_id, text): see the module's text.

    n_links is the number of other rows with a doc_id whose text links with this row's, equal sets among
    them; null without a doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints, classes, sets, maybe, prefixes, order, room = _classes(docs, n, num, den, False)
    found = all_links(sets, prefixes, order, num, den, room)
    links = _of_classes(found, maybe)
    dropped(sets, maybe, prefixes, found)
    edges = links.where("a <> b").select("a", "b")
    #: Rows that repeat a doc_id are one document, whatever their texts.
    rows = prints.join(classes.select("n", "f1", "f2", "key"), ["n", "f1", "f2"], "left").where("doc_id is not null").select("doc_id", "key")
    again = rows.groupBy("doc_id").agg(F.min("key").alias("least"), F.count("*").alias("times")).where("times > 1 and least is not null")
    again = written(again.select("doc_id", "least"), "again")
    repeats = not again.isEmpty()
    if repeats:
        edges = edges.unionByName(rows.join(again, "doc_id").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")))
    groups = components(edges, "groups")
    of = classes.join(groups, classes["key"] == groups["node"], "left").withColumn("component", F.coalesce("component", "key"))
    first = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    counts = links.where("a = b").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    n_links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    of = written(of.join(first, "component").join(counts, "key", "left").select("n", "f1", "f2", "key", "component_id", n_links), "of")
    dropped(classes, links)
    out = prints.join(of.drop("key"), ["n", "f1", "f2"], "left")
    if repeats:
        out = out.join(again.join(of.select(F.col("key").alias("least"), F.col("component_id").alias("whole")), "least").select("doc_id", "whole"), "doc_id", "left")
        out = out.withColumn("component_id", F.coalesce("component_id", "whole"))
    known = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(known, F.coalesce("n_links", F.lit(0))).alias("n_links"),
    )


def distinct_documents(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of linked texts: the first by doc_id, those without an id last.

    Rows count by their texts, whatever their ids: other texts under one id are judged each, and copies
    without an id go like all copies.  Of rows that repeat an id and its text one stays, with its other columns.
    Rows with null or blank texts all stay.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints, classes, sets, maybe, prefixes, order, room = _classes(plain, n, num, den, True)
    found = connected(sets, prefixes, order, num, den, room)
    links = _of_classes(found, maybe)
    dropped(sets, maybe, prefixes, found)
    groups = components(links, "groups")
    of = classes.join(groups, classes["key"] == groups["node"], "left").withColumn("component", F.coalesce("component", "key"))
    kept = written(of.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_a", "key_b")).alias("first")).select("first.key_a", "first.key_b"), "kept")
    rows = prints.where("n > 0").groupBy("key_a", "key_b").agg(F.count("*").alias("times"))
    marked = rows.join(kept.withColumn("stays", F.lit(True)), ["key_a", "key_b"], "left")
    #: Rows that must go, and rows that stay but are there more than once.
    gone = written(marked.where("stays is null or times > 1").select("key_a", "key_b", F.coalesce("stays", F.lit(False)).alias("stays")), "gone")
    dropped(links, prints, classes, kept, groups)
    values = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    out = without(docs, values, gone.select("key_a", "key_b"))
    double = gone.where("stays").select("key_a", "key_b")
    if double.isEmpty():
        return out
    names = docs.columns
    key_a, key_b = identity(*values)
    again = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key_a, key_b).join(double, ["key_a", "key_b"], "left_semi")
    one = again.groupBy("key_a", "key_b").agg(F.first("row").alias("row"))
    return out.unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in names]))
