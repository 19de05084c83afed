"""Unigram language model over a subword lattice, with the marginal probability of whole documents.

The pieces are an existing vocabulary (a sentencepiece model file); its scores, which are ranks, give
the first weights ``1 / (rank + 1)``.  Words are runs outside ASCII white space with A-Z lower-cased;
all segmentations of a word into pieces form its lattice (a character without a piece of its own takes
its byte pieces).  Segmentations never cross words, so a document's marginal probability is the product
of its words' marginals, and the end of the document.

The piece weights are fitted to the words of the training documents (crc32 of the id, as text, modulo
FOLDS is not HELD_OUT): each round adds up expected piece counts over every distinct word by forward
and backward recursion in log space, weighted by the word's count; the first weights stay as a prior of
PRIOR pieces.  What goes to the driver has at most one number a piece.

Counts of words are one table for all documents.  Documents get them through HOT words sent to the
executors (the most frequent, a fixed number) and a join for all other words, where each batch sends a
word once with its list of documents.

A word of more than LONG characters has a lattice of its own that is gone through character by character,
in time in proportion to its length (about 5 s for a million characters).

Defined cases: null and blank texts have the end token only; a null doc_id counts as the empty string in
the fold rule (crc32 0: a training document); repeated rows are scored, and count, each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written
from .wordhash import mix, word_codes

FOLDS, HELD_OUT = 7, 2
ROUNDS = 2
PRIOR = 1000.0
HOT = 1 << 16
START = "▁"
CELLS = 1 << 18
#: Longer words are taken one by one, in time and memory in proportion to their length.
LONG = 1 << 11
LONG_STEP = 1 << 16

_K = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary with log weights, and the lattice recursions over batches of words of one length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        rank = np.full(n, np.inf)
        rank[plain] = [-model.get_score(i) for i in plain]
        rank[list(self.bytes.values())] = rank[plain].max() + 1
        self.first = np.where(np.isfinite(rank), 1 / (rank + 1), 0.0)
        self.first /= self.first.sum()
        text = [model.id_to_piece(i) for i in plain]
        self.longest = max(map(len, text))
        keys = np.array([self._hash(x) for x in text], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain)[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        with np.errstate(divide="ignore"):
            self.log = np.log(self.first)

    @staticmethod
    def _hash(x: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in x:
            h = (h + np.uint64(ord(c) + 1)) * _K
        return int(mix(h)[0])

    def weigh(self, expected: np.ndarray) -> None:
        got = expected + PRIOR * self.first
        with np.errstate(divide="ignore"):
            self.log = np.log(got / got.sum())

    def _edges(self, chars: np.ndarray):
        """(from, to, rows, piece ids) of the pieces, and (at, rows, code points) of characters without one."""
        length = chars.shape[0]
        edges, alone = [], []
        for i in range(length):
            h = np.zeros(chars.shape[1], np.uint64)
            for j in range(i, min(length, i + self.longest)):
                h = (h + chars[j] + np.uint64(1)) * _K
                m = mix(h)
                rows = np.flatnonzero(self.maybe[(m >> np.uint64(42)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, m[rows]), len(self.keys) - 1)
                ok = self.keys[at] == m[rows]
                if ok.any():
                    edges.append((i, j + 1, rows[ok], self.ids[at[ok]]))
                if j == i and (len(rows) < len(h) or not ok.all()):
                    known = np.zeros(len(h), bool)
                    known[rows[ok]] = True
                    rest = np.flatnonzero(~known)
                    alone.append((i, rest, chars[i][rest]))
        return edges, alone

    def _long_edges(self, chars: np.ndarray):
        """(from, to, log weight, piece id) by from of one word; characters without a piece have the id -1 and their bytes' weights."""
        length = len(chars)
        h = np.zeros(length, np.uint64)
        found = [[], [], []]
        known = np.zeros(length, bool)
        for k in range(1, min(self.longest, length) + 1):
            h = (h[: length - k + 1] + chars[k - 1 :] + np.uint64(1)) * _K
            m = mix(h)
            at = np.flatnonzero(self.maybe[(m >> np.uint64(42)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, m[at]), len(self.keys) - 1)
            ok = self.keys[place] == m[at]
            if k == 1:
                known[at[ok]] = True
            for x, v in zip(found, (at[ok], at[ok] + k, self.ids[place[ok]]), strict=True):
                x.append(v)
        alone = np.flatnonzero(~known)
        code, of = np.unique(chars[alone], return_inverse=True)
        weight = np.array([sum(self.log[self.bytes[b]] for b in chr(int(c)).encode("utf-8", "surrogatepass")) for c in code])
        start, end, ids = (np.concatenate(x) for x in found)
        start, end = np.concatenate([start, alone]), np.concatenate([end, alone + 1])
        log = np.concatenate([self.log[ids], weight[of] if len(alone) else np.zeros(0)])
        ids = np.concatenate([ids, np.full(len(alone), -1)])
        order = np.lexsort((end, start))
        return start[order], end[order], log[order], ids[order]

    def _run_long(self, word: str, count: float | None, expected: np.ndarray | None) -> float:
        """run() for one long word."""
        chars = np.frombuffer((START + word).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        start, end, log, ids = self._long_edges(chars)

        def add(x: float, y: float) -> float:
            if x < y:
                x, y = y, x
            return x + math.log1p(math.exp(y - x)) if y > -math.inf else x

        a = [-math.inf] * (len(chars) + 1)
        a[0] = 0.0
        for at in range(0, len(start), LONG_STEP):
            part = slice(at, at + LONG_STEP)
            for i, j, w in zip(start[part].tolist(), end[part].tolist(), log[part].tolist(), strict=True):
                a[j] = add(a[j], a[i] + w)
        if expected is not None and count:
            b = [-math.inf] * len(a)
            b[-1] = math.log(count) - a[-1]
            for at in range(len(start), 0, -LONG_STEP):
                part = slice(max(0, at - LONG_STEP), at)
                shares = []
                for i, j, w in zip(start[part].tolist()[::-1], end[part].tolist()[::-1], log[part].tolist()[::-1], strict=True):
                    ahead = b[j] + w
                    shares.append(math.exp(min(0.0, a[i] + ahead - math.log(count))) * count)
                    b[i] = add(b[i], ahead)
                share, which = np.array(shares[::-1]), ids[part]
                expected += np.bincount(which[which >= 0], weights=share[which >= 0], minlength=len(expected))
                for c, x in zip(chars[start[part][which < 0]].tolist(), share[which < 0].tolist(), strict=True):
                    for y in chr(c).encode("utf-8", "surrogatepass"):
                        expected[self.bytes[y]] += x
        return a[-1]

    def run(self, words: list[str], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log marginals of words; with counts also the expected number of each piece."""
        out = np.zeros(len(words))
        expected = np.zeros(len(self.log)) if counts is not None else None
        sizes = np.array([len(w) + 1 for w in words])
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], LONG, "right"))
        for i in order[short:].tolist():
            out[i] = self._run_long(words[i], None if counts is None else float(counts[i]), expected)
        order = order[:short]
        begin = 0
        while begin < len(order):
            size = int(sizes[order[begin]])
            end = min(int(np.searchsorted(sizes[order], size, "right")), begin + max(1, CELLS // (size * min(size, self.longest))))
            some = order[begin:end]
            begin = end
            chars = np.frombuffer("".join(START + words[i] for i in some).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), size).T.astype(np.uint64)
            edges, alone = self._edges(np.ascontiguousarray(chars))
            steps = [(i, j, rows, self.log[ids], ids) for i, j, rows, ids in edges]
            for i, rows, code in alone:
                raw = [chr(int(c)).encode("utf-8", "surrogatepass") for c in code]
                steps.append((i, i + 1, rows, np.array([sum(self.log[self.bytes[b]] for b in x) for x in raw]), raw))
            steps.sort(key=lambda s: (s[0], s[1]))
            a = np.full((size + 1, len(some)), -np.inf)
            a[0] = 0
            for i, j, rows, log, _ in steps:
                a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + log)
            out[some] = a[size]
            if expected is not None:
                b = np.full((size + 1, len(some)), -np.inf)
                b[size] = np.log(counts[some]) - a[size]
                for i, j, rows, log, what in reversed(steps):
                    ahead = b[j, rows] + log
                    share = np.exp(a[i, rows] + ahead)
                    b[i, rows] = np.logaddexp(b[i, rows], ahead)
                    if isinstance(what, list):
                        for x, s in zip(what, share, strict=True):
                            for y in x:
                                expected[self.bytes[y]] += s
                    else:
                        expected += np.bincount(what, weights=share, minlength=len(expected))
        return out, expected


def _counted(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            words, index, upto = word_codes(batch.column("text"), True)
            train = np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False), np.diff(upto))
            n = np.bincount(index, weights=train, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], names=["word", "n"])

    return docs.select("held_out", "text").mapInArrow(run, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text)."""
    context = docs.sparkSession.sparkContext
    doc_id = F.col("doc_id").cast("long")
    held_out = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT
    docs = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    words = written(_counted(docs), "words")
    trained = docs.where("not held_out").count()
    tokens, kinds = words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, kinds = (tokens or 0) + trained, kinds + (trained > 0)

    pieces = Pieces(vocabulary)
    for _ in range(rounds):
        shared = context.broadcast(pieces)

        def expect(batches, shared=shared):
            total = np.zeros(len(shared.value.log))
            for batch in batches:
                for cut in range(0, batch.num_rows, 50_000):
                    some = batch.slice(cut, 50_000)
                    total += shared.value.run(some.column("word").to_pylist(), some.column("n").to_numpy().astype(float))[1]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "times"])

        rows = words.where("n > 0").mapInArrow(expect, "piece long, times double").groupBy("piece").agg(F.sum("times").alias("times")).toArrow()
        expected = np.zeros(len(pieces.log))
        expected[rows["piece"].to_numpy()] = rows["times"].to_numpy()
        pieces.weigh(expected)
        shared.unpersist()
    drawn = float(expected.sum()) if rounds else 0.0
    ends = (trained + 1) / (trained + drawn + 2)
    pieces.log = pieces.log + np.log1p(-ends)  # after each piece the document goes on
    shared = context.broadcast(pieces)
    ten = np.log(10.0)

    def weigh(batches):
        for batch in batches:
            for cut in range(0, batch.num_rows, 50_000):
                some = batch.slice(cut, 50_000)
                log = shared.value.run(some.column("word").to_pylist())[0]
                n = some.column("n").to_numpy()
                base = np.log10((n + 1.0) / (tokens + kinds + 1.0))
                yield pa.RecordBatch.from_arrays([some.column("word"), some.column("n"), pa.array(base), pa.array(log / ten)], names=["word", "n", "base", "score"])

    weighed = written(words.mapInArrow(weigh, "word string, n long, base double, score double"), "weighed")
    dropped(words)
    top = weighed.orderBy(F.desc("n"), "word").limit(HOT).toArrow()
    hot = context.broadcast((top["word"].combine_chunks(), (top["n"].to_numpy() > 0).astype(float), top["base"].to_numpy(), top["score"].to_numpy()))

    def split(batches):
        names = ["row", "doc_id", "held_out", "tokens", "known", "base", "score", "word", "rows", "times"]
        for batch in batches:
            held, known, base, score = hot.value
            words, index, upto = word_codes(batch.column("text"), True)
            at = pc.index_in(words, value_set=held.cast(words.type)).fill_null(-1).to_numpy().astype(np.int64)[index] if len(index) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(upto))
            easy = at >= 0
            sums = [np.bincount(doc[easy], weights=x[at[easy]], minlength=batch.num_rows) for x in (known, base, score)]
            empty = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(upto)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                 empty.cast(pa.string()), empty.cast(pa.list_(pa.int64())), empty.cast(pa.list_(pa.int64()))],
                names=names,
            )
            word, of = index[~easy].astype(np.int64), doc[~easy]
            if not len(word):
                continue
            pair, times = np.unique(word * batch.num_rows + of, return_counts=True)
            word, of = pair // batch.num_rows, pair % batch.num_rows
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            offsets = pa.array(np.append(first, len(word)).astype(np.int32))
            row = batch.column("row").to_numpy()
            n = len(first)
            blank = pa.nulls(n)
            yield pa.RecordBatch.from_arrays(
                [blank.cast(pa.int64()), blank.cast(pa.int64()), blank.cast(pa.bool_()), blank.cast(pa.int64()), blank.cast(pa.int64()), blank.cast(pa.float64()), blank.cast(pa.float64()),
                 words.take(pa.array(word[first])).cast(pa.string()), pa.ListArray.from_arrays(offsets, pa.array(row[of])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))],
                names=names,
            )

    schema = "row long, doc_id long, held_out boolean, tokens long, known long, base double, score double, word string, rows array<long>, times array<long>"
    parts = written(docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(split, schema), "parts")
    heads = parts.where("word is null").select("row", "doc_id", "held_out", "tokens", "known", "base", "score")
    lists = parts.where("word is not null").select("word", "rows", "times").join(weighed.select("word", F.col("n").alias("n"), F.col("base").alias("b"), F.col("score").alias("s")), "word")
    tails = lists.select(F.explode(F.arrays_zip("rows", "times")).alias("at"), "n", "b", "s").select(
        F.col("at.rows").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("tokens"),
        F.when(F.col("n") > 0, F.col("at.times")).otherwise(0).alias("known"), (F.col("b") * F.col("at.times")).alias("base"), (F.col("s") * F.col("at.times")).alias("score"),
    )
    sums = heads.unionByName(tails).groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out")], *[F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")])
    end_base = float(np.log10((trained + 1.0) / (tokens + kinds + 1.0)))
    return sums.select(
        "doc_id", "held_out", (F.col("tokens") + 1).alias("n_tokens"), (F.col("known") + int(trained > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + end_base).alias("base_score"), (F.col("score") + float(np.log10(ends))).alias("score"),
    )
