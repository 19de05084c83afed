"""Hierarchical empirical-Bayes quality classifier.

Document evidence: a logistic regression over binary features, the hashed words of the whole text, the
hashed beginnings of its longer words, and binned style measures (shares of capitals, digits, marks,
distinct and repeated words, repeated lines, length).  It is fitted on labelled documents, a bounded
sample of at most SAMPLE of them (those with the smallest hash of their id): features are counted and
chosen by grouped aggregation, at most FEATURES, and only these reach the driver.  Everything after it
covers all documents.

Site evidence: grouped aggregation gives each host and each path below it the number of documents and
the sum of their bad probabilities.  A host's rate is shrunk toward the global rate and a path's toward
its host's, ``(sum + k * parent) / (n + k)``.  The strength k of each level comes from the spread of the
groups' rates about their parents by moments; groups that differ no more than chance give a large k,
and a sparse group has its parent's rate.  A document's own probability is left out of the sums of its
path, its host and the whole.  Its log odds move by the difference between its path's and the global log odds.

A document is rejected when the combined probability of being bad (quality 0 or toxic 1) reaches
THRESHOLD.

Defined cases: null texts count as empty; a null host or path is a group of its own; a document with
several sites has the first by host and path; labels that repeat an id are bad if any is; of several texts
under one labelled id the one with the smallest hash is learnt from; without labels of both kinds the
evidence is the rate of bad labels (0 with none) and nothing is rejected; rows with a null doc_id are
judged as all others; other columns are not read, and kept() keeps them, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, identity, without, written
from .wordhash import _SPACE, _VALUE, _power, buffers, mix, slices, word_hashes

SAMPLE = 8000
FEATURES = 1 << 14
LEAST = 4
HEAD = 5
THRESHOLD = 0.3
CLEAR = 4.0
EDGES = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95])
LENGTHS = np.array([5, 10, 20, 50, 100, 400, 2000, 10000])
BYTES_AT_ONCE = 4 << 20


def _style(raw: bytes, words: np.ndarray) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    n = max(1, len(b))
    count = np.bincount(b, minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + count[128:].sum()))
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    lines = raw.split(b"\n")
    m = max(1, len(words))
    odd = marks - int(count[44] + count[46])
    measures = [count[65:91].sum() / letters, count[48:58].sum() / n, marks / n, odd / n, len(np.unique(words)) / m, (words[1:] == words[:-1]).sum() / m, 1 - len(set(lines)) / len(lines), count[33] / n, count[124] / n]
    bins = [100 * (i + 1) + int(np.searchsorted(EDGES, x, "right")) for i, x in enumerate(measures)]
    bins.append(5000 + int(np.searchsorted(LENGTHS, len(words))))
    bins.append(6000 + min(40, n // m))
    return mix(np.array(bins, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _heads(column: pa.Array, hashes: np.ndarray) -> np.ndarray:
    """For each word the hash of its first HEAD bytes in lower case; 0 for words no longer than that."""
    raw, offsets = buffers(column)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(raw)]
    first[starts] = inside[starts]
    begin = np.flatnonzero(first)
    value, long = np.zeros(len(begin), np.uint64), np.ones(len(begin), bool)
    boundary = np.zeros(len(raw) + 1, bool)
    boundary[offsets] = True
    for i in range(HEAD + 1):
        at = np.minimum(begin + i, max(0, len(raw) - 1))
        long &= (begin + i < len(raw)) & inside[at]
        if i:
            long &= ~boundary[np.minimum(begin + i, len(raw))]
        if i < HEAD:
            value += _VALUE[raw[at]] * _power(i + 1)[i]
    return np.where(long, mix(value ^ np.uint64(0x5851F42D4C957F2D)), np.uint64(0))


def document_features(column: pa.Array) -> list[np.ndarray]:
    """Distinct feature hashes of each text."""
    out = []
    size = max(1, len(column) * BYTES_AT_ONCE // max(1, column.nbytes))
    for cut in range(0, len(column), size):
        part = column.slice(cut, size)
        words, at = word_hashes(part)
        heads = _heads(part, words)
        raw, offsets = buffers(part)
        for i in range(len(part)):
            w = words[at[i] : at[i + 1]]
            found = np.unique(np.concatenate([w, heads[at[i] : at[i + 1]], _style(raw[offsets[i] : offsets[i + 1]].tobytes(), w)]))
            out.append(found[found != 0])
    return out


class Evidence:
    """Logistic regression over chosen binary features; constant where there is nothing to learn.

    value: the chosen features, ascending; rows: for each labelled document the places of its features.
    """

    def __init__(self, value: np.ndarray, rows: list[np.ndarray], bad: np.ndarray, steps: int = 300, ridge: float = 3e-4):
        self.value, self.weight = np.zeros(0, np.uint64), np.zeros(0)
        n = len(bad)
        self.usable = bool(n and 0 < bad.sum() < n)
        rate = float(bad.mean()) if n else 0.0
        self.bias = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
        if not self.usable:
            return
        col, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(n), [len(r) for r in rows])
        w, b, y = np.zeros(len(value)), self.bias, bad.astype(float)
        norm = np.sqrt(np.bincount(col, minlength=len(value)) / n) + 0.02
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, steps + 1):  # Adam on the mean log loss with a ridge
            z = b + np.bincount(row, weights=w[col], minlength=n)
            err = 1 / (1 + np.exp(-z)) - y
            grad = np.append(np.bincount(col, weights=err[row], minlength=len(w)) / n / norm + ridge * w, err.mean())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.value, self.weight, self.bias = value, w, float(b)

    def log_odds(self, found: np.ndarray) -> float:
        if not len(self.value):
            return self.bias
        at = np.minimum(np.searchsorted(self.value, found), len(self.value) - 1)
        return self.bias + float(self.weight[at][self.value[at] == found].sum())


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, bad) of at most sample labelled documents, one text for each id."""
    known = labels.where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    known = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "known")  # sample ids at most
    rows = docs.select(*identity(F.col("doc_id"), F.col("text")), "doc_id", "text").join(F.broadcast(known), "doc_id")
    first = rows.groupBy("doc_id", "bad").agg(F.min(F.struct("key_a", "key_b")).alias("first")).select("bad", "first.key_a", "first.key_b")
    rows = rows.drop("bad").join(F.broadcast(first), ["key_a", "key_b"])  # sample rows at most
    out = written(rows.groupBy("key_a", "key_b").agg(F.first("text").alias("text"), F.first("bad").alias("bad")).select("text", "bad"), "sample")
    dropped(known)
    return out


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence:
    """The document classifier from labels (doc_id, bad boolean)."""
    rows = _sample(docs, labels, sample)
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if not 0 < bad < n:
        dropped(rows)
        return Evidence(np.zeros(0, np.uint64), [], np.full(n, bool(bad)))
    rate = bad / n

    def count(batches):
        for batch in slices(batches):
            found = document_features(batch.column("text"))
            y = np.repeat(batch.column("bad").to_numpy(zero_copy_only=False), [len(x) for x in found])
            value, where, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            hits = np.bincount(where, weights=y.astype(float), minlength=len(value)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times), pa.array(hits)], names=["feature", "times", "hits"])

    counts = rows.mapInArrow(count, "feature long, times long, hits long").groupBy("feature").agg(F.sum("times").alias("times"), F.sum("hits").alias("hits"))
    spread = F.sqrt(F.col("times") * rate * (1 - rate) * (1 - F.col("times") / n + 1e-9))
    score = F.abs(F.col("hits") - F.col("times") * rate) / F.greatest(spread, F.lit(0.5))
    best = counts.where(F.col("times") >= LEAST).withColumn("score", score).where(F.col("score") > CLEAR).orderBy(F.desc("score"), "feature").limit(FEATURES)
    value = np.sort(best.select("feature").toArrow()["feature"].to_numpy().view(np.uint64))  # FEATURES at most

    def place(batches):
        for batch in slices(batches):
            found = [np.flatnonzero(np.isin(value, x)).astype(np.uint16).tobytes() for x in document_features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("bad")], names=["found", "bad"])

    placed = rows.mapInArrow(place, "found binary, bad boolean").toArrow()  # two bytes for each of at most FEATURES, for each of the sample
    dropped(rows)
    return Evidence(value, [np.frombuffer(x.as_buffer(), np.uint16) for x in placed["found"]], placed["bad"].to_numpy())


def _strength(groups: DataFrame) -> float:
    """k of the beta prior that (n, total, parent) of the groups fit by moments, between 2 and 1e6."""
    e, m = F.col("total") / F.col("n"), F.col("parent")
    got = groups.where("n > 1").agg(
        F.sum(F.col("n") * (e - m) * (e - m)).alias("found"), F.sum(m * (1 - m)).alias("chance"), F.sum((F.col("n") - 1) * m * (1 - m)).alias("more")
    ).first()
    if not got["more"] or got["found"] is None:
        return 1e6
    rho = (got["found"] - got["chance"]) / got["more"]
    return float(min(1e6, max(2.0, 1 / rho - 1))) if rho > 1e-6 else 1e6


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def shrunk(scored: DataFrame) -> DataFrame:
    """scored (host, path, p_document, ..) with p_all and p_site: rates without the document's own probability."""
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_document").alias("total")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))
    n, total = paths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0.0))).first()
    overall = total / n if n else 0.0
    hosts = written(hosts, "hosts")
    k_host = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_total").alias("total"), F.lit(overall).alias("parent")))
    under = written(
        paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).select(paths["host"].alias("_h"), F.col("path").alias("_p"), "n", "total", "host_n", "host_total"), "sites"
    )
    k_path = _strength(under.select("n", "total", ((F.col("host_total") + k_host * overall) / (F.col("host_n") + k_host)).alias("parent")))
    dropped(paths, hosts)
    own = F.col("p_document")
    p_all = F.when(F.lit(n > 1), (F.lit(total) - own) / F.lit(max(1, n - 1))).otherwise(F.lit(overall))
    p_host = (F.col("host_total") - own + k_host * F.col("p_all")) / (F.col("host_n") - 1 + k_host)
    p_site = (F.col("total") - own + k_path * p_host) / (F.col("n") - 1 + k_path)
    rows = scored.join(under, scored["host"].eqNullSafe(under["_h"]) & scored["path"].eqNullSafe(under["_p"]))
    rows = rows.withColumn("p_all", p_all).withColumn("p_site", p_site).withColumnRenamed("n", "site_docs").drop("_h", "_p", "total", "host_n", "host_total")
    return rows.withColumns({"k_host": F.lit(k_host), "k_path": F.lit(k_path)})


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sites: DataFrame | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, host, path, site_docs, p_document, p_all, p_site, p_bad, keep, key_a, key_b, ..) of all docs.

    sites (doc_id, host, path): where documents come from; those without a row there have the columns host
    and path of docs.  key_a and key_b are the identity of (doc_id, text, host, path), the latter as in docs.
    """
    values = [F.col("doc_id").cast("long"), F.col("text").cast("string"), host.cast("string"), path.cast("string")]
    docs = docs.select(*(v.alias(c) for v, c in zip(values, ("doc_id", "text", "host", "path"), strict=True)))
    model = fitted(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            odds = [shared.value.log_odds(r) for r in document_features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3, 4, 5)), pa.array(odds, pa.float64())], names=["doc_id", "host", "path", "key_a", "key_b", "odds"])

    keyed = docs.select("doc_id", "text", "host", "path", *identity(*(F.col(c) for c in ("doc_id", "text", "host", "path"))))
    scored = keyed.mapInArrow(run, "doc_id long, host string, path string, key_a long, key_b long, odds double")
    if sites is not None:
        one = sites.select(F.col("doc_id").cast("long").alias("_id"), F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path")).where("_id is not null")
        one = one.groupBy("_id").agg(F.min(F.struct("host", "path")).alias("_site"))
        scored = scored.join(one, F.col("doc_id") == F.col("_id"), "left")
        known = F.col("_site").isNotNull()
        scored = scored.withColumns({c: F.when(known, F.col("_site").getField(c)).otherwise(F.col(c)) for c in ("host", "path")}).drop("_id", "_site")
    scored = written(scored.withColumn("p_document", 1 / (1 + F.exp(-F.col("odds")))), "scored")
    odds = F.col("odds") + _logit(F.col("p_site")) - _logit(F.col("p_all"))
    rows = shrunk(scored).withColumn("p_bad", 1 / (1 + F.exp(-odds)))
    keep = F.lit(True) if not model.usable else F.col("p_bad") < threshold
    return rows.select("doc_id", "host", "path", "site_docs", "p_document", "p_all", "p_site", "p_bad", keep.alias("keep"), "k_host", "k_path", "key_a", "key_b")


def kept(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sites: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs without those that judged() rejects."""
    gone = written(judged(docs, labels, host, path, sites, sample).where("not keep").select("key_a", "key_b").distinct(), "rejected")
    return without(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string"), host.cast("string"), path.cast("string")], gone)
