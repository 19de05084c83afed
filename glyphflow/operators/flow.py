"""Keyword-document flow: maximum matching of keywords with documents, and its minimum cut.

Each keyword asks for ``demand`` documents, each document serves once.  Documents with the same set of
keywords are alike, so they become one class with their number as capacity: the network has at most
2^K classes whatever the number of documents, and only the classes' sizes come to the driver.

Beyond MOST_CLASSES classes the network is cut to its kernel.  A keyword with K * demand documents or more
always gets its own, since all others together take fewer; it is never on the source's side of the minimum
cut.  The other keywords have fewer than K * K * demand documents between them, and only these make classes.

Every augmenting path of the network of documents carries one unit, as each ends in a document, so the
rounds of Ford-Fulkerson and Edmonds-Karp there are the flow; Dinic's are the phases of the class network.
"""

from __future__ import annotations

import time
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokenize

MOST_KEYWORDS = 50
MOST_CLASSES = 1_000_000
MATCHING_SHOWN, CUT_SHOWN = 200, 60


class Network:
    """A flow network; edge e and its twin e ^ 1."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.capacity: list[int] = []
        self.flow: list[int] = []

    def add(self, a: int, b: int, capacity: int) -> int:
        e = len(self.to)
        self.to += [b, a]
        self.capacity += [capacity, 0]
        self.flow += [0, 0]
        self.edges[a].append(e)
        self.edges[b].append(e + 1)
        return e

    def left(self, e: int) -> int:
        return self.capacity[e] - self.flow[e]

    def push(self, e: int, amount: int) -> None:
        self.flow[e] += amount
        self.flow[e ^ 1] -= amount

    def reset(self) -> None:
        self.flow = [0] * len(self.flow)

    def reachable(self, source: int) -> list[bool]:
        seen, stack = [False] * len(self.edges), [source]
        seen[source] = True
        while stack:
            for e in self.edges[stack.pop()]:
                if self.left(e) > 0 and not seen[self.to[e]]:
                    seen[self.to[e]] = True
                    stack.append(self.to[e])
        return seen


def _augment(net: Network, source: int, sink: int, by_depth: bool) -> tuple[int, int]:
    total = rounds = 0
    while True:
        came = {source: -1}
        queue = deque([source])
        while queue and sink not in came:
            v = queue.pop() if by_depth else queue.popleft()
            for e in net.edges[v]:
                if net.left(e) > 0 and net.to[e] not in came:
                    came[net.to[e]] = e
                    queue.append(net.to[e])
        if sink not in came:
            return total, rounds
        path, v = [], sink
        while v != source:
            path.append(came[v])
            v = net.to[came[v] ^ 1]
        amount = min(map(net.left, path))
        for e in path:
            net.push(e, amount)
        total, rounds = total + amount, rounds + 1


def ford_fulkerson(net: Network, source: int, sink: int) -> tuple[int, int]:
    return _augment(net, source, sink, True)


def edmonds_karp(net: Network, source: int, sink: int) -> tuple[int, int]:
    return _augment(net, source, sink, False)


def dinic(net: Network, source: int, sink: int) -> tuple[int, int]:
    """The flow and the number of phases."""
    total = phases = 0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in net.edges[v]:
                if net.left(e) > 0 and net.to[e] not in level:
                    level[net.to[e]] = level[v] + 1
                    queue.append(net.to[e])
        if sink not in level:
            return total, phases
        phases += 1
        nth = [0] * len(net.edges)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                amount = min(map(net.left, path))
                for e in path:
                    net.push(e, amount)
                total += amount
                cut = next(i for i, e in enumerate(path) if net.left(e) == 0)
                v = net.to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nth[v] < len(net.edges[v]):
                e = net.edges[v][nth[v]]
                if net.left(e) > 0 and level.get(net.to[e]) == level[v] + 1:
                    break
                nth[v] += 1
            if nth[v] < len(net.edges[v]):
                path.append(net.edges[v][nth[v]])
                v = net.to[path[-1]]
            elif path:
                e = path.pop()
                v = net.to[e ^ 1]
                nth[v] += 1
            else:
                break


SOLVERS = {"fordfulkerson": ford_fulkerson, "edmondskarp": edmonds_karp, "dinic": dinic}


def resolve_solver(name: str | None) -> str:
    key = (name or "").lower().replace("-", "").replace("_", "").replace(" ", "")
    return "fordfulkerson" if key.startswith("ford") else "edmondskarp" if key.startswith("edmonds") or key == "ek" else "dinic"


def incidence(docs: DataFrame, keywords: list[str], language: str = "all") -> DataFrame:
    """(keyword, doc_id): documents of the language whose text holds the keyword."""
    held = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("searchable"), k))
    return of_language(docs, language).select(F.explode(held).alias("keyword"), F.col("id").alias("doc_id"))


def within_language(language: str | None):
    if not (language or "").strip() or language.strip().lower() == "all":
        return F.lit(True)
    return F.lower("language") == language.strip().lower()


def of_language(docs: DataFrame, language: str | None) -> DataFrame:
    return docs.where(within_language(language))


def signatures(docs: DataFrame, keywords: list[str], language: str = "all") -> DataFrame:
    """(doc_id, title, sig): one bit for each keyword that the document holds; documents with none are left out.

    A filter on sig would be pushed down with the folded text in it, once for each keyword; the generator takes the text once.
    """

    def sig(text):
        out = F.lit(0).cast("long")
        for i, k in enumerate(keywords):
            out = out.bitwiseOR(F.when(F.contains(text, F.lit(k)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        return out

    some = F.filter(F.transform(F.array("searchable"), sig), lambda x: x != 0)
    return of_language(docs, language).select(F.col("id").alias("doc_id"), "title", F.explode(some).alias("sig"))


def degrees(docs: DataFrame, keywords: list[str], language: str = "all") -> DataFrame:
    """(keyword, documents), keywords in no document with 0."""
    counts = [F.sum(F.contains("searchable", F.lit(k)).cast("long")) for k in keywords]
    row = of_language(docs, language).agg(F.array(*[F.coalesce(c, F.lit(0)) for c in counts]).alias("n"))
    return row.select(F.explode(F.arrays_zip(F.array(*map(F.lit, keywords)).alias("keyword"), F.col("n").alias("documents"))).alias("x")).select("x.*")


#: Names of the solvers in reports.
TITLES = {"fordfulkerson": "Ford-Fulkerson", "edmondskarp": "Edmonds-Karp", "dinic": "Dinic"}


@dataclass
class FlowReport:
    keywords: list[str]
    values: dict
    matching: DataFrame | None = None


def _network(keywords: list[str], classes: list[tuple[int, int]], demand: int):
    k = len(keywords)
    net = Network(2 + k + len(classes))
    supply = [net.add(0, 2 + i, demand) for i in range(k)]
    serve = {}
    for c, (sig, n) in enumerate(classes):
        for i in range(k):
            if sig >> i & 1:
                serve[i, c] = net.add(2 + i, 2 + k + c, n)
        net.add(2 + k + c, 1, n)
    return net, supply, serve


def _bits(mask: int):
    return F.col("sig").bitwiseAND(F.lit(mask).cast("long"))


def _classes(signed: DataFrame, mask: int) -> list[tuple[int, int]] | None:
    """(sig, documents) of the keyword sets within mask, or None if there are too many."""
    of = signed.select(_bits(mask).alias("sig")).where("sig <> 0").groupBy("sig").agg(F.count("*").alias("n"))
    rows = of.limit(MOST_CLASSES + 1).collect()
    return None if len(rows) > MOST_CLASSES else sorted((r["sig"], r["n"]) for r in rows)


def _served(signed: DataFrame, keywords: list[str], rich: list[int], poor: DataFrame, demand: int) -> DataFrame:
    """(keyword, doc_id, title): demand documents for each rich keyword, none of them in poor or given twice."""
    most = len(keywords) * demand
    taken, out = {r["doc_id"] for r in poor.select("doc_id").toLocalIterator()}, []  # K * demand at most
    for i in rich:
        mine = 0
        for r in signed.where(_bits(1 << i) != 0).select("doc_id", "title").orderBy("doc_id").limit(most).toLocalIterator():
            if mine < demand and r["doc_id"] not in taken:
                taken.add(r["doc_id"])
                out.append((keywords[i], r["doc_id"], r["title"]))
                mine += 1
    return signed.sparkSession.createDataFrame(out, "keyword string, doc_id string, title string")


def analyze(docs: DataFrame, query: str, language: str = "all", algorithm: str = "dinic", demand: int = 1) -> FlowReport:
    start = time.perf_counter()
    keywords = list(dict.fromkeys(tokenize(query)))
    if not keywords:
        raise ValueError("enter at least one keyword")
    if len(keywords) > MOST_KEYWORDS:
        raise ValueError(f"{len(keywords)} keywords; the maximum is {MOST_KEYWORDS}")
    demand, k = max(1, demand), len(keywords)
    signed = signatures(docs, keywords, language)
    rich: list[int] = []
    classes = _classes(signed, (1 << k) - 1)
    if classes is not None:
        documents, degree = sum(n for _, n in classes), [sum(n for sig, n in classes if sig >> i & 1) for i in range(k)]
    else:
        sums = signed.agg(F.count("*").alias("documents"), *[F.count_if(_bits(1 << i) != 0).alias(f"k{i}") for i in range(k)]).first()
        documents, degree = sums["documents"], [sums[f"k{i}"] for i in range(k)]
        rich = [i for i in range(k) if degree[i] >= k * demand]
        some = sum(1 << i for i in range(k) if i not in rich)
        #: Fewer than K * K * demand documents.
        classes = sorted((r["sig"], r["n"]) for r in signed.select(_bits(some).alias("sig")).where("sig <> 0").groupBy("sig").agg(F.count("*").alias("n")).toLocalIterator())
    net, supply, serve = _network(keywords, classes, demand)
    chosen, runs = resolve_solver(algorithm), []
    given = demand * len(rich)
    for name in [n for n in SOLVERS if n != chosen] + [chosen]:
        net.reset()
        began = time.perf_counter()
        value, rounds = SOLVERS[name](net, 0, 1)
        value += given
        runs.append({"algorithm": TITLES[name], "maxFlow": value, "augmentationsOrPhases": rounds if name == "dinic" else value, "executionTimeMs": round((time.perf_counter() - began) * 1e3, 4)})
    last = runs[-1]
    runs.sort(key=lambda r: list(TITLES.values()).index(r["algorithm"]))
    side = net.reachable(0)
    top = [i for i in range(k) if side[2 + i] and i not in rich]
    mask = sum(1 << i for i in top)
    shared = sum(n for sig, n in classes if (sig & mask).bit_count() >= 2)
    single = sum(n for sig, n in classes if (sig & mask).bit_count() == 1)
    assigned = [demand if i in rich else net.flow[e] for i, e in enumerate(supply)]
    capacity = demand * (k - len(top)) + shared + single
    matching = _matching(signed, keywords, classes, {ic: net.flow[e] for ic, e in serve.items()}, sum(1 << i for i in range(k) if i not in rich))
    if rich:
        matching = matching.unionByName(_served(signed, keywords, rich, matching, demand))
    values = {
        "query": query, "language": language, "keywords": keywords, "demand": demand, "algorithm": TITLES[chosen], "keywordNodes": k, "documentNodes": documents, "totalNodes": 2 + k + documents,
        "keywordDocumentEdges": sum(degree), "totalEdges": k + documents + sum(degree), "keywordDegrees": dict(zip(keywords, degree, strict=True)), "requestedFlow": k * demand, "maxFlow": value,
        "fullyMatched": value == k * demand, "matchingSize": sum(assigned),
        "unmatchedKeywords": [
            {"keyword": w, "assigned": a, "demand": demand, "documentsContainingKeyword": d} for w, a, d in zip(keywords, assigned, degree, strict=True) if a < demand
        ],
        "minCut": {
            "capacity": capacity, "equalsMaxFlow": capacity == value, "sourceSideKeywords": [keywords[i] for i in top], "sourceSideDocuments": shared,
            "cutEdgeCount": k - len(top) + shared + single, "cutEdges": _cut_edges(signed, keywords, top, demand),
        },
        "algorithmRuns": runs, "algorithmsAgree": len({r["maxFlow"] for r in runs}) == 1, "executionTimeMs": last["executionTimeMs"], "totalTimeMs": round((time.perf_counter() - start) * 1e3, 3),
    }
    return FlowReport(keywords, values, matching)


def _cut_edges(signed: DataFrame, keywords: list[str], top: list[int], demand: int) -> list[dict]:
    """The first CUT_SHOWN edges of the minimum cut: keywords that aren't on the source's side, documents that are, and documents of one keyword there.

    A document with two keywords of the source's side is on it, as at most one of them uses it; one with a single such keyword serves that one.
    """
    edges = [{"from": "SOURCE", "to": w, "capacity": demand} for i, w in enumerate(keywords) if i not in top]
    if top and len(edges) < CUT_SHOWN:
        held = F.bit_count(_bits(sum(1 << i for i in top)))
        rows = signed.where(held > 0).select("doc_id", "sig", (held == 1).alias("one")).orderBy("one", "doc_id").limit(CUT_SHOWN).collect()
        for r in rows:
            keyword = next(keywords[i] for i in top if r["sig"] >> i & 1)
            edges.append({"from": keyword, "to": r["doc_id"], "capacity": 1} if r["one"] else {"from": r["doc_id"], "to": "SINK", "capacity": 1})
    return edges[:CUT_SHOWN]


#: Documents of one keyword set are numbered in so many slices, each by a task of its own.
SLICES = 64

#: Up to so many documents of each set, every task keeps those with the lowest numbers only, as Spark limits the groups of a window
#: before its shuffle (spark.sql.optimizer.windowGroupLimitThreshold); to so many ranges go by a broadcast.
MOST_AT_ONCE, MOST_BROADCAST = 1000, 100_000


def _matching(signed: DataFrame, keywords: list[str], classes: list[tuple[int, int]], flows: dict[tuple[int, int], int], mask: int) -> DataFrame:
    """(keyword, doc_id, title): each class's documents are numbered and its keywords take ranges of numbers."""
    ranges, upto = [], {}
    for (i, c), f in sorted(flows.items()):
        if f > 0:
            ranges.append((classes[c][0], i, keywords[i], upto.get(c, 0), upto.get(c, 0) + f))
            upto[c] = upto.get(c, 0) + f
    spark = signed.sparkSession
    small = F.broadcast if len(ranges) <= MOST_BROADCAST else lambda df: df
    taken = small(spark.createDataFrame(ranges, "sig long, n int, keyword string, low long, high long"))
    used = small(spark.createDataFrame([(classes[c][0], n) for c, n in upto.items()], "sig long, most long"))
    sliced = signed.withColumn("sig", _bits(mask)).join(used, "sig").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    if (most := max(upto.values(), default=1)) <= MOST_AT_ONCE:
        #: The same numbers in one pass over the documents.
        numbered = sliced.withColumn("nth", F.row_number().over(Window.partitionBy("sig").orderBy("slice", "doc_id"))).where(F.col("nth") <= most).where(F.col("nth") <= F.col("most"))
    else:
        sizes = sliced.groupBy("sig", "slice").agg(F.count("*").alias("rows"))
        before = F.coalesce(F.sum("rows").over(Window.partitionBy("sig").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = sizes.select("sig", "slice", before.alias("before"))  # SLICES rows a set
        nth = F.row_number().over(Window.partitionBy("sig", "slice").orderBy("doc_id"))
        numbered = sliced.join(sizes, ["sig", "slice"]).where(F.col("before") < F.col("most")).withColumn("nth", F.col("before") + nth).where(F.col("nth") <= F.col("most"))
    return numbered.join(taken, "sig").where((F.col("nth") > F.col("low")) & (F.col("nth") <= F.col("high"))).select("keyword", "doc_id", "title").orderBy("keyword", "doc_id")
