"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node long, component long): the smallest node reachable, for every node of the edges (a, b).

    Each round takes the smallest label among a node and its neighbours, then jumps to that label's
    own label, so long chains halve.  Every round is a written table.  Aggregations combine before
    they shuffle, so a node with very many neighbours meets one row a task.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).withColumnRenamed("a", "node"), f"{name}-labels")
    before = _total(labels)
    while before is not None:
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "c")
        own = labels.select("node", F.col("c").alias("at"))
        jumped = own.join(labels.select(F.col("node").alias("at"), "c"), "at").select("node", "c")
        new = written(near.union(jumped).groupBy("node").agg(F.min("c").alias("c")), f"{name}-labels")
        dropped(labels)
        labels, after = new, _total(new)
        if after == before:  # labels only ever fall
            break
        before = after
    dropped(both)
    out = labels.select("node", F.col("c").alias("component"))
    out._scratch = labels._scratch
    return out


def _total(labels: DataFrame):
    return labels.select(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
