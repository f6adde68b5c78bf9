"""Connected components by alternating large-star and small-star rounds.

No group of neighbours is ever gathered: a star round is a minimum by node, then
a join back to the edges. The minima of hubs are broadcast, since a hub has more than a thousandth
of all edges and there are two thousand such nodes at most; so no task joins all edges of one. Before the rounds
each task contracts its own edges to a spanning forest, so a dense group leaves few of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written
from quillspark.shipping import ship_package


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component, given the edges of a graph."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def nearest_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of least weight, of edges of the graph; loops are ignored."""
    order = np.lexsort((b, a, weight))
    order = order[a[order] != b[order]]
    if not len(order):
        return a[:0], b[:0], weight[:0]
    a, b, weight = a[order], b[order], weight[order]
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label, open_, taken = np.arange(len(nodes)), np.arange(len(a)), []
    while True:
        open_ = open_[label[x[open_]] != label[y[open_]]]
        if not len(open_):
            break
        # every group takes its lightest edge to another; edges are in order of weight
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, label[x[open_]], open_)
        np.minimum.at(best, label[y[open_]], open_)
        chosen = np.unique(best[best < len(a)])
        taken.append(chosen)
        moved, root = forest(label[x[chosen]], label[y[chosen]])
        to = np.arange(len(nodes))
        to[moved] = root
        label = to[label]
    at = np.concatenate(taken)
    return a[at], b[at], weight[at]


def contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges (a, b) as a spanning forest of (node, smaller root), bounded batch by batch."""
    ship_package(edges.sparkSession)

    def run(batches):
        a, b, held = [], [], 0
        for batch in batches:
            a.append(np.asarray(batch.column(0)))
            b.append(np.asarray(batch.column(1)))
            held += batch.num_rows
            if held > 2_000_000:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
                if len(x) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
                    a, b = [], []
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


#: A node of more edges than this, and than this share of all, is a hub.
HUB_EDGES, HUB_SHARE = 2048, 1000


def with_least(edges: DataFrame, hub: int) -> DataFrame:
    """Edges (a, b) with m, the least of the a's bs; ``hub`` is the number of edges from which an a's is broadcast."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.filter(F.col("n") >= hub).select("a", F.col("m").alias("hm")))
    tagged = edges.join(hubs, "a", "left")
    rest = tagged.filter("hm is null").select("a", "b").join(least.filter(F.col("n") < hub).select("a", "m"), "a")
    return tagged.filter("hm is not null").select("a", "b", F.col("hm").alias("m")).union(rest.select("a", "b", "m"))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable node of each node that has an edge to another: node, component.

    ``edges`` has long columns a and b without nulls, in any order and repeated or not; loops
    are ignored. No edges give no rows. Each round is written to the shared folder.
    """
    now = written(contracted(edges.filter("a <> b")), name)
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before, n = None, now.count()
    while True:
        # large star: the larger neighbours of a node go to the least of its neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = max(HUB_EDGES, 2 * n // HUB_SHARE)
        large = with_least(both, hub).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        # small star: a node and its smaller neighbours go to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        small = with_least(down, hub).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        now = written(small, name)
        # done when every node has one edge, to a node that has none
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (state["n"], state["h"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, n = (state["n"], state["h"]), state["n"]
