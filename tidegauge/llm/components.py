"""Connected components of a table of links: contracted within tasks, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: Links that a task contracts at most; it holds some 100 bytes of each.
LINKS_PER_TASK = 1 << 20


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v) in order, and the smallest node that each can reach by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (further := new[new] != new).any():
            new = np.where(further, new[new], new)
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contracted(links: DataFrame, tasks: int) -> DataFrame:
    """(u, v): of the links of each task, every node with a smaller one in its task's component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        if held:
            nodes, root = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
            other = nodes != root
            yield from pa.table([pa.array(nodes[other]), pa.array(root[other])], ["u", "v"]).to_batches(1 << 16)

    return (links.coalesce(1) if tasks == 1 else links.repartition(tasks)).mapInArrow(run, "u long, v long")


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Links every larger (or every smaller) neighbour of u to the least of u and its neighbours.

    The minima are pre-aggregated in the map tasks, and the join with them can be split, so a node
    with very many neighbours gathers in no single task."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")) if large else both.filter("v < u").groupBy("u").agg(F.min("v").alias("m"))
    side = both.filter("v > u") if large else both.filter("v < u")
    linked = side.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked if large else linked.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, most_rounds: int = 60, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(node, component) of all nodes that have a link; the component is its smallest node.

    links has two columns of ids that are not null. Tasks of up to ``per_task`` links contract them to
    a forest first, and where one task holds all, that is the end. Else rounds of stars follow, each
    written to the shared folder. A round that changes nothing ends the loop; the number of rounds
    grows with the logarithm of the diameter."""
    a, b = links.columns
    edges = materialise(links.filter(f"{a} != {b}").select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")), "links")
    tasks = max(1, -(-edges.count() // per_task))
    edges = materialise(_contracted(edges, tasks), "links")
    state = None
    for _ in range(most_rounds if tasks > 1 else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _star(both, True).filter("u != v").distinct()
        both = wide.unionByName(wide.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = materialise(_star(both, False).filter("u != v").distinct(), "links")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
    else:
        if tasks > 1:
            raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    heads = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads.select("node", F.col("node").alias("component")))
