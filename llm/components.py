"""Connected components of a graph given as a table of edges, in rounds of Spark jobs.

Every round joins each node to its smallest neighbour and contracts the edges by that map, so a star
is gone after one round and every component at least halves. Node ids must look random (here they
are hashes), which keeps chains from lining up with the order. Edges are first replaced by spanning
stars of the pieces that lie within one partition, which bounds the edges of a component by its nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, written


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (deeper := new[new] != new).any():
            new = np.where(deeper, new[new], new)
        new = new[label]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


#: Edges that a task holds at once.
HELD = 1 << 22


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges a, b of a partition as edges from each node to the smallest one of its piece, HELD edges or so at a time."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, low = local_components(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        keep = node != low
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(low[keep])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= HELD:
            yield star(held)
            held, n = [], 0
    if held:
        yield star(held)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a long, b long); root is the same for connected nodes."""
    maps: list[DataFrame] = []
    edges = written(edges.select("a", "b").mapInArrow(releasing(stars), "a long, b long"), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "roots")
        maps.append(least)
        to_a, to_b = least.toDF("a", "ra"), least.toDF("b", "rb")
        moved = edges.join(to_a, "a").join(to_b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = written(moved.mapInArrow(releasing(stars), "a long, b long").distinct(), "edges")
    if not maps:
        return edges.toDF("node", "root")
    out = maps[-1]
    for before in maps[-2::-1]:
        out = before.join(out.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
