"""Connected components over a table of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspring.storage import drop_stored, stored

#: Edges that a task contracts at once.
TOGETHER = 1_000_000


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the smallest of each component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least, after = np.minimum(label[left], label[right]), label.copy()
        for end in (left, right, label[left], label[right]):
            np.minimum.at(after, end, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    own = nodes[label] != nodes
    return nodes[own], nodes[label][own]


def _forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, at most one a node in each partition: a combine where the
    edges lie. A task holds the nodes of its partition."""

    def contract(batches):
        a = b = np.zeros(0, np.int64)
        waiting, n = [], 0
        for batch in batches:
            waiting.append([batch.column(c).to_numpy(zero_copy_only=False) for c in "ab"])
            n += batch.num_rows
            if n >= max(TOGETHER, len(a)):
                a, b = _contracted(*(np.concatenate([have, *more]) for have, *more in zip((a, b), *waiting)))
                waiting, n = [], 0
        a, b = _contracted(*(np.concatenate([have, *more]) for have, *more in zip((a, b), *waiting)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.mapInArrow(contract, "a long, b long")


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) of whole numbers with the same components: cut to a forest where they lie, and
    again in partitions of even size."""
    own = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    return _forest(_forest(own).hint("rebalance"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of edges (a, b); label: the smallest node reached. Each round takes
    the smallest label among neighbours and then that label's label, so paths halve."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        after = stored(lower.join(jump, "to").select("node", F.least("to", "further").alias("label"), "was"))
        moved = after.where("label < was").limit(1).count()
        drop_stored(labels)
        labels = after.select("node", "label")
        if not moved:
            drop_stored(both)
            return labels
