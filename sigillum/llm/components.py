"""Connected components by least labels."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from .common import shared_folder, stash

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST_ROWS = 1 << 18  # of ids and digests: some 20 MB
CHUNK = 1 << 18  # edges
WHOLE = 1 << 20  # edges of stars that one task takes: 16 MB, and some times that while it sorts them
BATCH = 1 << 16


def least_labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least of the nodes 0 to `n` - 1 that each of them reaches over edges `i`, `j`."""
    label = np.arange(n)
    while True:
        lower = label.copy()
        np.minimum.at(lower, i, label[j])
        np.minimum.at(lower, j, label[i])
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _both_ways(edges: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Stars that connect what the edges do, around least nodes, each edge in both directions."""
    a, b = (np.concatenate([batch.column(k).to_numpy() for batch in edges]) for k in range(2))
    node, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = least_labels(place[: len(a)], place[len(a) :], len(node))
    moved = label != np.arange(len(node))
    alone = (np.bincount(label, minlength=len(node)) == 1) & ~moved
    low, high = node[label[moved]], node[moved]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((low, high, node[alone]))), pa.array(np.concatenate((high, low, node[alone])))],
        names=["a", "b"],
    )


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield _both_ways(held)
            held, rows = [], 0
    if rows:
        yield _both_ways(held)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in batches if batch.num_rows]
    if held:
        found = _both_ways(held)
        for first in range(0, found.num_rows, BATCH):
            yield found.slice(first, BATCH)


def components(edges: DataFrame) -> DataFrame:
    """`(node, component)`: the least node that `(a, b)` edges reach.

    Each task first turns its edges, `CHUNK` at a time, into stars around least nodes,
    so what is left has to connect what chunks share. Up to `WHOLE` edges one task does
    that, without rounds, whose queries and broadcast labels the driver would have to
    hold. With more, a round takes the least label
    of the neighbours and then the label of that label, so chains shorten by more than half. A hub's edges are combined
    before the shuffle, of which a round has one while the labels are few enough
    to be broadcast; beyond, Spark shuffles for the joins too. Every round is cut
    off by a stored table.
    """
    shared_folder(edges.sparkSession)
    both = stash(edges.select("a", "b").mapInArrow(_contracted, "a long, b long"))
    once = both.where("a <= b")
    is_whole = once.count() <= WHOLE
    if is_whole:
        both = stash(once.repartition(1).mapInArrow(_whole, "a long, b long"))
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("component")))
    if is_whole:
        return labels
    hint = F.broadcast if labels.count() <= BROADCAST_ROWS else lambda table: table
    while True:
        near = both.join(hint(labels.withColumnRenamed("node", "b")), "b").select(
            F.col("a").alias("node"), F.col("component").alias("low"), F.lit(None).cast("long").alias("was")
        )
        lowered = (
            near.union(labels.select("node", "component", F.col("component").alias("was")))
            .groupBy("node")
            .agg(F.min("low").alias("low"), F.max("was").alias("was"))
        )
        far = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        moved = stash(
            lookup(lowered, hint(far), "low").select("node", F.least("low", "far").alias("component"), "was")
        )
        labels = moved.select("node", "component")
        if moved.where("component <> was").isEmpty():
            return labels
