"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Edges up to which one task joins them in memory (16 bytes each); beyond, stars are contracted by joins.
ONE_TASK_EDGES = 2_000_000


def join_sets(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted nodes, and the least node of each one's component."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        hi, lo = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
        open_ = hi != lo
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(label, hi[open_], lo[open_])
        while (nxt := label[label]).tobytes() != label.tobytes():
            label = nxt
    return nodes, nodes[label]


def connected_components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component): the least node of each component, from a written table of bigint columns ``a`` and ``b``.

    Within the bound one task does it; beyond, alternate large-star and small-star rounds, each a grouped minimum and a
    join, run until no edge changes, with the edges written between rounds.  Both give the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            nodes, label = join_sets(*(np.concatenate([b.column(i).to_numpy() for b in got]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], names=["node", "component"])

    if edges.count() <= one_task:
        return edges.select("a", "b").coalesce(1).mapInArrow(run, "node bigint, component bigint")
    now = common.materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        after = common.materialise(small)
        if after.count() == now.count() and after.exceptAll(now).limit(1).count() == 0:
            break
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
