"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges are first contracted inside each batch to stars around the smallest node, which also breaks up hubs before
anything is shuffled. Each round is written to the shared store, so lineage stays short and a lost executor
costs one round; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.settings import remove, scratch, written


def local_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable over the edges a-b)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[label]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars with the same components as each batch."""
    for batch in batches:
        nodes, roots = local_labels(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        keep = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["src", "dst"])


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(src, dst) of longs -> (node, component): the smallest node of its component, for every node but that one itself."""
    spark = edges.sparkSession
    at = scratch(spark, "components")
    pairs = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst")
    now = written(pairs.mapInArrow(contracted, "src long, dst long").distinct(), f"{at}/0")  # src > dst
    mark = None
    for k in itertools.count(1):  # ends: every round but the last moves an edge to a smaller node
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("low"))
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(least, "src").select(F.explode(F.array(F.struct("src", F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))).alias("e")).select("e.*").filter("src <> dst")
        now = written(small.distinct(), f"{at}/{k}")
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        remove(spark, f"{at}/{k - 2}") if k >= 2 else None
        if (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
