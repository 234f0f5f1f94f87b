"""Connected components of grid cells (8-neighbours).

Cells are labelled inside tiles first, so that only tile borders become edges of a graph. That graph is contracted
to stars: in turn each node sends its larger and its smaller neighbours to the least one it knows, so chains halve
and the edges never grow in number. Each round is checkpointed in the folder of ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.storage import shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _label_tile(table: pa.Table) -> pa.Table:
    r, c = table["row"].to_numpy(), table["col"].to_numpy()
    r0, c0 = r.min() - 1, c.min() - 1
    index = np.full((int(r.max() - r0) + 2, int(c.max() - c0) + 2), -1, np.int64)
    index[r - r0, c - c0] = np.arange(len(r))
    label = np.arange(len(r))
    steps = [index[r - r0 + dr, c - c0 + dc] for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))]
    while True:
        before = label.copy()
        for near in steps:
            i = np.flatnonzero(near >= 0)
            low = np.minimum(label[i], label[near[i]])
            np.minimum.at(label, i, low)
            np.minimum.at(label, near[i], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    order = np.lexsort((c, r))
    rank = np.empty(len(r), np.int64)
    rank[order] = np.arange(len(r))
    first = np.full(len(r), len(r), np.int64)
    np.minimum.at(first, label, rank)
    root = order[first[label]]
    return pa.table({"row": r, "col": c, "label": (r[root].astype(np.int64) << 32) + c[root]})


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def spread_labels(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, label): the smallest node of each component, for every node in an edge.

    Edges point from the larger node to the smaller one. The least neighbours are pre-aggregated and joined back, so the
    neighbours of a hub are never one group. Repeated edges and loops are harmless; an edge with a NULL is left out.
    """
    known = checkpointed(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    stars = checkpointed(known.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, before = _state(stars), None
    while state != before:
        below = stars.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
        ends = stars.select(F.col("b").alias("n")).distinct().join(below, "n", "left").select("n", F.coalesce("low", "n").alias("low"))
        large = stars.join(ends, F.col("b") == F.col("n")).select("a", F.col("low").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
        small = large.join(least, F.col("a") == F.col("n")).select(F.when(F.col("b") > F.col("low"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("low").alias("b"))
        stars = checkpointed(small.distinct())
        state, before = _state(stars), state
    nodes = known.select(F.col("a").alias("node")).union(known.select("b")).distinct()
    return nodes.join(stars, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("label"))


def label_cells(cells: DataFrame, tile: int = 512) -> DataFrame:
    """cells(row int, col int) -> row, col, label. The label packs the first cell of the component in row-major order."""
    tiled = cells.select(F.col("row").cast("long"), F.col("col").cast("long")).withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))
    local = checkpointed(tiled.groupBy("tr", "tc").applyInArrow(_label_tile, "row long, col long, label long"))
    edge = (F.pmod("row", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1))
    border = local.filter(edge)
    near = border.select("row", "col", "label", F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))))).alias("d"))
    near = near.select((F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col"), F.col("label").alias("a"))
    seams = near.join(border.withColumnRenamed("label", "b"), ["row", "col"]).filter("a <> b").select("a", "b").distinct()
    joined = spread_labels(seams)
    return local.join(joined.withColumnRenamed("label", "top"), F.col("label") == F.col("node"), "left").select("row", "col", F.coalesce("top", "label").alias("label"))
