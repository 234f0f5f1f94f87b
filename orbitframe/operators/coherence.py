"""Loss of coherence over a target against a control, from jobs to figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.operators.grid import GridSpec
from orbitframe.operators.spatial import raster_in_boxes
from orbitframe.operators.zonal import spans, target_against_control
from orbitframe.sources.readers import product_for_pair

Box = tuple[float, float, float, float]


def coherence_loss(jobs: DataFrame, products: DataFrame, tiles: DataFrame, spec: GridSpec, target: Box, control: Box, event: Column, low: float = 0.3, size: int = 256) -> DataFrame:
    """jobs(ref, sec) -> per pair with a product: whether it spans the event, and both zones' figures in that product.

    products(path) carry their dates in their folder's name, and tiles(raster_id, tile_row, tile_col, data) their pixels under
    that path. Boxes are (west, south, east, north). Only tiles of chosen products that touch a box are unpacked. Pixels that
    aren't positive count for nothing; a zone without pixels has NULL means and counts of 0; a pair without a product is left out.
    """
    found = product_for_pair(products, jobs.select("ref", "sec").distinct(), "path")
    boxes = jobs.sparkSession.createDataFrame([("target", *map(float, target)), ("control", *map(float, control))], "zone string, west double, south double, east double, north double")
    chosen = tiles.join(found.select(F.col("path").alias("raster_id")).distinct(), "raster_id", "left_semi")
    pixels = raster_in_boxes(chosen, spec, F.broadcast(boxes), ["zone"], size)  # two rows
    figures = target_against_control(pixels, ["raster_id"], "v", F.col("zone") == "target", F.col("zone") == "control", low)
    out = found.join(figures.withColumnRenamed("raster_id", "path"), "path", "left")
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_target", "n_control")}
    return out.withColumns(counts).withColumn("spans_event", spans(F.col("ref"), F.col("sec"), event))
