"""Grids: target grids, pixel and world coordinates, resampling, windows, shading."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.functions.scalars import lonlat_from_utm, utm_bounds

@dataclass(frozen=True)
class GridSpec:
    """A north-up grid: the corner of the first pixel, the pixel size, rows and columns."""

    x0: float
    y0: float
    step: float
    height: int
    width: int

    @classmethod
    def covering(cls, west: float, south: float, east: float, north: float, step: float) -> GridSpec:
        """The grid snapped outwards to multiples of the step."""
        x0, y0 = math.floor(west / step) * step, math.ceil(north / step) * step
        return cls(x0, y0, step, math.ceil((y0 - south) / step), math.ceil((east - x0) / step))

    def cells(self, spark: SparkSession) -> DataFrame:
        rows = spark.range(self.height).select(F.col("id").cast("int").alias("row"))
        return rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(self.width - 1))).alias("col"))

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return self.x0 + (col + 0.5) * self.step, self.y0 - (row + 0.5) * self.step

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.floor((self.y0 - y) / self.step).cast("int"), F.floor((x - self.x0) / self.step).cast("int")


def common_grids(boxes: DataFrame, zone: int | Column, step: float, edge_points: int = 21) -> DataFrame:
    """boxes(west, south, east, north in degrees, ...) with the map grid that holds each one: zone, x0, y0, height, width.

    Edges are curved on the map, so each carries ``edge_points`` places besides its corners. The outline is snapped outwards
    to multiples of the step. A box with a missing side or NaN has no grid: NULLs. Outlines are worked out in numpy, a slice of boxes at a time.
    """

    @F.pandas_udf("left double, bottom double, right double, top double")
    def bounds(west: pd.Series, south: pd.Series, east: pd.Series, north: pd.Series, zone: pd.Series) -> pd.DataFrame:
        sides, most = np.stack([c.to_numpy(float) for c in (west, south, east, north, zone)]), max(1, (1 << 18) // (4 * edge_points + 8))
        parts = [utm_bounds(*sides[:, k : k + most], edge_points) for k in range(0, sides.shape[1], most)]
        return pd.DataFrame(np.concatenate(parts, axis=1).T if parts else np.empty((0, 4)), columns=["left", "bottom", "right", "top"])

    out = boxes.withColumn("zone", zone if isinstance(zone, Column) else F.lit(zone))
    out = out.withColumn("_b", bounds(*(F.col(c).cast("double") for c in ("west", "south", "east", "north", "zone"))))
    out = out.withColumns({"x0": F.floor(F.col("_b.left") / step) * step, "y0": F.ceil(F.col("_b.top") / step) * step})
    return out.withColumns({"height": F.ceil((F.col("y0") - F.col("_b.bottom")) / step).cast("int"), "width": F.ceil((F.col("_b.right") - F.col("x0")) / step).cast("int")}).drop("_b")


def pixel_lonlat(grids: DataFrame, row: Column, col: Column, step: float) -> DataFrame:
    """Grids of ``common_grids`` with the degrees (lon, lat) of the centre of one of their pixels."""
    back = lonlat_from_utm(F.col("x0") + (col + 0.5) * step, F.col("y0") - (row + 0.5) * step, F.col("zone"))
    return grids.withColumns({"lon": back[0], "lat": back[1]})


def decimated(pixels: DataFrame, keys: list[str], v: str, factor: int) -> DataFrame:
    """Block means; a block without values is NULL."""
    r, c = F.floor(F.col("row") / factor).cast("int"), F.floor(F.col("col") / factor).cast("int")
    return pixels.groupBy(*keys, r.alias("row"), c.alias("col")).agg(F.avg(v).alias(v))


def bilinear(points: DataFrame, grid: DataFrame, spec: GridSpec, v: str, renormalised: bool = False) -> DataFrame:
    """points(id, x, y) with the value between the four nearest pixel centres. If one of them is missing: NULL, or, renormalised,
    the mean of the others by their weights (NULL without any)."""
    fc, fr = (F.col("x") - spec.x0) / spec.step - 0.5, (spec.y0 - F.col("y")) / spec.step - 0.5
    p = points.withColumn("_c", F.floor(fc)).withColumn("_r", F.floor(fr)).withColumn("_fx", fc - F.col("_c")).withColumn("_fy", fr - F.col("_r"))
    corners = F.array(*(F.struct((F.col("_r") + dr).cast("int").alias("row"), (F.col("_c") + dc).cast("int").alias("col"), ((F.col("_fy") if dr else 1 - F.col("_fy")) * (F.col("_fx") if dc else 1 - F.col("_fx"))).alias("w")) for dr in (0, 1) for dc in (0, 1)))
    near = p.select("id", F.explode(corners).alias("k")).select("id", "k.*").filter("w > 0")
    got = near.join(grid.select("row", "col", v), ["row", "col"], "left")
    total, weight = F.sum(F.col(v) * F.col("w")), F.sum(F.when(F.col(v).isNotNull(), F.col("w")))
    return got.groupBy("id").agg((total / weight if renormalised else F.when(F.count(v) == F.count(F.lit(1)), total)).alias(v))


def nearest(points: DataFrame, grid: DataFrame, spec: GridSpec, v: str) -> DataFrame:
    r, c = spec.pixel(F.col("x"), F.col("y"))
    return points.select("id", r.alias("row"), c.alias("col")).join(grid.select("row", "col", v), ["row", "col"], "left").select("id", v)


def masked(grid: DataFrame, v: str, nodata: float | None = 0.0) -> DataFrame:
    """NaN and the nodata value become NULL."""
    known = F.col(v).isNotNull() & ~F.isnan(v)
    return grid.withColumn(v, F.when(known if nodata is None else known & (F.col(v) != nodata), F.col(v)))


def warped(grid: DataFrame, src: GridSpec, dst: GridSpec, v: str, nodata: float | None = 0.0, renormalised: bool = False) -> DataFrame:
    """The values of a grid at the pixel centres of another one, bilinear; a cell next to nodata is NULL, or has its weights renormalised."""
    x, y = dst.centre(F.col("row"), F.col("col"))
    cells = dst.cells(grid.sparkSession).withColumn("id", F.col("row").cast("long") * dst.width + F.col("col"))
    out = bilinear(cells.select("id", x.alias("x"), y.alias("y")), masked(grid, v, nodata), src, v, renormalised)
    return cells.join(out, "id").drop("id")


def read_resampled(pixels: DataFrame, shape: tuple[int, int], out: tuple[int, int], v: str, method: str = "bilinear") -> DataFrame:
    """A window of ``shape`` pixels as ``out`` pixels, sampled at the centre of each: between neighbours, or the nearest one."""
    (h, w), (oh, ow) = shape, out
    target = GridSpec(0.0, 0.0, 1.0, oh, ow)
    cells = target.cells(pixels.sparkSession).withColumn("id", F.col("row").cast("long") * ow + F.col("col"))
    points = cells.select("id", ((F.col("col") + 0.5) * (w / ow)).alias("x"), (-(F.col("row") + 0.5) * (h / oh)).alias("y"))
    kernel = bilinear if method == "bilinear" else nearest
    return cells.join(kernel(points, pixels, GridSpec(0.0, 0.0, 1.0, h, w), v), "id").drop("id")


def axis_weights(spark: SparkSession, n: int, out: int) -> DataFrame:
    """(src, dst, w): a triangle kernel from n cells to out cells along one axis; its reach grows with the factor, so no cell is skipped."""
    scale = n / out
    reach = max(1.0, scale)
    centre = (F.col("dst") + 0.5) * scale - 0.5
    taps = F.sequence(F.greatest(F.ceil(centre - reach), F.lit(0)).cast("int"), F.least(F.floor(centre + reach), F.lit(n - 1)).cast("int"))
    cells = spark.range(out).select(F.col("id").cast("int").alias("dst")).withColumn("src", F.explode(taps))
    return cells.withColumn("w", 1 - F.abs(F.col("src") - centre) / reach).filter("w > 0")


def resampled(pixels: DataFrame, shape: tuple[int, int], out: tuple[int, int], v: str, keys: list[str] | None = None) -> DataFrame:
    """A window of ``shape`` pixels as ``out`` pixels by a kernel that widens with the factor, rows first, then columns.

    Weights are renormalised over the cells that have a value; a target without any is NULL, and is a row only where
    its kernel met rows of ``pixels`` at all. Going up or by one this is bilinear sampling.
    """
    keys, spark = keys or [], pixels.sparkSession
    rows, cols = (axis_weights(spark, n, m) for n, m in zip(shape, out, strict=True))
    known = F.col(v).isNotNull()
    down = pixels.withColumnRenamed("row", "src").join(rows, "src").groupBy(*keys, F.col("dst").alias("row"), "col").agg(F.sum(F.col("w") * F.col(v)).alias("_sum"), F.sum(F.when(known, F.col("w"))).alias("_weight"))
    across = down.withColumnRenamed("col", "src").join(cols, "src").groupBy(*keys, "row", F.col("dst").alias("col")).agg(F.sum(F.col("w") * F.col("_sum")).alias("_s"), F.sum(F.col("w") * F.col("_weight")).alias("_w"))
    return across.select(*keys, "row", "col", F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).alias(v))


def aligned(bands: DataFrame, keys: list[str], band: str, v: str, names: list[str]) -> DataFrame:
    """Long bands side by side, one row per pixel, in one aggregate."""
    return bands.filter(F.col(band).isin(*names)).groupBy(*keys).agg(*(F.max(F.when(F.col(band) == n, F.col(v))).alias(n) for n in names))


def valid_fraction(pixels: DataFrame, keys: list[str], v: str) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg(F.col(v).isNotNull().cast("int")).alias("valid_frac"))


def window_around(pixels: DataFrame, sites: DataFrame, half: int = 40) -> DataFrame:
    """Pixels within ``half`` of each site(site, site_row, site_col), met on blocks of that size."""
    block = 2 * half
    tile = lambda x: F.floor(x / block)
    spots = sites.withColumn("_tr", F.explode(F.sequence(tile(F.col("site_row") - half), tile(F.col("site_row") + half))))
    spots = spots.withColumn("_tc", F.explode(F.sequence(tile(F.col("site_col") - half), tile(F.col("site_col") + half))))
    filed = pixels.withColumn("_tr", tile(F.col("row"))).withColumn("_tc", tile(F.col("col")))
    inside = F.col("row").between(F.col("site_row") - half, F.col("site_row") + half - 1) & F.col("col").between(F.col("site_col") - half, F.col("site_col") + half - 1)
    return filed.join(spots, ["_tr", "_tc"]).filter(inside).drop("_tr", "_tc")


def hillshade(d_row: Column, d_col: Column, azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 1.5) -> Column:
    """Shade of a surface from its gradients, 0 to 1."""
    a, z = math.radians(360 - azimuth + 90), math.radians(90 - altitude)
    slope = F.atan(exaggeration * F.hypot(d_row, d_col))
    aspect = F.atan2(d_row, -d_col)
    shade = math.cos(z) * F.cos(slope) + math.sin(z) * F.sin(slope) * F.cos(a - aspect)
    return F.when(shade.isNotNull(), F.greatest(F.lit(0.0), shade))


def map_table(terrain: DataFrame, elevation: str) -> DataFrame:
    """Terrain with its gradients -> the table a map is drawn from: shade, and whether a cell is sea."""
    return terrain.select("row", "col", hillshade(F.col("d_row"), F.col("d_col")).alias("shade"), (F.coalesce(F.col(elevation), F.lit(0.0)) <= 0).alias("sea"))


def map_rings(candidates: DataFrame, inside: Column, top: int = 100, ties: list[str] | None = None) -> DataFrame:
    """The first candidates with the size and colour of their ring; equal scores go by ``ties``, else by label."""
    first = candidates.orderBy(F.col("score").desc(), *(ties or ["label"])).limit(top)
    return first.withColumn("ring", F.greatest(F.lit(25.0), F.col("area_m2") / 80)).withColumn("colour", F.when(inside, "#ff3b30").otherwise("#8e8e93"))
