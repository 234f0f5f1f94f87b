"""Places against footprints, and boxes against tiles, joined by cells that cover them.

Cells are those of a quadtree over [-180, 180) x [-90, 90]: at level k, 2**k by 2**k of them, numbered along a Z-order
curve. A footprint is filed under the cells of the level at which its box touches four of them at most; a place is filed under
its one cell at each level that footprints may have. Both meet in an equi-join on (level, cell), once, and the exact test
decides. Cells where many footprints lie are dealt over parts, each of about ``part_rows`` footprints, which
the places of such a cell visit one and all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.operators.grid import GridSpec
from orbitframe.sources.readers import in_ring

LEVELS = 16


def interleaved(x: Column, y: Column) -> Column:
    """The place of cell (x, y) on the Z-order curve: its bits dealt alternately. Coordinates have LEVELS bits at most."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def cell_axis(value: Column, low: float, extent: float, level: Column) -> Column:
    """The cell of a coordinate along one axis; what lies beyond the ends belongs to the last cells."""
    n = F.pow(F.lit(2.0), level)
    return F.least(F.greatest(F.floor((value - low) / extent * n), F.lit(0)), n.cast("long") - 1)


def cell_of(lon: Column, lat: Column, level: Column) -> Column:
    return interleaved(cell_axis(lon, -180.0, 360.0, level), cell_axis(lat, -90.0, 180.0, level))


def box_level(west: Column, south: Column, east: Column, north: Column, levels: int = LEVELS) -> Column:
    """The finest level whose cells are as large as the box on both axes, so that it touches two a side at most."""
    larger = F.greatest((east - west) / 360, (north - south) / 180)
    return F.when(larger <= 0, F.lit(levels)).otherwise(F.greatest(F.lit(0), F.least(F.lit(levels), F.floor(-F.log2(larger)).cast("int"))))


def covered(boxes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """boxes(west, south, east, north, ...) once per cell of their own level that they touch: with ``level`` and ``cell``."""
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    leveled = boxes.withColumn("level", box_level(w, s, e, n, levels))
    span = lambda a, b, low, extent: F.sequence(cell_axis(a, low, extent, F.col("level")), cell_axis(b, low, extent, F.col("level")))
    out = leveled.withColumn("_x", F.explode(span(w, e, -180.0, 360.0))).withColumn("_y", F.explode(span(s, n, -90.0, 180.0)))
    return out.withColumn("cell", interleaved(F.col("_x"), F.col("_y"))).drop("_x", "_y")


def with_box(footprints: DataFrame, ring: str = "footprint") -> DataFrame:
    """The ring's box as columns west, south, east, north; rows without a ring are left out."""
    side = lambda of, c: of(F.transform(ring, lambda p: p[c]))
    return footprints.filter(F.size(ring) > 0).withColumns({"west": side(F.array_min, "x"), "south": side(F.array_min, "y"), "east": side(F.array_max, "x"), "north": side(F.array_max, "y")})


def places_in_footprints(places: DataFrame, footprints: DataFrame, lon: str = "lon", lat: str = "lat", ring: str = "footprint", levels: int = LEVELS, part_rows: int = 100_000) -> DataFrame:
    """Each place with each footprint (array<struct<x, y>>) that holds it: all columns of both. Points on an edge go by ``in_ring``."""
    filed = covered(with_box(footprints, ring), levels)
    parts = filed.groupBy("level", "cell").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("_parts"))
    hot = parts.filter("_parts > 1")
    used = sorted(r["level"] for r in filed.select("level").distinct().collect())  # at most levels + 1
    known = places.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    seen = known.withColumn("level", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn("cell", cell_of(F.col(lon), F.col(lat), F.col("level")))
    visits = seen.join(hot, ["level", "cell"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    dealt = filed.join(hot, ["level", "cell"], "left").withColumn("_part", F.pmod(F.xxhash64("west", "south", "east", "north", ring), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    box = dealt.withColumnsRenamed({"west": "_w", "south": "_s", "east": "_e", "north": "_n"})
    met = visits.join(box, ["level", "cell", "_part"])
    near = F.col(lon).between(F.col("_w"), F.col("_e")) & F.col(lat).between(F.col("_s"), F.col("_n"))  # a cell holds several times what its boxes do
    return met.filter(near & in_ring(F.col(ring), F.col(lon), F.col(lat))).drop("level", "cell", "_part", "_w", "_s", "_e", "_n")


def footprint_totals(places: DataFrame, footprints: DataFrame, key: str, lon: str = "lon", lat: str = "lat", ring: str = "footprint", levels: int = LEVELS, part_rows: int = 100_000) -> DataFrame:
    """places that some footprint holds, with the number (n), the least key (first_key) and the sum of keys (key_sum) of these footprints.

    Equal rings meet as one footprint and equal coordinates as one place, so pairs grow with the shapes and spots that
    differ, not with the rows that repeat them.
    """
    shapes = footprints.groupBy(ring).agg(F.count(F.lit(1)).alias("_count"), F.min(key).alias("_first"), F.sum(key).alias("_sum"))
    met = places_in_footprints(places.select(lon, lat).distinct(), shapes, lon, lat, ring, levels, part_rows)
    totals = met.groupBy(lon, lat).agg(F.sum("_count").alias("n"), F.min("_first").alias("first_key"), F.sum("_sum").alias("key_sum"))
    return places.join(totals, [lon, lat])


def raster_in_boxes(tiles: DataFrame, spec: GridSpec, boxes: DataFrame, keys: list[str], size: int = 256) -> DataFrame:
    """Pixels of tiles(raster_id, tile_row, tile_col, data) whose centre lies in each of boxes(keys, west, south, east, north).

    A box names the tiles it touches, and only those are unpacked; within a tile the rows and columns of the box are cut out
    of the array, so no pixel outside a box becomes a row.
    """
    axis = lambda value, origin, sign: F.floor((value - origin) * sign / spec.step)
    clip = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))
    inside = boxes.filter((F.col("east") > spec.x0) & (F.col("west") < spec.x0 + spec.width * spec.step) & (F.col("north") > spec.y0 - spec.height * spec.step) & (F.col("south") < spec.y0))
    ranges = inside.withColumns({
        "_r0": clip(axis(F.col("north"), spec.y0, -1), spec.height), "_r1": clip(axis(F.col("south"), spec.y0, -1), spec.height),
        "_c0": clip(axis(F.col("west"), spec.x0, 1), spec.width), "_c1": clip(axis(F.col("east"), spec.x0, 1), spec.width),
    })
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    touched = ranges.withColumn("tile_row", F.explode(F.sequence(tile("_r0"), tile("_r1")))).withColumn("tile_col", F.explode(F.sequence(tile("_c0"), tile("_c1"))))
    met = tiles.join(touched, ["tile_row", "tile_col"])
    along = lambda a, b, t: F.sequence(F.greatest(F.col(a), F.col(t) * size), F.least(F.col(b), F.col(t) * size + size - 1))
    px = met.withColumn("row", F.explode(along("_r0", "_r1", "tile_row"))).withColumn("col", F.explode(along("_c0", "_c1", "tile_col")))
    at = (F.col("row") - F.col("tile_row") * size) * size + F.col("col") - F.col("tile_col") * size
    v = F.try_element_at("data", (at + 1).cast("int"))
    px = px.select(*keys, "raster_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.when(~F.isnan(v), v).alias("v"), "west", "south", "east", "north")
    x, y = spec.centre(F.col("row"), F.col("col"))
    return px.filter(x.between(F.col("west"), F.col("east")) & y.between(F.col("south"), F.col("north"))).drop("west", "south", "east", "north")
