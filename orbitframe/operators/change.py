"""Before/after change: medians, log ratios, slopes, hysteresis clusters, truth checks."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.config import METRES_PER_DEGREE, ChangeConfig
from orbitframe.functions.scalars import cluster_score, decibel, metres_between
from orbitframe.operators.components import label_cells


def change_db(df: DataFrame, keys: list[str], value: str, is_post: Column) -> DataFrame:
    """Per key the median of decibels after minus before; NULL where a side has none."""
    db = df.withColumn("_db", decibel(F.col(value)))
    med = lambda side: F.percentile(F.when(side, F.col("_db")), F.lit(0.5))
    return db.groupBy(*keys).agg(med(~is_post).alias("pre_db"), med(is_post).alias("post_db")).withColumn("change_db", F.col("post_db") - F.col("pre_db"))


def gradient(grid: DataFrame, value: str, step: float = 1.0) -> DataFrame:
    """Central differences by row and by column, one-sided at edges, and the slope in degrees."""

    def along(fixed: str, moving: str) -> Column:
        w = Window.partitionBy(fixed).orderBy(moving)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        there, here = F.lag(moving).over(w), F.lead(moving).over(w)
        near = F.when(there == F.col(moving) - 1, before), F.when(here == F.col(moving) + 1, after)
        v = F.col(value)
        return F.when(near[0].isNotNull() & near[1].isNotNull(), (near[1] - near[0]) / (2 * step)).when(near[1].isNotNull(), (near[1] - v) / step).when(near[0].isNotNull(), (v - near[0]) / step)

    out = grid.withColumn("d_row", along("col", "row")).withColumn("d_col", along("row", "col"))
    return out.withColumn("slope_deg", F.degrees(F.atan(F.hypot("d_row", "d_col"))))


def hysteresis_clusters(cells: DataFrame, value: str, config: ChangeConfig = ChangeConfig(), halo: Column | None = None, means: tuple[str, ...] = ()) -> DataFrame:
    """Clusters of cells at or under the halo level that hold a seed and enough cells; lower is stronger. ``means`` are averaged over their cells."""
    inside = cells.filter(F.col(value) <= config.grow_db) if halo is None else cells.filter(halo)
    labels = label_cells(inside.select("row", "col"))
    labelled = labels.join(inside, ["row", "col"])
    out = labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("size"), F.min(value).alias("peak"), F.avg(value).alias("mean"), F.avg("row").alias("row"), F.avg("col").alias("col"),
        *(F.avg(c).alias(f"mean_{c}") for c in means),
    )
    out = out.filter((F.col("size") >= config.min_pixels) & (F.col("peak") <= config.seed_db))
    return out.withColumn("area_m2", F.col("size") * F.lit(config.pixel_area_m2)).withColumn("score", F.round(cluster_score(F.col("peak"), F.col("size")), 2))


def steep_halo(value: str, slope: str, config: ChangeConfig = ChangeConfig()) -> Column:
    """Cells that changed enough on a slope that is steep enough; missing values are outside."""
    return F.coalesce((F.col(slope) >= config.min_slope_deg) & (F.col(value) <= config.grow_db), F.lit(False))


_GROUP_ROWS = 1 << 24  # rows a group may have: groups lie that far apart, so that no cluster spans two


def persistent_change(passes: DataFrame, terrain: DataFrame, groups: tuple[str, ...], config: ChangeConfig = ChangeConfig()) -> DataFrame:
    """passes(group, seq, is_post, row, col, vh, vv as power), terrain(row, col, slope_deg) -> clusters of change per group and kind.

    ``rapid`` holds the first pass afterwards against the median before, ``confirmed`` the median of all passes
    afterwards: what changed for good stays, speckle doesn't repeat. All groups are labelled at once; they are a
    given short list (orbits), of fewer than 128.
    """
    first = passes.filter("is_post").groupBy("group").agg(F.min("seq").alias("_first"))
    index = F.array_position(F.array(*map(F.lit, groups)), F.col("group")) - 1
    p = passes.filter(F.col("group").isin(*groups)).join(first, "group")
    med = lambda c, side: F.percentile(F.when(side, decibel(F.col(c))), F.lit(0.5))
    post = F.col("is_post")
    sides = [m.alias(f"{c}_{n}") for c in ("vh", "vv") for n, m in (("pre", med(c, ~post)), ("confirmed", med(c, post)), ("rapid", med(c, post & (F.col("seq") == F.col("_first")))))]
    cells = p.groupBy("group", "row", "col").agg(*sides).join(terrain.select("row", "col", "slope_deg"), ["row", "col"])
    cells = cells.withColumn("row", F.col("row").cast("long") + index * _GROUP_ROWS)

    def clusters(kind: str) -> DataFrame:
        change = cells.select("row", "col", (F.col(f"vh_{kind}") - F.col("vh_pre")).alias("vh"), (F.col(f"vv_{kind}") - F.col("vv_pre")).alias("vv"), F.col("slope_deg").alias("slope"))
        return hysteresis_clusters(change, "vh", config, steep_halo("vh", "slope", config), ("vv", "slope")).withColumn("kind", F.lit(kind))

    out = clusters("rapid").unionByName(clusters("confirmed"))
    at = F.shiftright("label", 56)
    out = out.withColumn("group", F.element_at(F.array(*map(F.lit, groups)), (at + 1).cast("int")))
    return out.withColumn("row", F.col("row") - at * _GROUP_ROWS).withColumn("label", F.col("label") - F.shiftleft(at, 56))


def candidate_totals(candidates: DataFrame, keys: list[str], within: Column) -> DataFrame:
    return candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(within).alias("n_within"))


def ranked(clusters: DataFrame, within: Column, keys: list[str] | None = None) -> DataFrame:
    """Rank by score among the rows within, per key where there are keys; rows outside have none. The window is partitioned by the flag."""
    w = Window.partitionBy(*(keys or []), within).orderBy(F.col("score").desc(), F.col("label"))
    return clusters.withColumn("rank", F.when(within, F.row_number().over(w)))


_SPLIT = 4  # cells to a radius


def _narrowed(band: Column, cell: float, most: bool) -> Column:
    """The largest or smallest cosine in a band of latitude, or a little beyond it."""
    half = math.radians(cell) / 2
    middle = F.abs(F.cos(F.radians((band + 0.5) * cell)))
    return F.least(middle + half, F.lit(1.0)) if most else F.greatest(middle - half, F.lit(1e-12))


def _cell(lat: Column, lon: Column, cell: float) -> list[Column]:
    """Cells ``cell`` degrees high and as wide in metres: wider in degrees towards the poles."""
    la = F.floor(lat / cell)
    return [la.alias("la"), F.floor(lon * _narrowed(la, cell, True) / cell).alias("lo")]


def _cells_near(cells: DataFrame, radius_m: float, cell: float) -> DataFrame:
    """cells(la, lo) with each cell (near_la, near_lo) that their radius may touch, and ``whole``: it lies within the radius of any point of theirs."""
    reach = radius_m / METRES_PER_DEGREE
    la, near = F.col("la"), F.col("near_la")
    width, near_width = cell / _narrowed(la, cell, True), cell / _narrowed(near, cell, True)
    west, side = F.col("lo") * width, F.least(reach / _narrowed(la, cell, False), F.lit(360.0)) * (1 + 1e-9)
    out = cells.withColumn("near_la", F.explode(F.sequence(la - _SPLIT - 1, la + _SPLIT + 1)))
    out = out.withColumn("near_lo", F.explode(F.sequence(F.floor((west - side) / near_width), F.floor((west + width + side) / near_width))))
    near_west = F.col("near_lo") * near_width
    north = (F.abs(near - la) + 1) * cell
    east = F.greatest(near_west + near_width - west, west + width - near_west) * _narrowed(la, cell, True)
    return out.withColumn("whole", F.hypot(north, east) <= reach * (1 - 1e-9))


def truth_check(candidates: DataFrame, sites: DataFrame, radius_m: float = 300.0) -> DataFrame:
    """Each site with the best-ranked candidate (not the nearest) within the radius, if any.

    Both sides are filed under cells, several to a radius. The best rank in the cells that lie wholly within the radius
    bounds a site's answer; only candidates of that rank or better in the cells it may touch are tested one by one, so
    crowded places cost no pairs. Where no cell lies wholly within the radius or all of those are empty, all in touch are tested.
    """
    cell = radius_m / METRES_PER_DEGREE / _SPLIT
    known = lambda *c: functools.reduce(operator.and_, (F.col(x).isNotNull() & ~F.isnan(x) for x in c))
    spots = sites.select("site", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon")).filter(known("site_lat", "site_lon"))
    spots = spots.select("*", *_cell(F.col("site_lat"), F.col("site_lon"), cell))
    filed = candidates.filter(known("lat", "lon") & F.col("rank").isNotNull()).groupBy("lat", "lon").agg(F.min("rank").alias("rank"))
    filed = filed.select("lat", "lon", "rank", *(c.alias(n) for c, n in zip(_cell(F.col("lat"), F.col("lon"), cell), ("near_la", "near_lo"), strict=True)))
    near = _cells_near(spots.select("la", "lo").distinct(), radius_m, cell)
    met = near.join(filed.groupBy("near_la", "near_lo").agg(F.min("rank").alias("_best")), ["near_la", "near_lo"])
    bound = met.groupBy("la", "lo").agg(F.min(F.when(F.col("whole"), F.col("_best"))).alias("_bound"))
    within = met.join(bound, ["la", "lo"]).filter("_bound IS NULL OR _best <= _bound").select("la", "lo", "near_la", "near_lo", "_bound")
    tested = filed.join(within, ["near_la", "near_lo"]).filter("_bound IS NULL OR rank <= _bound").select("la", "lo", "lat", "lon", "rank")
    d = metres_between(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon"))
    hits = spots.join(tested, ["la", "lo"]).withColumn("dist_m", d).filter(F.col("dist_m") <= radius_m)
    best = hits.groupBy("site").agg(F.min(F.struct("rank", "dist_m")).alias("m")).select("site", "m.rank", "m.dist_m")
    return sites.select("site").join(best, "site", "left")
