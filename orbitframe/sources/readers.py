"""Sources: catalogues, manifests, product names, tiled rasters, text lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.functions.scalars import asset_href, compact_date
from orbitframe.operators.grid import GridSpec

OPTICAL = "scene_id string, ts timestamp, cloud double, tile string, lon double, lat double, assets map<string, struct<href: string>>"
RADAR = "scene string, start string, path int, direction string, lon double, lat double, seq long"


def scenes(
    catalogue: DataFrame, max_cloud: float = 60.0, tile: str | None = None, limit: int | None = 600, since: str | None = None, until: str | None = None, box: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Catalogue rows under a cloud limit, latest first; of a tile, from ``since`` up to before ``until``, meeting a box (columns
    west, south, east, north) where these are given. Predicates reach the scan of the catalogue table."""
    out = catalogue.filter(F.col("cloud") < max_cloud)
    kind = catalogue.schema["ts"].dataType if since or until else None
    if since is not None:
        out = out.filter(F.col("ts") >= F.lit(since).cast(kind))
    if until is not None:
        out = out.filter(F.col("ts") < F.lit(until).cast(kind))
    if box is not None:
        out = out.filter(boxes_meet(*(F.col(c) for c in ("west", "south", "east", "north")), box))
    if tile is not None:
        out = out.filter(F.col("tile") == tile)
    return out.orderBy(F.col("ts").desc(), "scene_id").limit(limit) if limit else out


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return lon.between(west, east) & lat.between(south, north)


def boxes_meet(west: Column, south: Column, east: Column, north: Column, box: tuple[float, float, float, float]) -> Column:
    w, s, e, n = box
    return (west <= e) & (east >= w) & (south <= n) & (north >= s)


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring (array of structs x, y; not closed) holds the point: an odd number of its edges lie to the right."""
    following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def crossed(a: Column, b: Column) -> Column:
        at = a["x"] + F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"])
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, following, crossed), F.lit(0), lambda n, k: n + k) % 2 == 1


def radar_dates(bursts: DataFrame, polarisation: str | None = "_VV_", dates: list | None = None) -> DataFrame:
    """Burst scenes with their date; a polarisation is kept by the scene's name, None keeps all; ``dates`` keeps a set of days."""
    out = bursts.withColumn("date", F.to_date(F.substring("start", 1, 10)))
    if dates is not None:
        out = out.filter(F.col("date").isin(*dates))
    return out if polarisation is None else out.filter(F.contains("scene", F.lit(polarisation)))


def burst_search(bursts: DataFrame, lon: float, lat: float, track: int, start: str, end: str, polarisation: str | None = "_VV_", limit: int = 2000) -> DataFrame:
    """Bursts (RADAR columns and footprint array<struct<x, y>>) of a track over a point between two days, in order of start and arrival.

    Track and days are plain comparisons that the scan prunes by; the point is tested on what they leave.
    """
    out = bursts.filter((F.col("path") == track) & (F.col("start") >= start) & (F.col("start") < F.lit(end)))
    out = radar_dates(out.filter(in_ring(F.col("footprint"), F.lit(lon), F.lit(lat))), polarisation)
    return out.orderBy("start", "seq").limit(limit)


def archive_passes(passes: DataFrame, lon: float, lat: float, since: str, limit: int = 400) -> DataFrame:
    """The first ``limit`` arrivals since a day whose footprint holds the point, with the label of their track."""
    out = passes.filter((F.col("start") >= F.lit(since)) & in_ring(F.col("footprint"), F.lit(lon), F.lit(lat)))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return out.orderBy("seq").limit(limit).withColumn("track", F.concat(known("direction"), F.lit(" track "), known("path")))


def items_over(items: DataFrame, box: tuple[float, float, float, float], start: str, end: str) -> DataFrame:
    """Items (west, south, east, north, date) that meet a box, between two days, both included."""
    return items.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & boxes_meet(*(F.col(c) for c in ("west", "south", "east", "north")), box))


def grouped_on_arrival(items: DataFrame, keys: list[str], seq: str, item: str) -> DataFrame:
    """Per key the items in order of arrival. A key is one orbit on one day, so its list is short."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("at"), F.col(item).alias("item"))))
    return items.groupBy(*keys).agg(F.transform(listed, lambda x: x["item"]).alias("items"))


def latest_scene(scenes: DataFrame, place: str, ts: str, seq: str, scene: str, cloud: str, max_cloud: float = 60.0) -> DataFrame:
    """Per place the latest scene under the cloud limit; the first arrival wins ties. A missing cloud is put out as 0."""
    under = scenes.filter(F.coalesce(F.col(cloud), F.lit(0.0)) < max_cloud)
    best = F.max_by(F.struct(F.to_date(ts).alias("latest"), F.col(scene), F.coalesce(F.col(cloud), F.lit(0.0)).alias(cloud)), F.struct(F.col(ts), -F.col(seq)))
    return under.groupBy(place).agg(best.alias("b")).select(place, "b.*")


def product_dates(products: DataFrame, path: str = "path") -> DataFrame:
    """Products with the two dates in their folder's name; those with fewer are left out."""
    folder = F.try_element_at(F.split(path, "/"), F.lit(-2))
    dates = F.regexp_extract_all(folder, F.lit(r"\d{8}"), F.lit(0))
    out = products.withColumn("_d", dates).filter(F.size("_d") >= 2)
    return out.withColumn("ref", compact_date(F.element_at("_d", 1))).withColumn("sec", compact_date(F.element_at("_d", 2))).drop("_d")


def layer_sets(files: DataFrame) -> DataFrame:
    """files(path, height, width) -> one row per folder with its unwrapped, coherence and component layers, and the dates of its name.

    Folders without the first two layers, or with fewer than two dates, are left out.
    """
    kind = F.regexp_extract("path", r"_(unw_phase|corr|conncomp)\.tif$", 1)
    file = F.struct("path", "height", "width")
    named = files.withColumn("_kind", kind).filter("_kind <> ''").withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    layers = [F.min(F.when(F.col("_kind") == k, file)).alias(n) for k, n in (("unw_phase", "unw"), ("corr", "corr"), ("conncomp", "conn"))]
    sets = named.groupBy("folder").agg(*layers).filter("unw IS NOT NULL AND corr IS NOT NULL").withColumn("_path", F.col("unw.path"))
    return product_dates(sets, "_path").drop("_path")


def same_shape(sets: DataFrame) -> DataFrame:
    """Sets whose unwrapped layer has the shape of the first set's; a component layer of another shape becomes NULL."""
    first = sets.orderBy("folder").limit(1).select(F.col("unw.height").alias("_h"), F.col("unw.width").alias("_w"))
    same = lambda c: (F.col(f"{c}.height") == F.col("_h")) & (F.col(f"{c}.width") == F.col("_w"))
    out = sets.join(F.broadcast(first), same("unw"))  # first is one row
    return out.withColumn("conn", F.when(same("conn"), F.col("conn"))).drop("_h", "_w")


def product_for_pair(products: DataFrame, pairs: DataFrame, path: str = "path") -> DataFrame:
    """For each pair the first product (by path) whose name holds both dates."""
    dated = product_dates(products, path).groupBy("ref", "sec").agg(F.min(path).alias(path))
    return pairs.join(dated, ["ref", "sec"])


def manifest_jobs(manifests: DataFrame) -> DataFrame:
    """One row per job of manifests(batch, looks, submitted_utc, jobs)."""
    return manifests.select("batch", "looks", F.explode_outer("jobs").alias("j")).select("batch", "looks", "j.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "batch string, looks string, submitted_utc string, epochs array<struct<scene: string, date: string>>, jobs array<struct<job_id: string, ref: string, sec: string, ref_scene: string, sec_scene: string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def raster_window(tiles: DataFrame, rows: tuple[int, int], cols: tuple[int, int], size: int = 256) -> DataFrame:
    """Pixels of a window of tiles(raster_id, tile_row, tile_col, data array<float>); only tiles it touches are read."""
    touched = tiles.filter(F.col("tile_row").between(rows[0] // size, (rows[1] - 1) // size) & F.col("tile_col").between(cols[0] // size, (cols[1] - 1) // size))
    px = touched.select("raster_id", "tile_row", "tile_col", F.posexplode("data").alias("i", "v"))
    px = px.select("raster_id", (F.col("tile_row") * size + F.floor(F.col("i") / size)).cast("int").alias("row"), (F.col("tile_col") * size + F.col("i") % size).cast("int").alias("col"), F.when(~F.isnan("v"), F.col("v")).alias("v"))
    return px.filter((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of UTF-8 files; a file that can't be decoded is left out, whole, as is one without bytes."""
    text = F.col("content").cast("string")
    return spark.read.format("binaryFile").load(path).select("path", text.alias("content")).filter(F.is_valid_utf8("content"))


def place_hits(hits: DataFrame, limit: int = 6) -> DataFrame:
    return hits.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).orderBy("seq").limit(limit)


def channel_table(wide: DataFrame, site: str, ts: str, channels: list[str]) -> DataFrame:
    """Measurements side by side -> (channel, site, ts, v), the table that the detectors read; missing values are left out."""
    long = wide.select(F.col(site).alias("site"), F.col(ts).alias("ts"), *(F.col(c).cast("double").alias(c) for c in channels))
    return long.unpivot(["site", "ts"], channels, "channel", "v").filter("v IS NOT NULL").select("channel", "site", "ts", "v")


def raster_in_box(tiles: DataFrame, spec: GridSpec, box: tuple[float, float, float, float], size: int = 256) -> DataFrame:
    """Pixels whose centre lies in a box of world coordinates; only tiles that the box touches are read."""
    west, south, east, north = box
    rows = max(0, math.floor((spec.y0 - north) / spec.step)), min(spec.height, math.floor((spec.y0 - south) / spec.step) + 1)
    cols = max(0, math.floor((west - spec.x0) / spec.step)), min(spec.width, math.floor((east - spec.x0) / spec.step) + 1)
    x, y = spec.centre(F.col("row"), F.col("col"))
    return raster_window(tiles, rows, cols, size).filter(in_box(x, y, box))


def band_hrefs(scenes: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Scenes with the address of each wanted band, by its name or an alias; those that lack one are left out."""
    out = scenes.withColumns({band: asset_href(F.col("assets"), band, aliases)["href"] for band, aliases in wanted.items()})
    for band in wanted:
        out = out.filter(F.col(band).isNotNull())
    return out
