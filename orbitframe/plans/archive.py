"""More queries: searches, product layers, rasters, composed change detection, request texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.config import ChangeConfig, TrailingConfig
from orbitframe.functions import scalars
from orbitframe.operators import change, detectors, grid, select, textlint, zonal
from orbitframe.plans.catalogue import EPOCHS, GRID, LINT_COUNT, gram_schmidt, hour_grid, order_epochs, page_lines, query, t
from orbitframe.sources import readers, sinks

LON, LAT = 5.3, 3.7


def footprints(spark, sf_dir):
    """Orders as passes whose footprints are slanted boxes around a place of their own."""
    x, y = (F.col("o_custkey") * 7 % 360 - 180).cast("double"), (F.col("o_orderkey") * 11 % 140 - 70).cast("double")
    ring = F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((-30, -20), (30, -10), (30, 20), (-30, 10))))
    return t(spark, sf_dir, "orders").withColumn("footprint", ring).withColumn("start", F.date_format("o_orderdate", "yyyy-MM-dd"))


# The slanted box in SQL: two bounds on either axis, no edges.
OVER = f"abs({LON} - (o_custkey * 7 % 360 - 180)) < 30 AND abs(({LAT} - (o_orderkey * 11 % 140 - 70)) - ({LON} - (o_custkey * 7 % 360 - 180)) / 6) < 15"


@query(f"""SELECT o_orderkey, o_orderdate::DATE AS date FROM orders WHERE o_custkey % 3 = 1 AND o_orderkey % 5 <> 0
  AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '2001-01-01' AND {OVER} ORDER BY o_orderdate, o_orderkey LIMIT 2000""")
def burst_search(spark, sf_dir):
    name = F.concat(F.lit("S1_"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, "_VH_").otherwise("_VV_"))
    b = footprints(spark, sf_dir).withColumn("scene", name).withColumn("path", F.col("o_custkey") % 3).withColumn("seq", F.col("o_orderkey"))
    return readers.burst_search(b, LON, LAT, 1, "1996-01-01", "2001-01-01").select("o_orderkey", "date")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '?' ELSE o_orderstatus END || ' track ' || CASE WHEN o_custkey % 5 = 0 THEN '?' ELSE (o_custkey % 5)::VARCHAR END AS track
FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND {OVER} ORDER BY o_orderkey LIMIT 400""")
def archive_passes(spark, sf_dir):
    p = footprints(spark, sf_dir).withColumn("seq", F.col("o_orderkey"))
    p = p.withColumn("direction", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus"))).withColumn("path", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 5))
    return readers.archive_passes(p, LON, LAT, "1997-01-01").select("o_orderkey", "track")


@query("""SELECT event_type AS orbit, ts::DATE AS date, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS items FROM events
WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND user_id * 2 - 150 BETWEEN -5 AND 45 AND event_id % 60 - 30 BETWEEN -5 AND 25 GROUP BY 1, 2""")
def arrival_groups(spark, sf_dir):
    lon, lat = F.col("user_id") * 2 - 150, F.col("event_id") % 60 - 30
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("orbit"), F.to_date("ts").alias("date"), "event_id", (lon - 5).alias("west"), (lat - 5).alias("south"), (lon + 5).alias("east"), (lat + 5).alias("north"))
    found = readers.items_over(e, (0, 0, 40, 20), "2024-01-05", "2024-01-20")
    out = readers.grouped_on_arrival(found, ["orbit", "date"], "event_id", "event_id")
    return out.select("orbit", "date", F.size("items").cast("long").alias("n"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("""SELECT o_custkey, o_orderdate::DATE AS latest, o_orderkey, coalesce(cloud, 0) AS cloud FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n
  FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 5000 END AS cloud FROM orders) WHERE coalesce(cloud, 0) < 60) WHERE n = 1""")
def latest_scene(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("cloud", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 5000))
    return readers.latest_scene(o, "o_custkey", "o_orderdate", "o_orderkey", "o_orderkey", "cloud")


PRODUCTS = """prod AS (SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS ref, (date_trunc('month', o_orderdate) + to_months((1 + o_orderkey % 3)::INT))::DATE AS sec, 
  '/p/S1_' || o_orderkey || '_' || strftime(date_trunc('month', o_orderdate), '%Y%m%d') || '_' || strftime(date_trunc('month', o_orderdate) + to_months((1 + o_orderkey % 3)::INT), '%Y%m%d') AS folder FROM orders)"""


def product_files(spark, sf_dir):
    """Three files a product; some products lack one, some have another shape."""
    ref = F.to_date(F.date_trunc("month", "o_orderdate"))
    sec = F.add_months(ref, (1 + F.col("o_orderkey") % 3).cast("int"))
    day = lambda c: F.date_format(c, "yyyyMMdd")
    folder = F.concat(F.lit("/p/S1_"), F.col("o_orderkey"), F.lit("_"), day(ref), F.lit("_"), day(sec))
    key = F.col("o_orderkey")
    odd = F.when(key % 6 == 1, 101).otherwise(100)
    file = lambda kind, there, height: F.struct(F.lit(kind).alias("kind"), there.alias("there"), height.alias("height"))
    kinds = F.array(file("unw_phase", F.lit(True), odd), file("corr", key % 7 != 3, odd), file("conncomp", key % 3 == 0, F.when(key % 4 == 0, 99).otherwise(odd)))
    f = t(spark, sf_dir, "orders").select("o_orderkey", folder.alias("folder"), F.explode(kinds).alias("k")).filter("k.there")
    return f.select("o_orderkey", F.concat("folder", F.lit("/x_"), F.col("k.kind"), F.lit(".tif")).alias("path"), F.col("k.height").alias("height"), F.lit(200).alias("width"))


@query(f"""WITH {EPOCHS}, {PRODUCTS}, used AS (SELECT p.*, a.epoch::INT AS ref_epoch, b.epoch::INT AS sec_epoch, CASE WHEN o_orderkey % 6 = 1 THEN 101 ELSE 100 END AS height
  FROM prod p JOIN epochs a ON a.date = p.ref JOIN epochs b ON b.date = p.sec WHERE o_orderkey % 7 <> 3),
f AS (SELECT height AS h FROM used ORDER BY folder LIMIT 1)
SELECT folder, ref, sec, ref_epoch, sec_epoch, o_orderkey % 3 = 0 AND CASE WHEN o_orderkey % 4 = 0 THEN 99 ELSE height END = h AS has_conn FROM used, f WHERE height = h""")
def product_layers(spark, sf_dir):
    sets = readers.layer_sets(product_files(spark, sf_dir).drop("o_orderkey"))
    out = readers.same_shape(select.products_in_network(sets, order_epochs(spark, sf_dir)))
    return out.select("folder", "ref", "sec", "ref_epoch", "sec_epoch", F.col("conn").isNotNull().alias("has_conn"))


@query(f"""WITH {EPOCHS}, {PRODUCTS} SELECT p.ref, p.sec, min(folder || '/x_corr.tif') AS path FROM pairs p JOIN prod USING (ref, sec) WHERE o_orderkey % 7 <> 3 GROUP BY 1, 2""")
def product_for_pair(spark, sf_dir):
    files = product_files(spark, sf_dir).filter(F.endswith("path", F.lit("_corr.tif")))
    return readers.product_for_pair(files.select("path"), select.pair_network(order_epochs(spark, sf_dir)).select("ref", "sec"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS channel, l_suppkey AS site, l_shipdate::DATE AS ts, {c} AS v FROM lineitem WHERE {c} <> 0.05" for c in ("l_quantity", "l_discount", "l_tax")))
def channel_table(spark, sf_dir):
    names = ["l_quantity", "l_discount", "l_tax"]
    wide = t(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), *(F.when(F.col(c) != 0.05, F.col(c)).alias(c) for c in names))
    return readers.channel_table(wide, "l_suppkey", "day", names)


@query("""WITH c AS (SELECT c_custkey, c_name || ' & ' || c_mktsegment || ' (it''s 100% "ok"!) ~*é<b>' AS s, c_acctbal / 70 AS lon, c_nationkey / 7 AS lat FROM customer)
SELECT c_custkey, printf('%.4f', lon) AS lon4, replace(replace(replace(replace(replace(url_encode(s), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS encoded,
  replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, 'POINT(' || printf('%.4f', lon) || '%20' || printf('%.4f', lat) || ')' AS point FROM c""")
def request_text(spark, sf_dir):
    s = F.concat("c_name", F.lit(" & "), "c_mktsegment", F.lit(" (it's 100% \"ok\"!) ~*é<b>"))
    lon, lat = F.col("c_acctbal") / 70, F.col("c_nationkey") / 7
    return t(spark, sf_dir, "customer").select("c_custkey", scalars.fixed4(lon).alias("lon4"), scalars.uri_component(s).alias("encoded"), scalars.html_escape(s).alias("escaped"), scalars.point_query(lon, lat).alias("point"))


@query("""SELECT event_id, user_id::DOUBLE AS lon, value AS lat FROM events WHERE event_id % 3 <> 0 AND user_id % 2 = 0 ORDER BY event_id LIMIT 6""")
def place_hits(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("lon", F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("double"))).withColumn("lat", F.when(F.col("user_id") % 2 == 0, F.col("value")))
    return readers.place_hits(e.withColumn("seq", F.col("event_id"))).select("event_id", "lon", "lat")


@query("""SELECT event_id, 'g' || event_id AS green, CASE WHEN event_id % 3 = 0 THEN 'n' ELSE 'b' END || event_id AS nir FROM events WHERE event_id % 4 <> 0 AND event_id % 5 <> 0""")
def asset_scenes(spark, sf_dir):
    key = F.col("event_id")
    item = lambda name, mark: F.struct(name.alias("key"), F.struct(F.concat(F.lit(mark), key).alias("href")).alias("value"))
    green = F.when(key % 4 != 0, item(F.when(key % 2 == 0, "green").otherwise("X_B03"), "g"))
    nir = F.when(key % 5 != 0, F.when(key % 3 == 0, item(F.lit("nir"), "n")).otherwise(item(F.lit("B08"), "b")))
    pairs = F.filter(F.array(green, nir, item(F.lit("thumbnail"), "t")), lambda x: x.isNotNull())
    s = t(spark, sf_dir, "events").select("event_id", F.map_from_entries(pairs).alias("assets"))
    return readers.band_hrefs(s, {"green": ("b03",), "nir": ("b08", "nir08")}).select("event_id", "green", "nir")


CHANGE = ChangeConfig(seed_db=-1.0, grow_db=-0.25, min_pixels=2)
CHANGES = """px AS (SELECT event_type AS grp, user_id % 8 AS "row", hour(ts) // 2 AS col, ts::DATE AS d, round(sum(value), 4) AS vh, count(*) AS vv FROM events GROUP BY ALL),
grps AS (SELECT grp, row_number() OVER (ORDER BY grp) AS nth FROM (SELECT DISTINCT grp FROM px)),
f AS (SELECT grp, min(d) AS first FROM px WHERE d >= DATE '2024-01-15' GROUP BY 1),
db AS (SELECT px.*, 10 * log10(vh) AS h, 10 * log10(vv) AS v, d < DATE '2024-01-15' AS before, d = first AS at_first FROM px JOIN f USING (grp)),
c AS (SELECT grp, "row", col, ("row" * 5 + col * 3) % 30 AS slope, quantile_cont(h, 0.5) FILTER (before) AS h0, quantile_cont(v, 0.5) FILTER (before) AS v0,
  quantile_cont(h, 0.5) FILTER (NOT before) AS h1, quantile_cont(v, 0.5) FILTER (NOT before) AS v1, max(h) FILTER (at_first) AS h2, max(v) FILTER (at_first) AS v2 FROM db GROUP BY 1, 2, 3),
inside AS (SELECT kind, grp, "row", col, slope, vh, vv, (kind = 'rapid')::BIGINT * 10000000 + nth * 50000 + "row" * 1000 + col AS id FROM (
  SELECT 'confirmed' AS kind, *, h1 - h0 AS vh, v1 - v0 AS vv FROM c UNION ALL SELECT 'rapid', *, h2 - h0, v2 - v0 FROM c) JOIN grps USING (grp) WHERE slope >= 15 AND vh <= -0.25),
near AS (SELECT a.id, b.id AS other FROM inside a JOIN inside b ON a.kind = b.kind AND a.grp = b.grp AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1),
reach(id, root) AS (SELECT id, id FROM inside UNION SELECT n.other, r.root FROM reach r JOIN near n ON n.id = r.id),
label AS (SELECT id, min(root) AS root FROM reach GROUP BY 1),
found AS (SELECT kind, grp AS "group", (root % 50000 // 1000)::INT AS top_row, (root % 1000)::INT AS top_col, count(*) AS size, round(min(vh), 5) AS peak, round(avg(vh), 5) AS mean, round(avg(vv), 5) AS mean_vv,
  round(avg(slope), 5) AS mean_slope, round(-min(vh) * ln(1 + count(*)), 2) AS score FROM label JOIN inside USING (id) GROUP BY kind, grp, root HAVING count(*) >= 2 AND min(vh) <= -1)"""


def changes(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("group"), F.to_date("ts").alias("seq"), (F.col("user_id") % 8).alias("row"), F.floor(F.hour("ts") / 2).cast("int").alias("col"), "value")
    p = e.groupBy("group", "seq", "row", "col").agg(F.round(F.sum("value"), 4).alias("vh"), F.count(F.lit(1)).alias("vv")).withColumn("is_post", F.col("seq") >= F.lit("2024-01-15").cast("date"))
    g = grid.GridSpec(0.0, 0.0, 1.0, 8, 12).cells(spark).withColumn("slope_deg", (F.col("row") * 5 + F.col("col") * 3) % 30)
    out = change.persistent_change(p, g, tuple(r[0] for r in e.select("group").distinct().orderBy("group").collect()), CHANGE)
    return out.withColumn("top_row", F.shiftright("label", 32).cast("int")).withColumn("top_col", F.expr("cast(label & 4294967295 as int)"))


@query(f"WITH RECURSIVE {CHANGES} SELECT * FROM found")
def persistent_change(spark, sf_dir):
    five = [F.round(c, 5).alias(n) for c, n in (("peak", "peak"), ("mean", "mean"), ("mean_vv", "mean_vv"), ("mean_slope", "mean_slope"))]
    return changes(spark, sf_dir).select("kind", "group", "top_row", "top_col", "size", *five, "score")


@query(f"""WITH RECURSIVE {CHANGES} SELECT kind, "group", count(*) AS n, count(*) FILTER (top_row <= 3) AS n_within FROM found GROUP BY 1, 2""")
def candidate_totals(spark, sf_dir):
    return change.candidate_totals(changes(spark, sf_dir), ["kind", "group"], F.col("top_row") <= 3)


@query(f"""WITH RECURSIVE {CHANGES}, k AS (SELECT * FROM found WHERE kind = 'confirmed')
SELECT "group", top_row, top_col, score, CASE WHEN top_row <= 3 THEN row_number() OVER (PARTITION BY "group", top_row <= 3 ORDER BY score DESC, top_row, top_col) END AS nth FROM k""")
def territory_ranks(spark, sf_dir):
    c = changes(spark, sf_dir).filter("kind = 'confirmed'")
    return change.ranked(c, F.col("top_row") <= 3, ["group"]).select("group", "top_row", "top_col", "score", F.col("rank").cast("long").alias("nth"))


@query(f"""WITH RECURSIVE {CHANGES} SELECT "group", top_row, top_col, greatest(25.0::DOUBLE, size * 100.0::DOUBLE / 80) AS ring, CASE WHEN top_row <= 3 THEN '#ff3b30' ELSE '#8e8e93' END AS colour
FROM found WHERE kind = 'confirmed' ORDER BY score DESC, top_row, top_col, "group" LIMIT 100""")
def map_rings(spark, sf_dir):
    c = changes(spark, sf_dir).filter("kind = 'confirmed'")
    return grid.map_rings(c, F.col("top_row") <= 3, ties=["label", "group"]).select("group", "top_row", "top_col", "ring", "colour")


# Shade by surface normals: no angles of slope or aspect. At 315 and 45 degrees the light comes from (-1, 1) / 2 and sqrt(1/2) above.
@query(f"""WITH {GRID}, n AS (SELECT g.*, u.v AS up, d.v AS down, l.v AS lft, r.v AS rgt FROM grid g
  LEFT JOIN grid u ON u."row" = g."row" - 1 AND u.col = g.col LEFT JOIN grid d ON d."row" = g."row" + 1 AND d.col = g.col
  LEFT JOIN grid l ON l."row" = g."row" AND l.col = g.col - 1 LEFT JOIN grid r ON r."row" = g."row" AND r.col = g.col + 1),
g2 AS (SELECT "row", col, v, coalesce((down - up) / 2, down - v, v - up) AS dr, coalesce((rgt - lft) / 2, rgt - v, v - lft) AS dc FROM n)
SELECT "row", col, round(CASE WHEN dr IS NOT NULL AND dc IS NOT NULL THEN greatest(0, (sqrt(0.5) + 1.5 * 0.5 * (dr + dc)) / sqrt(1 + 2.25 * (dr * dr + dc * dc))) END, 6) + 0.0 AS shade, v <= 60 AS sea FROM g2""")
def map_shade(spark, sf_dir):
    g = change.gradient(hour_grid(spark, sf_dir), "v").withColumn("v", F.col("v") - 60)
    return grid.map_table(g, "v").select("row", "col", (F.round("shade", 6) + F.lit(0.0)).alias("shade"), "sea")


def _between(rows: int, cols: int, fr: str, fc: str, cell: str) -> str:
    """SQL for values between four pixels: fr and fc are the places of a target cell in rows and columns of the grid."""
    return f"""tgt AS (SELECT r AS "row", c AS col, {fr} AS fr, {fc} AS fc FROM range({rows}) a(r), range({cols}) b(c)),
four AS (SELECT t."row", t.col, i, j, floor(fr)::BIGINT + i AS gr, floor(fc)::BIGINT + j AS gc, abs(1 - i - (fr - floor(fr))) * abs(1 - j - (fc - floor(fc))) AS w FROM tgt t, range(2) p(i), range(2) q(j)),
val AS (SELECT f."row"::INT AS "row", f.col::INT AS col, CASE WHEN count({cell}) = count(*) THEN round(sum(w * {cell}), 6) END AS v FROM four f LEFT JOIN grid g ON g."row" = gr AND g.col = gc WHERE w > 0 GROUP BY 1, 2)"""


@query(f"""WITH {GRID}, {_between(9, 7, '(r + 0.5::DOUBLE) * 30 / 9 - 0.5', '(c + 0.5::DOUBLE) * 24 / 7 - 0.5', 'g.v')}, hit AS (SELECT t."row"::INT AS "row", t.col::INT AS col, g.v AS nearest FROM tgt t LEFT JOIN grid g ON g."row" = floor(fr + 0.5) AND g.col = floor(fc + 0.5))
SELECT * FROM val JOIN hit USING ("row", col)""")
def resampled_read(spark, sf_dir):
    g = hour_grid(spark, sf_dir)
    near = grid.read_resampled(g, (30, 24), (9, 7), "v", "nearest").withColumnRenamed("v", "nearest")
    return grid.read_resampled(g, (30, 24), (9, 7), "v").join(near, ["row", "col"]).select("row", "col", F.round("v", 6).alias("v"), "nearest")


@query(f"""WITH {GRID}, {_between(12, 9, '1.3::DOUBLE + (r + 0.5) * 2 - 0.5', '0.7::DOUBLE + (c + 0.5) * 2 - 0.5', 'CASE WHEN floor(g.v) % 7 <> 0 THEN g.v END')} SELECT * FROM val""")
def warped_read(spark, sf_dir):
    g = hour_grid(spark, sf_dir).withColumn("v", F.when(F.floor("v") % 7 != 0, F.col("v")).otherwise(0.0))
    src, dst = grid.GridSpec(0.0, 0.0, 1.0, 30, 24), grid.GridSpec(0.7, -1.3, 2.0, 12, 9)
    return grid.warped(g, src, dst, "v").select("row", "col", F.round("v", 6).alias("v"))


@query(f"""WITH {GRID} SELECT "row", col, round(v::FLOAT::DOUBLE, 3) AS v FROM grid WHERE 10 + (col + 0.5) * 0.5 BETWEEN 12 AND 20.1 AND 50 - ("row" + 0.5) * 0.5 BETWEEN 39.9 AND 47""")
def raster_box(spark, sf_dir):
    spec = grid.GridSpec(10.0, 50.0, 0.5, 30, 24)
    full = grid.GridSpec(0.0, 0.0, 1.0, 32, 24).cells(spark).join(hour_grid(spark, sf_dir), ["row", "col"], "left")
    tile = lambda c: F.floor(F.col(c) / 8).cast("int").alias(f"tile_{c}")
    cell = F.struct((F.col("row") % 8 * 8 + F.col("col") % 8).alias("i"), F.col("v").cast("float").alias("v"))
    tiles = full.groupBy(F.lit("a").alias("raster_id"), tile("row"), tile("col")).agg(F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["v"]).alias("data"))
    out = readers.raster_in_box(tiles, spec, (12, 39.9, 20.1, 47), 8).filter("v IS NOT NULL")
    return out.select("row", "col", F.round(F.col("v").cast("double"), 3).alias("v"))


@query("""SELECT user_id, date, click, view, round(CASE WHEN click + view > 0 THEN (click - view) / greatest(click + view, 1e-6) ELSE CASE WHEN click IS NULL OR view IS NULL THEN -1 END END, 6) AS nd FROM (
  SELECT user_id, ts::DATE AS date, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)""")
def aligned_bands(spark, sf_dir):
    out = grid.aligned(t(spark, sf_dir, "events").withColumn("date", F.to_date("ts")), ["user_id", "date"], "event_type", "value", ["click", "view"])
    return out.withColumn("nd", F.round(scalars.normalized_difference(F.col("click"), F.col("view")), 6))


@query("""SELECT event_type, ts::DATE AS day, round(avg(CASE WHEN value > 20 THEN 1 ELSE 0 END), 9) AS valid_frac FROM events GROUP BY 1, 2""")
def layer_valid_fraction(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), F.when(F.col("value") > 20, F.col("value")).alias("v"))
    return grid.valid_fraction(e, ["event_type", "day"], "v").withColumn("valid_frac", F.round("valid_frac", 9))


FLUX = """d AS (SELECT o_orderdate::DATE AS day, round(sum(o_totalprice) / 1000, 6) AS v, count(*)::DOUBLE AS flux FROM orders GROUP BY 1),
s AS (SELECT *, avg(flux) OVER (ORDER BY day RANGE BETWEEN INTERVAL 40 DAYS PRECEDING AND INTERVAL 40 DAYS FOLLOWING) AS flux81 FROM d)"""


def flux_days(spark, sf_dir):
    d = t(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice") / 1000, 6).alias("v"), F.count(F.lit(1)).cast("double").alias("flux"))
    return d.withColumn("flux81", detectors.centred_mean(d, [], F.unix_date("day"), "flux")).withColumn("at", F.col("day").cast("timestamp"))


@query(f"""WITH {FLUX}, {gram_schmidt("s", ["1.0", "flux", "flux81"], "v", "day")},
q AS (SELECT day, y, quantile_cont(y, [0.25, 0.5, 0.75]) OVER w AS q, count(y) OVER w AS n_prior FROM g3 WINDOW w AS (PARTITION BY year(day) ORDER BY day RANGE BETWEEN INTERVAL 15 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT day, n_prior, y < q[2] - 1.5 * (q[2] - q[1]) OR y > q[2] + 1.5 * (q[3] - q[2]) AS exceeds FROM q""")
def detrended_exceedance(spark, sf_dir):
    d = flux_days(spark, sf_dir).withColumn("season", F.year("day"))
    return detectors.detrended_exceedance(d, ["season"], "at", ["flux", "flux81"], "v", TrailingConfig()).select("day", "n_prior", "exceeds")


@query(f"""WITH {FLUX}, {gram_schmidt("s", ["1.0", "flux", "flux81"], "v", "v")} SELECT round(1 - sum(y * y) / (var_pop(v) * count(*)), 6) AS r2, count(*) AS n FROM g3""")
def variance_explained(spark, sf_dir):
    return detectors.variance_explained(flux_days(spark, sf_dir), ["flux", "flux81"], "v").withColumn("r2", F.round("r2", 6))


@query("""WITH s AS (SELECT user_id, event_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS med FROM events)
SELECT event_id, CASE WHEN value <= 5 * abs(med) THEN value END AS value FROM s""")
def despiked(spark, sf_dir):
    return detectors.despiked(t(spark, sf_dir, "events"), ["user_id"], "event_id", "value").select("event_id", "value")


@query(f"""WITH {GRID} SELECT count(*) AS n, round(avg(v), 6) AS mean FROM grid WHERE "row" BETWEEN 10 AND 18 AND col BETWEEN 7 AND 15""")
def central_band(spark, sf_dir):
    g = hour_grid(spark, sf_dir).filter(zonal.central_band(F.col("row"), F.col("col"), 30, 24))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN 'old' ELSE 'new' END AS batch FROM orders""")
def manifest_merge(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    old, new = o.filter("job_id % 4 = 0").withColumn("batch", F.lit("old")), o.withColumn("batch", F.lit("new"))
    return sinks.merged_manifest(old, new, ["job_id"])


@query("""SELECT c_custkey, round(lon - d, 6) AS w, round(lat - 0.045::DOUBLE, 6) AS s, round(lon + d, 6) AS e, round(lat + 0.045::DOUBLE, 6) AS n FROM (
  SELECT *, 0.045 / greatest(0.2, cos(radians(lat))) AS d FROM (SELECT c_custkey, c_acctbal / 100 AS lon, c_nationkey * 3.6::DOUBLE - 45 AS lat FROM customer))""")
def order_boxes(spark, sf_dir):
    box = scalars.order_box(F.col("c_nationkey") * 3.6 - 45, F.col("c_acctbal") / 100)
    return t(spark, sf_dir, "customer").select("c_custkey", box.alias("b")).select("c_custkey", *(F.round(f"b.{k}", 6).alias(k) for k in "wsen"))


@query(f"SELECT findings, CASE WHEN findings > 0 THEN 1 ELSE 0 END AS status FROM ({LINT_COUNT})")
def lint_status(spark, sf_dir):
    return textlint.exit_status(textlint.findings(textlint.outside_style(page_lines(spark, sf_dir, True))))
