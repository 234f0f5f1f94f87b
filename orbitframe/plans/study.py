"""Queries over many places at once: catalogue pages, precursor studies, spatial joins, whole-column quantiles, fits per site."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.config import HarmonicConfig, InversionConfig, PrecursorConfig, TrailingConfig
from orbitframe.functions import scalars
from orbitframe.operators import coherence, coverage, detectors, grid, harmonic, sbas, select, spatial, windows
from orbitframe.operators.quantiles import quantiles
from orbitframe.plans.archive import PRODUCTS, product_files
from orbitframe.plans.catalogue import EPOCHS, FISHER, GRID, HARMONIC_X, gram_schmidt, hour_grid, order_epochs, query, t
from orbitframe.sources import pages, readers
from orbitframe.storage import scratch, written


def order_scenes(spark, sf_dir):
    x, y = (F.col("o_custkey") * 7 % 360 - 180).cast("double"), (F.col("o_orderkey") * 11 % 140 - 70).cast("double")
    return t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("scene_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 5000).alias("cloud"),
        F.col("o_orderpriority").alias("tile"), (x - 5).alias("west"), (y - 5).alias("south"), (x + 5).alias("east"), (y + 5).alias("north"),
    )


@query("""SELECT o_orderkey::VARCHAR AS scene_id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice / 5000 AS cloud, o_orderpriority AS tile FROM orders
WHERE o_orderkey % 9 <> 0 AND o_totalprice / 5000 < 60 AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-01-01'
  AND o_custkey * 7 % 360 - 180 BETWEEN -65 AND 105 AND o_orderkey * 11 % 140 - 70 BETWEEN -45 AND 55""")
def catalogue_pages(spark, sf_dir):
    """All orders as pages of JSON features; the search opens the pages whose time, box, cloud and tile may fit."""
    pages.register(spark)
    at = scratch(spark, "pages")
    order_scenes(spark, sf_dir).repartitionByRange("ts").sortWithinPartitions("ts").write.format("catalogue_pages").option("page_size", 250).mode("append").save(at)
    found = readers.scenes(spark.read.format("catalogue_pages").load(at), 60.0, None, None, "1996-01-01", "1999-01-01", (-60, -40, 100, 50))
    return found.filter(F.col("tile").isin("1-URGENT", "5-LOW")).select("scene_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "cloud", "tile")


SITES = """nodes AS (SELECT (l_suppkey % 6) * 60 - 180 AS lon, (l_partkey % 2) * 60 AS lat, l_shipdate::DATE AS day, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1, 2, 3),
ev AS (SELECT n_nationkey AS event, DATE '1996-06-01' + n_nationkey * 40 AS date, n_nationkey * 14.4::DOUBLE - 176.7 AS lon, n_nationkey * 7 % 11 * 5.0::DOUBLE + 2.5 AS lat FROM nation),
sites AS (SELECT event, 'event' AS kind, 0 AS shift, lon, lat, date AS origin FROM ev
  UNION ALL SELECT event, 'twin', 0, lon, lat, (date - INTERVAL 12 MONTHS)::DATE FROM ev
  UNION ALL SELECT event, 'placebo', shift, ((lon + shift + 180) % 360 + 360) % 360 - 180, lat, date FROM ev, unnest([15, -15, 25, -25, 35, -35, 45, -45, 55, -55, 65, -65, 75, -75]) u(shift)),
near AS (SELECT s.*, floor(lon / 60) AS x, floor(lat / 60) AS y, lon / 60 - floor(lon / 60) AS fx, lat / 60 - floor(lat / 60) AS fy, dx, dy FROM sites s, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)),
corner AS (SELECT event, kind, shift, origin, (((x + dx) * 60 + 180) % 360 + 360) % 360 - 180 AS lon, (y + dy) * 60 AS lat, (CASE dx WHEN 1 THEN fx ELSE 1 - fx END) * (CASE dy WHEN 1 THEN fy ELSE 1 - fy END) AS w FROM near),
daily AS (SELECT event, kind, shift, origin, day, sum(w * v) / sum(w) AS v FROM corner c JOIN nodes n ON n.lon = c.lon AND n.lat = c.lat AND day >= origin - 45 AND day < origin WHERE w > 0 GROUP BY 1, 2, 3, 4, 5),
bounds AS (SELECT *, quantile_cont(v, [0.25, 0.5, 0.75]) OVER (PARTITION BY event, kind, shift, origin ORDER BY day RANGE BETWEEN INTERVAL 15 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS q FROM daily),
counts AS (SELECT s.event, s.kind, s.shift, count(b.day) AS days, count(b.day) FILTER (b.v < q[2] - 1.5 * (q[2] - q[1]) OR b.v > q[2] + 1.5 * (q[3] - q[2])) AS flagged
  FROM sites s LEFT JOIN bounds b ON b.event = s.event AND b.kind = s.kind AND b.shift = s.shift AND b.day >= b.origin - 30 GROUP BY 1, 2, 3)"""


def study_inputs(spark, sf_dir):
    """Nations as events, each on a day and at a place of its own; shipments as a grid of daily means at twelve nodes."""
    nodes = t(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 6 * 60 - 180).alias("lon"), (F.col("l_partkey") % 2 * 60).alias("lat"), F.to_date("l_shipdate").alias("day")).agg(F.round(F.avg("l_extendedprice"), 4).alias("v"))
    key = F.col("n_nationkey")
    events = t(spark, sf_dir, "nation").select(key.alias("event"), F.date_add(F.lit("1996-06-01").cast("date"), key * 40).alias("date"), (key * 14.4 - 176.7).alias("lon"), (key * 7 % 11 * 5.0 + 2.5).alias("lat"))
    return events, nodes


@query(f"""WITH {SITES},
o AS (SELECT event, max(flagged) FILTER (kind = 'event') AS flagged, max(days) FILTER (kind = 'event') AS days, max(flagged) FILTER (kind = 'twin') AS twin_flagged, max(days) FILTER (kind = 'twin') AS twin_days FROM counts GROUP BY 1),
n AS (SELECT event, avg(flagged) AS m, stddev_samp(flagged) / sqrt(count(*)) AS se FROM counts WHERE kind = 'placebo' GROUP BY 1),
b AS (SELECT c.event, count(*) FILTER (c.flagged < o.flagged) / count(*) AS share_below FROM counts c JOIN o USING (event) WHERE kind = 'placebo' GROUP BY 1),
tw AS (SELECT event, flagged AS a, days - flagged AS b, twin_flagged AS c, twin_days - twin_flagged AS d FROM o), {FISHER}
SELECT event, flagged, days, twin_flagged, twin_days, round(p.p, 6) AS p, round(share_below, 6) AS share_below, CASE WHEN se > 0 THEN round((flagged - m) / se, 4) END AS offset_se
FROM o JOIN n USING (event) JOIN b USING (event) JOIN (SELECT event, p FROM p) p USING (event)""")
def precursor_study(spark, sf_dir):
    events, nodes = study_inputs(spark, sf_dir)
    out = windows.precursor_study(events, nodes, 60.0, "v", PrecursorConfig())
    return out.select("event", "flagged", "days", "twin_flagged", "twin_days", F.round("p", 6).alias("p"), F.round("share_below", 6).alias("share_below"), F.round("offset_se", 4).alias("offset_se"))


@query(f"WITH {SITES} SELECT event, kind, shift, days, flagged FROM counts")
def anomalous_days(spark, sf_dir):
    events, nodes = study_inputs(spark, sf_dir)
    return windows.anomalous_days(windows.study_sites(events), nodes, 60.0, "v").select("event", "kind", "shift", "days", "flagged")


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 13 % 3600) / 10.0::DOUBLE - 180 + 0.037 AS lon, (c_custkey * 7 % 1400) / 10.0::DOUBLE - 70 + 0.0113 AS lat FROM customer),
f AS (SELECT o_orderkey, (o_custkey * 7 % 360 - 180)::DOUBLE AS x, (o_orderkey * 11 % 140 - 70)::DOUBLE AS y, [0.5, 3.0, 30.0][(o_orderkey % 3 + 1)::INT]::DOUBLE AS k FROM orders)
SELECT c_custkey, count(*) AS n, min(o_orderkey) AS first_key, sum(o_orderkey)::BIGINT AS key_sum FROM p JOIN f ON abs(lon - x) < k AND abs((lat - y) - (lon - x) / 6) < k / 2 GROUP BY 1""")
def places_in_footprints(spark, sf_dir):
    """Every customer as a place against every order as a slanted footprint, of three sizes; cells with many footprints are dealt over parts."""
    places = t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 13 % 3600 / 10.0 - 180 + 0.037).alias("lon"), (F.col("c_custkey") * 7 % 1400 / 10.0 - 70 + 0.0113).alias("lat"))
    k = F.element_at(F.array(F.lit(0.5), F.lit(3.0), F.lit(30.0)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    x, y = (F.col("o_custkey") * 7 % 360 - 180).cast("double"), (F.col("o_orderkey") * 11 % 140 - 70).cast("double")
    ring = F.array(*(F.struct((x + k * dx).alias("x"), (y + k * dy).alias("y")) for dx, dy in ((-1.0, -2 / 3), (1.0, -1 / 3), (1.0, 2 / 3), (-1.0, 1 / 3))))
    totals = spatial.footprint_totals(places, t(spark, sf_dir, "orders").select("o_orderkey", ring.alias("footprint")), "o_orderkey", part_rows=1000)
    return totals.groupBy("c_custkey").agg(F.sum("n").alias("n"), F.min("first_key").alias("first_key"), F.sum("key_sum").alias("key_sum"))


@query(f"""WITH {GRID}, b AS (SELECT n_nationkey, 9 + n_nationkey * 0.4::DOUBLE AS w, 12.31 + n_nationkey * 0.4::DOUBLE AS e, 46.1 - n_nationkey * 0.5::DOUBLE AS s, 50.21 - n_nationkey * 0.5::DOUBLE AS n FROM nation)
SELECT n_nationkey, "row", col, round(v::FLOAT::DOUBLE, 3) AS v FROM b JOIN grid ON 10 + (col + 0.5) * 0.5 BETWEEN w AND e AND 50 - ("row" + 0.5) * 0.5 BETWEEN s AND n""")
def boxed_pixels(spark, sf_dir):
    """The pixels of a tiled raster in many boxes."""
    spec = grid.GridSpec(10.0, 50.0, 0.5, 30, 24)
    full = grid.GridSpec(0.0, 0.0, 1.0, 32, 24).cells(spark).join(hour_grid(spark, sf_dir), ["row", "col"], "left")
    tile = lambda c: F.floor(F.col(c) / 8).cast("int").alias(f"tile_{c}")
    cell = F.struct((F.col("row") % 8 * 8 + F.col("col") % 8).alias("i"), F.col("v").cast("float").alias("v"))
    tiles = full.groupBy(F.lit("a").alias("raster_id"), tile("row"), tile("col")).agg(F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["v"]).alias("data"))
    k = F.col("n_nationkey")
    boxes = t(spark, sf_dir, "nation").select(k, (9 + k * 0.4).alias("west"), (46.1 - k * 0.5).alias("south"), (12.31 + k * 0.4).alias("east"), (50.21 - k * 0.5).alias("north"))
    out = spatial.raster_in_boxes(tiles, spec, boxes, ["n_nationkey"], 8).filter("v IS NOT NULL")
    return out.select("n_nationkey", "row", "col", F.round(F.col("v").cast("double"), 3).alias("v"))


SHARES = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


@query(" UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, round(quantile_cont(l_extendedprice, {s}), 6) AS price, round(quantile_cont(l_quantity, {s}), 6) AS quantity FROM lineitem" for s in SHARES))
def whole_quantiles(spark, sf_dir):
    """Quantiles of whole columns, one of many values and one of fifty, in passes that hold little."""
    l = t(spark, sf_dir, "lineitem")
    price, quantity = (quantiles(l, c, SHARES, held=900, accuracy=500) for c in ("l_extendedprice", "l_quantity"))
    out = spark.createDataFrame(list(zip(SHARES, price, quantity, strict=True)), "share double, price double, quantity double")
    return out.select("share", F.round("price", 6).alias("price"), F.round("quantity", 6).alias("quantity"))


SITE_MONTHS = """m AS (SELECT o_custkey % 40 AS site, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice) / 1e6, 3) AS value, dayofyear(date_trunc('month', o_orderdate)::DATE) AS doy FROM orders GROUP BY 1, 2),
enough AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY site) >= 12)"""


@query(f"""WITH {SITE_MONTHS}, {gram_schmidt("enough", HARMONIC_X, "value", "site, month, value", "site")},
d AS (SELECT *, quantile_cont(y, 0.5) OVER (PARTITION BY site) AS med FROM g9),
z AS (SELECT *, quantile_cont(abs(y - med), 0.5) OVER (PARTITION BY site) AS mad FROM d)
SELECT site, month, value, round(value - y, 4) AS expected, round(0.6745 * (y - med) / CASE WHEN mad = 0 THEN 1e-6 ELSE mad END, 2) + 0.0 AS z FROM z""")
def anomalies_by_site(spark, sf_dir):
    """Seasonal anomalies of forty series, each with a fit of its own, in one plan."""
    o = t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("site"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.round(F.sum("o_totalprice") / 1e6, 3).alias("value"))
    out = harmonic.seasonal_anomalies(o.withColumn("doy", F.dayofyear("month")), ["site"], "doy", "value", HarmonicConfig(min_rows=12))
    return out.select("site", "month", "value", F.round("expected", 4).alias("expected"), (F.round("z", 2) + F.lit(0.0)).alias("z"))


SITE_FLUX = """d AS (SELECT o_custkey % 7 AS site, o_orderdate::DATE AS day, round(sum(o_totalprice) / 1000, 6) AS v, count(*)::DOUBLE AS flux FROM orders GROUP BY 1, 2),
s AS (SELECT *, avg(flux) OVER (PARTITION BY site ORDER BY day RANGE BETWEEN INTERVAL 40 DAYS PRECEDING AND INTERVAL 40 DAYS FOLLOWING) AS flux81 FROM d)"""


def site_flux(spark, sf_dir):
    d = t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).alias("site"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice") / 1000, 6).alias("v"), F.count(F.lit(1)).cast("double").alias("flux"))
    return d.withColumn("flux81", detectors.centred_mean(d, ["site"], F.unix_date("day"), "flux")).withColumn("at", F.col("day").cast("timestamp"))


@query(f"""WITH {SITE_FLUX}, {gram_schmidt("s", ["1.0", "flux", "flux81"], "v", "site, v", "site")} SELECT site, round(1 - sum(y * y) / (var_pop(v) * count(*)), 6) AS r2, count(*) AS n FROM g3 GROUP BY site""")
def variance_explained_by_site(spark, sf_dir):
    return detectors.variance_explained(site_flux(spark, sf_dir), ["flux", "flux81"], "v", ["site"]).withColumn("r2", F.round("r2", 6))


@query(f"""WITH {SITE_FLUX}, {gram_schmidt("s", ["1.0", "flux", "flux81"], "v", "site, day", "site")},
q AS (SELECT site, day, y, quantile_cont(y, [0.25, 0.5, 0.75]) OVER w AS q, count(y) OVER w AS n_prior FROM g3 WINDOW w AS (PARTITION BY site ORDER BY day RANGE BETWEEN INTERVAL 15 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT site, day, n_prior, y < q[2] - 1.5 * (q[2] - q[1]) OR y > q[2] + 1.5 * (q[3] - q[2]) AS exceeds FROM q""")
def detrended_exceedance_by_site(spark, sf_dir):
    out = detectors.detrended_exceedance(site_flux(spark, sf_dir), ["site"], "at", ["flux", "flux81"], "v", TrailingConfig(), ["site"])
    return out.select("site", "day", "n_prior", "exceeds")


def _triangle(n: int, out: int, name: str) -> str:
    at, reach = f"((d + 0.5::DOUBLE) * {n / out!r} - 0.5)", max(1.0, n / out)
    return f"{name} AS (SELECT s, d, 1 - abs(s - {at}) / {reach!r} AS w FROM range({n}) a(s), range({out}) b(d) WHERE abs(s - {at}) < {reach!r})"


@query(f"""WITH {GRID}, {_triangle(30, 8, "wr")}, {_triangle(24, 7, "wc")}
SELECT wr.d::INT AS "row", wc.d::INT AS col, round(sum(wr.w * wc.w * v) FILTER (floor(v) % 7 <> 0) / sum(wr.w * wc.w) FILTER (floor(v) % 7 <> 0), 6) AS v FROM grid JOIN wr ON wr.s = "row" JOIN wc ON wc.s = col GROUP BY 1, 2""")
def widened_read(spark, sf_dir):
    """A grid with holes at 1 / 3.75 of its rows and 1 / 3.43 of its columns."""
    g = hour_grid(spark, sf_dir).withColumn("v", F.when(F.floor("v") % 7 != 0, F.col("v")))
    return grid.resampled(g, (30, 24), (8, 7), "v").select("row", "col", F.round("v", 6).alias("v"))


@query(f"""WITH {GRID}, tgt AS (SELECT r AS "row", c AS col, 1.3::DOUBLE + (r + 0.5) * 2 - 0.5 AS fr, 0.7::DOUBLE + (c + 0.5) * 2 - 0.5 AS fc FROM range(12) a(r), range(9) b(c)),
four AS (SELECT t."row", t.col, floor(fr)::BIGINT + i AS gr, floor(fc)::BIGINT + j AS gc, abs(1 - i - (fr - floor(fr))) * abs(1 - j - (fc - floor(fc))) AS w FROM tgt t, range(2) p(i), range(2) q(j))
SELECT f."row"::INT AS "row", f.col::INT AS col, round(sum(w * v) FILTER (floor(v) % 7 <> 0) / sum(w) FILTER (floor(v) % 7 <> 0), 6) AS v FROM four f LEFT JOIN grid g ON g."row" = gr AND g.col = gc WHERE w > 0 GROUP BY 1, 2""")
def warped_beside_nodata(spark, sf_dir):
    g = hour_grid(spark, sf_dir).withColumn("v", F.when(F.floor("v") % 7 != 0, F.col("v")).otherwise(0.0))
    src, dst = grid.GridSpec(0.0, 0.0, 1.0, 30, 24), grid.GridSpec(0.7, -1.3, 2.0, 12, 9)
    return grid.warped(g, src, dst, "v", renormalised=True).select("row", "col", F.round("v", 6).alias("v"))


# Pixels 1 and 4 lack some pairs, 2 is incoherent, 3 has a layer without coherence, 5 too few usable pairs, 6 unreliable components.
COHERENCE = {0: "0.9", 1: "CASE WHEN sec = ref + 1 AND ref % 2 = 1 THEN 0.2 ELSE 0.8 END", 2: "0.38", 3: "CASE WHEN ref <> 2 THEN 0.9 END", 4: "CASE WHEN sec = last THEN 0.1 ELSE 0.7 END", 5: "CASE WHEN sec = ref + 1 OR ref % 4 = 0 THEN 0.25 ELSE 0.9 END", 6: "0.85"}
CASES = "CASE pixel " + " ".join(f"WHEN {k} THEN {c}" for k, c in COHERENCE.items()) + " END"
UNRELIABLE = "pixel = 6 AND sec = ref + 2 AND ref % 3 = 0"


@query(f"""WITH m AS (SELECT o_custkey % 7 AS pixel, date_trunc('quarter', o_orderdate)::DATE AS date, round(avg(o_totalprice) / 1000, 6) AS v FROM orders GROUP BY 1, 2),
e AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS epoch FROM (SELECT DISTINCT date FROM m)), s AS (SELECT pixel, epoch, v FROM m JOIN e USING (date)),
pairs AS (SELECT a.epoch AS ref, b.epoch AS sec, (SELECT max(epoch) FROM e) AS last FROM e a JOIN e b ON b.epoch - a.epoch IN (1, 2)),
c AS (SELECT pixel, ref, sec, CASE WHEN {UNRELIABLE} THEN 0.0 ELSE ({CASES})::DOUBLE END AS coh FROM pairs, (SELECT DISTINCT pixel FROM s)),
kept AS (SELECT pixel FROM c GROUP BY 1 HAVING count(coh) = count(*) AND avg(coh) > 0.4 AND count(*) FILTER (coh > 0.3) >= (SELECT count(*) - 1 FROM e)),
seen AS (SELECT pixel, unnest([ref, sec]) AS epoch FROM c WHERE coh > 0.3), n AS (SELECT pixel, epoch, count(*)::INT AS n_obs FROM seen GROUP BY 1, 2)
SELECT s.pixel, s.epoch, CASE WHEN n_obs > 0 THEN round(v - first_value(v) OVER (PARTITION BY s.pixel ORDER BY s.epoch), 6) END AS disp, coalesce(n_obs, 0)::INT AS n_obs
FROM s JOIN kept USING (pixel) LEFT JOIN n ON n.pixel = s.pixel AND n.epoch = s.epoch""")
def sbas_with_gaps(spark, sf_dir):
    """An inversion that trips every gate: incoherent pairs and pixels, a missing layer, too few pairs, an orphan epoch, unreliable components."""
    quarter = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    m = t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).alias("pixel"), quarter.alias("date")).agg(F.round(F.avg("o_totalprice") / 1000, 6).alias("v"))
    e = select.epochs(m.select("date"))
    n = e.count()
    series = m.join(e, "date").select("pixel", "epoch", "v")
    a, b = (series.select("pixel", F.col("epoch").alias(f"{side}_epoch"), F.col("v").alias(f"v{side}")) for side in ("ref", "sec"))
    obs = select.pair_network(e).join(a, "ref_epoch").join(b, ["pixel", "sec_epoch"]).withColumns({"ref": F.col("ref_epoch"), "sec": F.col("sec_epoch"), "last": F.lit(n - 1)})
    obs = obs.withColumn("coh", F.expr(f"cast({CASES} as double)")).withColumn("component", F.expr(f"CASE WHEN {UNRELIABLE} THEN 0 WHEN pixel % 2 = 0 THEN 1 END"))
    obs = sbas.zero_unreliable(obs.withColumn("disp", F.col("vsec") - F.col("vref")), "coh", "component")
    out = sbas.invert(obs.select("pixel", "ref_epoch", "sec_epoch", "disp", "coh"), n, InversionConfig())
    return out.select("pixel", "epoch", (F.round("disp", 6) + F.lit(0.0)).alias("disp"), "n_obs")


@query("""WITH p AS (SELECT c_custkey, count(o_orderkey) AS n, max(CASE WHEN c_custkey % 3 = 0 THEN o_custkey END) AS context, max(CASE WHEN c_custkey % 5 <> 0 THEN 10 END) AS number FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, n, coalesce(context, number, n)::BIGINT AS matched, coalesce(context, number, n) = n AND n = 10 AS cut_off FROM p""")
def page_matches(spark, sf_dir):
    """How many items a search matched: what the page says in one of two places, else its length; and whether the page cuts them off."""
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    p = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.collect_list("o_orderkey").alias("features"), F.max(F.when(F.col("c_custkey") % 3 == 0, F.col("o_custkey"))).alias("context"))
    m, cut = coverage.matched(F.col("features"), F.col("context"), F.when(F.col("c_custkey") % 5 != 0, F.lit(10)), 10)
    return p.select("c_custkey", F.size("features").cast("long").alias("n"), m.cast("long").alias("matched"), cut.alias("cut_off"))


@query("""SELECT c_custkey, zone, round(lon, 7) + 0.0 AS lon, round(lat, 7) + 0.0 AS lat, CASE WHEN c_custkey % 50 = 0 THEN 500000::DOUBLE END AS easting FROM (
  SELECT c_custkey, (c_custkey % 60 + 1)::INT AS zone, (6 * (c_custkey % 60 + 1) - 183)::DOUBLE + CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE c_custkey % 7 - 3 END AS lon, c_nationkey * 6.1::DOUBLE - 73 AS lat FROM customer)""")
def projected_and_back(spark, sf_dir):
    """Places to map metres and back; on a zone's middle meridian the easting is known."""
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").select("c_custkey", (k % 60 + 1).cast("int").alias("zone"), (6 * (k % 60 + 1) - 183 + F.when(k % 50 == 0, 0).otherwise(k % 7 - 3)).cast("double").alias("lon"), (F.col("c_nationkey") * 6.1 - 73).alias("lat"))
    moved = c.withColumn("lon", F.col("lon") - (6 * F.col("zone") - 183) - 177)  # zone 1 has them all, after a turn
    x, y = scalars.utm_from_lonlat(F.col("lon"), F.col("lat"), 1)
    back = scalars.lonlat_from_utm(F.col("x"), F.col("y"), 1)
    out = moved.withColumn("x", x).withColumn("y", y).select("c_custkey", "zone", (back[0] + 177 + 6 * F.col("zone") - 183).alias("lon"), back[1].alias("lat"), "x")
    return out.select("c_custkey", "zone", *((F.round(n, 7) + F.lit(0.0)).alias(n) for n in ("lon", "lat")), F.when(F.col("c_custkey") % 50 == 0, F.round("x", 4)).alias("easting"))


@query(f"""WITH {GRID}, s AS (SELECT n_nationkey AS site, (n_nationkey * 7 % 30)::INT AS site_row, (n_nationkey * 5 % 24)::INT AS site_col FROM nation)
SELECT site, count(*) AS n, round(sum(v), 4) AS total, min("row")::INT AS first_row, max(col)::INT AS last_col FROM s JOIN grid ON "row" >= site_row - 4 AND "row" < site_row + 4 AND col >= site_col - 4 AND col < site_col + 4 GROUP BY 1""")
def site_windows(spark, sf_dir):
    """A window of eight by eight pixels around each site."""
    k = F.col("n_nationkey")
    sites = t(spark, sf_dir, "nation").select(k.alias("site"), (k * 7 % 30).cast("int").alias("site_row"), (k * 5 % 24).cast("int").alias("site_col"))
    out = grid.window_around(hour_grid(spark, sf_dir), sites, 4)
    return out.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"), F.min("row").cast("int").alias("first_row"), F.max("col").cast("int").alias("last_col"))


@query("""WITH e AS (SELECT l_suppkey % 50 AS site, date, row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY date) - 1 AS epoch
  FROM (SELECT DISTINCT l_suppkey, date_trunc('week', l_shipdate)::DATE AS date FROM lineitem WHERE l_shipdate IS NOT NULL) GROUP BY 1, 2)
SELECT a.site, a.date AS ref, a.epoch::INT AS ref_epoch, b.date AS sec, b.epoch::INT AS sec_epoch FROM e a JOIN e b ON b.site = a.site AND b.epoch BETWEEN a.epoch + 1 AND a.epoch + 3""")
def networks_by_site(spark, sf_dir):
    """Pair networks of fifty sites in one plan, each epoch with its next three."""
    days = t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("site"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))
    return select.pair_network(select.epochs(days, "date", ("site",)), 3, ("site",))


TARGET_BOX, CONTROL_BOX = (10.6, 47.4, 12.1, 49.3), (12.2, 46.1, 13.9, 49.9)


def _zone(box) -> str:
    w, s, e, n = box
    return f"10 + (col + 0.5) * 0.5 BETWEEN {w} AND {e} AND 50 - (row_ + 0.5) * 0.5 BETWEEN {s} AND {n}"


@query(f"""WITH {EPOCHS}, {PRODUCTS},
chosen AS (SELECT p.ref, p.sec, min(folder || '/x_corr.tif') AS path, arg_min(o_orderkey, folder || '/x_corr.tif') AS k FROM pairs p JOIN prod USING (ref, sec) WHERE o_orderkey % 7 <> 3 GROUP BY 1, 2),
px AS (SELECT l_orderkey AS k, l_linenumber - 1 AS row_, col, (min(l_partkey) * 7 + col * 37) % 100 / 100.0::DOUBLE AS v FROM lineitem, range(0, 8) r(col) WHERE l_linenumber <= 8 GROUP BY 1, 2, 3),
z AS (SELECT ref, sec, path, CASE WHEN {_zone(TARGET_BOX)} THEN v END AS a, CASE WHEN {_zone(CONTROL_BOX)} THEN v END AS b FROM chosen LEFT JOIN (SELECT * FROM px WHERE v > 0) px USING (k))
SELECT ref, sec, path, ref < DATE '1995-03-15' AND DATE '1995-03-15' < sec AS spans_event, count(a) AS n_target, count(b) AS n_control,
  round(avg(a), 6) AS target_mean, round(avg(b), 6) AS control_mean, round(avg(CASE WHEN a IS NULL THEN NULL WHEN a < 0.3 THEN 1.0 ELSE 0.0 END), 6) AS target_low FROM z GROUP BY 1, 2, 3""")
def coherence_loss(spark, sf_dir):
    """Every pair of the network with its product's coherence over a target and a control, from file names to figures.

    The product of each pair is found by name first, so tiles are made of the lines of those products alone.
    """
    files = product_files(spark, sf_dir).filter(F.endswith("path", F.lit("_corr.tif")))
    jobs = select.pair_network(order_epochs(spark, sf_dir))
    chosen = readers.product_for_pair(files.select("path"), jobs.select("ref", "sec").distinct()).select("path")
    chosen = written(files.select(F.col("o_orderkey").alias("l_orderkey"), F.col("path").alias("raster_id")).join(chosen.withColumnRenamed("path", "raster_id"), "raster_id"), scratch(spark, "chosen"))
    lines = t(spark, sf_dir, "lineitem").filter("l_linenumber <= 8").join(chosen, "l_orderkey", "left_semi").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    px = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("row"), "l_partkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("col"))
    tile = lambda c: F.floor(F.col(c) / 4).cast("int").alias(f"tile_{c}")
    at, v = (F.col("row") % 4 * 4 + F.col("col") % 4).cast("int"), (F.col("l_partkey") * 7 + F.col("col") * 37) % 100 / F.lit(100.0)
    cells = px.groupBy("l_orderkey", tile("row"), tile("col")).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("i"), v.cast("double").alias("v")))).alias("m"))  # 16 of them at most
    tiles = cells.select("l_orderkey", "tile_row", "tile_col", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.try_element_at("m", i)).alias("data"))
    tiles = tiles.join(chosen, "l_orderkey").drop("l_orderkey")
    out = coherence.coherence_loss(jobs, chosen.select(F.col("raster_id").alias("path")), tiles, grid.GridSpec(10.0, 50.0, 0.5, 8, 8), TARGET_BOX, CONTROL_BOX, F.lit("1995-03-15").cast("date"), size=4)
    return out.select("ref", "sec", "path", "spans_event", "n_target", "n_control", *(F.round(c, 6).alias(c) for c in ("target_mean", "control_mean", "target_low")))


def _utm_sql(source: str) -> str:
    """CTE ``m``: the columns of source(lon, lat, zone, ...) with map metres x and y, by the same series to the third order."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    radius, ecc = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * n**0.5 / (1 + n)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    sh, ch = (lambda x: f"((exp({x}) - exp(-({x}))) / 2)"), (lambda x: f"((exp({x}) + exp(-({x}))) / 2)")
    ath = lambda x: f"(ln((1 + {x}) / (1 - {x})) / 2)"
    east = " + ".join(f"{a!r}::DOUBLE * cos({2 * j} * xi) * {sh(f'{2 * j} * eta')}" for j, a in enumerate(alpha, 1))
    north = " + ".join(f"{a!r}::DOUBLE * sin({2 * j} * xi) * {ch(f'{2 * j} * eta')}" for j, a in enumerate(alpha, 1))
    return f"""m0 AS (SELECT *, sin(radians(lat)) AS s, radians(lon - (6 * zone - 183)) AS dl FROM {source}),
m1 AS (SELECT *, {ath("s")} - {ecc!r}::DOUBLE * {ath(f"({ecc!r}::DOUBLE * s)")} AS q FROM m0), m2 AS (SELECT *, {sh("q")} AS tt FROM m1),
m3 AS (SELECT *, atan2(tt, cos(dl)) AS xi, {ath("(sin(dl) / sqrt(1 + tt * tt))")} AS eta FROM m2),
m AS (SELECT *, 500000 + {radius!r}::DOUBLE * (eta + {east}) AS x, {radius!r}::DOUBLE * (xi + {north}) AS y FROM m3)"""


@query(f"""WITH b AS (SELECT c_custkey, (c_custkey % 60 + 1)::INT AS zone, (6 * (c_custkey % 60 + 1) - 183)::DOUBLE - 1.7 + c_custkey % 5 * 0.31::DOUBLE AS w, c_nationkey * 5.3::DOUBLE - 64 AS s FROM customer),
k AS (SELECT *, w + 0.43::DOUBLE AS e, s + 0.27::DOUBLE AS n FROM b), i AS (SELECT unnest(range(0, 23)) / 22.0::DOUBLE AS f),
p AS (SELECT c_custkey, zone, x_ AS lon, s + (n - s) * f AS lat FROM k, i, unnest([w, e]) u(x_) UNION ALL SELECT c_custkey, zone, w + (e - w) * f AS lon, y_ AS lat FROM k, i, unnest([s, n]) u(y_)),
{_utm_sql("p")}, g AS (SELECT c_custkey, zone, floor(min(x) / 10) * 10.0::DOUBLE AS x0, ceil(max(y) / 10) * 10.0::DOUBLE AS y0, min(y) AS low, max(x) AS far FROM m GROUP BY 1, 2)
SELECT c_custkey, zone, x0, y0, ceil((y0 - low) / 10)::INT AS height, ceil((far - x0) / 10)::INT AS width, true AS middle_inside FROM g""")
def grids_of_boxes(spark, sf_dir):
    """A map grid of ten metres around a box of degrees for each customer; the middle pixel, taken back to degrees, lies in the box."""
    k = F.col("c_custkey")
    rows = t(spark, sf_dir, "customer").repartition("c_custkey")  # a box costs far more than the few bytes it is stored in
    c = rows.select(k, (k % 60 + 1).cast("int").alias("nth"), (F.col("c_nationkey") * 5.3 - 64).alias("south"))
    west = 6 * F.col("nth") - 183 - F.lit(1.7) + k % 5 * F.lit(0.31)
    boxes = c.withColumn("west", west).withColumns({"east": F.col("west") + 0.43, "north": F.col("south") + 0.27})
    out = grid.pixel_lonlat(grid.common_grids(boxes, F.col("nth"), 10.0), F.floor(F.col("height") / 2), F.floor(F.col("width") / 2), 10.0)
    inside = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    return out.select("c_custkey", "zone", F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"), "height", "width", inside.alias("middle_inside"))
