"""Queries that run the operators on the driver's tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.config import ChangeConfig, ClimatologyConfig, HarmonicConfig, InversionConfig, RunConfig, TrailingConfig
from orbitframe.functions import scalars
from orbitframe.operators import change, components, coverage, detectors, harmonic, sbas, select, stats, textlint, trend, zonal
from orbitframe.operators.quantiles import quantiles
from orbitframe.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.round(F.sum("o_totalprice") / 1e6, 3).alias("value"))
    return o.withColumn("doy", F.dayofyear("month"))


MONTHLY = """monthly AS (
  SELECT date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice) / 1e6, 3) AS value,
    dayofyear(date_trunc('month', o_orderdate)::DATE) AS doy
  FROM orders GROUP BY 1, 3)"""


def gram_schmidt(source: str, columns: list[str], y: str, keep: str, by: str = "") -> str:
    """CTEs that leave in y what the columns don't explain, within each group of ``by``: modified Gram-Schmidt, one column at a time."""
    n, over = len(columns), f"OVER (PARTITION BY {by})" if by else "OVER ()"
    ctes = [f"g0 AS (SELECT {keep}, {', '.join(f'({c})::DOUBLE AS x{i}' for i, c in enumerate(columns))}, {y}::DOUBLE AS y FROM {source})"]
    for k in range(n):
        proj = lambda v, k=k: f"{v} - (sum({v} * x{k}) {over} / sum(x{k} * x{k}) {over}) * x{k} AS {v}"
        rest = [proj(f"x{j}") for j in range(k + 1, n)] + [proj("y")]
        ctes.append(f"g{k + 1} AS (SELECT {keep}, {', '.join(rest)} FROM g{k})")
    return ",\n".join(ctes)


HARMONIC_X = ["1.0"] + [f"{f}(doy * {2 * 3.141592653589793 * k / 365.25!r})" for k in (1, 2, 3, 4) for f in ("cos", "sin")]


@query(f"""WITH {MONTHLY}, {gram_schmidt("monthly", HARMONIC_X, "value", "month, doy, value")},
r AS (SELECT month, doy, value, y AS residual FROM g9),
m AS (SELECT quantile_cont(residual, 0.5) AS med FROM r),
d AS (SELECT quantile_cont(abs(residual - med), 0.5) AS mad FROM r, m),
z AS (SELECT r.*, 0.6745 * (residual - med) / CASE WHEN mad = 0 THEN 1e-6 ELSE mad END AS z FROM r, m, d)
SELECT month, value, round(value - residual, 3) AS expected, round(residual, 3) AS residual, round(z, 2) AS z, abs(z) >= 3 AS anomaly FROM z""")
def seasonal_anomaly(spark, sf_dir):
    out = harmonic.seasonal_anomaly(monthly(spark, sf_dir), "doy", "value", HarmonicConfig())
    return out.select("month", "value", F.round("expected", 3).alias("expected"), F.round("residual", 3).alias("residual"), F.round("z", 2).alias("z"), "anomaly")


@query("""SELECT month, o_orderkey, cloud FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, cloud,
    row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY coalesce(cloud, 100.0), o_orderkey) AS n
  FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 5000 END AS cloud FROM orders)) WHERE n = 1""")
def clearest_per_month(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("cloud", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 5000))
    return select.clearest_per_month(o, "o_orderdate", "cloud", "o_orderkey").select("month", "o_orderkey", "cloud")


@query("""SELECT day, event_id, user_id FROM (SELECT ts::DATE AS day, event_id, user_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def first_per_day(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return select.first_by(e, ["day"], ["ts", "event_id"]).select("day", "event_id", "user_id")


EPOCHS = """epochs AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS epoch FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS date FROM orders)),
pairs AS (
  SELECT a.date AS ref, a.epoch::INT AS ref_epoch, b.date AS sec, b.epoch::INT AS sec_epoch FROM epochs a JOIN epochs b ON b.epoch IN (a.epoch + 1, a.epoch + 2))"""


def order_epochs(spark, sf_dir):
    return select.epochs(t(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")))


@query(f"WITH {EPOCHS} SELECT * FROM pairs")
def skip_pair_network(spark, sf_dir):
    return select.pair_network(order_epochs(spark, sf_dir))


@query(f"WITH {EPOCHS} SELECT ref, sec FROM pairs WHERE NOT sec < DATE '1998-01-01'")
def incremental_pairs(spark, sf_dir):
    pairs = select.pair_network(order_epochs(spark, sf_dir))
    return select.new_pairs(pairs, pairs.filter(F.col("sec") < F.lit("1998-01-01").cast("date")), ["ref", "sec"]).select("ref", "sec")


@query(f"WITH {EPOCHS} SELECT ref, min(sec) AS sec FROM pairs GROUP BY ref")
def consecutive_pairs(spark, sf_dir):
    return select.pair_network(order_epochs(spark, sf_dir), 1).select("ref", "sec")


@query(f"""WITH {EPOCHS}, products AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS ref, (date_trunc('month', o_orderdate) + INTERVAL 6 MONTH)::DATE AS sec FROM orders)
SELECT p.ref, p.sec, a.epoch::INT AS ref_epoch, b.epoch::INT AS sec_epoch FROM products p JOIN epochs a ON a.date = p.ref JOIN epochs b ON b.date = p.sec""")
def products_in_network(spark, sf_dir):
    e = order_epochs(spark, sf_dir)
    return select.products_in_network(e.select(F.col("date").alias("ref"), F.add_months("date", 6).alias("sec")), e)


@query("""SELECT user_id, day, arg_min(value, k) AS value FROM (SELECT user_id, ts::DATE AS day, value, (ts, event_id) AS k FROM events WHERE event_type <> 'error') GROUP BY ALL""")
def first_valid_mosaic(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.struct("ts", "event_id").alias("k"))
    return select.first_valid(e, ["user_id", "day"], "value", F.col("k"))


VALID = "event_type IN ('click', 'view', 'purchase')"


@query(f"""SELECT day, round(valid_frac, 9) AS valid_frac, area FROM (
  SELECT ts::DATE AS day, avg(CASE WHEN {VALID} THEN 1 ELSE 0 END) AS valid_frac, round(sum(CASE WHEN {VALID} AND value > 10 THEN 1 ELSE 0 END) * 0.0036::DOUBLE, 4) AS area FROM events GROUP BY 1) WHERE valid_frac >= 0.59""")
def valid_fraction_gate(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("v", F.expr(VALID))
    out = e.groupBy("day").agg(F.avg(F.col("v").cast("int")).alias("valid_frac"), F.round(F.sum((F.col("v") & (F.col("value") > 10)).cast("int")) * 0.0036, 4).alias("area"))
    return out.filter(F.col("valid_frac") >= 0.59).withColumn("valid_frac", F.round("valid_frac", 9))


@query("""SELECT scene, round(valid_frac, 9) AS valid_frac, round(water_km2, 4) AS water_km2 FROM (
  SELECT l_returnflag || l_linestatus AS scene, avg(CASE WHEN ok THEN 1 ELSE 0 END) AS valid_frac,
    sum(CASE WHEN ok AND (CASE WHEN l_tax + l_discount > 0 THEN (l_tax - l_discount) / greatest(l_tax + l_discount, 1e-6) ELSE -1.0 END > 0 OR l_linenumber = 6) THEN 1 ELSE 0 END) * 0.0036::DOUBLE AS water_km2
  FROM (SELECT *, l_linenumber IN (4, 5, 6, 7, 11) AS ok FROM lineitem) GROUP BY 1) WHERE valid_frac >= 0.3""")
def normalized_difference_area(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").withColumn("scene", F.concat("l_returnflag", "l_linestatus"))
    out = select.water_area(l, "scene", "l_tax", "l_discount", "l_linenumber", 0.3, 0.0036, (4, 5, 6, 7, 11), 6)
    return out.select("scene", F.round("valid_frac", 9).alias("valid_frac"), F.round("water_km2", 4).alias("water_km2"))


TARGET, CONTROL = "l_quantity BETWEEN 10 AND 20 AND l_extendedprice < 30000", "l_quantity BETWEEN 30 AND 45 AND l_extendedprice >= 30000"


@query(f"""WITH v AS (SELECT l_shipmonth, CASE WHEN l_discount > 0 THEN l_discount END AS x, {TARGET} AS tgt, {CONTROL} AS ctl FROM (SELECT *, date_trunc('month', l_shipdate)::DATE AS l_shipmonth FROM lineitem))
SELECT l_shipmonth, l_shipmonth < DATE '1998-01-15' AND DATE '1998-01-15' < (l_shipmonth + INTERVAL 1 MONTH)::DATE AS spans_event,
  round(avg(x) FILTER (tgt), 6) AS target_mean, round(avg(x) FILTER (ctl), 6) AS control_mean,
  round(avg(CASE WHEN x < 0.03 THEN 1 ELSE 0 END) FILTER (tgt AND x IS NOT NULL), 6) AS target_low, count(x) FILTER (tgt) AS n_target, count(x) FILTER (ctl) AS n_control
FROM v GROUP BY 1""")
def zonal_vs_control(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").withColumn("l_shipmonth", F.to_date(F.date_trunc("month", "l_shipdate")))
    out = zonal.target_against_control(l, ["l_shipmonth"], "l_discount", F.expr(TARGET), F.expr(CONTROL), 0.03)
    event = F.lit("1998-01-15").cast("date")
    rounded = [F.round(c, 6).alias(c) for c in ("target_mean", "control_mean", "target_low")]
    return out.select("l_shipmonth", zonal.spans(F.col("l_shipmonth"), F.add_months("l_shipmonth", 1), event).alias("spans_event"), *rounded, "n_target", "n_control")


@query("""SELECT event_type, ts::DATE AS day, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1, 2""")
def zonal_summary(spark, sf_dir):
    out = zonal.zonal_stats(t(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["event_type", "day"], "value")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


def user_days(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))


USER_DAYS = "ud AS (SELECT user_id, ts::DATE AS day, round(sum(value), 4) AS v, (ts::DATE - DATE '1970-01-01')::INT / 365.25 AS yr FROM events GROUP BY 1, 2)"


@query(f"""WITH {USER_DAYS} SELECT user_id, round(regr_slope(v, yr), 3) AS slope, count(*) AS n,
  round(sqrt(greatest(var_pop(v) - regr_slope(v, yr) * covar_pop(yr, v), 0)), 5) AS scatter FROM ud GROUP BY 1 HAVING count(*) >= 8""")
def trend_by_group(spark, sf_dir):
    out = trend.trends(user_days(spark, sf_dir).withColumn("yr", scalars.year_fraction(F.col("day"))), ["user_id"], "yr", "v")
    return out.select("user_id", F.round("slope", 3).alias("slope"), "n", F.round("scatter", 5).alias("scatter"))


@query(f"""WITH {USER_DAYS}, s AS (SELECT user_id, regr_slope(v, yr) AS slope FROM ud GROUP BY 1 HAVING count(*) >= 8),
c AS (SELECT quantile_cont(slope, 0.1) AS cut, count(*) AS n FROM s)
SELECT day, round(quantile_cont(v, 0.5), 4) AS median, count(*) AS n_px FROM ud WHERE user_id IN (SELECT user_id FROM s, c WHERE slope <= cut AND n >= 10) GROUP BY 1""")
def hotspot_decile(spark, sf_dir):
    px = user_days(spark, sf_dir).withColumn("yr", scalars.year_fraction(F.col("day")))
    out = trend.hotspot(px, ["user_id"], "yr", "v", 10)
    days = px.select("yr", "day").distinct()
    return out.join(days, "yr").select("day", F.round("median", 4).alias("median"), "n_px")


@query("""WITH l AS (SELECT ts::DATE AS day, user_id, round(avg(value), 4) AS v FROM events GROUP BY 1, 2),
m AS (SELECT user_id, sum(coalesce(v, 0)) / greatest(count(*) FILTER (v > 0), 1) AS mean FROM l GROUP BY 1),
r AS (SELECT user_id FROM m ORDER BY mean DESC NULLS LAST, user_id LIMIT 1)
SELECT l.day, l.user_id, round(l.v - b.v, 4) AS v FROM l LEFT JOIN (SELECT day, v FROM l WHERE user_id = (SELECT user_id FROM r)) b ON l.day = b.day""")
def reference_pixel(spark, sf_dir):
    l = t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.round(F.avg("value"), 4).alias("v"))
    means = sbas.coherence_means(l, ["user_id"], "v").withColumn("col", F.lit(0))
    ref = sbas.reference_pixel(means, "user_id", "col")
    return sbas.referenced(l, ref, ["day"], ["user_id"], "v").select("day", "user_id", F.round("v", 4).alias("v"))


@query("""WITH m AS (SELECT o_orderpriority AS pixel, date_trunc('month', o_orderdate)::DATE AS date, round(avg(o_totalprice) / 1000, 6) AS v FROM orders GROUP BY 1, 2),
e AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS epoch FROM (SELECT DISTINCT date FROM m)),
f AS (SELECT pixel FROM m GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM e))
SELECT pixel, epoch, round(v - first_value(v) OVER (PARTITION BY pixel ORDER BY epoch), 6) AS disp FROM m JOIN e USING (date) WHERE pixel IN (SELECT pixel FROM f)""")
def sbas_noise_free(spark, sf_dir):
    m = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("pixel"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.round(F.avg("o_totalprice") / 1000, 6).alias("v"))
    e = select.epochs(m.select("date"))
    n = e.count()
    pairs = select.pair_network(e)
    series = m.join(e, "date").select("pixel", "epoch", "v")
    whole = series.groupBy("pixel").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n).select("pixel")
    series = series.join(whole, "pixel")
    a = series.select("pixel", F.col("epoch").alias("ref_epoch"), F.col("v").alias("va"))
    b = series.select("pixel", F.col("epoch").alias("sec_epoch"), F.col("v").alias("vb"))
    obs = pairs.join(a, "ref_epoch").join(b, ["pixel", "sec_epoch"]).select("pixel", "ref_epoch", "sec_epoch", (F.col("vb") - F.col("va")).alias("disp"), (0.45 + 0.5 * F.pmod(F.xxhash64("ref_epoch", "sec_epoch"), F.lit(1000)) / 1000).alias("coh"))
    out = sbas.invert(obs, n, InversionConfig())
    return out.select("pixel", "epoch", (F.round("disp", 6) + F.lit(0.0)).alias("disp"))


@query("""WITH d AS (SELECT user_id, ts >= TIMESTAMP '2024-01-16' AS post, CASE WHEN value > 0 THEN 10 * log10(value) END AS db FROM events)
SELECT user_id, round(quantile_cont(db, 0.5) FILTER (NOT post), 6) AS pre_db, round(quantile_cont(db, 0.5) FILTER (post), 6) AS post_db,
  round(quantile_cont(db, 0.5) FILTER (post) - quantile_cont(db, 0.5) FILTER (NOT post), 6) AS change_db FROM d GROUP BY 1""")
def change_db(spark, sf_dir):
    out = change.change_db(t(spark, sf_dir, "events"), ["user_id"], "value", F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    return out.select("user_id", *(F.round(c, 6).alias(c) for c in ("pre_db", "post_db", "change_db")))


def hour_grid(spark, sf_dir):
    """Days by hours: sum of values of each cell that has events."""
    e = t(spark, sf_dir, "events")
    return e.groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("row"), F.hour("ts").alias("col")).agg(F.round(F.sum("value"), 4).alias("v"))


GRID = "grid AS (SELECT (ts::DATE - DATE '2024-01-01')::INT AS \"row\", hour(ts)::INT AS col, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)"


@query(f"""WITH {GRID}, n AS (SELECT g.*, u.v AS up, d.v AS down, l.v AS lft, r.v AS rgt FROM grid g
  LEFT JOIN grid u ON u."row" = g."row" - 1 AND u.col = g.col LEFT JOIN grid d ON d."row" = g."row" + 1 AND d.col = g.col
  LEFT JOIN grid l ON l."row" = g."row" AND l.col = g.col - 1 LEFT JOIN grid r ON r."row" = g."row" AND r.col = g.col + 1),
g2 AS (SELECT "row", col, CASE WHEN up IS NOT NULL AND down IS NOT NULL THEN (down - up) / 2 WHEN down IS NOT NULL THEN down - v WHEN up IS NOT NULL THEN v - up END AS d_row,
  CASE WHEN lft IS NOT NULL AND rgt IS NOT NULL THEN (rgt - lft) / 2 WHEN rgt IS NOT NULL THEN rgt - v WHEN lft IS NOT NULL THEN v - lft END AS d_col FROM n)
SELECT "row", col, round(d_row, 4) AS d_row, round(d_col, 4) AS d_col, round(degrees(atan(sqrt(d_row * d_row + d_col * d_col))), 5) AS slope_deg FROM g2""")
def gradient_slope(spark, sf_dir):
    out = change.gradient(hour_grid(spark, sf_dir), "v")
    return out.select("row", "col", F.round("d_row", 4).alias("d_row"), F.round("d_col", 4).alias("d_col"), F.round("slope_deg", 5).alias("slope_deg"))


HALO = """lim AS (SELECT quantile_cont(v, 0.7) AS halo, quantile_cont(v, 0.9) AS seed FROM grid),
inside AS (SELECT "row", col, v, "row"::BIGINT * 1000 + col AS id FROM grid, lim WHERE v >= halo),
near AS (SELECT a.id, b.id AS other FROM inside a JOIN inside b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1)"""
LABELS = """reach(id, root) AS (SELECT id, id FROM inside UNION SELECT n.other, r.root FROM reach r JOIN near n ON n.id = r.id),
label AS (SELECT id, min(root) AS root FROM reach GROUP BY 1)"""


@query(f"""WITH RECURSIVE {GRID}, {HALO}, {LABELS}
SELECT "row", col, (root // 1000)::INT AS top_row, (root % 1000)::INT AS top_col FROM label JOIN inside USING (id)""")
def component_labels(spark, sf_dir):
    g = hour_grid(spark, sf_dir)
    inside = g.filter(F.col("v") >= F.lit(quantiles(g, "v", [0.7])[0]).cast("double"))
    out = components.label_cells(inside.select("row", "col"), 8)
    return out.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.shiftright("label", 32).cast("int").alias("top_row"), F.expr("cast(label & 4294967295 as int)").alias("top_col"))


CLUSTERS = f"""{GRID}, {HALO}, {LABELS},
clusters AS (SELECT root, count(*) AS size, max(v) AS peak, avg("row") AS mrow, avg(col) AS mcol, round(max(v) * ln(1 + count(*)), 2) AS score
  FROM label JOIN inside USING (id), lim GROUP BY root, seed HAVING count(*) >= 3 AND max(v) >= seed)"""


def clusters(spark, sf_dir):
    g = hour_grid(spark, sf_dir)
    lim = [x or 0.0 for x in quantiles(g, "v", [0.7, 0.9])]
    falling = g.withColumn("v", -F.col("v"))
    return change.hysteresis_clusters(falling, "v", ChangeConfig(seed_db=-lim[1], grow_db=-lim[0], min_pixels=3))


@query(f"""WITH RECURSIVE {CLUSTERS}
SELECT (root // 1000)::INT AS top_row, (root % 1000)::INT AS top_col, size, peak, round(mrow, 5) AS mean_row, round(mcol, 5) AS mean_col, score FROM clusters""")
def hysteresis_clusters(spark, sf_dir):
    return clusters(spark, sf_dir).select(
        F.shiftright("label", 32).cast("int").alias("top_row"), F.expr("cast(label & 4294967295 as int)").alias("top_col"), "size", (-F.col("peak")).alias("peak"), F.round("row", 5).alias("mean_row"), F.round("col", 5).alias("mean_col"), "score"
    )


@query(f"""WITH RECURSIVE {CLUSTERS}
SELECT (root // 1000)::INT AS top_row, (root % 1000)::INT AS top_col, score, row_number() OVER (ORDER BY score DESC, (root // 1000), (root % 1000)) AS nth FROM clusters ORDER BY score DESC, top_row, top_col LIMIT 100""")
def top_candidates(spark, sf_dir):
    top = clusters(spark, sf_dir).orderBy(F.col("score").desc(), "label").limit(100)
    out = sbas.rank_in(top, [F.lit(0)], [F.col("score").desc(), "label"])
    return out.select(F.shiftright("label", 32).cast("int").alias("top_row"), F.expr("cast(label & 4294967295 as int)").alias("top_col"), "score", F.col("rank").cast("long").alias("nth"))


POINTS = """cand AS (SELECT 22.3 + round(embedding[1]::DOUBLE, 5) / 50 AS lat, 114.2 + round(embedding[2]::DOUBLE, 5) / 50 AS lon, row_number() OVER (ORDER BY vec_id) AS "rank" FROM embeddings),
site AS (SELECT vec_id AS site, 22.3 + round(embedding[1]::DOUBLE, 5) / 50 + 0.001 AS lat, 114.2 + round(embedding[2]::DOUBLE, 5) / 50 - 0.001 AS lon FROM embeddings)"""


@query(f"""WITH {POINTS}, d AS (SELECT site, "rank", sqrt(pow((c.lat - s.lat) * 111320, 2) + pow((c.lon - s.lon) * 111320 * cos(radians(s.lat)), 2)) AS m FROM cand c, site s)
SELECT s.site, min(d."rank") AS "rank", round(arg_min(d.m, d."rank"), 3) AS dist_m FROM site s LEFT JOIN d ON d.site = s.site AND d.m <= 300 GROUP BY 1""")
def truth_check(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    at = lambda i, base: F.lit(base) + F.round(F.element_at("embedding", i).cast("double"), 5) / 50
    cand = select.ordered_rank(e.select("vec_id", at(1, 22.3).alias("lat"), at(2, 114.2).alias("lon")), ["vec_id"])
    sites = e.select(F.col("vec_id").alias("site"), (at(1, 22.3) + 0.001).alias("lat"), (at(2, 114.2) - 0.001).alias("lon"))
    return change.truth_check(cand, sites).select("site", F.col("rank").cast("long").alias("rank"), F.round("dist_m", 3).alias("dist_m"))


@query("""WITH tr AS (SELECT o_custkey AS place, o_orderstatus AS track, count(*) AS passes, min(o_orderkey) AS first_seen, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months,
  count(*) FILTER (o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 366 DAYS) AS recent FROM orders GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY passes DESC, first_seen) AS n, sum(passes) OVER (PARTITION BY place) AS total FROM tr)
SELECT place, total::BIGINT AS total, total = 400 AS capped, track AS best_track, passes AS best_passes, months, CASE WHEN recent > 0 THEN floor(365.0::DOUBLE / recent + 0.5)::BIGINT END AS cadence_days,
  CASE WHEN months >= 3 THEN least(months, 36) END AS epochs, CASE WHEN months >= 3 THEN 2 * least(months, 36) - 3 END AS pairs FROM b WHERE n = 1""")
def coverage_report(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("place"), F.col("o_orderstatus").alias("track"), "o_orderdate", "o_orderkey")
    return coverage.coverage_report(o, "place", "track", "o_orderdate", "o_orderkey", F.lit("2001-08-01").cast("timestamp_ntz"))


SLOTS = "slots AS (SELECT event_type, ts::DATE AS day, hour(ts) // 2 AS slot, avg(value) AS v FROM events GROUP BY 1, 2, 3)"


def two_hour_slots(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 2).alias("slot")).agg(F.avg("value").alias("v"))


TRAIL = f"""{SLOTS}, q AS (SELECT *, quantile_cont(v, [0.25, 0.5, 0.75]) OVER w AS q, count(v) OVER w AS n_prior FROM slots
  WINDOW w AS (PARTITION BY event_type, slot ORDER BY day RANGE BETWEEN INTERVAL 15 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
flags AS (SELECT *, q[2] - 1.5 * (q[2] - q[1]) AS lower, q[2] + 1.5 * (q[3] - q[2]) AS upper, v < q[2] - 1.5 * (q[2] - q[1]) OR v > q[2] + 1.5 * (q[3] - q[2]) AS exceeds FROM q)"""


def trailing(spark, sf_dir):
    s = two_hour_slots(spark, sf_dir).withColumn("at", F.col("day").cast("timestamp"))
    return detectors.trailing_quartiles(s, ["event_type", "slot"], "at", "v", TrailingConfig())


@query(f"WITH {TRAIL} SELECT event_type, day, slot, round(v, 9) AS v, n_prior, round(lower, 10) AS lower, round(upper, 10) AS upper, exceeds FROM flags")
def trailing_quartile(spark, sf_dir):
    return trailing(spark, sf_dir).select("event_type", "day", "slot", F.round("v", 9).alias("v"), "n_prior", F.round("lower", 10).alias("lower"), F.round("upper", 10).alias("upper"), "exceeds")


KP = "kp AS (SELECT ts::DATE AS day, max(value % 9) AS level FROM events WHERE event_type = 'click' GROUP BY 1)"


@query(f"""WITH {TRAIL}, {KP}, f AS (SELECT event_type, (day - DATE '2024-01-01')::BIGINT * 12 + slot AS step, exceeds FROM flags JOIN kp USING (day) WHERE level <= 8.9),
i AS (SELECT *, step - row_number() OVER (PARTITION BY event_type ORDER BY step) AS island FROM f WHERE exceeds)
SELECT event_type, min(step) AS first_step, max(step) AS last_step, count(*) AS length FROM i GROUP BY event_type, island HAVING count(*) >= 2""")
def sustained_quiet_runs(spark, sf_dir):
    kp = t(spark, sf_dir, "events").filter("event_type = 'click'").groupBy(F.to_date("ts").alias("day")).agg(F.max(F.col("value") % 9).alias("level"))
    quiet = detectors.quiet_only(trailing(spark, sf_dir), kp, "day", "level", 8.9)
    steps = quiet.withColumn("step", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long") * 12 + F.col("slot"))
    return detectors.sustained_runs(steps, ["event_type"], "step", "exceeds", RunConfig(steps=2))


DAILY = """daily AS (SELECT n_regionkey AS region, n_nationkey AS nation, o_orderdate::DATE AS day, round(sum(o_totalprice) / 1000, 6) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def daily(spark, sf_dir):
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice") / 1000, 6).alias("v"))


@query(f"""WITH {DAILY}, e AS (SELECT *, v - avg(v) OVER (PARTITION BY region, day) AS eddy FROM daily),
w AS (SELECT a.region, a.nation, a.day, a.eddy, avg(b.eddy) AS m, stddev_samp(b.eddy) AS s, count(b.eddy) AS n FROM e a
  LEFT JOIN e b ON b.nation = a.nation AND strftime(b.day, '%m-%d') = strftime(a.day, '%m-%d') AND year(b.day) BETWEEN year(a.day) - 10 AND year(a.day) - 1 GROUP BY 1, 2, 3, 4)
SELECT nation, day, round(eddy, 8) + 0.0 AS eddy, n AS n_years, CASE WHEN n >= 2 AND s > 1e-6 THEN round((eddy - m) / s, 2) + 0.0 END AS z FROM w""")
def climatology_z(spark, sf_dir):
    e = detectors.minus_zonal_mean(daily(spark, sf_dir), ["region", "day"], "v")
    out = detectors.climatology_z(e, ["nation"], "day", "eddy", ClimatologyConfig())
    return out.select("nation", "day", (F.round("eddy", 8) + F.lit(0.0)).alias("eddy"), "n_years", F.when(F.col("clim_sd") > 1e-6, F.round("z", 2) + F.lit(0.0)).alias("z"))


@query(f"""WITH d AS (SELECT o_orderdate::DATE AS day, round(sum(o_totalprice) / 1000, 6) AS v, count(*)::DOUBLE AS flux FROM orders GROUP BY 1),
s AS (SELECT *, avg(flux) OVER (ORDER BY day RANGE BETWEEN INTERVAL 40 DAYS PRECEDING AND INTERVAL 40 DAYS FOLLOWING) AS flux81 FROM d),
{gram_schmidt("s", ["1.0", "flux", "flux81"], "v", "day, v")} SELECT day, v, round(y, 3) + 0.0 AS detrended FROM g3""")
def detrended(spark, sf_dir):
    d = t(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice") / 1000, 6).alias("v"), F.count(F.lit(1)).cast("double").alias("flux"))
    d = d.withColumn("flux81", detectors.centred_mean(d, [], F.unix_date("day"), "flux"))
    return detectors.detrended(d, ["flux", "flux81"], "v").select("day", "v", (F.round("detrended", 3) + F.lit(0.0)).alias("detrended"))


TWIN = """d AS (SELECT o_orderpriority AS event, o_orderdate::DATE AS day, sum(o_totalprice) > 400000 AS hit FROM orders GROUP BY 1, 2),
e AS (SELECT event, count(*) AS days, count(*) FILTER (hit) AS hits FROM d WHERE day >= DATE '1999-03-01' AND day < DATE '1999-03-31' GROUP BY 1),
c AS (SELECT event, count(*) AS days, count(*) FILTER (hit) AS hits FROM d WHERE day >= DATE '1998-03-01' AND day < DATE '1998-03-31' GROUP BY 1),
tw AS (SELECT e.event, e.hits AS a, e.days - e.hits AS b, c.hits AS c, c.days - c.hits AS d FROM e JOIN c USING (event))"""
FISHER = """lf AS (SELECT event, a, b, c, d, x, lgamma(a + b + 1.0) + lgamma(c + d + 1.0) + lgamma(a + c + 1.0) + lgamma(b + d + 1.0) - lgamma(a + b + c + d + 1.0) AS k
  FROM tw, range(0, 200) r(x) WHERE x >= greatest(0, a + c - (c + d)) AND x <= least(a + b, a + c)),
lp AS (SELECT *, k - lgamma(x + 1.0) - lgamma(a + b - x + 1.0) - lgamma(a + c - x + 1.0) - lgamma(d - a + x + 1.0) AS l,
  k - lgamma(a + 1.0) - lgamma(b + 1.0) - lgamma(c + 1.0) - lgamma(d + 1.0) AS seen FROM lf),
p AS (SELECT event, a, b, c, d, least(sum(CASE WHEN l <= seen + 1e-7 THEN exp(l) ELSE 0 END), 1.0) AS p FROM lp GROUP BY ALL)"""


def twin_counts(spark, sf_dir):
    d = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("event"), F.to_date("o_orderdate").alias("day")).agg((F.sum("o_totalprice") > 400000).alias("hit"))
    window = d.filter((F.col("day") >= F.lit("1999-03-01").cast("date")) & (F.col("day") < F.lit("1999-03-31").cast("date")))
    e = window.groupBy("event").agg(F.count_if("hit").alias("a"), F.count_if(~F.col("hit")).alias("b"))
    shifted = detectors.control_twin(d.select("event", "day", "hit"), "day", -12).filter((F.col("twin_date") >= F.lit("1999-03-01").cast("date")) & (F.col("twin_date") < F.lit("1999-03-31").cast("date")))
    c = shifted.groupBy("event").agg(F.count_if("hit").alias("c"), F.count_if(~F.col("hit")).alias("d"))
    return e.join(c, "event")


@query(f"WITH {TWIN} SELECT * FROM tw")
def control_twin(spark, sf_dir):
    return twin_counts(spark, sf_dir)


def fisher(spark, sf_dir):
    return twin_counts(spark, sf_dir).withColumn("p", stats.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d")))


@query(f"WITH {TWIN}, {FISHER} SELECT event, a, b, c, d, round(p, 6) AS p FROM p")
def fisher_exact(spark, sf_dir):
    return fisher(spark, sf_dir).withColumn("p", F.round("p", 6))


@query(f"WITH {TWIN}, {FISHER} SELECT event, round(p, 6) AS p, row_number() OVER (ORDER BY round(p, 6), event) AS nth, round(row_number() OVER (ORDER BY round(p, 6), event) / (count(*) OVER () + 1), 6) AS expected FROM p")
def uniform_pvalues(spark, sf_dir):
    out = stats.against_uniform(fisher(spark, sf_dir).withColumn("p", F.round("p", 6)), "p", ["event"])
    return out.select("event", "p", F.col("nth").cast("long").alias("nth"), F.round("expected", 6).alias("expected"))


@query("""WITH s AS (SELECT ts::DATE AS day, user_id, round(sum(value), 4) AS v FROM events GROUP BY 1, 2), o AS (SELECT day, max(v) FILTER (user_id = 8) AS observed, avg(v) FILTER (user_id <> 8) AS m,
  stddev_samp(v) FILTER (user_id <> 8) / sqrt(count(v) FILTER (user_id <> 8)) AS se, count(*) FILTER (user_id <> 8) AS n FROM s GROUP BY 1)
SELECT o.day, observed, round(CASE WHEN observed IS NULL THEN NULL ELSE (SELECT count(*) FROM s WHERE s.day = o.day AND user_id <> 8 AND v < observed) / n END, 6) AS share_below, round((observed - m) / se, 4) AS offset_se FROM o""")
def placebo_rank(spark, sf_dir):
    s = t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.round(F.sum("value"), 4).alias("v"))
    out = detectors.placebo_rank(s, "day", F.col("user_id") == 8, "v")
    return out.select("day", "observed", F.when(F.col("observed").isNotNull(), F.round("share_below", 6)).alias("share_below"), F.round("offset_se", 4).alias("offset_se"))


@query("""SELECT s_suppkey, shift, round(((s_suppkey * 3.5::DOUBLE % 360 + shift + 180) % 360 + 360) % 360 - 180, 6) AS placebo_lon FROM supplier, unnest([15, -15, 25, -25, 35, -35, 45, -45, 55, -55, 65, -65, 75, -75]) u(shift)""")
def placebo_shifts(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3.5 % 360).alias("lon"))
    return detectors.placebos(s, "lon").select("s_suppkey", "shift", F.round("placebo_lon", 6).alias("placebo_lon"))


LINE_SQL = r"""raw AS (SELECT {key} AS path, unnest(string_split(regexp_replace({text}, '(</?(style|h1|p|title)[^>]*>)', E'\n\\1', 'g'), E'\n')) AS raw, unnest(range(1, len(string_split(regexp_replace({text}, '(</?(style|h1|p|title)[^>]*>)', E'\n\\1', 'g'), E'\n')) + 1)) AS line FROM {source}),
marks AS (SELECT *, last_value(CASE WHEN contains(raw, '</style') THEN 0 WHEN contains(raw, '<style') THEN 1 END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING) AS inside FROM raw),
kept AS (SELECT path, line::INT AS line, raw FROM marks WHERE coalesce(inside, 0) = 0 AND NOT contains(raw, '</style'))"""


def _lint_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({i}, {quote(textlint.portable(p))}, {quote(m)})" for i, (p, m) in enumerate(textlint.RULES))
    return f"""WITH {LINE_SQL.format(key="page_id", text="replace(html, 'with', 'not just')", source="pages")}, rules(rule, pattern, message) AS (VALUES {rules}),
txt AS (SELECT path, line, raw, regexp_replace(raw, '<[^>]+>', ' ', 'g') AS text, regexp_matches(raw, {quote(textlint.HEADING)}) AS head FROM kept)
SELECT path, line, rule::INT AS rule, message, left(regexp_replace(text, '^[\\s\\v\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+|[\\s\\v\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '', 'g'), 90) AS snippet FROM txt, rules WHERE regexp_matches(text, pattern) AND NOT (head AND contains(message, 'em-dash'))"""


def page_lines(spark, sf_dir, swap: bool = False):
    html = F.replace("html", F.lit("with"), F.lit("not just")) if swap else F.col("html")
    cut = F.regexp_replace(html, "(</?(style|h1|p|title)[^>]*>)", "\n$1")
    return textlint.lines_of(t(spark, sf_dir, "pages").select("page_id", cut.alias("content")), "page_id")


def _lint_count_sql() -> str:
    """How many findings all rules have: one constant pattern each."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hits = " + ".join(f"(regexp_matches(text, {quote(textlint.portable(p))}){' AND NOT head' if 'em-dash' in m else ''})::INT" for p, m in textlint.RULES)
    return f"""WITH {LINE_SQL.format(key="page_id", text="replace(html, 'with', 'not just')", source="pages")},
txt AS (SELECT regexp_replace(raw, '<[^>]+>', ' ', 'g') AS text, regexp_matches(raw, {quote(textlint.HEADING)}) AS head FROM kept)
SELECT coalesce(sum({hits}), 0)::BIGINT AS findings FROM txt"""


LINT_COUNT = _lint_count_sql()


@query(_lint_sql())
def prose_lint(spark, sf_dir):
    return textlint.findings(textlint.outside_style(page_lines(spark, sf_dir, True)))


@query(f"WITH {LINE_SQL.format(key='page_id', text='html', source='pages')} SELECT path, count(*) AS n_lines, sum(line)::BIGINT AS line_sum, sum(length(raw))::BIGINT AS chars FROM kept GROUP BY 1")
def style_skip(spark, sf_dir):
    return textlint.outside_style(page_lines(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("line").alias("line_sum"), F.sum(F.length("raw")).alias("chars"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, '{\"k\":' || (props->>'k') || '}' AS again FROM events")
def json_props(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.select("event_id", "p.k", F.to_json("p").alias("again"))


@query("""SELECT c_custkey, array_to_string(list_filter([c_name, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, n_name], lambda x: x <> ''), ', ') AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def label_join(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select("c_custkey", scalars.join_parts(F.col("c_name"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")), F.col("n_name")).alias("label"))


@query("""SELECT o_custkey::VARCHAR AS batch, '10x2' AS looks, o_orderkey::VARCHAR AS job_id, strftime(o_orderdate, '%Y-%m-%d') AS ref FROM orders""")
def manifest_explode(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    m = o.groupBy(F.col("o_custkey").cast("string").alias("batch")).agg(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("job_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ref"))).alias("jobs"))
    return readers.manifest_jobs(m.withColumn("looks", F.lit("10x2")))


@query("""SELECT o_orderkey, ref, sec FROM (SELECT o_orderkey, o_orderdate::DATE AS ref, (o_orderdate::DATE + 12)::DATE AS sec FROM orders WHERE o_orderkey % 10 <> 0)""")
def product_discovery(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    day = lambda c: F.date_format(c, "yyyyMMdd")
    name = F.when(F.col("o_orderkey") % 10 != 0, F.concat(F.lit("/p/S1_"), day("o_orderdate"), F.lit("_"), day(F.date_add("o_orderdate", 12)), F.lit("/x_unw_phase.tif"))).otherwise(F.concat(F.lit("/p/S1_"), day("o_orderdate"), F.lit("/x_unw_phase.tif")))
    return readers.product_dates(o.select("o_orderkey", name.alias("path"))).select("o_orderkey", "ref", "sec")


@query("""SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1""")
def count_by_status(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_totalprice / 5000 AS cloud FROM orders WHERE o_totalprice / 5000 < 60 AND o_orderpriority = '5-LOW' ORDER BY o_orderdate DESC, o_orderkey LIMIT 600""")
def scene_search(spark, sf_dir):
    c = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 5000).alias("cloud"), F.col("o_orderpriority").alias("tile"))
    return readers.scenes(c, 60.0, "5-LOW").select(F.col("scene_id").alias("o_orderkey"), "cloud")


@query("""SELECT l_orderkey, l_linenumber, round(-l_discount * 0.055465 / (4 * pi()) * 1000, 6) + 0.0 AS los_mm, round(0.045 / greatest(0.2, cos(radians(l_quantity))), 6) AS half_lon FROM lineitem""")
def scalar_measures(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    box = scalars.order_box(F.col("l_quantity"), F.lit(0.0))
    return l.select("l_orderkey", "l_linenumber", (F.round(scalars.los_metres(F.col("l_discount")) * 1000, 6) + F.lit(0.0)).alias("los_mm"), F.round(box["e"], 6).alias("half_lon"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y') AS yr, count(*) AS n FROM orders GROUP BY 1)
SELECT '{"source":"orders","method":"count","summary":{"total":' || sum(n)::BIGINT || '},"series":[' || string_agg('{"yr":"' || yr || '","n":' || n || '}', ',' ORDER BY yr) || ']}' AS json FROM m""")
def result_json(spark, sf_dir):
    m = t(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    return sinks.result_json(m, ["yr"], {"total": F.sum("n")}, "orders", "count")
