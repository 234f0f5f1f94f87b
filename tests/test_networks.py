"""Keyed networks, contraction to stars, grids around boxes, coherence loss: against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from orbitframe.functions import scalars
from orbitframe.operators import coherence, grid, select
from orbitframe.operators.components import spread_labels


def unions(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(top)}


def shuffled_path(n, seed):
    names = list(range(n))
    random.Random(seed).shuffle(names)
    return list(zip(names, names[1:]))


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(5, 5)],
        [(2, 1), (1, 2), (2, 1), (7, 7), (7, 9)],
        [(i, i + 1) for i in range(700)],
        shuffled_path(600, 3),
        [(0, i) for i in range(1, 400)] + [(1000 - i, 1000) for i in range(1, 300)],
        [(random.Random(i).randrange(500), random.Random(-i).randrange(500)) for i in range(1, 300)],
    ],
)
def test_components(spark, edges):
    got = spread_labels(spark.createDataFrame(edges, "a long, b long"))
    assert got.columns == ["node", "label"]
    rows = got.collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["label"] for r in rows} == unions(edges)


def test_edges_with_nulls(spark):
    got = spread_labels(spark.createDataFrame([(1, None), (None, None), (4, 3)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(3, 3), (4, 3)]


def test_networks_apart(spark):
    day = dt.date(2020, 1, 1)
    rows = [(k, day + dt.timedelta(12 * i)) for k, n in (("a", 6), ("b", 2), ("c", 1), (None, 3)) for i in range(n)] * 2 + [("a", None)]
    e = select.epochs(spark.createDataFrame(rows, "site string, d date"), "d", ("site",))
    assert e.columns == ["site", "date", "epoch"]
    pairs = select.pair_network(e, 2, ("site",)).collect()
    count = {k: sum(r["site"] == k for r in pairs) for k in ("a", "b", "c", None)}
    assert count == {"a": 9, "b": 1, "c": 0, None: 3}
    assert all(0 < r["sec_epoch"] - r["ref_epoch"] <= 2 and (r["sec"] - r["ref"]).days == 12 * (r["sec_epoch"] - r["ref_epoch"]) for r in pairs)


def test_grid_around_a_box(spark):
    boxes = spark.createDataFrame([("a", 113.8, 22.15, 114.5, 22.6), ("b", None, 1.0, 2.0, 2.0)], "id string, west double, south double, east double, north double")
    rows = {r["id"]: r for r in grid.common_grids(boxes, 50, 10.0).collect()}
    a = rows["a"]
    assert (rows["b"]["x0"], rows["b"]["height"], rows["b"]["width"]) == (None, None, None)
    assert a["x0"] % 10 == 0 and a["y0"] % 10 == 0 and a["zone"] == 50
    assert 0.44 * 111000 / 10 < a["height"] < 0.47 * 111000 / 10
    # Every corner and the middle of every side lies in the grid.
    pts = spark.createDataFrame([(x, y) for x in (113.8, 114.15, 114.5) for y in (22.15, 22.375, 22.6)], "lon double, lat double")
    x, y = scalars.utm_from_lonlat(F.col("lon"), F.col("lat"), 50)
    spec = grid.GridSpec(float(a["x0"]), float(a["y0"]), 10.0, a["height"], a["width"])
    r, c = spec.pixel(x, y)
    assert all(0 <= p["r"] < spec.height and 0 <= p["c"] < spec.width for p in pts.select(r.alias("r"), c.alias("c")).collect())
    back = grid.pixel_lonlat(grid.common_grids(boxes.filter("id = 'a'"), 50, 10.0), F.lit(a["height"] // 2), F.lit(a["width"] // 2), 10.0).first()
    assert abs(back["lon"] - 114.15) < 2e-3 and abs(back["lat"] - 22.375) < 2e-3


def test_outlines_of_boxes_follow_the_series(spark):
    """Bounds found in numpy equal those of the Column series; they are derived once a box, and a NaN side leaves no grid."""
    rng = random.Random(4)
    rows = [(i, rng.uniform(-2, 1), rng.uniform(-80, 80), rng.uniform(0.01, 1.5), rng.choice((1, 30, 60))) for i in range(300)]
    rows = [(i, 6 * z - 183 + w, s, 6 * z - 183 + w + d, s + d, z) for i, w, s, d, z in rows] + [(300, float("nan"), 1.0, 2.0, 2.0, 30), (301, 1.0, 1.0, 2.0, float("nan"), 30), (302, 1.0, 1.0, 2.0, 2.0, None)]
    boxes = spark.createDataFrame(rows, "id int, west double, south double, east double, north double, nth int")
    out = grid.common_grids(boxes, F.col("nth"), 10.0, 3)
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: (r["x0"], r["y0"], r["height"], r["width"]) for r in out.collect()}
    assert all(got[i] == (None,) * 4 for i in (300, 301, 302))
    pts = [(i, x, y, z) for i, w, s, e, n, z in rows[:300] for k in range(5) for x, y in ((w, s + (n - s) * k / 4), (e, s + (n - s) * k / 4), (w + (e - w) * k / 4, s), (w + (e - w) * k / 4, n))]
    x, y = scalars.utm_from_lonlat(F.col("lon"), F.col("lat"), F.col("zone"))
    sides = spark.createDataFrame(pts, "id int, lon double, lat double, zone int").groupBy("id").agg(F.min(x).alias("x0"), F.max(y).alias("y0"), F.min(y).alias("y1"), F.max(x).alias("x1"))
    for r in sides.collect():
        x0, y0 = math.floor(r["x0"] / 10) * 10.0, math.ceil(r["y0"] / 10) * 10.0
        assert got[r["id"]] == (x0, y0, math.ceil((y0 - r["y1"]) / 10), math.ceil((r["x1"] - x0) / 10))


def test_coherence_loss(spark):
    d = lambda m: dt.date(2019, m, 1)
    jobs = spark.createDataFrame([(d(1), d(2)), (d(2), d(3)), (d(3), d(4)), (d(4), d(5))], "ref date, sec date")
    names = {"p": "/x/b_20190101_20190201/c_corr.tif", "q": "/x/a_20190201_20190301/c_corr.tif", "late": "/x/z_20190201_20190301/c_corr.tif", "bare": "/x/a_20190301_20190401/c_corr.tif"}
    products = spark.createDataFrame([(v,) for v in names.values()], "path string")
    nan = float("nan")
    one = [0.2, 0.4, 0.9, 0.8, 0.0, -1.0, nan, 0.6, 0.1, None, 0.7, 0.7, 0.5, 0.5, 0.5, 0.5]
    rows = [(names["p"], 0, 0, one), (names["q"], 0, 0, [0.5] * 16), (names["late"], 0, 0, [0.1] * 16)]
    tiles = spark.createDataFrame(rows, "raster_id string, tile_row int, tile_col int, data array<double>")
    got = {r["path"]: r for r in coherence.coherence_loss(jobs, products, tiles, grid.GridSpec(0.0, 4.0, 1.0, 4, 4), (0, 1, 2, 4), (2, 1, 4, 4), F.lit("2019-01-25").cast("date"), size=4).collect()}
    assert set(got) == {names["p"], names["q"], names["bare"]}
    p, q, bare = got[names["p"]], got[names["q"]], got[names["bare"]]
    assert p["spans_event"] and not q["spans_event"]
    assert (p["n_target"], p["n_control"]) == (3, 5)
    assert p["target_mean"] == pytest.approx(0.7 / 3) and p["control_mean"] == pytest.approx(3.7 / 5) and p["target_low"] == pytest.approx(2 / 3)
    assert (q["target_mean"], q["control_mean"], q["target_low"]) == (0.5, 0.5, 0.0)
    assert (bare["n_target"], bare["n_control"], bare["target_mean"], bare["target_low"]) == (0, 0, None, None)
