"""Catalogue pages, interval and spatial joins, whole-column quantiles and fits per key, against plain Python."""

import datetime as dt
import json
import math
import os
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe import storage
from orbitframe.config import HarmonicConfig, PrecursorConfig
from orbitframe.operators import detectors, grid, harmonic, quantiles, spatial, windows
from orbitframe.sources import pages, readers

DAY = dt.date(2020, 1, 1)


def scene_rows(n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        x, y = rng.uniform(-170, 160), rng.uniform(-80, 70)
        ts = dt.datetime(2020, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=i * 7)
        rows.append((f"s{i}", ts if i % 11 else None, rng.uniform(0, 100) if i % 5 else None, f"T{i % 3}" if i % 7 else None, *((x, y, x + 5, y + 5) if i % 13 else (None,) * 4)))
    return rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    pages.register(spark)
    at = f"file://{tmp_path_factory.mktemp('pages')}/catalogue"
    df = spark.createDataFrame(scene_rows(), pages.SCHEMA)
    df.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.format("catalogue_pages").option("page_size", 20).mode("append").save(at)
    return at, df


def loaded(spark, at):
    return spark.read.format("catalogue_pages").load(at)


def test_pages_hold_what_was_written(spark, stored):
    at, df = stored
    got = loaded(spark, at)
    assert got.exceptAll(df).count() == df.exceptAll(got).count() == 0 and got.rdd.getNumPartitions() >= 20


@pytest.mark.parametrize("condition", [
    "ts >= '2020-02-01' AND ts < '2020-02-10'", "cloud < 20 AND tile = 'T1'", "tile IN ('T0', 'T9')", "west <= -100 AND east >= -120 AND south <= 10 AND north >= -10",
    "cloud IS NULL", "NOT (cloud < 50)", "scene_id = 's17'", "scene_id = 'none'", "cloud > 5 AND cloud > 99", "tile LIKE 'T%' AND ts > '2020-04-01'",
])
def test_pushed_filters_change_no_row(spark, stored, condition):
    at, df = stored
    got, want = loaded(spark, at).filter(condition), df.filter(condition)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_a_search_opens_few_pages_and_filters_in_the_source(spark, stored):
    at, df = stored
    found = readers.scenes(loaded(spark, at), 60.0, "T1", None, "2020-02-01", "2020-02-08")
    assert 0 < found.rdd.getNumPartitions() <= 4 and "Filter (" not in found._jdf.queryExecution().executedPlan().toString()
    want = df.filter("cloud < 60 AND tile = 'T1' AND ts >= '2020-02-01' AND ts < '2020-02-08'")
    assert sorted(r[0] for r in found.collect()) == sorted(r[0] for r in want.collect())
    boxed = readers.scenes(loaded(spark, at), 60.0, None, None, box=(-50, -20, 0, 20))
    assert {r[0] for r in boxed.collect()} == {r[0] for r in scene_rows() if r[2] is not None and r[2] < 60 and r[4] is not None and r[4] <= 0 and r[6] >= -50 and r[5] <= 20 and r[7] >= -20}


def test_latest_scenes_come_first(spark, stored):
    at, df = stored
    want = [r[0] for r in sorted((r for r in scene_rows() if r[1] and r[2] is not None and r[2] < 60 and r[1] >= dt.datetime(2020, 2, 1, tzinfo=dt.UTC)), key=lambda r: (-r[1].timestamp(), r[0]))[:100]]
    assert [r["scene_id"] for r in readers.scenes(loaded(spark, at), limit=100, since="2020-02-01").collect()] == want


def test_pages_outside_an_index_are_not_read(spark, tmp_path):
    at = f"file://{tmp_path}/c"
    df = spark.createDataFrame(scene_rows(30), pages.SCHEMA)
    df.coalesce(1).write.format("catalogue_pages").mode("append").save(at)
    with open(f"{tmp_path}/c/page-left-behind.json", "w") as f:
        json.dump({"features": [{"id": "ghost", "properties": {}}]}, f)
    assert loaded(spark, at).count() == 30
    df.limit(7).write.format("catalogue_pages").mode("append").save(at)
    assert loaded(spark, at).count() == 37
    df.limit(5).write.format("catalogue_pages").mode("overwrite").save(at)
    assert loaded(spark, at).count() == 5
    df.limit(0).write.format("catalogue_pages").mode("overwrite").save(at)
    assert loaded(spark, at).count() == 0
    assert loaded(spark, f"file://{tmp_path}/nothing").count() == 0


def test_interval_join_meets_each_pair_once(spark):
    rng = random.Random(4)
    series = [(k, DAY + dt.timedelta(rng.randrange(-200, 400)), i) for i, k in enumerate(rng.choices("abc", k=300))]
    wins = []
    for i in range(60):
        start = DAY + dt.timedelta(rng.randrange(-250, 400))
        wins.append((rng.choice("abcd"), start, start + dt.timedelta(rng.choice((-3, 0, 1, 32, 64, 150))), i))
    a, b = spark.createDataFrame(series, "k string, day date, i int"), spark.createDataFrame(wins, "k string, start date, end date, w int")
    for bucket in (1, 32, 1000):
        met = windows.interval_join(a, b, ["k"], "day", "start", "end", bucket)
        assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["i"], r["w"]) for r in met.collect()) == sorted((i, w) for k, d, i in series for k2, s, e, w in wins if k == k2 and s <= d < e)


def test_study_of_places_without_data_and_of_a_planted_burst(spark):
    """One node carries a steady signal with a burst before the event; its twin window and a place without nodes are quiet."""
    config = PrecursorConfig(scored_days=10, history_days=5, shifts=(60, -60, 120))
    rng = random.Random(2)
    event = dt.date(2021, 6, 1)
    days = [event - dt.timedelta(k) for k in range(-5, 400)]
    rows = [(lon, lat, d, rng.uniform(1, 2) + (50 + (event - d).days % 7 * 30 if lon == 0 and 0 < (event - d).days <= 6 else 0)) for lon in (-60.0, 0.0, 60.0) for lat in (0.0, 60.0) for d in days]
    series = spark.createDataFrame(rows, "lon double, lat double, day date, v double")
    events = spark.createDataFrame([(1, event, 0.0, 0.0), (2, event, 170.0, -85.0)], "event int, date date, lon double, lat double")
    counts = {(r["event"], r["kind"], r["shift"]): (r["flagged"], r["days"]) for r in windows.anomalous_days(windows.study_sites(events, config), series, 60.0, "v", config).collect()}
    assert len(counts) == 2 * (2 + 3) and counts[1, "event", 0][1] == 10 and counts[1, "event", 0][0] > counts[1, "twin", 0][0]
    assert counts[2, "event", 0] == (0, 0) and counts[1, "placebo", 120] == (0, 0)
    study = {r["event"]: r for r in windows.precursor_study(events, series, 60.0, "v", config).collect()}
    assert study[1]["flagged"] == counts[1, "event", 0][0] and study[2]["p"] == 1.0
    assert study[1]["share_below"] == pytest.approx(sum(counts[1, "placebo", k][0] < counts[1, "event", 0][0] for k in config.shifts) / 3)


def test_interpolation_wraps_and_renormalises(spark):
    series = spark.createDataFrame([(-180.0, 0.0, DAY, 8.0), (120.0, 0.0, DAY, 2.0), (120.0, 60.0, DAY, None)], "lon double, lat double, day date, v double")
    sites = spark.createDataFrame([(k, "event", 0, lon, lat, DAY, DAY, DAY + dt.timedelta(1)) for k, lon, lat in ((0, 150.0, 0.0), (1, 135.0, 15.0), (2, 120.0, 0.0), (3, -30.0, 0.0))], "event int, kind string, shift int, lon double, lat double, origin date, start date, end date")
    got = {r["event"]: r["v"] for r in windows.at_sites(sites, series, 60.0, "v").collect()}
    assert got.keys() == {0, 1, 2} and (got[0], got[1], got[2]) == (pytest.approx(5.0), pytest.approx(0.75 * 2 + 0.25 * 8), 2.0)


def in_ring(ring, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
            inside = not inside
    return inside


@pytest.mark.parametrize("part_rows", [3, 100_000])
def test_places_in_footprints_against_all_pairs(spark, part_rows):
    rng = random.Random(6)
    places = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(150)] + [(150, -180.0, -90.0), (151, 180.0, 90.0), (152, None, 1.0)] + [(200 + i, 10.2 + i / 100, 5.1) for i in range(10)]
    prints = []
    for i in range(200):
        x, y, k = (10, 5, 0.5) if i % 3 == 0 else (rng.uniform(-175, 175), rng.uniform(-85, 85), rng.choice((0.01, 1, 20, 170)))
        prints.append((i, [(x - k, y - k / 3), (x + k, y - k / 4), (x + k / 2, y + k / 2), (x - k, y + k / 5)]))
    prints += [(300, []), (301, None), (302, [(1.0, 1.0)])]
    a = spark.createDataFrame(places, "place int, lon double, lat double")
    b = spark.createDataFrame([(i, [{"x": float(p[0]), "y": float(p[1])} for p in r] if r is not None else None) for i, r in prints], "item int, footprint array<struct<x: double, y: double>>")
    met = spatial.places_in_footprints(a, b, part_rows=part_rows)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((p, i) for p, x, y in places if x is not None for i, r in prints if r and in_ring(r, x, y))
    assert sorted((r["place"], r["item"]) for r in met.collect()) == want and len(want) > 200


def test_repeated_shapes_and_places_meet_once(spark, monkeypatch):
    """Totals count every row, but copies of a place or of a ring don't multiply the pairs that are tested."""
    ring = lambda k: [{"x": float(x), "y": float(y)} for x, y in ((-k, -k), (k, -k), (k, k), (-k, k))]
    places = spark.createDataFrame([(i, i % 3 * 4.0, 0.5) for i in range(60)] + [(60, None, 0.5)], "place int, lon double, lat double")
    prints = spark.createDataFrame([(i, ring((3, 6)[i % 2])) for i in range(400)] + [(400, None)], "item long, footprint array<struct<x: double, y: double>>")
    pairs, plain = [], spatial.places_in_footprints
    monkeypatch.setattr(spatial, "places_in_footprints", lambda *a, **k: pairs.append(plain(*a, **k)) or pairs[-1])
    got = {r["place"]: (r["n"], r["first_key"], r["key_sum"]) for r in spatial.footprint_totals(places, prints, "item").collect()}
    odd, both = (200, 1, sum(range(1, 400, 2))), (400, 0, sum(range(400)))
    assert got == {i: (both, odd, None)[i % 3] for i in range(60) if i % 3 < 2} and pairs[0].count() == 3


def test_many_pages_share_partitions(spark, tmp_path):
    """Partitions follow the rows; a thousand small pages are no thousand tasks, and none is lost or read twice."""
    pages.register(spark)
    at = str(tmp_path / "many")
    df = spark.range(3001).select(F.col("id").cast("string").alias("scene_id"), F.timestamp_seconds("id").alias("ts"), F.lit(1.0).alias("cloud"), F.lit("T").alias("tile"), *(F.col("id").cast("double").alias(c) for c in ("west", "south", "east", "north")))
    df.repartition(3, "scene_id").write.format("catalogue_pages").option("page_size", 3).mode("append").save(at)
    got = spark.read.format("catalogue_pages").load(at)
    assert got.rdd.getNumPartitions() == pages.SPREAD and got.exceptAll(df).count() == 0 and got.count() == 3001


def test_cells_follow_the_z_order_curve(spark):
    x, y = 0b1011, 0b0110
    want = sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(16))
    assert spark.range(1).select(spatial.interleaved(F.lit(x), F.lit(y))).first()[0] == want
    full = (1 << 16) - 1
    assert spark.range(1).select(spatial.interleaved(F.lit(full), F.lit(full))).first()[0] == (1 << 32) - 1
    cells = spatial.covered(spark.createDataFrame([(-180.0, -90.0, 180.0, 90.0), (0.1, 0.1, 0.2, 0.2), (5.0, 5.0, 5.0, 5.0)], "west double, south double, east double, north double"))
    assert max(r["count"] for r in cells.groupBy("west").count().collect()) <= 4


def test_raster_in_many_boxes(spark):
    rng = random.Random(3)
    spec, size = grid.GridSpec(10.0, 50.0, 0.5, 30, 24), 8
    value = {(r, c): float(r * 100 + c) if rng.random() < 0.9 else float("nan") for r in range(32) for c in range(24)}
    tiles = [("a", tr, tc, [value[tr * 8 + i // 8, tc * 8 + i % 8] for i in range(64)]) for tr in range(4) for tc in range(3)]
    boxes = [(i, w, s, w + rng.choice((0.0, 0.3, 4, 40)), s + rng.choice((0.0, 0.7, 6, 40))) for i, (w, s) in enumerate((rng.uniform(-5, 25), rng.uniform(20, 55)) for _ in range(40))]
    got = spatial.raster_in_boxes(spark.createDataFrame(tiles, "raster_id string, tile_row int, tile_col int, data array<float>"), spec, spark.createDataFrame(boxes, "box int, west double, south double, east double, north double"), ["box"], size)
    inside = lambda r, c, b: b[1] <= 10 + (c + 0.5) / 2 <= b[3] and b[2] <= 50 - (r + 0.5) / 2 <= b[4]
    want = {(b[0], r, c): None if math.isnan(v) else v for (r, c), v in value.items() if r < 30 for b in boxes if inside(r, c, b)}
    rows = got.collect()
    assert len(rows) == len(want) and {(r["box"], r["row"], r["col"]): r["v"] for r in rows} == want


@pytest.mark.parametrize("held, accuracy", [(1, 20), (50, 100), (20_000, 10_000)])
@pytest.mark.parametrize("kind", ["spread", "ties", "two", "one", "huge"])
def test_quantiles_are_exact(spark, held, accuracy, kind):
    rng = random.Random(8)
    draw = {"spread": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randrange(6)), "two": lambda: rng.choice((1.0, 2.0)), "one": lambda: 7.0, "huge": lambda: rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300)}[kind]
    values = [draw() for _ in range(701)]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "v double").repartition(3)
    shares = [0.0, 0.1, 0.5, 0.73, 1.0]
    n = len(values) - 1
    ordered = sorted(values)
    want = [(math.ceil(s * n) - s * n or 1.0) * ordered[math.floor(s * n)] + (s * n - math.floor(s * n)) * ordered[math.ceil(s * n)] for s in shares]
    assert quantiles.quantiles(df, "v", shares, held, accuracy) == pytest.approx(want, rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles.quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]
    out = harmonic.with_robust_z(spark.createDataFrame([(None,)], "v double"), "v", 3.0).first()
    assert out["z"] is None and out["anomaly"] is None


def test_fits_per_key(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key in ("a", "b", None):
        for i in range(40):
            x, z = rng.normal(), rng.normal() * 1e6
            rows.append((key, 1, float(x), float(z), float(3 * x - z / 1e5 + rng.normal() + (5 if key else 0)) if i % 9 else None, i))
    rows += [("flat", 1, 2.0, 2.0, float(i), i) for i in range(6)] + [("none", 1, 1.0, 1.0, None, i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, g int, x double, z double, y double, i int").repartition(3)
    got = {(r["k"], r["i"]): r for r in harmonic.with_fit(df, ["k", "g"], [F.lit(1.0), F.col("x"), F.col("z")], "y").collect()}
    assert len(got) == len(rows)
    for key in ("a", "b", None, "flat"):
        own = [r for r in rows if r[0] == key and r[4] is not None]
        m = np.array([[1.0, r[2], r[3]] for r in own])
        fitted = m @ np.linalg.lstsq(m, np.array([r[4] for r in own]), rcond=None)[0]
        assert [got[key, r[5]]["expected"] for r in own] == pytest.approx(fitted.tolist(), rel=1e-6, abs=1e-6)
    assert all(got["none", i]["expected"] is None for i in range(3))


def test_seasonal_anomalies_per_key_equal_single_fits(spark):
    rng = random.Random(5)
    rows = [(k, doy, (3 + k) * math.cos(doy / 58.1) + rng.gauss(0, 1) + (30 if (k, doy) == (1, 183) else 0)) for k in range(3) for doy in range(1, 365, 14)] + [(9, d, 1.0) for d in range(4)]
    df = spark.createDataFrame(rows, "k int, doy int, v double")
    config = HarmonicConfig()
    got = {(r["k"], r["doy"]): r for r in harmonic.seasonal_anomalies(df, ["k"], "doy", "v", config).collect()}
    assert {k for k, _ in got} == {0, 1, 2} and got[1, 183]["anomaly"]
    for k in range(3):
        for r in harmonic.seasonal_anomaly(df.filter(F.col("k") == k), "doy", "v", config).collect():
            assert (got[k, r["doy"]]["expected"], got[k, r["doy"]]["z"]) == (pytest.approx(r["expected"], abs=1e-6), pytest.approx(r["z"], abs=1e-4))


def test_placebo_rank_counts(spark):
    rows = [("a", True, 5.0), ("a", False, 1.0), ("a", False, 5.0), ("a", False, 9.0), ("b", False, 1.0), ("c", True, 2.0), ("d", True, 3.0), ("d", False, None)]
    got = {r["k"]: r for r in detectors.placebo_rank(spark.createDataFrame(rows, "k string, e boolean, v double"), "k", F.col("e"), "v").collect()}
    assert (got["a"]["share_below"], got["b"]["share_below"], got["c"]["share_below"], got["d"]["share_below"]) == (pytest.approx(1 / 3), 0.0, None, None)
    assert got["a"]["offset_se"] == pytest.approx(0.0) and got["b"]["observed"] is None


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master, fails in (("spark://h:7077", True), ("local-cluster[2,1,512]", True), ("local[2]", False), ("local", False)):
        context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None, master=master)
        session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d))
        if fails:
            with pytest.raises(ValueError):
                storage.shared_dir(session)
        else:
            assert os.path.isdir(storage.shared_dir(session).removeprefix("file://"))
