import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.config import ChangeConfig, InversionConfig
from orbitframe.functions import scalars
from orbitframe.operators import change, components, detectors, grid, harmonic, sbas, select, stats, textlint, trend, zonal
from orbitframe.sources import readers, sinks
from tests import golden


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def network(n):
    return [(i, j) for i in range(n) for j in (i + 1, i + 2) if j < n]


@pytest.mark.parametrize("n", [2, 3, 7])
def test_network_has_2n_minus_3_pairs(spark, n):
    d = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(12 * i),) for i in range(n)], "date date")
    assert select.pair_network(select.epochs(d)).count() == 2 * n - 3


def test_first_wins_ties_under_any_partitioning(spark):
    rows = [(dt.datetime(2020, 1, 1 + i), 10.0, i) for i in range(20)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "ts timestamp, cloud double, seq long").repartition(parts)
        assert [r["seq"] for r in select.clearest_per_month(df, "ts", "cloud", "seq").collect()] == [0]


def test_inversion_recovers_noise_free_series(spark):
    rng = random.Random(1)
    truth = [0.0, *(rng.uniform(-5, 5) for _ in range(6))]
    rows = [(p, i, j, truth[j] - truth[i], rng.uniform(0.45, 1)) for p in range(3) for i, j in network(7)]
    df = spark.createDataFrame(rows, "pixel long, ref_epoch int, sec_epoch int, disp double, coh double")
    got = {(r["pixel"], r["epoch"]): r["disp"] for r in sbas.invert(df, 7).collect()}
    assert len(got) == 21 and all(abs(v - truth[e]) < 1e-9 for (_, e), v in got.items())


def test_orphan_epochs(spark):
    pairs = [(0, 1, 1.0), (0, 1, 1.0), (1, 3, 1.0), (0, 3, 2.0)]
    df = spark.createDataFrame([(0, i, j, d, 0.9) for i, j, d in pairs], "pixel long, ref_epoch int, sec_epoch int, disp double, coh double")
    assert [r["disp"] for r in sbas.invert(df, 4).orderBy("epoch").collect()][2] is None
    zero = [r["disp"] for r in sbas.invert(df, 4, InversionConfig(orphan="zero")).orderBy("epoch").collect()]
    assert zero[2] == pytest.approx(0.0, abs=1e-12) and zero[3] == pytest.approx(2.0)


def test_the_two_coherence_means_differ(spark):
    df = spark.createDataFrame([(0, None), (0, 0.5), (1, 0.0), (1, 0.5)], "p long, coh double")
    got = {r["p"]: (r["mean_all"], r["mean_positive"]) for r in sbas.coherence_means(df, ["p"], "coh").collect()}
    assert got == {0: (None, 0.5), 1: (0.25, 0.5)}


def test_mad_has_a_floor(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "r double")
    assert {r["z"] for r in harmonic.with_robust_z(df, "r", 3.0).collect()} == {0.0}


def test_z_is_invariant_to_affine_scaling(spark):
    rows = [(float(x),) for x in (1, 2, 4, 7, 30)]
    a = spark.createDataFrame(rows, "r double")
    z = lambda d: [round(r["z"], 9) for r in harmonic.with_robust_z(d, "r", 3.0).orderBy("r").collect()]
    assert z(a) == z(a.select((F.col("r") * 5 + 3).alias("r")))


def brute_labels(cells):
    left, out = set(cells), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            r, c = todo.pop()
            group.append((r, c))
            for n in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out |= dict.fromkeys(group, min(group))
    return out


@pytest.mark.parametrize("tile", [3, 64])
def test_labels_equal_flood_fill(spark, tile):
    rng = random.Random(tile)
    cells = {(rng.randrange(14), rng.randrange(14)) for _ in range(80)}
    df = spark.createDataFrame(sorted(cells), "row int, col int")
    got = {(r["row"], r["col"]): (r["label"] >> 32, r["label"] & 0xFFFFFFFF) for r in components.label_cells(df, tile).collect()}
    assert got == brute_labels(cells)


def test_hysteresis_needs_a_seed_and_enough_cells(spark):
    blob = lambda r0, n, v: [(r0, c, v) for c in range(n)]
    rows = blob(0, 9, -3.5) + blob(5, 8, -3.2) + [(6, 8, -5.0)] + blob(10, 7, -5.0)
    df = spark.createDataFrame(rows, "row int, col int, v double")
    got = change.hysteresis_clusters(df, "v", ChangeConfig()).collect()
    assert [(r["size"], r["peak"]) for r in got] == [(9, -5.0)] and got[0]["score"] == round(5 * math.log1p(9), 2)


def test_lowest_rank_wins_not_the_nearest(spark):
    cand = spark.createDataFrame([(0.0001, 0.0, 2), (0.002, 0.0, 1), (1.0, 1.0, 0)], "lat double, lon double, rank int")
    sites = spark.createDataFrame([("a", 0.0, 0.0), ("b", 50.0, 0.0)], "site string, lat double, lon double")
    got = {r["site"]: r["rank"] for r in change.truth_check(cand, sites).collect()}
    assert got == {"a": 1, "b": None}


@pytest.mark.parametrize("lat", [0.0, 22.3, -60.0, 89.995])
def test_truth_check_against_all_pairs(spark, lat):
    rng = random.Random(int(lat))
    wide = 0.008 / max(math.cos(math.radians(lat)), 1e-3)
    at = lambda: (lat + rng.uniform(-0.008, 0.004), 10 + rng.uniform(-wide, wide))
    cand = [(*at(), i) for i in range(300)] + [(None, 10.0, 300), (float("nan"), 10.0, -1), (lat, 10.0, None)]
    cand += [(*cand[7][:2], 301)]
    sites = [(i, *at()) for i in range(200)] + [(200, None, 10.0), (201, lat - 3.0, 10.0)]
    a, b = spark.createDataFrame(cand, "lat double, lon double, rank int"), spark.createDataFrame(sites, "site int, lat double, lon double")
    metres = lambda y, x, sy, sx: math.hypot((y - sy) * 111320, (x - sx) * 111320 * math.cos(math.radians(sy)))
    for radius in (300.0, 40.0):
        want = {s: min(((r, metres(y, x, sy, sx)) for y, x, r in cand if None not in (y, r, sy) and metres(y, x, sy, sx) <= radius), default=(None, None)) for s, sy, sx in sites}
        got = {r["site"]: (r["rank"], r["dist_m"]) for r in change.truth_check(a, b, radius).collect()}
        assert {s: r for s, (r, _) in got.items()} == {s: r for s, (r, _) in want.items()} and sum(r is not None for r, _ in want.values()) > 15
        assert all(d is None or d == pytest.approx(want[s][1]) for s, (_, d) in got.items())


def test_truth_check_of_a_crowd_tests_few_pairs(spark):
    """Ten thousand candidates around one place: the rows that its joins put out grow with the rows, not with the pairs."""
    n = 10_000
    df = spark.range(n).select(F.col("id").alias("site"), (22.3 + F.col("id") % 101 / 40000).alias("lat"), (114.2 + F.col("id") % 97 / 40000).alias("lon"), F.col("id").alias("rank"))
    out = change.truth_check(df.drop("site"), df.drop("rank"))
    assert out.filter("rank IS NULL").count() == 0
    out.collect()
    queue, most = [out._jdf.queryExecution().executedPlan()], 0
    while queue:
        p = queue.pop()
        queue += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
        m = p.metrics().get("numOutputRows")
        most = max(most, m.get().value() if m.isDefined() else 0)
    assert n <= most < 60 * n


def test_fisher_exact_by_enumeration(spark):
    for a, b, c, d in ((3, 1, 1, 3), (0, 5, 5, 0), (2, 2, 2, 2), (0, 0, 3, 4)):
        ways = {x: math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
        want = sum(w for w in ways.values() if w <= ways[a]) / sum(ways.values())
        got = one(spark, stats.fisher_exact(*(F.lit(v) for v in (a, b, c, d))).alias("p"))["p"]
        assert got == pytest.approx(want)


def test_gradient_is_one_sided_at_edges(spark):
    df = spark.createDataFrame([(0, c, float(c * c)) for c in range(4)], "row int, col int, v double")
    assert [r["d_col"] for r in change.gradient(df, "v").orderBy("col").collect()] == [1.0, 2.0, 4.0, 5.0]


def test_style_blocks_and_headings(spark):
    text = "plain a — b\n<style>x — y</style>\n<style>\nc — d\n</style>\n<h1>Name — place</h1>\nit is not just this\nok"
    df = spark.createDataFrame([("f", text), ("none", None)], "path string, content string")
    assert [(r["line"], r["rule"]) for r in textlint.lint(df).orderBy("line").collect()] == [(1, 0), (7, 2)]


def test_utm_round_trip(spark):
    x, y = scalars.utm_from_lonlat(F.lit(114.2), F.lit(22.3), 50)
    row = one(spark, x.alias("x"), y.alias("y"))
    lon, lat = scalars.lonlat_from_utm(F.lit(row["x"]), F.lit(row["y"]), 50)
    back = one(spark, lon.alias("lon"), lat.alias("lat"))
    assert back["lon"] == pytest.approx(114.2, abs=1e-8) and back["lat"] == pytest.approx(22.3, abs=1e-8)


def test_bilinear_and_grid(spark):
    spec = grid.GridSpec.covering(0, 0, 3, 3, 1)
    px = spec.cells(spark).withColumn("v", F.col("col") * 10.0 + F.col("row"))
    pts = spark.createDataFrame([(1, 1.0, 2.0), (2, 0.5, 2.5), (3, 9.0, 9.0)], "id int, x double, y double")
    got = {r["id"]: r["v"] for r in grid.bilinear(pts, px, spec, "v").collect()}
    assert got == {1: 5.5, 2: 0.0, 3: None}


def test_sustained_runs(spark):
    df = spark.createDataFrame([("a", i, i in (1, 2, 3, 7, 8)) for i in range(10)], "k string, step long, flag boolean")
    assert [(r["first_step"], r["length"]) for r in detectors.sustained_runs(df, ["k"], "step", "flag").collect()] == [(1, 3)]


def test_missing_day_is_never_quiet(spark):
    df = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "day string")
    kp = spark.createDataFrame([("d1", 1.0), ("d2", 5.0)], "day string, level double")
    assert [r["day"] for r in detectors.quiet_only(df, kp, "day", "level", 3.0).collect()] == ["d1"]


def test_product_names_manifest_and_json(spark):
    df = spark.createDataFrame([("/x/A_20200101_20200113/f.tif",), ("/x/A_20200101/f.tif",)], "path string")
    assert [(str(r["ref"]), str(r["sec"])) for r in readers.product_dates(df).collect()] == [("2020-01-01", "2020-01-13")]
    old = spark.createDataFrame([("a", "1")], "ref string, job string")
    new = spark.createDataFrame([("a", "2"), ("b", "3")], "ref string, job string")
    assert sorted(r["job"] for r in sinks.merged_manifest(old, new, ["ref"]).collect()) == ["1", "3"]


def test_guards(spark):
    with pytest.raises(ValueError):
        select.require_rows(spark.range(3), 8, "scenes")
    a, b = (spark.createDataFrame([(d,) for d in ds], "date string") for ds in (["1"], ["1", "2"]))
    with pytest.raises(ValueError):
        select.require_dates(a, "date", b)


def test_spans_is_exclusive(spark):
    f = lambda a, b: one(spark, zonal.spans(F.lit(a), F.lit(b), F.lit(5)).alias("x"))["x"]
    assert f(4, 6) and not f(5, 6) and not f(4, 5)


def test_harmonic_fit_equals_lstsq(spark):
    rng = np.random.default_rng(0)
    rows = [(int(d), float(v)) for d, v in zip(rng.integers(1, 366, 40), rng.normal(size=40), strict=True)]
    df = spark.createDataFrame(rows, "doy int, y double")
    got = harmonic.least_squares(df, harmonic.design(F.col("doy"), 2), "y")
    w = 2 * np.pi / 365.25
    x = np.array([[1, *(g(k * w * d) for k in (1, 2) for g in (np.cos, np.sin))] for d, _ in rows])
    assert np.allclose(got, np.linalg.lstsq(x, np.array([v for _, v in rows]), rcond=None)[0])


def test_inversion_takes_nan_for_missing(spark):
    """A NaN coherence fails the pixel's gate, as a missing one does; a NaN displacement is one observation less."""
    nan, pairs = float("nan"), [(0, 1), (1, 2), (0, 2), (2, 3), (1, 3)]
    rows = [(p, a, b, nan if (p, a, b) == (2, 0, 2) else float(b - a), nan if (p, a, b) == (1, 1, 2) else 0.9) for p in range(3) for a, b in pairs]
    got = sbas.invert(spark.createDataFrame(rows, "pixel int, ref_epoch int, sec_epoch int, disp double, coh double"), 4).collect()
    assert {r["pixel"] for r in got} == {0, 2} and all(abs(r["disp"] - r["epoch"]) < 1e-9 for r in got)


def test_lint_snippets_and_line_ends(spark):
    text = "one\x0btwo\u2028\t\t we delve here \u00a0\t\r\nplain\x85a robust thing"
    got = {(r["line"], r["snippet"]) for r in textlint.lint(spark.createDataFrame([("f", text)], "path string, content string")).collect()}
    assert got == {(3, "we delve here"), (5, "a robust thing")}
    assert [r["raw"] for r in textlint.lines_of(spark.createDataFrame([("f", text)], "path string, content string")).orderBy("line").collect()] == text.splitlines()


def test_published_seasonal_baseline(spark):
    rows = [(dt.date.fromisoformat(d), doy, v) for d, doy, v, _, _ in golden.SEASONAL]
    got = harmonic.seasonal_anomaly(spark.createDataFrame(rows, "date date, doy int, v double"), "doy", "v").orderBy("date").collect()
    assert [r["date"] for r in got if r["anomaly"]] == [dt.date(2025, 5, 9)]
    for r, (_, _, _, expected, z) in zip(got, sorted(golden.SEASONAL), strict=True):
        assert r["expected"] == pytest.approx(expected, abs=6e-4) and r["z"] == pytest.approx(z, abs=6e-3)


def test_published_trend(spark):
    df = spark.createDataFrame([(dt.date.fromisoformat(d), v) for d, v in golden.DISPLACEMENT], "date date, v double")
    r = trend.trends(df.withColumn("t", scalars.year_fraction(F.col("date"))).withColumn("k", F.lit(0)), ["k"], "t", "v").first()
    assert r["n"] == 37 and r["slope"] == pytest.approx(0.01, abs=0.006) and r["scatter"] == pytest.approx(2.33, abs=0.006)


def test_published_scores(spark):
    df = spark.createDataFrame([(float(p), a // 100, s) for p, a, s in golden.SCORES], "peak double, size int, score double")
    assert all(abs(r["got"] - r["score"]) < 0.03 for r in df.withColumn("got", scalars.cluster_score(F.col("peak"), F.col("size"))).collect())


def test_too_short_a_series_is_an_error(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(9)], "doy int, v double")
    with pytest.raises(ValueError, match="9 rows"):
        harmonic.seasonal_anomaly(df, "doy", "v")


def test_ring_of_any_shape(spark):
    hollow = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]  # a notch from above
    df = spark.createDataFrame([([dict(x=x, y=y) for x, y in hollow],), ([],), (None,)], "ring array<struct<x: double, y: double>>")
    at = lambda x, y: [r[0] for r in df.select(readers.in_ring(F.col("ring"), F.lit(x), F.lit(y))).collect()]
    assert at(2.0, 0.5) == [True, False, None] and at(2.0, 2.0)[0] is False and at(0.5, 2.0)[0] is True and at(5.0, 1.0)[0] is False


def test_noise_weighs_by_coherence_squared(spark):
    obs = [(0, 1, 1.0, 0.9), (0, 1, 2.0, 0.5), (1, 2, 1.0, 0.8)]
    df = spark.createDataFrame([(0, *o) for o in obs], "pixel long, ref_epoch int, sec_epoch int, disp double, coh double")
    got = [r["disp"] for r in sbas.invert(df, 3).orderBy("epoch").collect()]
    first = (0.81 * 1.0 + 0.25 * 2.0) / (0.81 + 0.25)
    assert got == pytest.approx([0.0, first, first + 1.0])


def test_nan_coherence_fails_the_gates(spark):
    obs = [(p, i, j, 1.0, math.nan if p == 1 and i == 0 else 0.9) for p in (0, 1) for i, j in network(3)]
    df = spark.createDataFrame(obs, "pixel long, ref_epoch int, sec_epoch int, disp double, coh double")
    assert {r["pixel"] for r in sbas.invert(df, 3).collect()} == {0}


def test_change_that_stays_and_change_that_does_not(spark):
    """Two blocks fall on the first pass afterwards; one recovers. Equal places in two groups stay apart, flat ground is left out."""
    rows = []
    for g in ("a", "b"):
        for s in range(6):
            for r in range(10):
                for c in range(10):
                    low = g == "a" and ((r < 3 and c < 3 and s >= 3) or (r > 6 and c > 6 and s == 3))
                    rows.append((g, s, s >= 3, r, c, 0.1 if low else 1.0, 1.0))
    passes = spark.createDataFrame(rows, "group string, seq int, is_post boolean, row int, col int, vh double, vv double")
    terrain = spark.createDataFrame([(r, c, 5.0 if r == 0 and c == 0 else 20.0) for r in range(10) for c in range(10)], "row int, col int, slope_deg double")
    got = {(x["kind"], x["group"], x["size"], x["label"] >> 32) for x in change.persistent_change(passes, terrain, ("b", "a")).collect()}
    assert got == {("rapid", "a", 8, 0), ("rapid", "a", 9, 7), ("confirmed", "a", 8, 0)}


def test_ranks_over_ranges(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1009).repartition(7)
    got = [r["k"] for r in select.ordered_rank(df, ["k"]).orderBy("rank").collect()]
    assert got == sorted(got) and [r["rank"] for r in select.ordered_rank(df, ["k"]).orderBy("rank").collect()] == list(range(1, 1001))
