"""Resampling that widens, stacked inversions, keyed streams, the layer cache and files that can't be decoded."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.config import InversionConfig, TrailingConfig
from orbitframe.operators import detectors, grid, sbas
from orbitframe.sources import readers, sinks
from orbitframe.streaming import keyed


@pytest.mark.parametrize("shape, out", [((30, 24), (8, 7)), ((10, 10), (10, 10)), ((4, 5), (9, 11)), ((37, 1), (10, 1))])
def test_resampling_by_weights_of_both_axes(spark, shape, out):
    rng = np.random.default_rng(1)
    v = np.where(rng.random(shape) < 0.7, rng.normal(size=shape), np.nan)
    v[: shape[0] // 3] = np.nan
    pixels = spark.createDataFrame([(r, c, None if np.isnan(v[r, c]) else float(v[r, c])) for r in range(shape[0]) for c in range(shape[1])], "row int, col int, v double")

    def weights(n, m):
        at, reach = (np.arange(m) + 0.5) * n / m - 0.5, max(1.0, n / m)
        return np.maximum(0, 1 - abs(np.arange(n)[None] - at[:, None]) / reach)

    a, b, known = weights(shape[0], out[0]), weights(shape[1], out[1]), ~np.isnan(v)
    with np.errstate(invalid="ignore"):
        want = (a @ np.where(known, v, 0) @ b.T) / (a @ known @ b.T)
    got = {(r["row"], r["col"]): r["v"] for r in grid.resampled(pixels, shape, out, "v").collect()}
    assert len(got) == out[0] * out[1]
    for (r, c), x in got.items():
        assert (x is None) == bool(np.isnan(want[r, c])) and (x is None or x == pytest.approx(want[r, c]))


def test_every_cell_counts_when_reading_down(spark):
    """A single bright pixel is seen whatever the factor; samples of four neighbours would miss it."""
    pixels = spark.createDataFrame([(r, c, 1.0 if (r, c) == (13, 17) else 0.0) for r in range(37) for c in range(37)], "row int, col int, v double")
    got = grid.resampled(pixels, (37, 37), (10, 10), "v").agg(F.sum("v")).first()[0]
    assert got == pytest.approx(100 / 37**2, rel=0.2)


def test_stacked_inversion_equals_single_solves(spark):
    rng = random.Random(3)
    n, rows, want = 7, [], {}
    network = [(i, j) for i in range(n) for j in (i + 1, i + 2) if j < n]
    for p in range(30):
        pairs = [x for x in network if p % 3 == 0 or x[0] != p % 5] if p % 4 else [x for x in network if 5 not in x]
        obs = [(a, b, rng.gauss(0, 1), rng.uniform(0.45, 1)) for a, b in pairs]
        rows += [(f"p{p}", *o) for o in obs]
        if len(obs) >= n - 1:
            g = np.zeros((len(obs), n))
            for k, (a, b, *_) in enumerate(obs):
                g[k, a], g[k, b] = -1, 1
            w, d = np.array([o[3] for o in obs]), np.array([o[2] for o in obs])
            want[f"p{p}"] = np.append(0, np.linalg.lstsq(g[:, 1:] * w[:, None], d * w, rcond=None)[0])
    df = spark.createDataFrame(rows, "pixel string, ref_epoch int, sec_epoch int, disp double, coh double").repartition(3)
    got = {}
    for r in sbas.invert(df, n, InversionConfig(orphan="zero")).collect():
        got.setdefault(r["pixel"], {})[r["epoch"]] = r["disp"]
    assert got.keys() == want.keys()
    for p, series in want.items():
        assert [got[p][k] for k in range(n)] == pytest.approx(series.tolist(), abs=1e-9)
    orphans = sbas.invert(df, n, InversionConfig()).filter("disp IS NULL").select("epoch").distinct().collect()
    assert [r[0] for r in orphans] == [5]


def test_stacks_are_bounded(monkeypatch):
    rng = np.random.default_rng(2)
    g, d, w = rng.normal(size=(9, 4)), rng.normal(size=(50, 9)), rng.uniform(0.3, 1, size=(50, 9))
    whole = sbas.solve_stack(g, d, w)
    monkeypatch.setattr(sbas, "STACKED", 100)
    assert np.allclose(sbas.solve_stack(g, d, w), whole) and np.allclose(whole[7], np.linalg.lstsq(g * w[7][:, None], d[7] * w[7], rcond=None)[0])


def run_stream(spark, tmp_path, frames, schema, make, name):
    """Feeds frames one micro-batch each and returns all rows given out."""
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k:03}")
        os.utime(next(os.path.join(f"{tmp_path}/{name}/{k:03}", f) for f in os.listdir(f"{tmp_path}/{name}/{k:03}") if f.endswith(".parquet")), (1_600_000_000 + 100 * k,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name).collect()


def test_late_events_give_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    events = [("ab"[k % 2], start + dt.timedelta(hours=rng.choice((1, 9)), days=d, minutes=k), rng.gauss(0, 1) * (9 if rng.random() < 0.1 else 1)) for k, d in enumerate(sorted(rng.choices(range(40), k=160)))]
    # Shuffled within a day and a half, in six deliveries; the last one only moves the watermark on.
    late = sorted(events, key=lambda e: e[1] + dt.timedelta(hours=rng.uniform(0, 36)))
    frames = [late[k : k + 32] for k in range(0, 160, 32)] + [[("end", start + dt.timedelta(days=100), 0.0)], [("end", start + dt.timedelta(days=101), 0.0)]]
    schema = "key string, ts timestamp, v double"
    config = TrailingConfig()
    got = [r for r in run_stream(spark, tmp_path, frames, schema, lambda s: keyed.trailing_exceedances(s, "key", "ts", "v", "3 days", 2, config), "late") if r["key"] != "end"]
    batch = spark.createDataFrame(events, schema).withColumn("slot", F.floor(F.hour("ts") / 2).cast("int"))
    want = detectors.trailing_quartiles(batch, ["key", "slot"], "ts", "v", config).collect()
    shape = lambda r: (r["key"], r["ts"], round(r["v"], 9), r["n_prior"], None if r["n_prior"] == 0 else round(r["lower"], 9), r["exceeds"])
    assert sorted(map(shape, got), key=str) == sorted(map(shape, want), key=str) and any(r["exceeds"] for r in want)


def test_batches_are_given_out_once_all_their_jobs_finish(spark, tmp_path):
    log = [(b, f"{b}{j}", s, q, n) for b, n in (("x", 3), ("y", 2), ("z", 2)) for j in range(n) for q, s in enumerate(("PENDING", "RUNNING", "FAILED" if j == 1 else "SUCCEEDED"))]
    log = [r for r in log if (r[1], r[3]) != ("z1", 2)]  # one job of z never ends
    rng = random.Random(1)
    shuffled = log + rng.choices(log, k=10)
    rng.shuffle(shuffled)
    frames = [shuffled[k : k + 7] for k in range(0, len(shuffled), 7)] + [log[:4]]
    got = run_stream(spark, tmp_path, frames, "batch string, job_id string, status string, seq long, jobs int", keyed.finished_batches, "jobs")
    assert sorted(map(tuple, got)) == [("x", 3, 2, 1), ("y", 2, 1, 1)]


def test_layers_are_made_once_and_a_lost_one_alone(spark, tmp_path):
    made = []

    def layer(name, value):
        def make():
            made.append(name)
            return spark.range(4).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.lit(value).alias("v"))

        return make

    compute = {"2024-01-01/VV": layer("2024-01-01/VV", 1.0), "b": layer("b", 2.0)}
    at = f"{tmp_path}/layers"
    first = sorted(map(tuple, sinks.cached_layers(spark, at, compute).select("layer", "row", "v").collect()))
    assert made == ["2024-01-01/VV", "b"] and first == sorted([("2024-01-01/VV", k, 1.0) for k in range(4)] + [("b", k, 2.0) for k in range(4)])
    kept = {f: os.stat(f"{at}/layer=b/{f}").st_mtime_ns for f in os.listdir(f"{at}/layer=b")}
    assert sorted(map(tuple, sinks.cached_layers(spark, at, compute).select("layer", "row", "v").collect())) == first and len(made) == 2
    lost = next(d for d in os.listdir(at) if d.startswith("layer=2024"))
    os.rename(f"{at}/{lost}", f"{tmp_path}/gone")
    assert sorted(map(tuple, sinks.cached_layers(spark, at, compute).select("layer", "row", "v").collect())) == first
    assert made[2:] == ["2024-01-01/VV"] and {f: os.stat(f"{at}/layer=b/{f}").st_mtime_ns for f in os.listdir(f"{at}/layer=b")} == kept


def test_files_that_cannot_be_decoded_are_left_out(spark, tmp_path):
    for name, raw in (("good.txt", "a ü\nb".encode()), ("bad.txt", b"a\xff\xfeb"), ("cut.txt", "é".encode()[:1]), ("empty.txt", b"")):
        (tmp_path / name).write_bytes(raw)
    got = {os.path.basename(r["path"]): r["content"] for r in readers.text_files(spark, str(tmp_path)).collect()}
    assert got == {"good.txt": "a ü\nb"}  # an empty file has no row, as it has no lines
