"""Small-baseline displacement inversion, in stacks of pixels that share their pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.config import InversionConfig


def coherence_means(layers: DataFrame, keys: list[str], coh: str) -> DataFrame:
    """Two means that differ on purpose: over all layers (gate), and over positive ones (reference)."""
    c = F.coalesce(F.col(coh), F.lit(0.0))
    gate = F.when(F.count(coh) == F.count(F.lit(1)), F.avg(coh))
    return layers.groupBy(*keys).agg(gate.alias("mean_all"), (F.sum(c) / F.greatest(F.count_if(F.col(coh) > 0), F.lit(1))).alias("mean_positive"))


def reference_pixel(means: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """The pixel with the highest positive mean; the first in row-major order wins ties."""
    return means.orderBy(F.col("mean_positive").desc_nulls_last(), F.col(row), F.col(col)).limit(1)


def referenced(layers: DataFrame, reference: DataFrame, layer: list[str], pixel: list[str], v: str) -> DataFrame:
    """Every layer minus its value at the reference pixel; a layer without one is NULL throughout."""
    base = layers.join(F.broadcast(reference.select(*pixel)), pixel).select(*layer, F.col(v).alias("_ref"))  # reference is one row
    return layers.join(base, layer, "left").withColumn(v, F.col(v) - F.col("_ref")).drop("_ref")


def zero_unreliable(layers: DataFrame, coh: str, component: str) -> DataFrame:
    return layers.withColumn(coh, F.when(F.col(component).isNull() | (F.col(component) > 0), F.col(coh)).otherwise(0.0))


STACKED = 1 << 22  # numbers in a stack of designs that is solved at a time


def solve_stack(g: np.ndarray, d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Minimum-norm least squares of pixels that share the design g: d and w are (pixels, pairs). Rows and data are
    scaled by w, so squared misfits weigh w**2. Singular values count as zero as in a single least-squares solve."""
    pairs, unknowns = g.shape
    step = max(1, STACKED // max(1, pairs * unknowns))
    out = [np.zeros((0, unknowns))]
    for k in range(0, len(d), step):
        inverse = np.linalg.pinv(g * w[k : k + step, :, None], rcond=np.finfo(float).eps * max(pairs, unknowns))
        out.append((inverse @ (d * w)[k : k + step, :, None])[:, :, 0])
    return np.concatenate(out)


def invert(obs: DataFrame, n_epochs: int, config: InversionConfig = InversionConfig()) -> DataFrame:
    """obs(pixel, ref_epoch, sec_epoch, disp, coh) -> (pixel, epoch, disp, n_obs), relative to epoch 0.

    A pixel's observations are collected to one row (at most the network's pairs); of an Arrow batch, the pixels that have
    the same pairs are solved as one stack. Pixels that fail the coherence gate, or have fewer usable pairs than unknowns, give no
    rows. NaN counts as missing.
    """
    obs = obs.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("disp", "coh")})
    good = (F.col("coh") > config.min_coherence) & F.col("disp").isNotNull()
    gate = (F.count("coh") == F.count(F.lit(1))) & (F.avg("coh") > config.min_mean_coherence)
    item = F.struct(F.col("ref_epoch").cast("int").alias("ref"), F.col("sec_epoch").cast("int").alias("sec"), F.col("disp").cast("double").alias("disp"), F.col("coh").cast("double").alias("coh"))
    pixels = obs.groupBy("pixel").agg(F.sort_array(F.collect_list(F.when(good, item))).alias("obs"), gate.alias("ok")).filter("ok").select("pixel", "obs").filter(F.size("obs") >= n_epochs - 1)
    zero = config.orphan == "zero"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            ref, sec, disp, coh = (c.to_numpy() for c in lists.flatten().flatten())
            pairs = np.stack([ref, sec], 1).astype(np.int32)
            kind = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(first * 8), pa.py_buffer(pairs)]).dictionary_encode().indices.to_numpy()
            value = np.zeros((batch.num_rows, n_epochs))
            known = np.zeros((batch.num_rows, n_epochs), np.int32)
            for k in range(int(kind.max(initial=-1)) + 1):  # sets of pairs, not pixels
                own = np.flatnonzero(kind == k)
                n = int(first[own[0] + 1] - first[own[0]])
                a, b = pairs[first[own[0]] : first[own[0]] + n].T
                g = np.zeros((n, n_epochs))
                g[np.arange(n), a], g[np.arange(n), b] = -1, 1
                at = first[own][:, None] + np.arange(n)
                value[own, 1:] = solve_stack(g[:, 1:], disp[at], coh[at])
                known[own] = np.bincount(np.concatenate([a, b]), minlength=n_epochs)
            missing = (known == 0) & (np.arange(n_epochs) > 0) & (not zero)
            each = pa.array(np.repeat(np.arange(batch.num_rows), n_epochs))
            epochs = pa.array(np.tile(np.arange(n_epochs, dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(each), epochs, pa.array(value.ravel(), mask=missing.ravel()), pa.array(known.ravel())], ["pixel", "epoch", "disp", "n_obs"])

    return pixels.mapInArrow(run, f"pixel {obs.schema['pixel'].dataType.simpleString()}, epoch int, disp double, n_obs int")


def rank_in(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
