"""Seasonal baselines: harmonic least squares from moment sums, robust anomaly scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.config import HarmonicConfig
from orbitframe.functions.scalars import floored_mad, robust_z
from orbitframe.operators.quantiles import quantiles
from orbitframe.operators.select import require_rows


def design(doy: Column, harmonics: int) -> list[Column]:
    """1, then cos and sin of each harmonic of the year."""
    out = [F.lit(1.0)]
    for k in range(1, harmonics + 1):
        angle = doy * F.lit(2 * math.pi * k / 365.25)
        out += [F.cos(angle), F.sin(angle)]
    return out


def least_squares(df: DataFrame, columns: list[Column], y: str) -> np.ndarray:
    """Coefficients from one aggregate of moment sums; only (p + 1)**2 numbers leave the cluster, whatever the rows."""
    p = len(columns)
    names = [f"x{i}" for i in range(p)]
    x = df.filter(F.col(y).isNotNull()).select(*(c.alias(n) for c, n in zip(columns, names, strict=True)), F.col(y).alias("y"))
    names.append("y")
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i in range(p + 1) for j in range(i, p + 1) if (i, j) != (p, p)]
    row = x.agg(*sums).first()
    g = np.zeros((p, p + 1))
    for i in range(p):
        for j in range(i, p + 1):
            v = row[f"m{i}_{j}"] or 0.0
            g[i, j] = v
            if j < p:
                g[j, i] = v
    return np.linalg.lstsq(g[:, :p], g[:, p], rcond=None)[0]


def linear(columns: list[Column], coefficients: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, b in zip(columns, coefficients.tolist(), strict=True):
        out = out + c * F.lit(b)
    return out


def solved(p: int, keys: int):
    """Least squares of many groups at a time from their moment sums (keys, p * (p + 1) / 2 of x'x, p of x'y): coefficients of minimum norm."""
    upper = np.triu_indices(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[keys:]], 1) if batch.num_rows else np.zeros((0, len(upper[0]) + p))
            g = np.zeros((batch.num_rows, p, p))
            g[:, upper[0], upper[1]] = g[:, upper[1], upper[0]] = sums[:, : len(upper[0])]
            # Scaled to a unit diagonal first: columns of very different size then don't count as dependent.
            size = np.sqrt(np.einsum("kii->ki", g))
            size[size == 0] = 1.0
            b = np.linalg.pinv(g / size[:, :, None] / size[:, None, :], rcond=1e-12, hermitian=True) @ (sums[:, len(upper[0]) :] / size)[:, :, None]
            coefficients = pa.array(list(b[:, :, 0] / size), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], coefficients], [*batch.schema.names[:keys], "coefficients"])

    return run


def least_squares_by(df: DataFrame, keys: list[str], columns: list[Column], y: str) -> DataFrame:
    """(keys, coefficients): a fit per key. One partial aggregate of moment sums, then systems solved in stacks, a task's groups at a time."""
    p = len(columns)
    x = df.filter(F.col(y).isNotNull()).select(*keys, *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)), F.col(y).cast("double").alias("_y"))
    moments = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"b{i}") for i in range(p)]
    sums = x.groupBy(*keys).agg(*moments)
    schema = ", ".join([*(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys), "coefficients array<double>"])
    return sums.mapInArrow(solved(p, len(keys)), schema)


def with_fit(df: DataFrame, keys: list[str], columns: list[Column], y: str) -> DataFrame:
    """df with ``expected`` and ``residual`` of a fit per key. Keys that are NULL are groups too; a key without values has neither."""
    own = least_squares_by(df, keys, columns, y).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "coefficients")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = df.join(own, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))
    expected = sum((c * F.col("coefficients")[i] for i, c in enumerate(columns[1:], 1)), columns[0] * F.col("coefficients")[0])
    return joined.withColumn("expected", expected).withColumn("residual", F.col(y) - F.col("expected")).drop("coefficients")


def seasonal_anomalies(series: DataFrame, keys: list[str], doy: str, value: str, config: HarmonicConfig = HarmonicConfig()) -> DataFrame:
    """Seasonal anomalies of many series in one plan: a baseline, a median and a deviation per key; keys with too few rows are left out."""
    n = F.count(value).over(Window.partitionBy(*keys))
    enough = series.withColumn("_n", n).filter(F.col("_n") >= config.min_rows).drop("_n").withColumn(value, F.round(value, config.value_digits))
    fitted = with_fit(enough, keys, design(F.col(doy), config.harmonics), value)
    own = Window.partitionBy(*keys)
    centred = fitted.withColumn("_med", F.percentile("residual", F.lit(0.5)).over(own))
    scaled = centred.withColumn("_mad", floored_mad(F.percentile(F.abs(F.col("residual") - F.col("_med")), F.lit(0.5)).over(own)))
    z = robust_z(F.col("residual"), F.col("_med"), F.col("_mad"))
    return scaled.withColumn("z", z).withColumn("anomaly", F.abs("z") >= config.threshold).drop("_med", "_mad")


def with_baseline(df: DataFrame, doy: str, value: str, config: HarmonicConfig = HarmonicConfig()) -> DataFrame:
    """df with ``expected`` and ``residual``."""
    x = design(F.col(doy), config.harmonics)
    expected = linear(x, least_squares(df, x, value))
    return df.withColumn("expected", expected).withColumn("residual", F.col(value) - F.col("expected"))


def with_robust_z(df: DataFrame, residual: str, threshold: float) -> DataFrame:
    """df with ``z`` and ``anomaly``; the median and the median deviation are found in passes of bounded state."""
    med = quantiles(df, residual, [0.5])[0]
    mad = floored_mad(F.lit(quantiles(df, F.abs(F.col(residual) - F.lit(med)), [0.5])[0] if med is not None else None).cast("double"))
    return df.withColumn("z", robust_z(F.col(residual), F.lit(med).cast("double"), mad)).withColumn("anomaly", F.abs("z") >= threshold)


def seasonal_anomaly(series: DataFrame, doy: str, value: str, config: HarmonicConfig = HarmonicConfig()) -> DataFrame:
    """Anomalies of a series around its seasonal cycle; fewer rows than the fit needs are an error."""
    rounded = require_rows(series, config.min_rows, "seasonal baseline").withColumn(value, F.round(value, config.value_digits))
    return with_robust_z(with_baseline(rounded, doy, value, config), "residual", config.threshold)
