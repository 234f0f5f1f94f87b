"""Zonal statistics, and a target zone against a control zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zonal_stats(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"))


def target_against_control(df: DataFrame, keys: list[str], v: str, target: Column, control: Column, low: float) -> DataFrame:
    """Means of positive values in two zones, and the target's share under a level, in one aggregate."""
    x = F.when(F.col(v) > 0, F.col(v))
    t, c = F.when(target, x), F.when(control, x)
    return df.groupBy(*keys).agg(
        F.avg(t).alias("target_mean"), F.avg(c).alias("control_mean"), F.avg((t < low).cast("int")).alias("target_low"), F.count(t).alias("n_target"), F.count(c).alias("n_control")
    )


def spans(ref: Column, sec: Column, event: Column) -> Column:
    """Whether the open interval holds the event."""
    return (ref < event) & (event < sec)


def central_band(row: Column, col: Column, height: int, width: int) -> Column:
    """The rows and columns around the centre of an area of interest, half open."""
    return (row >= int(0.35 * height)) & (row < int(0.65 * height)) & (col >= int(0.30 * width)) & (col < int(0.70 * width))
