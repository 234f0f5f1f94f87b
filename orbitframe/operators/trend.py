"""Linear trends, per series and per pixel, and the hotspot of the fastest movers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.operators.components import checkpointed
from orbitframe.operators.quantiles import quantiles


def trends(df: DataFrame, keys: list[str], t: str, v: str, min_points: int = 8) -> DataFrame:
    """Per key slope, intercept, points and the scatter around the line (population)."""
    known = df.filter(F.col(v).isNotNull() & F.col(t).isNotNull())
    n, slope = F.count(F.lit(1)), F.regr_slope(F.col(v), F.col(t))
    # Var(residual) = Var(y) - slope * Cov(x, y)
    scatter = F.sqrt(F.greatest(F.var_pop(v) - slope * F.covar_pop(F.col(t), F.col(v)), F.lit(0.0)))
    out = known.groupBy(*keys).agg(slope.alias("slope"), F.regr_intercept(F.col(v), F.col(t)).alias("intercept"), n.alias("n"), scatter.alias("scatter"))
    return out.filter(F.col("n") >= min_points)


def hotspot(pixels: DataFrame, keys: list[str], t: str, v: str, min_pixels: int = 20, share: float = 0.1, min_points: int = 8) -> DataFrame:
    """Median series of the pixels whose slope is within the lowest ``share``; empty with fewer than ``min_pixels``."""
    slopes = checkpointed(trends(pixels, keys, t, v, min_points).select(*keys, "slope"))
    cut = quantiles(slopes, "slope", [share])[0] if slopes.count() >= min_pixels else None
    hot = slopes.filter(F.col("slope") <= F.lit(cut).cast("double")).select(*keys)
    return pixels.join(hot, keys).filter(F.col(v).isNotNull()).groupBy(t).agg(F.percentile(v, F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n_px"))


def median_series(pixels: DataFrame, epoch: str, v: str) -> DataFrame:
    return pixels.filter(F.col(v).isNotNull()).groupBy(epoch).agg(F.percentile(v, F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n_px"))
