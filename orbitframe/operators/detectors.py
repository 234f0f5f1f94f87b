"""Detectors over time series: trailing quartiles, climatology, sustained runs, detrending, placebos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.config import ClimatologyConfig, RunConfig, TrailingConfig
from orbitframe.operators.harmonic import least_squares, linear, with_fit

DAY = 86400


def trailing_quartiles(df: DataFrame, keys: list[str], ts: str, v: str, config: TrailingConfig = TrailingConfig()) -> DataFrame:
    """Bounds from the ``days`` before each row of the same key: median plus or minus ``factor`` quartile distances."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).cast("long")).rangeBetween(-config.days * DAY, -1)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
    out = df.withColumn("_q", q).withColumn("n_prior", F.count(v).over(w))
    lq, med, uq = (F.try_element_at("_q", F.lit(i)) for i in (1, 2, 3))
    out = out.withColumn("lower", med - config.factor * (med - lq)).withColumn("upper", med + config.factor * (uq - med))
    x = F.col(v)
    exceeds = (x < F.col("lower")) | (x > F.col("upper")) if config.strict else (x <= F.col("lower")) | (x >= F.col("upper"))
    return out.withColumn("exceeds", exceeds).drop("_q")


def minus_zonal_mean(df: DataFrame, zone: list[str], v: str) -> DataFrame:
    return df.withColumn("eddy", F.col(v) - F.avg(v).over(Window.partitionBy(*zone)))


def climatology_z(df: DataFrame, keys: list[str], date: str, v: str, config: ClimatologyConfig = ClimatologyConfig()) -> DataFrame:
    """z of each day against the same calendar day of earlier years. A window per key and calendar day, so no self-join."""
    day = F.date_format(date, "MM-dd")
    keyed = df.withColumn("_day", day).withColumn("_year", F.year(date))
    w = Window.partitionBy(*keys, "_day").orderBy("_year").rangeBetween(-config.years, -1)
    sd = F.stddev_samp(v) if config.ddof == 1 else F.stddev_pop(v)
    out = keyed.withColumn("clim_mean", F.avg(v).over(w)).withColumn("clim_sd", sd.over(w)).withColumn("n_years", F.count(v).over(w))
    z = F.when((F.col("n_years") >= config.min_history) & (F.col("clim_sd") > 0), (F.col(v) - F.col("clim_mean")) / F.col("clim_sd"))
    return out.withColumn("z", z).withColumn("exceeds", F.coalesce(F.col("z") > config.threshold, F.lit(False))).drop("_day", "_year")


def sustained_runs(df: DataFrame, keys: list[str], step: str, flag: str, config: RunConfig = RunConfig()) -> DataFrame:
    """Runs of at least ``steps`` consecutive flagged steps (integers one apart): gaps and islands."""
    flagged = df.filter(F.col(flag))
    w = Window.partitionBy(*keys).orderBy(step)
    island = flagged.withColumn("_island", F.col(step) - F.row_number().over(w))
    out = island.groupBy(*keys, "_island").agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count(F.lit(1)).alias("length"))
    return out.filter(F.col("length") >= config.steps).drop("_island")


def quiet_only(df: DataFrame, activity: DataFrame, date: str, level: str, quiet_max: float) -> DataFrame:
    """Rows of quiet days. A day without a reading is a gap, never quiet."""
    return df.join(activity.select(date, level), date, "left").filter(F.col(level) <= quiet_max)


def centred_mean(df: DataFrame, keys: list[str], day: Column, v: str, days: int = 81, trailing: bool = False) -> Column:
    half = days // 2
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-(days - 1) if trailing else -half, 0 if trailing else half)
    return F.avg(v).over(w)


def despiked(df: DataFrame, keys: list[str], order: str, v: str, reach: int = 3, factor: float = 5.0) -> DataFrame:
    """Values far above the median of their neighbourhood become NULL."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    med = F.percentile(v, F.lit(0.5)).over(w)
    return df.withColumn("_med", med).withColumn(v, F.when(F.col(v) <= factor * F.abs("_med"), F.col(v))).drop("_med")


def detrended(df: DataFrame, covariates: list[str], v: str, keys: list[str] | None = None) -> DataFrame:
    """df with ``detrended``: the residual of v on an intercept and the covariates; with keys, of one fit per key."""
    if keys:
        return with_fit(df, keys, [F.lit(1.0), *(F.col(c) for c in covariates)], v).withColumn("detrended", F.col("residual")).drop("expected", "residual")
    x = [F.lit(1.0), *(F.col(c) for c in covariates)]
    return df.withColumn("detrended", F.col(v) - linear(x, least_squares(df, x, v)))


def control_twin(windows: DataFrame, date: str, months: int = 12) -> DataFrame:
    """Each event window day with the same day ``months`` earlier."""
    return windows.withColumn("twin_date", F.add_months(date, -months))


def placebos(events: DataFrame, lon: str, shifts: tuple[int, ...] = tuple(s for d in range(15, 76, 10) for s in (d, -d))) -> DataFrame:
    """Copies of each event shifted in longitude, wrapped to [-180, 180)."""
    out = events.withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))
    return out.withColumn("placebo_lon", F.pmod(F.col(lon) + F.col("shift") + 180, F.lit(360)) - 180)


def placebo_rank(scores: DataFrame, key: str, is_event: Column, v: str) -> DataFrame:
    """Per key: share of placebos below the event, and the event's offset from their mean in standard errors."""
    seen = scores.groupBy(key).agg(F.max(F.when(is_event, F.col(v))).alias("observed"))
    null = F.when(~is_event, F.col(v))
    below = F.count_if(~is_event & (F.col(v) < F.col("observed"))) / F.count(null)
    out = scores.join(seen, key).groupBy(key).agg(
        F.first("observed").alias("observed"), F.when(F.count(null) > 0, below).alias("share_below"), F.avg(null).alias("null_mean"), (F.stddev_samp(null) / F.sqrt(F.count(null))).alias("null_se")
    )
    return out.select(key, "observed", "share_below", F.when(F.col("null_se") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_se")).alias("offset_se"))


def variance_explained(df: DataFrame, covariates: list[str], v: str, keys: list[str] | None = None) -> DataFrame:
    """One row, or one per key: the share of the variance of v that the covariates explain; NULL where v doesn't vary."""
    left, spread = F.sum(F.col("detrended") * F.col("detrended")), F.var_pop(v) * F.count(v)
    known = detrended(df, covariates, v, keys).filter(F.col(v).isNotNull())
    return known.groupBy(*(keys or [])).agg(F.when(spread > 0, 1 - left / spread).alias("r2"), F.count(v).alias("n"))


def detrended_exceedance(df: DataFrame, keys: list[str], ts: str, covariates: list[str], v: str, config: TrailingConfig = TrailingConfig(), fit_keys: list[str] | None = None) -> DataFrame:
    """The trailing-quartile detector on what the covariates leave; ``fit_keys`` are those that have a fit of their own."""
    return trailing_quartiles(detrended(df, covariates, v, fit_keys), keys, ts, "detrended", config)
