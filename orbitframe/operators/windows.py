"""Events against daily series: interval joins, and the study of what precedes events.

An interval join meets on buckets of days: a window is filed under each bucket that it touches, a day under its own, so a
pair meets once, on an equi-join with the keys; what overlaps a bucket only is then refined away. A window touches
its length / bucket + 1 buckets, whatever the series hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.config import PrecursorConfig, TrailingConfig
from orbitframe.operators.detectors import placebo_rank, placebos, trailing_quartiles
from orbitframe.operators.stats import fisher_exact


def interval_join(series: DataFrame, windows: DataFrame, keys: list[str], day: str, start: str, end: str, bucket_days: int = 32) -> DataFrame:
    """Rows of windows(keys, start, end, ...) with the rows of series(keys, day, ...) of the same keys with start <= day < end."""
    bucket = lambda c: F.floor(F.unix_date(c) / bucket_days)
    filed = windows.filter(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(F.date_sub(end, 1)))))
    met = series.withColumn("_bucket", bucket(day)).join(filed, [*keys, "_bucket"])
    return met.filter((F.col(day) >= F.col(start)) & (F.col(day) < F.col(end))).drop("_bucket")


def study_sites(events: DataFrame, config: PrecursorConfig = PrecursorConfig()) -> DataFrame:
    """events(event, date, lon, lat) -> one row per place and window to look at: the event, its twin a year before, its placebos.

    (event, kind, shift, lon, lat, origin, start, end): ``origin`` is the day that the window leads up to, ``start`` leaves room
    for the detector's history before the scored days.
    """
    plain = events.select("event", "date", "lon", "lat")
    true = plain.withColumn("kind", F.lit("event")).withColumn("shift", F.lit(0)).withColumn("origin", F.col("date"))
    twin = true.withColumn("kind", F.lit("twin")).withColumn("origin", F.add_months("date", -config.twin_months))
    moved = placebos(plain, "lon", config.shifts).withColumn("lon", F.col("placebo_lon").cast("double")).drop("placebo_lon")
    shifted = moved.withColumn("kind", F.lit("placebo")).withColumn("origin", F.col("date"))
    both = true.unionByName(twin).unionByName(shifted.select(*true.columns))
    return both.withColumn("start", F.date_sub("origin", config.scored_days + config.history_days)).withColumn("end", F.col("origin")).drop("date")


def at_sites(sites: DataFrame, grid: DataFrame, step: float, v: str) -> DataFrame:
    """Daily values of grid(lon, lat, day, v) at each site: between the four nodes around it, weights renormalised over those known.

    Nodes stand at multiples of ``step``; longitudes wrap. Sites meet nodes on the node and on buckets of days.
    """
    fx, fy = F.col("lon") / step, F.col("lat") / step
    near = sites.withColumn("_x", F.floor(fx)).withColumn("_y", F.floor(fy)).withColumn("_fx", fx - F.col("_x")).withColumn("_fy", fy - F.col("_y"))
    wrap = lambda x: (F.pmod(x * step + 180, F.lit(360.0)) - 180).cast("double")
    corners = F.array(*(
        F.struct(wrap(F.col("_x") + dx).alias("node_lon"), ((F.col("_y") + dy) * step).cast("double").alias("node_lat"), ((F.col("_fx") if dx else 1 - F.col("_fx")) * (F.col("_fy") if dy else 1 - F.col("_fy"))).alias("w"))
        for dx in (0, 1) for dy in (0, 1)
    ))
    keys = ["event", "kind", "shift", "origin"]
    wanted = near.select(*keys, "start", "end", F.explode(corners).alias("k")).select(*keys, "start", "end", "k.*").filter("w > 0")
    nodes = grid.filter(F.col(v).isNotNull()).select(F.col("lon").cast("double").alias("node_lon"), F.col("lat").cast("double").alias("node_lat"), "day", v)
    met = interval_join(nodes, wanted, ["node_lon", "node_lat"], "day", "start", "end")
    return met.groupBy(*keys, "day").agg((F.sum(F.col("w") * F.col(v)) / F.sum("w")).alias(v))


def anomalous_days(sites: DataFrame, grid: DataFrame, step: float, v: str, config: PrecursorConfig = PrecursorConfig()) -> DataFrame:
    """Per site the days of its scored span that have a value, and those that leave the trailing quartile bounds; 0 of 0 without data."""
    keys = ["event", "kind", "shift", "origin"]
    daily = at_sites(sites, grid, step, v).withColumn("at", F.col("day").cast("timestamp"))
    flagged = trailing_quartiles(daily, keys, "at", v, TrailingConfig(config.history_days, config.factor))
    scored = flagged.filter(F.col("day") >= F.date_sub("origin", config.scored_days))
    counts = scored.groupBy(*keys).agg(F.count_if("exceeds").alias("flagged"), F.count(F.lit(1)).alias("days"))
    zero = F.lit(0).cast("long")
    return sites.select(*keys).join(counts, keys, "left").withColumn("flagged", F.coalesce("flagged", zero)).withColumn("days", F.coalesce("days", zero))


def twin_test(counts: DataFrame) -> DataFrame:
    """Per event Fisher's exact p of flagged and other days, the event's window against its twin's."""
    of = lambda kind, c: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    table = counts.groupBy("event").agg(of("event", "flagged").alias("a"), of("event", "days").alias("n"), of("twin", "flagged").alias("c"), of("twin", "days").alias("m"))
    return table.select("event", F.col("a").alias("flagged"), F.col("n").alias("days"), F.col("c").alias("twin_flagged"), F.col("m").alias("twin_days"), fisher_exact(F.col("a"), F.col("n") - F.col("a"), F.col("c"), F.col("m") - F.col("c")).alias("p"))


def precursor_study(events: DataFrame, grid: DataFrame, step: float, v: str, config: PrecursorConfig = PrecursorConfig()) -> DataFrame:
    """Per event: flagged days before it and before its twin with their p, and where it stands among its placebos."""
    counts = anomalous_days(study_sites(events, config), grid, step, v, config)
    ranked = placebo_rank(counts.filter("kind <> 'twin'"), "event", F.col("kind") == "event", "flagged")
    return twin_test(counts).join(ranked.drop("observed"), "event", "left")
