"""Archive coverage: the best group of passes, its months, cadence and the network it allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions.scalars import cadence_days, plan_epochs, plan_pairs


def coverage_report(passes: DataFrame, place: str, track: str, start: str, seq: str, as_of: Column, cap: int = 400) -> DataFrame:
    """Per place: passes, best track (most passes, then first seen), its months, cadence, epochs and pairs.

    ``as_of`` is given, never the clock. Months and last-year counts are taken per track in the same aggregate.
    """
    month = F.date_format(start, "yyyy-MM")
    last_year = F.col(start) > as_of - F.expr("INTERVAL 366 DAYS")
    tracks = passes.groupBy(place, track).agg(
        F.count(F.lit(1)).alias("passes"), F.min(seq).alias("first_seen"), F.count_distinct(month).alias("months"), F.count_if(last_year).alias("recent")
    )
    best = F.max_by(F.struct(track, "passes", "months", "recent"), F.struct("passes", -F.col("first_seen")))
    out = tracks.groupBy(place).agg(F.sum("passes").alias("total"), best.alias("b"))
    epochs = plan_epochs(F.col("b.months"))
    return out.select(
        place, "total", (F.col("total") == cap).alias("capped"), F.col(f"b.{track}").alias("best_track"), F.col("b.passes").alias("best_passes"), F.col("b.months").alias("months"),
        cadence_days(F.col("b.recent")).cast("long").alias("cadence_days"), epochs.cast("long").alias("epochs"), plan_pairs(epochs).cast("long").alias("pairs"),
    )


def matched(features: Column, context_matched: Column, number_matched: Column, page: int = 100) -> tuple[Column, Column]:
    """(matched, whether the page cuts it off)."""
    n = F.size(features)
    m = F.coalesce(context_matched, number_matched, n)
    return m, (m == n) & (n == page)
