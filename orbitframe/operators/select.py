"""Scene selection, epochs and pair networks, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each group in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def clearest_per_month(scenes: DataFrame, ts: str, cloud: str, seq: str) -> DataFrame:
    """The clearest scene of each calendar month; the earliest arrival wins ties, a missing cloud counts as 100."""
    keyed = scenes.withColumn("month", F.date_format(ts, "yyyy-MM"))
    return first_by(keyed, ["month"], [F.coalesce(F.col(cloud), F.lit(100.0)), F.col(seq)])


def first_valid(df: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """Mosaic: per key the value of the earliest item that has one."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def epochs(dates: DataFrame, date: str = "date", keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct dates of each network with a dense index from 0. Without keys all dates are one network."""
    w = Window.partitionBy(*keys).orderBy("date")
    return dates.select(*keys, F.col(date).alias("date")).filter("date is not null").distinct().withColumn("epoch", F.row_number().over(w) - 1)


def pair_network(epochs_: DataFrame, reach: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each epoch with its next ``reach`` ones: 2n - 3 pairs for n epochs and a reach of 2. No join."""
    w = Window.partitionBy(*keys).orderBy("epoch")
    later = F.array(*(F.struct(F.lead("date", k).over(w).alias("sec"), F.lead("epoch", k).over(w).alias("sec_epoch")) for k in range(1, reach + 1)))
    out = epochs_.select(*keys, F.col("date").alias("ref"), F.col("epoch").alias("ref_epoch"), later.alias("later"))
    return out.select(*keys, "ref", "ref_epoch", F.explode("later").alias("p")).select(*keys, "ref", "ref_epoch", "p.sec", "p.sec_epoch").filter("sec is not null")


def new_pairs(pairs: DataFrame, submitted: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.join(submitted.select(*keys).distinct(), keys, "left_anti")


def products_in_network(products: DataFrame, epochs_: DataFrame) -> DataFrame:
    """Products (ref, sec, ...) whose two dates are epochs, with their indexes."""
    a = epochs_.select(F.col("date").alias("ref"), F.col("epoch").alias("ref_epoch"))
    b = epochs_.select(F.col("date").alias("sec"), F.col("epoch").alias("sec_epoch"))
    return products.join(a, "ref").join(b, "sec")


def require_rows(df: DataFrame, least: int, what: str) -> DataFrame:
    found = df.limit(least).count()
    if found < least:
        raise ValueError(f"{what}: {found} rows, at least {least} are needed")
    return df


def require_dates(df: DataFrame, date: str, wanted: DataFrame) -> DataFrame:
    missing = [str(r[0]) for r in wanted.join(df.select(date).distinct(), date, "left_anti").select(date).orderBy(date).limit(20).collect()]
    if missing:
        raise ValueError(f"no scene for {', '.join(missing)}")
    return df


def water_area(pixels: DataFrame, scene: str, green: str, nir: str, scl: str, min_valid: float, area: float, classes: tuple[int, ...], water: int) -> DataFrame:
    """Per scene with enough valid pixels the water area; a pixel is water by index or by class."""
    from orbitframe.functions.scalars import normalized_difference

    valid = F.coalesce(F.col(scl).isin(*classes), F.lit(False))
    wet = valid & ((normalized_difference(F.col(green), F.col(nir)) > 0) | (F.col(scl) == water))
    out = pixels.groupBy(scene).agg(F.avg(valid.cast("int")).alias("valid_frac"), (F.sum(F.coalesce(wet, F.lit(False)).cast("int")) * F.lit(area)).alias("water_km2"))
    return out.filter(F.col("valid_frac") >= min_valid)


def ordered_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with its place (from 1) in a total order. Ranges of the order are sorted apart; only their sizes are summed in one place."""
    from orbitframe.operators.components import checkpointed

    parts = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    parts = parts.withColumn("_part", F.shiftright("_at", 33))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    out = parts.join(F.broadcast(sizes), "_part")  # one row a shuffle partition
    return out.withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).drop("_at", "_part", "_before")
