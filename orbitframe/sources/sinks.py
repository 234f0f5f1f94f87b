"""Sinks: results with their provenance, manifests, layers and their cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def result_json(series: DataFrame, order: list[str], summary: dict[str, Column], source: str, method: str) -> DataFrame:
    """One row with the whole result as JSON. A series has one element per epoch."""
    item = F.struct(*order, *(c for c in series.columns if c not in order))
    one = series.agg(F.struct(*(v.alias(k) for k, v in summary.items())).alias("summary"), F.sort_array(F.collect_list(item)).alias("series"))
    return one.select(F.to_json(F.struct(F.lit(source).alias("source"), F.lit(method).alias("method"), "summary", "series")).alias("json"))


def merged_manifest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old records with the new ones whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def write_layers(pixels: DataFrame, path: str, layer: str = "layer") -> None:
    pixels.sortWithinPartitions(layer, "row", "col").write.mode("overwrite").partitionBy(layer).parquet(path)


def _has_partition(spark: SparkSession, path: str, layer: str, name: str) -> bool:
    jvm = spark.sparkContext._jvm
    escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)
    at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{layer}={escaped}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached_layers(spark: SparkSession, path: str, compute: dict[str, Callable[[], DataFrame]], layer: str = "layer") -> DataFrame:
    """The named layers of a table partitioned by layer: those that are there are read, the others are made and added.

    Layers that are missing are made in one job, which replaces their partitions and no others when it commits; a job that fails
    leaves the table as it was, so asking again is safe. ``compute`` gives pixels without the layer column.
    """
    lost = [name for name in sorted(compute) if not _has_partition(spark, path, layer, name)]
    made = None
    for name in lost:
        one = compute[name]().withColumn(layer, F.lit(name))
        made = one if made is None else made.unionByName(one)
    if made is not None:
        rows = made.repartition(layer, "row").sortWithinPartitions(layer, "row", "col")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(layer).parquet(path)
    kept = spark.read.option("basePath", path).parquet(path).withColumn(layer, F.col(layer).cast("string"))
    return kept.filter(F.col(layer).isin(*compute))
