from pyspark.sql import functions as F

from orbitframe.operators import select
from orbitframe.streaming import incremental


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int") * 7)).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = incremental.windowed_counts(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = incremental.windowed_counts(rows, "ts", "k")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_foreach_batch_runs_operators(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("seq"))
    rows.write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    incremental.on_each_batch(stream, lambda df, _: seen.append(select.first_by(df, ["k"], ["seq"]).count()), f"{tmp_path}/ck").awaitTermination(120)
    assert sum(seen) == 10
