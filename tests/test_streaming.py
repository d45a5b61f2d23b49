import time

from pyspark.sql import functions as F

from gaugeflow.operators import monitoring
from gaugeflow.streaming import monitor


def run(spark, stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path, rows):
    path = str(tmp_path / f"in{time.time_ns()}")
    spark.createDataFrame(rows, "key string, ts timestamp, value double").coalesce(1).write.parquet(path)
    return spark.readStream.schema("key string, ts timestamp, value double").parquet(path)


def test_charts_equal_the_batch_operators(spark, tmp_path):
    rows = spark.range(60).select(F.concat(F.lit("k"), F.col("id") % 2).alias("key"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.when(F.col("id") % 9 == 4, None).otherwise(F.sin("id") * 3).alias("value")).collect()
    got = run(spark, monitor.charts(source(spark, tmp_path, rows), "key", "value", 0.1, 1.2), tmp_path, "charts").orderBy("key", "ts").collect()
    df = spark.createDataFrame(rows, "key string, ts timestamp, value double").withColumns({"t": F.unix_timestamp("ts"), "mu": F.lit(0.1), "sigma": F.lit(1.2)})
    want = monitoring.cusum(monitoring.ewma(df, ["key"], "value"), ["key"], "value").orderBy("key", "t").collect()
    assert len(got) == 60 and all(abs(a.z - b.z) < 1e-9 and abs(a.c_plus - b.c_plus) < 1e-9 and abs(a.c_minus - b.c_minus) < 1e-9 for a, b in zip(got, want))


def test_duplicates_and_segments(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [("k", t0 + timedelta(hours=h), 1.0) for h in (0, 1, 1, 2, 10, 11)] + [("k", t0 + timedelta(days=9), 1.0)]
    assert run(spark, monitor.deduplicated(source(spark, tmp_path, rows), ["key"]), tmp_path, "dedup").count() == 6
    out = run(spark, monitor.segments(source(spark, tmp_path, rows), ["key"]), tmp_path, "segs").orderBy("start_ts").collect()
    assert [r.n for r in out][:2] == [4, 2]
