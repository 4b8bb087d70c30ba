"""Running values in buckets of measured size."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reeltable.operators import monitor


def test_a_fleet_within_one_hour(spark):
    """Five elements, all rows in a few seconds, many at one time; a null element."""
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([0, 0, rnd.randrange(3_000_000)]), i, float(rnd.randrange(100))) for i in range(2_000)]
    df = spark.createDataFrame(rows, "element string, us long, frame_id int, latency_ms double").withColumn("src_ts", F.timestamp_micros("us"))
    w = Window.partitionBy("element").orderBy("src_ts", "frame_id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("frame_id", F.round(F.avg("latency_ms").over(w), 6), F.min("latency_ms").over(w), F.max("latency_ms").over(w), F.count("*").over(w))
    got = monitor.latency_running(df, rows=50).select("frame_id", F.round("avg_ms", 6), "min_ms", "max_ms", "frame_num")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    placed = df.repartitionByRange(40, F.asc_nulls_first("element"), F.asc_nulls_first("src_ts"), F.asc_nulls_first("frame_id")).groupBy("element", F.spark_partition_id()).count()
    assert placed.agg(F.max("count")).first()[0] <= 150
    assert monitor.latency_running(df.limit(0)).collect() == []
