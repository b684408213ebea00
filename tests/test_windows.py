"""Running values over whole tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from corpusgraph.operators import windows


def test_running_values_of_rows_within_one_hour(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    data = [(i, start + dt.timedelta(seconds=rng.randint(0, 600)), rng.choice([None, *range(9)])) for i in range(2000)]
    df = spark.createDataFrame(data, "id int, ts timestamp, v int").repartition(6)
    total = count = 0
    sums, means = {}, {}
    for i, _, v in sorted(data, key=lambda r: (r[1], r[0])):
        total, count = total + (v or 0), count + (v is not None)
        sums[i], means[i] = total, (total / count if count else None)
    assert {r.id: r.s for r in windows.running_sum(df, "ts", ["id"], "v", "s").collect()} == sums
    got = windows.running_mean(df, "ts", "id", "v")
    assert {r.id: r.running_mean for r in got.collect()} == means and got.columns == [*df.columns, "running_mean"]
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(conf, "false")
        sizes = [r["count"] for r in windows.running_sum(df, "ts", ["id"], "v", "s")
                 .groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset(conf)
    assert len(sizes) > 1 and max(sizes) < 2000  # one hour is no longer one task
    assert windows.running_mean(df.limit(0), "ts", "id", "v").count() == 0
