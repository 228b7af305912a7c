from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import models
from flowlens.plans.catalog import QUERIES
from flowlens.plans.inputs import packets, read


def test_periods_come_from_packets(spark, sf_dir, tmp_path):
    events = read(spark, sf_dir, "events")
    kind = events.schema["ts"].dataType.simpleString()
    # one more event type that every device has once a day
    start = events.agg(F.min("ts")).first()[0]
    daily = spark.range(300).select((F.col("id") % 10).alias("user_id"), (F.lit(start) + F.make_dt_interval((F.col("id") / 10).cast("int"))).cast(kind).alias("ts"), F.lit("daily").alias("event_type"), (F.col("id") + 10**6).alias("event_id"))
    events.unionByName(daily.withColumn("user_id", F.col("user_id").cast(events.schema["user_id"].dataType)), allowMissingColumns=True).write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["period_detection"](spark, str(tmp_path)).collect()
    keys = {tuple(r) for r in packets(spark, str(tmp_path)).select("device", "event_type").distinct().collect()}
    assert {(r["device"], r["event_type"]) for r in out} == keys
    found = [r["period"] for r in out if r["event_type"] == "daily" and r["rank"] == 1]
    assert len(found) == 10 and all(abs(p - 86400.0) < 4000 for p in found)


def test_clusters_are_fitted_to_5000_rows(spark, sf_dir):
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", (F.col("l_discount") * 100).alias("discount")).withColumn("place", place).orderBy("place").collect()
    got = {(r["l_orderkey"], r["l_linenumber"]): r["cluster"] for r in QUERIES["density_clusters"](spark, sf_dir).collect()}
    devices = defaultdict(list)
    for r in rows:
        devices[r["l_suppkey"] % 4].append(r)
    late = 0
    for mine in devices.values():
        mine = mine[:5000]
        points = np.array([[float(r["l_quantity"]), float(r["discount"])] for r in mine])
        labels = models.density_clusters(points, 1.5, 5)
        for n, (r, p) in enumerate(zip(mine, points, strict=True)):
            if (np.sqrt(((points - p) ** 2).sum(axis=1)) <= 1.5).sum() >= 5:
                assert got[(r["l_orderkey"], r["l_linenumber"])] == labels[n]
                late += n >= 300
    assert late
