from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import flows, lookups, mining, periodic, scans, traces


def made(seed, n=900):
    """A device with nearly all rows, one with few, a null one, and runs of equal times."""
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0.0, 0.0, 0.5, 1.0, 5.0, 10.0, 10.0, 30.0])
        rows.append((rng.choice(["hot"] * 12 + ["cold", None]), round(t, 3), i))
    rng.shuffle(rows)
    return rows


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_slices_change_no_row(spark, seed):
    rows = spark.createDataFrame(made(seed), "device string, ts double, frame_num long").repartition(5)
    cuts = scans.hot_cuts(rows, ["device"], "ts", 40)
    per = scans.sliced(rows, ["device"], "ts", cuts).groupBy("device", "_slice").count().collect()
    assert sum(r["device"] == "hot" for r in per) > 8 and max(r["count"] for r in per if r["device"] == "hot") < 160
    plain, cut = flows.with_deltas(rows, ["device"]), flows.with_deltas(rows, ["device"], cuts=cuts)
    same(plain, cut)
    kept = plain.where("frame_num % 7 > 0")
    for gap in (0.7, 7.0, 29.0, 1e9):
        same(flows.split_bursts(kept, ["device"], gap), flows.split_bursts(kept, ["device"], gap, cuts=cuts))
    timed = rows.withColumn("period", F.lit(10.0))
    same(periodic.timing_labels(timed, ["device"], "ts", "frame_num", "period"), periodic.timing_labels(timed, ["device"], "ts", "frame_num", "period", cuts))
    history = rows.where("frame_num % 31 = 3 and ts > 300").selectExpr("device", "ts", "concat('h', frame_num) as name")
    same(lookups.as_of(rows, history, ["device"], "ts", "name"), lookups.as_of(rows, history, ["device"], "ts", "name", cuts))


def test_one_device_spreads_over_all_partitions(spark):
    rows = spark.range(20_000).selectExpr("'d' as device", "id * 0.25 as ts", "id as frame_num")
    cuts = scans.hot_cuts(rows, ["device"], "ts", 500)
    out = flows.split_bursts(flows.with_deltas(rows, ["device"], cuts=cuts), ["device"], 1.0, cuts=cuts)
    tasks = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in tasks) < 8000
    assert out.agg(F.max("burst"), F.max("burst_start")).first() == (0, 0.0)


def test_keys_that_fit_one_task_have_no_cuts(spark):
    rows = spark.createDataFrame(made(3, 50), "device string, ts double, frame_num long")
    assert scans.hot_cuts(rows, ["device"], "ts") is None and scans.hot_cuts(rows.limit(0), ["device"], "ts", 1) is None


def test_a_row_looks_at_few_cuts(spark):
    values = [None, float("nan"), -1.0, 0.0, 0.5, 1.0, 2.0, 7.0, 7.5, 998.0, 998.5, 1e9]
    rows = spark.createDataFrame([(k, v) for k in ("a", "b", "c", None) for v in values], "k string, t double")
    made = {"a": [float(i) for i in range(scans.MOST_SLICES - 1)], "b": [2.0, 2.0, 7.0], None: [0.0]}
    cuts = spark.createDataFrame(list(made.items()), "k string, _cuts array<double>")
    out = scans.sliced(rows, ["k"], "t", cuts)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "filter(_cuts" not in plan
    for r in out.collect():
        t, mine = r["t"], made.get(r["k"])
        want = -1 if mine is None else 0 if t is None else len(mine) if t != t else sum(c < t for c in mine)
        assert r["_slice"] == want, r


@pytest.mark.parametrize("gap", [9.0, 29.0, 1e9])
def test_slices_change_no_trace(spark, gap):
    rows = spark.createDataFrame(made(4), "device string, ts double, frame_num long").repartition(5)
    cuts = scans.hot_cuts(rows, ["device"], "ts", 40)
    plain, cut = traces.split_traces(rows, ["device"], "ts", "frame_num", gap), traces.split_traces(rows, ["device"], "ts", "frame_num", gap, cuts)
    same(plain, cut)
    keys = ["device", "trace"]
    nodes = plain.selectExpr("device", "trace", "pos", "concat('l', frame_num % 5) as label", "concat('n', frame_num % 7) as node")
    same(mining.machine_of(nodes, keys), mining.machine_of(nodes, keys, 30))
