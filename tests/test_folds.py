from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import folds, models, monitor, naming, periodic
from flowlens.sources import readers, sinks


def test_anchored_windows_carry_over_batches_and_keys(spark):
    rng = random.Random(4)
    rows = [(k, round(rng.random() * 400, 2), i) for i, k in enumerate(["a", "b", None] * 100)]
    df = spark.createDataFrame(rows, "k string, t double, id long").withColumn("more", F.array(F.lit(1)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["id"]: r["window"] for r in folds.anchored_windows(df, ["k"], "t", "id", 5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for k in ("a", "b", None):
        bound, window = -1.0, -1
        for t, i in sorted((t, i) for key, t, i in rows if key == k):
            if t > bound:
                bound, window = int(t) + 5, window + 1
            want[i] = window
    assert got == want
    assert folds.anchored_windows(df.limit(0), ["k"], "t", "id", 5).count() == 0


def test_fewest_missing_edges_by_brute_force():
    rng = random.Random(2)
    nodes = {"a": [1, 2], "b": [3, 4, 5], "c": [6]}
    for _ in range(200):
        edges = {(rng.randrange(1, 7), rng.randrange(1, 7)) for _ in range(9)}
        labels = [rng.choice("abcx") for _ in range(rng.randrange(1, 5))]
        options = list(itertools.product(*[nodes.get(e, [None]) for e in labels]))
        missing = lambda p, edges=edges: sum(e not in edges for e in itertools.pairwise(p))
        best = min(map(missing, options))
        assert monitor.node_path(labels, nodes, edges) == (next(list(p) for p in options if missing(p) == best), best)
    assert monitor.node_path([], nodes, set()) == ([], 0)


def test_monitor_alerts_and_upkeep():
    m = monitor.Monitor()
    for i in range(40):
        m.maintain(0.0)
        m.step("a", "b" if i % 2 else "c")
    assert ("a", "b") in m.limits
    assert "HIGH" in [m.step("a", "b")[2] for _ in range(60)]
    total = sum(m.counts["a"].values())
    m.maintain(8 * 86400.0)
    assert sum(m.counts["a"].values()) == total
    m.maintain(40 * 86400.0)
    assert sum(m.counts["a"].values()) == total / 2


def test_fingerprints_act_in_order(spark):
    beat = [("d", "TCP", "x.example.com", 100.0 + 30 * i, i) for i in range(6)]
    other = [("d", "TCP", "y.example.com", 117.0 + 30 * i, 100 + i) for i in range(4)]
    alone = [("d", "TCP", "z.net", 5.0, 200)]
    rows = spark.createDataFrame(beat + other + alone, "device string, protocol string, host string, t double, id long")
    prints = [("d", "TCP", 0, "x.example.com", 30.0), ("d", "TCP", 1, "*.example.com", 30.0), ("d", "TCP", 2, "z.net", 90000.0)]
    df = spark.createDataFrame(prints, "device string, protocol string, seq int, host_pattern string, period double")
    left = {r["id"] for r in periodic.without_periodic(rows, df, ["device", "protocol"], "t", "id").collect()}
    # the first fingerprint leaves the first beat of x, so the second sees that and all of y: y's own beat goes but for its first
    assert left == {0, 100, 200}


def test_labels_of_unknown_devices_stay(spark):
    rows = spark.createDataFrame([("lamp", "on"), ("nest-tstat", "local_temp"), (None, "on"), ("lamp", None)], "device string, label string")
    got = {(r["device"], r["label"]): r["activity"] for r in naming.merged_labels(rows, rows, "device", "label").collect()}
    assert got == {("lamp", "on"): "on", ("nest-tstat", "local_temp"): "set", (None, "on"): None, ("lamp", None): None}


def test_forests_and_overall_tables_come_back(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 3), "on" if i % 2 else "off") for i in range(60)], "x1 double, x2 double, label string")
    fitted = models.train_activities(df, ["x1", "x2"], "label", ["on"], trees=2)
    sinks.forests(fitted, str(tmp_path / "f"))
    back = readers.forests(spark, str(tmp_path / "f"), ["on"])
    assert back["on"].toDebugString == fitted["on"].toDebugString
    (tmp_path / "overall.csv").write_text("device,first party,third party\nplug,3, 4\n")
    assert readers.overall_tables(spark, str(tmp_path / "overall.csv")).collect() == [("plug", 3, 4)]


@pytest.mark.parametrize("gaps,want", [([30, 30, 45, 45], [30, 30, 30, 50, 50])])
def test_periods_switch(spark, gaps, want):
    t, rows = 0.0, [(0.0, 0)]
    for i, g in enumerate(gaps):
        t += g
        rows.append((t, i + 1))
    df = spark.createDataFrame(rows, "t double, id long").withColumn("k", F.lit("k")).withColumn("p", F.lit(30.0)).withColumn("more", F.array(F.lit(50.0)))
    out = folds.switching_periods(df, ["k"], "t", "id", "p", "more").orderBy("id").collect()
    assert [r["current"] for r in out] == want and out[0]["score"] is None


def test_clusters_by_brute_force(spark):
    rng = random.Random(8)
    points = [("k" if i % 3 else "j", i, round(rng.gauss(0, 2), 2), round(rng.gauss(0, 2), 2), round(rng.gauss(0, 1), 2)) for i in range(240)]
    df = spark.createDataFrame(points, "k string, id long, x double, y double, z double")
    cores = models.fit_clusters(df.where("id < 150"), ["k"], ["x", "y", "z"], "id", eps=1.0, least=4)
    held = {}
    for r in sorted(cores.collect(), key=lambda r: (r["k"], r["core"])):
        held.setdefault(r["k"], []).append((r["cluster"], r["point"]))
    got = {r["id"]: r["cluster"] for r in models.assign_clusters(df, cores, ["k"], ["x", "y", "z"], eps=1.0).collect()}
    want = {i: next((c for c, p in held.get(k, []) if sum((a - b) ** 2 for a, b in zip(p, xyz, strict=True)) ** 0.5 < 1.0), -1) for k, i, *xyz in points}
    assert got == want and len(set(want.values())) > 1
