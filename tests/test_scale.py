from __future__ import annotations

import random

from flowlens.operators import models, periodic


def test_undersample_takes_exactly_as_many(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc")) for i in range(5000)] + [(7, "same")] * 40
    df = spark.createDataFrame(rows, "id long, kind string")
    for n in (0, 30, 31, 1000, 4999, 5040, 9000):
        out = [tuple(r) for r in models.undersample(df, n, 5).collect()]
        assert len(out) == min(max(30, n), len(rows)) and not set(out) - set(rows)
        assert sorted(out) == sorted(tuple(r) for r in models.undersample(df.repartition(5), n, 5).collect())
    assert models.undersample(df.limit(0), 10, 5).count() == 0


def test_passes_of_fingerprints_do_not_double_the_plan(spark):
    rows = spark.createDataFrame([(n, "d", "TCP", f"h{n % 3}.example.com", float(n * 7 % 500)) for n in range(200)], "id long, device string, protocol string, host string, t double")
    prints = spark.createDataFrame([("d", "TCP", "*.example.com", k, 10.0 + k) for k in range(8)], "device string, protocol string, host_pattern string, seq int, period double")
    left = periodic.without_periodic(rows, prints, ["device", "protocol"], "t", "id")
    assert len(left._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert 0 <= left.count() <= 200


def test_training_rows_are_dealt_to_more_tasks_as_they_grow(spark):
    assert [models.dealt_for_training(spark.range(n), "id", 100).rdd.getNumPartitions() for n in (50, 1000)] == [4, 10]
