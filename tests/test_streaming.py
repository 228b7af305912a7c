from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowlens.operators import machine, models, periodic, traces
from flowlens.plans.periodic_queries import spike_train
from flowlens.streaming import streams


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_streaming_sessions_equal_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = run(streams.sessions(stream, ["user_id"], "ts", "1 hour", "2 hours"), "sessions")
    batch = traces.session_counts(events, ["user_id"], "ts", "1 hour")
    newest = events.agg(F.max("ts")).first()[0]
    want = {tuple(r) for r in batch.collect()}
    have = {(r["user_id"], r["start"], r["n_events"]) for r in got.collect()}
    assert have <= want and {w for w in want if (newest - w[1]).days >= 2} <= have
    counts = run(streams.counts_by_window(stream, [], "ts", "1 day", "1 hour", "12 hours"), "windows", "complete")
    assert counts.agg(F.sum("n_events")).first()[0] == 2 * events.count()


def test_streaming_machine_counts(spark, tmp_path):
    steps = [("m", "a", "b")] * 30 + [("m", "a", "c")] * 10 + [("n", "a", "b")] * 3
    spark.createDataFrame(steps, "machine string, src string, dst string").write.parquet(str(tmp_path / "1"))
    stream = spark.readStream.schema("machine string, src string, dst string").parquet(str(tmp_path / "1"))
    got = {(r["machine"], r["src"], r["dst"]): (r["cnt"], round(r["prob"], 4)) for r in run(streams.machine_updates(stream, "machine"), "machines", "update").collect()}
    assert got == {("m", "a", "b"): (30, 0.75), ("m", "a", "c"): (10, 0.25), ("n", "a", "b"): (3, 1.0)}


@pytest.mark.parametrize("period", [5, 12, 30, 48])
@pytest.mark.parametrize("noise", [0.0, 0.03])
def test_periods_of_spike_trains(period, noise):
    found = periodic.find_periods(spike_train(period, 960, noise, seed=period), 1.0, seed=2)
    assert any(abs(p - period) <= 1 or p % period == 0 for p, _ in found)


def test_noise_has_no_period():
    assert sum(bool(periodic.find_periods(spike_train(10**6, 900, 0.05, seed=s), 1.0, seed=3)) for s in range(20)) <= 3


def test_density_clusters():
    import numpy as np

    a, b = np.zeros((6, 2)), np.full((6, 2), 10.0)
    points = np.concatenate([a + np.arange(6)[:, None] * 0.1, b, [[50.0, 50.0]]])
    assert models.density_clusters(points, 1.0, 5).tolist() == [0] * 6 + [1] * 6 + [-1]


def test_alert_when_a_share_changes():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd

    state = State()
    frame = lambda n, m: pd.DataFrame({"src": ["a"] * (n + m), "dst": ["b"] * n + ["c"] * m})
    list(machine.update_stream(("m",), iter([frame(40, 10)]), state))
    out = pd.concat(machine.update_stream(("m",), iter([frame(0, 200)]), state))
    assert out.set_index("dst").loc["c", "alert"] == "HIGH"


def test_streaming_upkeep_equals_batch(spark, tmp_path):
    """Two files in time order: rows as the batch gives them, a step behind the watermark doesn't count."""
    import random

    from flowlens.operators import monitor

    rng = random.Random(3)
    rows = [(m, 1_700_000_000.0 + 3600.0 * i + (m == "n"), rng.choice("ab"), rng.choice("abc")) for i in range(900) for m in "mn"]
    schema = "machine string, t double, src string, dst string"
    late = ("m", rows[0][1] + 1, "a", "zz")
    for i, part in enumerate((rows[:1000], [*rows[1000:], late])):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/steps/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/steps/*")
    got = run(streams.watched_updates(stream, "machine", "ts", "1 hour"), "upkeep")
    want = monitor.watched(spark.createDataFrame(rows, schema), ["machine"], ["t", "src", "dst"], "t")
    shown = lambda df, t: sorted((r["machine"], r[t], r["src"], r["dst"], round(r["prob"], 9), r["z"] and round(r["z"], 9), r["alert"]) for r in df.collect())
    assert shown(got, "time") == shown(want, "t")
    assert any(r["alert"] for r in got.collect())


def test_timer_keeps_machines_without_traffic():
    import pandas as pd

    from flowlens.operators import monitor

    class State:
        exists, get, hasTimedOut, mark, timer = False, None, False, 0, None

        def update(self, value):
            self.exists, self.get = True, value

        def getCurrentWatermarkMs(self):
            return self.mark

        def setTimeoutTimestamp(self, at):
            assert at > self.mark
            self.timer = at

    state, now = State(), 1_700_000_000.0
    rows = pd.DataFrame({"time": [now] * 20, "src": ["a"] * 20, "dst": ["b"] * 10 + ["c"] * 10})
    assert len(pd.concat(monitor.watch_stream(("m",), iter([rows]), state))) == 20
    assert state.timer / 1000 == pytest.approx(now + monitor.WEEK, abs=1)
    state.hasTimedOut = True
    for week in range(1, 6):
        state.mark = int((now + week * (monitor.WEEK + 2)) * 1000)
        assert list(monitor.watch_stream(("m",), iter([]), state)) == []
    kept = monitor.Monitor.load(state.get[0])
    assert kept.counts == {"a": {"b": 5.0, "c": 5.0}} and kept.week == state.mark / 1000


def test_short_periods_need_coarse_bins():
    x = spike_train(5, 960)
    assert periodic.find_periods(x, 1.0, seed=2)
    assert all(p >= 9 for p, _ in periodic.find_periods(x, 1.0, seed=2, shortest=10))
    assert any(abs(p - 48) <= 1 or p % 48 == 0 for p, _ in periodic.find_periods(spike_train(48, 960), 1.0, seed=2, shortest=10))


@pytest.mark.parametrize(("noise", "least"), [(0.0, 4), (0.005, 3), (0.02, 1)])
def test_period_evaluation_of_spike_trains(spark, noise, least):
    """Half of the sequences have a period; the more of the events are noise, the fewer of them are found."""
    rows = [(k, t, b, int(v)) for k, t in enumerate([20, 40, 60, 80, 0, 0, 0, 0]) for b, v in enumerate(spike_train(t or 10**6, 960, noise if t else 0.02, seed=k))]
    signal = spark.createDataFrame(rows, "k int, true_period int, bin long, n long")
    found = periodic.detect_periods(signal.drop("true_period"), ["k"], 1.0)
    r = periodic.period_evaluation(signal.select("k", "true_period").distinct(), found, ["k"], slack=1.0).first()
    assert r["tp"] + r["fn"] == 4 and r["fp"] + r["tn"] == 4 and r["tp"] >= least and r["tn"] >= 3
    empty = periodic.period_evaluation(signal.where("false").select("k", "true_period"), found, ["k"]).first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_models_speak_for_their_hosts(spark):
    rows = spark.createDataFrame([(i, float(i % 2), h, p) for i, (h, p) in enumerate([("a.x.com", "TCP"), ("a.x.com", "TCP"), ("b.y.com", "TCP"), ("b.y.com", "TCP"), ("a.x.com", "UDP"), ("a.x.com", "UDP"), (None, "TCP"), ("x.com", "TCP")] * 6)], "i int, f double, host string, protocol string")
    model = models.train_activities(rows.withColumn("label", F.when(F.col("f") == 1, "on").otherwise("off")), ["f"], "label", ["on"], trees=3)["on"]
    out = models.predict_at_hosts(rows, {("on", "*.x.com", "TCP"): model}, ["f"])
    got = {(r["host"], r["protocol"], r["f"], r["activity"]) for r in out.collect()}
    assert {g for g in got if g[3] == "on"} == {("a.x.com", "TCP", 1.0, "on"), ("x.com", "TCP", 1.0, "on")}
    assert all(r["activity"] == "unknown" and r["proba"] == 0 for r in models.predict_at_hosts(rows, {}, ["f"]).collect())


def test_a_row_meets_the_models_of_its_host_only(spark):
    """Each row's answer is the best of the single models that speak for its host, and a model scans its own part of the rows."""
    places = [("a.x.com", "TCP"), ("b.x.com", "TCP"), ("b.y.com", "UDP"), ("c.z.org", "TCP"), (None, "TCP"), ("b.y.com", None)]
    rows = spark.createDataFrame([(n, None if n % 17 == 0 else float(n % 7), float(n % 5), *places[n % 6], "clash") for n in range(420)] * 2, "n int, f double, g double, host string, protocol string, _id string")
    truths = {"high": F.col("f") > 2, "mid": F.col("g") > 1, "low": F.col("f") < 5}  # most rows have several
    fitted = {a: models.train_activities(rows.withColumn("label", F.when(is_so, a).otherwise("-")), ["f", "g"], "label", [a], trees=3)[a] for a, is_so in truths.items()}
    named = {("high", "*.x.com", "TCP"): fitted["high"], ("mid", "b.x.com", "TCP"): fitted["mid"], ("low", "*.x.com", "TCP"): fitted["low"], ("mid", "*.y.com", "UDP"): fitted["mid"], ("low", "no.such.host", "TCP"): fitted["low"]}
    out = models.predict_at_hosts(rows, named, ["f", "g"])
    assert out.columns == [*rows.columns, "activity", "proba"]
    single = {}
    for (activity, pattern, protocol), model in named.items():
        for r in models.predict_activities(rows.where("n is not null").distinct(), {activity: model}, ["f", "g"]).collect():
            fits = r["protocol"] == protocol and r["host"] is not None and (r["host"] == pattern or (pattern.startswith("*") and r["host"].endswith(pattern[2:])))
            if fits and r["activity"] == activity:
                single.setdefault(r["n"], []).append((r["proba"], activity))
    got = out.collect()
    assert sorted(r["n"] for r in got) == sorted([*range(420)] * 2)
    for r in got:
        proba, activity = max(single.get(r["n"], [(0.0, "unknown")]))
        assert r["activity"] == activity and r["proba"] == pytest.approx(proba, abs=1e-12)
    assert sum(len(v) > 1 for v in single.values()) > 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(_model") >= 3 and "no.such.host" not in plan


def test_ranked_equals_one_window(spark):
    from flowlens.operators import summaries

    rows = spark.range(5000).selectExpr("cast(id % 700 as double) as v", "id")
    out = [r["at"] for r in summaries.ranked(rows, [F.asc("v"), F.asc("id")], "id", "at").orderBy("at").collect()]
    want, sums = sorted((i % 700, i) for i in range(5000)), 0
    for (_, i), at in zip(want, out, strict=True):
        sums += i
        assert at == sums
    assert summaries.ranked(rows.where("false"), [F.asc("v")], "id", "at").count() == 0
