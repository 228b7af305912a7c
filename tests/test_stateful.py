from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import flows, lookups
from flowlens.streaming import stateful

BASE, END = 1_700_000_000.0, 1_700_900_000.0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def put(spark, folder, parts, schema):
    """A file for each part, read in that order."""
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, schema).withColumn("at", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(df, name, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(170)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def shuffled(rng, rows, parts, at):
    """Rows in parts whose times overlap, each shuffled."""
    rows = sorted(rows, key=lambda r: r[at] + rng.uniform(0, 40))
    size = -(-len(rows) // parts)
    out = [rows[i : i + size] for i in range(0, len(rows), size)]
    for part in out:
        rng.shuffle(part)
    return out


def test_bursts_equal_batch(rocks, tmp_path):
    rng, t, rows = random.Random(1), BASE, []
    for i in range(300):
        t += rng.choice([0.0, 0.25, 0.5, 1.0, 1.5, 30.0])
        rows.append((rng.choice(["plug", "plug", "lamp", None]), round(t, 3), i, 40 + i % 9))
    late = [("plug", BASE, 9999, 1)]
    parts = [*shuffled(rng, rows, 4, 1), [("end", END, 10_000, 1)], late, [("end", END + 9000, 10_001, 1)]]
    schema = "device string, ts double, frame_num long, frame_len long"
    got = run(stateful.burst_stream(put(rocks, tmp_path / "in", parts, schema), ["device"], 1.0, "60 seconds"), "bursts", tmp_path)
    batch = rocks.createDataFrame(rows, schema)
    want = flows.split_bursts(flows.with_deltas(batch, ["device"]), ["device"], 1.0).groupBy("device", "burst", "burst_start").agg(F.max("ts").alias("burst_end"), F.count("*").alias("n"), F.sum("frame_len").alias("size"))
    shown = lambda rs: sorted((tuple(r) for r in rs if r["device"] != "end"), key=repr)
    assert shown(got) == shown(want.select("device", "burst", "burst_start", "burst_end", "n", "size").collect())


def test_names_of_one_stream_resolve_packets_of_another(rocks, tmp_path):
    rng, t, packets, names = random.Random(2), BASE, [], []
    for i in range(250):
        t += rng.choice([0.5, 2.0, 5.0])
        packets.append(("d", rng.choice(["1.1.1.1", "2.2.2.2", "3.3.3.3"]), round(t, 3), i, None))
        if i % 10 == 7 and i > 60:
            names.append(("d", rng.choice(["1.1.1.1", "2.2.2.2"]), round(t + rng.choice([0.0, 0.5]), 3), None, f"h{i}"))
    schema = "device string, ip string, ts double, frame_num long, name string"
    end = [("d", "9.9.9.9", END, 10_000, None)]
    streams = put(rocks, tmp_path / "in", [*shuffled(rng, packets + names, 4, 2), end, [("d", "1.1.1.1", BASE, None, "late")], [("d", "9.9.9.9", END + 9000, 10_001, None)]], schema)
    got = run(stateful.resolved_stream(streams.where("frame_num is not null"), streams.where("frame_num is null"), "60 seconds", 5000.0), "resolved", tmp_path)
    rows, history = rocks.createDataFrame(packets, schema).drop("name"), rocks.createDataFrame(names, schema).drop("frame_num")
    want = lookups.as_of(rows, history, ["device", "ip"], "ts", "name").select("frame_num", "name", "outcome").collect()
    assert sorted((r["frame_num"], r["name"], r["outcome"]) for r in got if r["ip"] != "9.9.9.9" and r["name"]) == sorted((r["frame_num"], r["name"], r["outcome"]) for r in want if r["name"])
    assert {r["frame_num"] for r in got if r["outcome"] == "blank" and r["frame_num"] < 10_000} == {r["frame_num"] for r in want if r["outcome"] == "blank"}
    assert {r["outcome"] for r in got} == {"prior", "after", "blank"}


def test_machines_watched_by_source_equal_batch(rocks, tmp_path):
    """Three files in time order over nine weeks: rows as the batch gives them, upkeep included; a step behind the watermark doesn't count."""
    from flowlens.operators import monitor

    rng = random.Random(3)
    rows = [(m, BASE + 3600.0 * i + (m == "n"), rng.choice("abcd"), rng.choice("abc" if i < 700 else "cd")) for i in range(1500) for m in "mn"]
    rows = [r for r in rows if r[2] != "d" or r[1] < BASE + 400_000 or r[1] > BASE + 4_000_000]  # a source without steps for weeks
    late = ("m", BASE + 1, "a", "zz")
    third = len(rows) // 3
    stream = put(rocks, tmp_path / "in", [rows[:third], rows[third : 2 * third], [*rows[2 * third :], late]], "machine string, ts double, src string, dst string")
    got = run(stateful.watched_by_source(stream, "machine", "at", "1 hour"), "by_source", tmp_path)
    want = monitor.watched(rocks.createDataFrame(rows, "machine string, t double, src string, dst string"), ["machine"], ["t", "src", "dst"], "t").collect()
    shown = lambda out, t: sorted((r["machine"], r[t], r["src"], r["dst"], round(r["prob"], 9), None if r["z"] is None else round(r["z"], 9), r["alert"]) for r in out)
    assert len(got) == len(rows)
    assert shown(got, "time") == shown(want, "t")
    assert sum(bool(r["alert"]) for r in got) > 5
