from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.operators import flows
from flowlens.sources import commits, readers

ROOT = Path(__file__).resolve().parents[1]


def names(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file() and commits.DONE not in str(p) and not p.name.startswith("."))


def batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["file", "value"])


def test_only_attempts_that_count_are_moved(tmp_path):
    writer = commits.CommitWriter(f"file://{tmp_path}", commits.FILES, "head", "", False)
    first = writer.write(iter([batch(("a/x.txt", "1"), ("a/x.txt", "2")), batch(("b.txt", "3"))]))
    again = writer.write(iter([batch(("a/x.txt", "1"), ("a/x.txt", "2")), batch(("b.txt", "3"))]))
    assert first.moves and not (tmp_path / "a").exists()
    writer.commit([again, None])
    assert names(tmp_path) == ["a/x.txt", "b.txt"] and (tmp_path / "a/x.txt").read_text() == "head\n1\n2\n"
    assert not (tmp_path / commits.STAGED).exists()


def test_two_tasks_of_one_file_and_bad_names_commit_nothing(tmp_path):
    writer = commits.CommitWriter(f"file://{tmp_path}", commits.FILES, "", "", False)
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit([writer.write(iter([batch(("a", "1"))])), writer.write(iter([batch(("a", "2"))]))])
    for bad in (None, "../up", "/etc/x", "_staged/x"):
        with pytest.raises(ValueError, match="no name"):
            writer.write(iter([batch(("ok", "1"), (bad, "2"))]))
    writer.abort([])
    assert names(tmp_path) == []


def test_bursts_round_trip(spark, tmp_path):
    rows = [(i, float(t), 0.0, 60 + i, "TCP", s, "10.0.0.2", "1.2.3.4", 4000, 443, 6, "aa:bb", None if i % 2 else "x.example.com", d, "on") for i, (t, s, d) in enumerate([(1, 0, "plug"), (2, 0, "plug"), (90, 0, "plug"), (91, 0, "plug"), (92, 1, "plug"), (1, 0, "lamp"), (2, 0, "lamp"), (3, 0, None), (4, 0, None)])]
    packets = spark.createDataFrame(rows, readers.PACKETS + ", device string, activity string")
    keys = ["device", "activity", "trans_proto", "stream_id"]
    bursts = flows.split_bursts(flows.with_deltas(packets, keys), keys, 1.0)
    commits.burst_files(bursts, str(tmp_path / "b"))
    assert names(tmp_path / "b") == ["lamp/on/flow6-0_burst1.000000.txt", "plug/on/flow6-0_burst1.000000.txt", "plug/on/flow6-0_burst90.000000.txt"]
    back = readers.packets(spark, str(tmp_path / "b"))
    want = {r[0]: r[13] for r in rows if r[13] and r[5] == 0}
    assert {r["frame_num"]: r["device"] for r in back.collect()} == want
    assert {r["host"] for r in back.collect()} == {None, "x.example.com"}
    commits.burst_files(bursts.where("device = 'lamp'"), str(tmp_path / "b"))
    assert names(tmp_path / "b") == ["lamp/on/flow6-0_burst1.000000.txt"]


def test_log_grows_once_a_batch(spark, tmp_path):
    rows = spark.range(100).withColumn("keep", F.col("id") % 4 > 0).withColumn("device", F.when(F.col("id") < 40, "plug").otherwise("lamp")).withColumn("event", F.col("id") % 7)
    said = commits.left_after_filter(rows, "keep", "event", ["device"])
    for name in ("one", "one", "two"):
        commits.append_log(said, str(tmp_path / "log"), F.col("line"), ["device"], name)
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "log")).collect())
    assert lines == ["lamp; Flows left: 0.750000 45 60; Activity left: 1.000000 7 7"] * 2 + ["plug; Flows left: 0.750000 30 40; Activity left: 1.000000 7 7"] * 2
    commits.append_log(said.limit(0), str(tmp_path / "log"), F.col("line"), ["device"], "three")
    assert spark.read.text(str(tmp_path / "log")).count() == 4


def test_failing_job_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def broken(x):
        if x == 70:
            raise RuntimeError("made to fail")
        return str(x)

    rows = spark.range(100).withColumn("value", broken("id"))
    with pytest.raises(Exception, match="made to fail"):
        commits.named_files(rows, str(tmp_path / "f"), F.concat(F.lit("f"), F.col("id") % 5), F.col("value"), ["id"])
    assert names(tmp_path / "f") == []


ONCE = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from flowlens.sources import commits
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()

@F.udf("string")
def once(x):
    if TaskContext.get().attemptNumber() == 0 and x % 10 == 9:
        raise RuntimeError("first attempt")
    return str(x)

rows = spark.range(60).repartition(3)
commits.named_files(rows, sys.argv[1] + "/f", F.concat(F.lit("f"), F.col("id") % 5), F.col("id").cast("string"), ["id"])
lines = rows.repartitionByRange(3, "id").withColumn("value", once("id")).withColumn("file", F.lit(""))
commits._written(lines, sys.argv[1] + "/log", commits.LOG, "append", "", "b")
spark.stop()
"""


def test_task_that_fails_once_doubles_nothing(tmp_path):
    script = tmp_path / "once.py"
    script.write_text(ONCE)
    subprocess.run([sys.executable, str(script), str(tmp_path)], check=True, timeout=180, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True)
    segments = [p for p in (tmp_path / "log").iterdir() if p.suffix == ".txt"]
    assert sorted(int(x) for p in segments for x in p.read_text().split()) == list(range(60)) and len(segments) == 3
    assert [(tmp_path / f"f/f{k}").read_text().split() for k in range(5)] == [[str(x) for x in range(k, 60, 5)] for k in range(5)]
    assert not (tmp_path / "log" / commits.STAGED).exists()
