from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from flowlens.sources import readers, sinks


def put(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_packets_and_names(spark, tmp_path):
    head = "\t".join(c.split()[0] for c in readers.PACKETS.split(", "))
    put(tmp_path, "p/plug/on2/a.txt", f"{head}\n1\t10.5\t0\t60\tTCP\t3\t1.2.3.4\t10.0.0.2\t443\t4000\t6\taa:bb\tx.example.com\nbad\n")
    got = rows(readers.packets(spark, str(tmp_path / "p")).select("device", "activity", "frame_num", "ts", "frame_len", "host"))
    assert got == [("plug", "on", 1, 10.5, 60, "x.example.com")]
    put(tmp_path, "n/plug/dns.tsv", "X.example.com\t1.1.1.1,2.2.2.2\t5.0\n\t3.3.3.3\t6.0\n")
    assert rows(readers.name_history(spark, str(tmp_path / "n"))) == [("plug", "1.1.1.1", "x.example.com", 5.0), ("plug", "2.2.2.2", "x.example.com", 5.0)]


def test_features(spark, tmp_path):
    names = [*readers.FEATURES, "device", "state", "event", "start_time", "protocol", "hosts"]
    put(tmp_path, "f/plug.csv", ",".join(names) + "\n" + ",".join(["1"] * 22 + ["plug", "on", "", "7.5", "TCP", "a;b"]) + "\n")
    r = readers.features(spark, str(tmp_path / "f")).first()
    assert (r["meanBytes"], r["device"], r["event"], r["start_time"], r["hosts"], r["remote_ip"]) == (1.0, "plug", "", 7.5, "a;b", None)


def test_fingerprints(spark, tmp_path):
    put(tmp_path, "fp/plug.txt", "TCP *.x.com 30\nDNS # 60 7200\n\nshort line")
    assert rows(readers.periodic_fingerprints(spark, str(tmp_path / "fp")).select("device", "seq", "protocol", "host_pattern", "periods")) == [("plug", 0, "TCP", "*.x.com", [30.0]), ("plug", 1, "DNS", "", [60.0, 7200.0])]
    put(tmp_path, "af/plug.txt", "fingerprint- on: a.com,TCP;b.com,UDP;\nts- on:1.5\nother\n")
    r = readers.activity_fingerprints(spark, str(tmp_path / "af")).first()
    assert r["activity"] == "on" and [tuple(p) for p in r["pairs"]] == [("a.com", "TCP"), ("b.com", "UDP")] and r["avg_span"] == 1.5


def test_logs_and_traces(spark, tmp_path):
    put(tmp_path, "log/unctrl-plug.txt", "05/01/2021, 10:00:00.250000 :on\nbroken\n05/01/2021, 10:00:01.000000 :unknown\n05/01/2021, 10:00:02.000000 :0x\n")
    assert rows(readers.event_logs(spark, str(tmp_path / "log"))) == [("plug", datetime.datetime(2021, 5, 1, 10, 0, 0, 250000), "on")]
    put(tmp_path, "tr/t1", "plug-on, 0.0 \nlamp-off, 3.5 \n---2021-10-20 15:35:57.363749---\nplug-on, 0.0\n@skip, 1\n------\n")
    assert rows(readers.traces(spark, str(tmp_path / "tr"))) == [("t1", 0, 0, "plug-on", 0.0), ("t1", 0, 1, "lamp-off", 3.5), ("t1", 1, 0, "plug-on", 0.0)]
    put(tmp_path, "tl/x.txt", "1.5\n------a.com TCP 30------\n2.5\n------b.com DNS 60.5------\n3.5\n")
    assert rows(readers.timing_logs(spark, str(tmp_path / "tl")).drop("seq")) == [("x", "a.com", "TCP", 30.0, 2.5), ("x", "b.com", "DNS", 60.5, 3.5)]


def test_graph_registry_and_parties(spark, tmp_path):
    put(tmp_path, "g.dot", 'digraph G {\n  0 [label="INITIAL"];\n  1 [label="plug-on"];\n  0->1 [label="p:0.5,c:7"];\n}\n')
    nodes, edges = readers.dot_graph(spark, str(tmp_path / "g.dot"))
    assert rows(nodes) == [("0", "INITIAL"), ("1", "plug-on")] and rows(edges) == [("0", "1", 0.5, 7.0)]
    put(tmp_path, "d.txt", "a:0B:1:22:33:44 plug\n")
    assert rows(readers.device_registry(spark, str(tmp_path / "d.txt"))) == [("0a:0b:01:22:33:44", "plug")]
    put(tmp_path, "o.txt", "plug amazon aws\nlamp\n")
    assert rows(readers.first_parties(spark, str(tmp_path / "o.txt"))) == [("lamp", []), ("plug", ["amazon", "aws"])]
    put(tmp_path, "pt/plug.csv", "domain,count,org,party\na.com,3,a,2 \n")
    put(tmp_path, "pt/_x.csv", "")
    assert [r["party"] for r in readers.party_tables(spark, str(tmp_path / "pt/plug.csv")).collect()] == [2]


def test_sinks_round_trip(spark, tmp_path):
    t = datetime.datetime(2021, 5, 1, 10, 0, 0, 250000)
    df = spark.createDataFrame([("plug", t, "on"), ("lamp", t, "off")], "device string, ts timestamp_ntz, label string")
    sinks.by_device(df, str(tmp_path / "o"))
    assert rows(spark.read.parquet(str(tmp_path / "o")).select("device", "label")) == [("lamp", "off"), ("plug", "on")]
    sinks.event_log(df, str(tmp_path / "e"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "e")).where("device = 'plug'").collect()] == ["05/01/2021, 10:00:00.250000 :on"]
    tr = spark.createDataFrame([(1.0, 0, 0, "plug-on", 0.0), (1.0, 0, 1, "lamp-off", 2.5), (9.0, 1, 0, "x", 0.0)], "started double, trace int, pos int, event string, rel_ts double")
    sinks.trace_text(tr.coalesce(1), str(tmp_path / "t"))
    back = readers.traces(spark, str(tmp_path / "t"))
    assert sorted((r["event"], r["rel_ts"]) for r in back.collect()) == [("lamp-off", 2.5), ("plug-on", 0.0), ("x", 0.0)]
    fp = spark.createDataFrame([("plug", "TCP", "", 30.0, None), ("plug", "DNS", "a.com", 60.0, 7200.0)], "device string, protocol string, host_pattern string, period double, period2 double")
    sinks.fingerprint_text(fp, str(tmp_path / "f"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "f")).collect()) == ["DNS a.com 60 7200", "TCP # 30"]
    sinks.json_lines(df.select("device"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).select(F.count("*")).first()[0] == 2


def test_nested_activity_folders(spark, tmp_path):
    head = "\t".join(c.split()[0] for c in readers.PACKETS.split(", "))
    lines = lambda n: head + "\n" + "".join(f"{i}\t{i}.5\t0\t60\tTCP\t3\t1.2.3.4\t10.0.0.2\t443\t4000\t6\taa:bb\tx.example.com\n" for i in range(n))
    put(tmp_path, "p/plug/idle/a.txt", lines(2))
    put(tmp_path, "p/plug/voice/on/b.txt", lines(3))
    put(tmp_path, "p/plug/voice/on/companion.lamp.txt", lines(2))
    put(tmp_path, "p/plug/voice/on/short.txt", lines(1))
    put(tmp_path, "p/plug/power/on/c.txt", lines(2))
    put(tmp_path, "p/plug/voice/on/d.csv", lines(2))
    got = readers.activity_packets(spark, str(tmp_path / "p")).groupBy("device", "state", "event").count()
    assert rows(got) == [("lamp", "voice_companion_plug", "on", 2), ("plug", "idle", "idle", 2), ("plug", "voice", "on", 3)]


def test_hidden_overall_tables(spark, tmp_path):
    put(tmp_path, "o/periodic/_overall.csv", "device, first party,support party,third party\nplug,1, 2,3\nlamp,x,,\n")
    put(tmp_path, "o/other/_overall.csv", "device,first party\ncam,9\n")
    put(tmp_path, "o/other/plug.csv", "device\nno\n")
    got = rows(readers.hidden_overall_tables(spark, str(tmp_path / "o")).drop("file"))
    assert got == [("cam", 9, None, None), ("lamp", None, None, None), ("plug", 1, 2, 3)]
    assert readers.hidden_overall_tables(spark, str(tmp_path / "none")).collect() == []
