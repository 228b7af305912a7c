"""Readers of the text formats in which traffic, fingerprints and traces come."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PACKETS = "frame_num long, ts double, ts_delta double, frame_len int, protocol string, stream_id int, ip_src string, ip_dst string, srcport int, dstport int, trans_proto int, mac_addr string, host string"
RAW_PACKETS = PACKETS.replace(", host string", ", expert string")
# The feature columns in the order in which files have them.
FEATURES = "meanBytes minBytes maxBytes medAbsDev skewLength kurtosisLength meanTBP varTBP medianTBP kurtosisTBP skewTBP network_total network_in network_out network_external network_local network_in_local network_out_local meanBytes_out_external meanBytes_in_external meanBytes_out_local meanBytes_in_local".split()
ADDED = ["remote_ip string", "remote_port string", "trans_protocol int", "raw_protocol string"]
TRACE_BREAK = r"^-{3,}"


def path_part(up: int) -> Column:
    """A part of the file's path, 0 for the file's own name without its ending."""
    part = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - up)
    return F.regexp_replace(part, r"\.[A-Za-z0-9]+$", "") if up == 0 else part


def packets(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """Decoded packets, tab separated with a header; device and activity are the folders above the file.

    ``raw`` files have the capture's expert marks instead of hosts. A trailing 2
    of an activity is dropped; rows without a time are.
    """
    rows = spark.read.schema(RAW_PACKETS if raw else PACKETS).option("sep", "\t").option("header", True).option("recursiveFileLookup", True).csv(path)
    return rows.select("*", path_part(2).alias("device"), F.regexp_replace(path_part(1), "2$", "").alias("activity")).where("ts is not null")


#: Activities whose files lie right below them, without a folder for the event.
UNLABELLED = ("unctrl", "unctr", "idle")


def activity_packets(spark: SparkSession, path: str, least: int = 2, without: tuple[str, ...] = ("power",)) -> DataFrame:
    """Decoded packets of nested folders ``device/activity/event/file.txt``, or without the event below ``UNLABELLED``: with device, state, event and file.

    A file whose name has ``companion`` belongs to the device named before its
    ending, and its state names the folder's device too. Files of fewer than
    ``least`` rows, files that aren't .txt, and states in ``without`` are left out.
    """
    rows = spark.read.schema(PACKETS).option("sep", "\t").option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), *[path_part(k).alias(f"_up{k}") for k in (1, 2, 3)])
    bare = F.col("_up1").isin(*UNLABELLED)
    device, state = F.when(bare, F.col("_up2")).otherwise(F.col("_up3")), F.when(bare, F.col("_up1")).otherwise(F.col("_up2"))
    name = F.element_at(F.split("file", "/"), -1)
    companion = name.contains("companion")
    own = F.when(companion, F.get(F.split(name, r"\."), F.size(F.split(name, r"\.")) - 2)).otherwise(device)
    rows = rows.withColumns({"device": own, "state": F.when(companion, F.concat(state, F.lit("_companion_"), device)).otherwise(state), "event": F.col("_up1")}).drop("_up1", "_up2", "_up3")
    enough = rows.groupBy("file").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("file")
    return rows.where(~F.col("state").isin(*without) & F.col("ts").isNotNull()).join(enough, "file", "left_semi")


def name_history(spark: SparkSession, path: str) -> DataFrame:
    """(device, ip, host, ts) from answers: name, comma separated addresses, time, tab separated, one folder per device."""
    rows = spark.read.schema("host string, ips string, ts double").option("sep", "\t").option("recursiveFileLookup", True).csv(path).select("*", path_part(1).alias("device"))
    return rows.where("host <> '' and ts is not null").select("device", F.explode(F.split("ips", ",")).alias("ip"), F.lower("host").alias("host"), "ts").where("ip <> ''")


def features(spark: SparkSession, path: str, second_version: bool = False) -> DataFrame:
    """Burst features of one CSV file per device; the first version's files lack four columns, which are null then."""
    numbers = [f"{c} double" for c in FEATURES]
    schema = ", ".join([*numbers, "device string", "state string", "event string", "start_time double", *(ADDED if second_version else []), "protocol string", "hosts string"])
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    if not second_version:
        rows = rows.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in ADDED})
    return rows.withColumn("event", F.coalesce("event", F.lit("")))


def periodic_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(device, seq, protocol, host_pattern, periods) from lines ``protocol host period [period]``; # is no host."""
    rows = _lines(spark, path).where("trim(line) <> ''").withColumn("t", F.split(F.trim("line"), r"\s+")).where(F.size("t") >= 3)
    host = F.when(F.get("t", 1).isin("#", "-"), "").otherwise(F.get("t", 1))
    periods = F.transform(F.slice("t", 3, F.size("t") - 2), lambda x: x.try_cast("double"))
    return rows.select(F.col("file").alias("device"), "seq", F.get("t", 0).alias("protocol"), host.alias("host_pattern"), F.filter(periods, lambda p: p.isNotNull()).alias("periods"))


def activity_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(device, activity, pairs, avg_span) from lines ``fingerprint- act: host,proto;...`` and ``ts- act:span``."""
    rows = _lines(spark, path)
    body = rows.select(F.col("file").alias("device"), F.regexp_extract("line", r"^(fingerprint|ts)- ", 1).alias("kind"), F.trim(F.regexp_extract("line", r"^[a-z]+- ([^:]+):", 1)).alias("activity"), F.trim(F.regexp_extract("line", r"^[a-z]+- [^:]+:(.*)$", 1)).alias("value"))
    pairs = F.transform(F.filter(F.split("value", ";"), lambda p: p.contains(",")), lambda p: F.struct(F.trim(F.split_part(p, F.lit(","), F.lit(1))).alias("host"), F.trim(F.split_part(p, F.lit(","), F.lit(2))).alias("protocol")))
    prints = body.where("kind = 'fingerprint'").select("device", "activity", pairs.alias("pairs"))
    spans = body.where("kind = 'ts'").select("device", "activity", F.col("value").try_cast("double").alias("avg_span"))
    return prints.join(spans, ["device", "activity"], "left")


def event_logs(spark: SparkSession, path: str, prefix: str = "unctrl-") -> DataFrame:
    """(device, ts, label) from lines ``MM/dd/yyyy, HH:mm:ss.SSSSSS :label``; malformed, unknown and 0 labels go."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.regexp_replace(path_part(0), f"^{prefix}", "").alias("device"))
    found = rows.select("device", F.try_to_timestamp(F.trim(F.regexp_extract("value", r"^(.*\d)\s*:\s*\S.*$", 1)), F.lit("MM/dd/yyyy, HH:mm:ss.SSSSSS")).cast("timestamp_ntz").alias("ts"), F.trim(F.regexp_extract("value", r"^.*\d\s*:\s*(\S.*)$", 1)).alias("label"))
    return found.where("ts is not null and label not in ('', 'unknown') and label not like '0%'")


def traces(spark: SparkSession, path: str, skip: str = "@") -> DataFrame:
    """(file, trace, pos, event, rel_ts) from lines ``event, seconds`` between lines that begin with ---.

    Events that begin with ``skip`` are left out. Traces count from 0 in each file.
    """
    rows = _lines(spark, path).withColumn("cut", F.col("line").rlike(TRACE_BREAK))
    w = Window.partitionBy("file").orderBy("seq")
    rows = rows.withColumn("n", F.sum(F.col("cut").cast("int")).over(w)).where("not cut and trim(line) <> ''").where(~F.startswith("line", F.lit(skip)))
    t = Window.partitionBy("file", "n").orderBy("seq")
    event, rel = F.trim(F.regexp_extract("line", r"^(.*?)(,\s*[-0-9.eE+]+\s*)?$", 1)), F.regexp_extract("line", r",\s*([-0-9.eE+]+)\s*$", 1).try_cast("double")
    rows = rows.select("file", "n", (F.row_number().over(t) - 1).alias("pos"), event.alias("event"), rel.alias("rel_ts"))
    return rows.select("file", (F.dense_rank().over(Window.partitionBy("file").orderBy("n")) - 1).alias("trace"), "pos", "event", "rel_ts")


def dot_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (src, dst, prob, cnt) of a DOT file whose edge labels are ``a:prob,b:count``."""
    rows = _lines(spark, path)
    edge = r'^\s*"?([^"\s]+)"?\s*->\s*"?([^"\s\[]+)"?\s*\[.*label\s*=\s*"([^"]*)"'
    edges = rows.where(F.col("line").rlike(edge)).select(F.regexp_extract("line", edge, 1).alias("src"), F.regexp_extract("line", edge, 2).alias("dst"), F.regexp_extract("line", edge, 3).alias("l"))
    number = lambda i: F.element_at(F.split(F.get(F.split("l", ","), i), ":"), -1).try_cast("double")
    node = r'^\s*"?([^"\s\[>-]+)"?\s*\[.*label\s*=\s*"([^"]*)"'
    nodes = rows.where(F.col("line").rlike(node) & ~F.col("line").contains("->")).select(F.regexp_extract("line", node, 1).alias("id"), F.regexp_extract("line", node, 2).alias("label"))
    return nodes, edges.select("src", "dst", number(0).alias("prob"), number(1).alias("cnt"))


def timing_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, host, protocol, period, value): detail lines under headers ``------host protocol period------``."""
    head = r"^-{6}(\S*)\s+(\S+)\s+([0-9.]+)-{6}$"
    rows = _lines(spark, path)
    w = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("line").rlike(head), F.struct(*[F.regexp_extract("line", head, i).alias(n) for i, n in ((1, "host"), (2, "protocol"), (3, "period"))]))
    rows = rows.withColumn("h", F.last(header, ignorenulls=True).over(w)).where(~F.col("line").rlike(head) & F.col("h").isNotNull() & (F.trim("line") != ""))
    return rows.select("file", "seq", "h.host", "h.protocol", F.col("h.period").cast("double").alias("period"), F.col("line").try_cast("double").alias("value"))


def device_registry(spark: SparkSession, path: str) -> DataFrame:
    """(mac, device) from lines ``mac device``; octets get two digits."""
    rows = spark.read.text(path).withColumn("t", F.split(F.trim("value"), r"\s+")).where(F.size("t") >= 2)
    octets = F.transform(F.split(F.lower(F.get("t", 0)), ":"), lambda x: F.lpad(x, 2, "0"))
    return rows.select(F.array_join(octets, ":").alias("mac"), F.get("t", 1).alias("device"))


def first_parties(spark: SparkSession, path: str) -> DataFrame:
    """(device, orgs) from lines ``device org org ...``."""
    rows = spark.read.text(path).withColumn("t", F.split(F.trim("value"), r"\s+")).where("trim(value) <> ''")
    return rows.select(F.get("t", 0).alias("device"), F.slice("t", 2, F.size("t")).alias("orgs"))


def party_tables(spark: SparkSession, path: str) -> DataFrame:
    """Destination tables with a header, one file per device, ``_overall`` left out; party is trimmed to a number."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path).select("*", path_part(0).alias("device"))
    return rows.where("device not like '\\_overall%'").withColumn("party", F.trim("party").try_cast("int"))


def overall_tables(spark: SparkSession, path: str) -> DataFrame:
    """Summaries by device with a header (first, support and third party counts); counts as longs, spaces in names as underscores.

    Spark passes over files whose name begins with an underscore; ``hidden_overall_tables`` reads those.
    """
    rows = spark.read.csv(path, header=True, recursiveFileLookup=True)
    return rows.select(*[(F.col(c) if c == "device" else F.trim(c).try_cast("long")).alias(c.strip().replace(" ", "_")) for c in rows.columns])


def hidden_overall_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, device, first_party, support_party, third_party) from every ``_overall.csv`` below a path, in any store that pyarrow opens.

    The driver lists the files, and tasks read one each; a summary has a row for
    each device. Columns that a file lacks are null.
    """
    fs, root = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    found = sorted(i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)) if i.is_file and i.base_name.startswith("_overall") and i.path.endswith(".csv"))
    names = ["device", "first party", "support party", "third party"]
    store = path.split("://")[0] + "://" if "://" in path else "file://"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held = pyarrow.fs.FileSystem.from_uri(store + file)[0]
                with held.open_input_stream(file) as f:
                    lines = [{(k or "").strip(): v for k, v in r.items() if isinstance(v, str)} for r in csv.DictReader(io.TextIOWrapper(f, "utf-8"), skipinitialspace=True)]
                columns = [pa.array([r.get(n) for r in lines], pa.string()) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(lines), pa.string()), *columns], names=["file", *[n.replace(" ", "_") for n in names]])

    schema = "file string, device string, first_party string, support_party string, third_party string"
    listed = spark.createDataFrame([(f,) for f in found], "file string").repartition(max(1, min(len(found), 200)))
    rows = listed.mapInArrow(each, schema)
    return rows.select("file", "device", *[F.trim(c).try_cast("long").alias(c) for c in ("first_party", "support_party", "third_party")])


def forests(spark: SparkSession, path: str, activities: list[str]) -> dict[str, RandomForestClassificationModel]:
    """The forests that ``sinks.forests`` wrote, by activity."""
    return {a: RandomForestClassificationModel.load(f"{path}/{a}") for a in activities}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, line) of small text files; a file is read whole so that its lines keep their places."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", path_part(0).alias("file"))
    return rows.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line"))
