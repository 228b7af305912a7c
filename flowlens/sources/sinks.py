"""Writers of the formats that other tools read."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_device(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """One folder for each device; ``kind`` is parquet or csv, ``mode`` ignore leaves what is there."""
    writer = rows.repartition("device").write.partitionBy("device").mode(mode)
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def event_log(rows: DataFrame, path: str) -> None:
    """(device, ts, label) as lines ``MM/dd/yyyy, HH:mm:ss.SSSSSS :label``, in order of time in each device's folder."""
    line = F.concat(F.date_format("ts", "MM/dd/yyyy, HH:mm:ss.SSSSSS"), F.lit(" :"), F.col("label"))
    rows.repartition("device").sortWithinPartitions("device", "ts").select("device", line.alias("value")).write.partitionBy("device").mode("overwrite").text(path)


def trace_text(rows: DataFrame, path: str) -> None:
    """(started, trace, pos, event, rel_ts) as traces of lines ``event, seconds`` after a separator, one block per trace."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("pos", "event", "rel_ts"))), lambda x: F.concat(x["event"], F.lit(", "), x["rel_ts"].cast("string")))
    blocks = rows.groupBy("started", "trace").agg(line.alias("l")).orderBy("started", "trace")
    blocks.select(F.concat(F.lit("------\n"), F.array_join("l", "\n")).alias("value")).write.mode("overwrite").text(path)


def fingerprint_text(rows: DataFrame, path: str) -> None:
    """(device, protocol, host_pattern, period, period2) as lines ``protocol host period [period]`` in each device's folder."""
    host = F.coalesce(F.nullif("host_pattern", F.lit("")), F.lit("#"))
    line = F.concat_ws(" ", "protocol", host, F.col("period").cast("long").cast("string"), F.col("period2").cast("long").cast("string"))
    rows.repartition("device").select("device", line.alias("value")).write.partitionBy("device").mode("overwrite").text(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def forests(models: dict[str, RandomForestClassificationModel], path: str) -> None:
    """One folder for each activity's forest. Scalers and clusters are tables and need no format of their own."""
    for activity, model in models.items():
        model.write().overwrite().save(f"{path}/{activity}")
