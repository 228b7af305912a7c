"""Tables in the shape the operators take, derived from the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUTERS = ["192.168.10.1", "192.168.10.254"]
#: Columns of packets by expressions that Spark and DuckDB read alike; us is microseconds since 1970.
PACKET = {
    "frame_num": "event_id",
    "us": "us",
    "ts": "cast(us as double) / 1000000.0",
    "device": "concat('dev', cast(user_id % 10 as varchar(9)))",
    "frame_len": "cast(40 + (event_id * 37) % 1400 as int)",
    "trans_proto": "case when event_id % 3 = 0 then 17 else 6 end",
    "protocol": "case event_type when 'view' then 'TLSv1.2' when 'click' then 'TCP' when 'error' then 'DNS' when 'purchase' then 'MQTT' else 'UDP;QUIC' end",
    "ip_src": "case when event_id % 2 = 0 then concat('192.168.10.', cast(2 + user_id % 10 as varchar(9))) else concat('', case event_id % 5 when 0 then '52.94.1.10' when 1 then '192.168.10.1' when 2 then '10.0.0.7' when 3 then '224.0.0.251' else '8.8.8.8' end) end",
    "ip_dst": "case when event_id % 2 = 1 then concat('192.168.10.', cast(2 + user_id % 10 as varchar(9))) else concat('', case event_id % 5 when 0 then '52.94.1.10' when 1 then '192.168.10.1' when 2 then '10.0.0.7' when 3 then '224.0.0.251' else '8.8.8.8' end) end",
    "srcport": "cast(case when event_id % 2 = 0 then 40000 + user_id % 3 else 443 end as int)",
    "dstport": "cast(case when event_id % 2 = 1 then 40000 + user_id % 3 else 443 end as int)",
    "expert": "case when event_id % 11 = 0 then 'TCP retransmission' when event_id % 13 = 0 then 'Duplicate ACK #1' else '' end",
    "host": "case event_id % 6 when 0 then 'ec2-1-2.compute-1.amazonaws.com' when 1 then 'a.api.example.com' when 2 then 'b.api.example.com' when 3 then 'time.example.org' when 4 then '' else 'cdn.example.net' end",
    "label": "case event_type when 'view' then 'alexa_lamp_on' when 'click' then 'android_lan_lamp_off' when 'error' then 'unknown' when 'purchase' then 'local_watch' else 'ring' end",
    "event_type": "event_type",
    "user_id": "user_id",
    "value": "value",
}
PACKETS_SQL = "p as (select " + ", ".join(f"{e} as {n}" for n, e in PACKET.items()) + " from (select *, epoch_us(ts) as us from events))"
#: Host fingerprints: protocol, pattern, period.
FINGERPRINTS = [("TCP", "*.example.com", 3600.0), ("TCP", "cdn.example.net", 1800.0), ("UDP", "time.example.org", 7200.0), ("DNS", "*.compute.amazonaws.com", 600.0), ("TCP", "*.gone.example", 60.0)]
FINGERPRINTS_SQL = "fp(protocol, host_pattern, period) as (values " + ", ".join(f"('{a}', '{b}', {c}::double)" for a, b, c in FINGERPRINTS) + ")"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> str:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").selectExpr("* except (ts)", f"{micros('ts')} as us")
    return events.selectExpr(*[f"{e} as {n}" for n, e in PACKET.items()])


def outbound():
    return F.col("ip_src").startswith("192.168.10.") & (F.col("srcport") != 443)


OUTBOUND_SQL = "(starts_with(ip_src, '192.168.10.') and srcport <> 443)"


def fingerprints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FINGERPRINTS, "protocol string, host_pattern string, period double")
