"""From packets to flow bursts and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from flowlens.functions import net

from . import scans

#: Sends the median's absolute deviation to a standard deviation.
MAD_SCALE = 0.6744897501960817


def oriented(packets: DataFrame, is_outbound: Column) -> DataFrame:
    """Adds local_ip, local_port, remote_ip, remote_port and outbound."""
    pick = lambda a, b: F.when(is_outbound, F.col(a)).otherwise(F.col(b))
    ends = {"local_ip": ("ip_src", "ip_dst"), "local_port": ("srcport", "dstport"), "remote_ip": ("ip_dst", "ip_src"), "remote_port": ("dstport", "srcport")}
    return packets.withColumns({k: pick(*v) for k, v in ends.items()} | {"outbound": is_outbound})


FLOW = ["device", "trans_proto", "local_ip", "local_port", "remote_ip", "remote_port"]


def with_deltas(packets: DataFrame, keys: list[str], ts: str = "ts", tie: str = "frame_num", cuts: DataFrame | None = None) -> DataFrame:
    """Adds ts_delta, the time since the flow's last packet to six places; a first packet has 0.

    ``cuts``, from ``scans.hot_cuts`` for the same keys, spreads each large flow over many tasks.
    """
    rows = scans.previous_time(scans.sliced(packets, keys, ts, cuts), keys, ts, tie, cuts)
    return rows.withColumn("ts_delta", F.round(F.coalesce(F.col(ts) - F.col("_before"), F.lit(0.0)), 6)).drop("_before", "_slice")


def without_retransmissions(packets: DataFrame, expert: str = "expert") -> DataFrame:
    """Drops repeats that a capture marks; a null mark keeps the packet."""
    e = F.coalesce(F.col(expert), F.lit(""))
    return packets.where(~(e.contains("retransmission") | e.contains("Duplicate ACK")))


def decodable(packets: DataFrame, idle: bool = False) -> DataFrame:
    """Packets between two IPv4 addresses that aren't ICMP; of idle traffic STUN's old form goes too. Null protocols stay."""
    out = ("ICMP", "CLASSIC-STUN") if idle else ("ICMP",)
    return packets.where(net.is_ipv4(F.col("ip_src")) & net.is_ipv4(F.col("ip_dst")) & ~F.coalesce(F.col("protocol").isin(*out), F.lit(False)))


def split_bursts(packets: DataFrame, keys: list[str], gap: float, ts: str = "ts", tie: str = "frame_num", cuts: DataFrame | None = None) -> DataFrame:
    """Adds burst, counted from 0 in each flow, and burst_start; a burst's first delta becomes 0.

    A burst ends where ts_delta exceeds ``gap``. Deltas may have been taken
    before packets were dropped, so a dropped packet doesn't widen a gap.
    ``cuts``, from ``scans.hot_cuts`` for the same keys, spreads each large flow
    over many tasks; a slice then takes over how many bursts opened before it
    and when the last of them did.
    """
    wide = F.coalesce(F.col("ts_delta") > gap, F.lit(False))
    states = [F.count_if(wide).alias("_n"), F.max(F.when(wide, F.col(ts))).alias("_t"), F.min(ts).alias("_f"), F.min_by(wide, F.struct(ts, tie)).alias("_w")]

    def carry(table: DataFrame, w: WindowSpec) -> DataFrame:
        table = table.withColumn("_own", (F.row_number().over(w) == 1) & ~F.col("_w"))  # a flow's first packet opens a burst in any case
        opened, last = F.col("_n") + F.col("_own").cast("long"), F.coalesce("_t", F.when(F.col("_own"), F.col("_f")))
        return table.withColumns({"_opened": F.sum(opened).over(scans.before(w)), "_open": F.last(last, ignorenulls=True).over(scans.before(w))})

    rows = scans.carried(scans.sliced(packets, keys, ts, cuts), keys, cuts, states, carry, {"_opened": "long", "_open": packets.schema[ts].dataType.simpleString()})
    w = Window.partitionBy(*keys, "_slice").orderBy(ts, tie)
    rows = rows.withColumn("_opens", wide | ((F.row_number().over(w) == 1) & F.col("_opened").isNull()))
    start = F.coalesce(F.last(F.when(F.col("_opens"), F.col(ts)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open"))
    burst = F.sum(F.col("_opens").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_opened", F.lit(0)) - 1
    rows = rows.withColumns({"burst": burst.cast("long"), "burst_start": start, "ts_delta": F.when(F.col("_opens"), 0.0).otherwise(F.col("ts_delta"))})
    return rows.drop("_opens", "_opened", "_open", "_slice")


def at_least(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of groups of at least ``n`` rows."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= n).drop("_n")


def moments(x: str, prefix: str) -> list[Column]:
    """Population skewness and excess kurtosis; 0 and -3 where all values are equal."""
    return [F.coalesce(F.skewness(x), F.lit(0.0)).alias(f"skew{prefix}"), F.coalesce(F.kurtosis(x), F.lit(-3.0)).alias(f"kurtosis{prefix}")]


def with_median_deviation(rows: DataFrame, keys: list[str], x: str, name: str, most: int | None = None) -> DataFrame:
    """One row for each group: its keys and the scaled median absolute deviation of ``x``.

    With ``most``, groups of more values than that are never gathered in one
    task: both medians then come from ``quantiles.exact_quantiles``.
    """
    from .quantiles import exact_quantiles

    def median(df: DataFrame, column: str, called: str) -> DataFrame:
        if most is None:
            return df.groupBy(*keys).agg(F.median(column).alias(called))
        return exact_quantiles(df, keys, column, [0.5], most).select(*keys, F.col("quantiles")[0].alias(called))

    away = rows.join(median(rows, x, "_middle"), keys).withColumn("_away", F.abs(F.col(x) - F.col("_middle")))
    return median(away, "_away", "_deviation").select(*keys, (F.col("_deviation") / MAD_SCALE).alias(name))


def burst_features(rows: DataFrame, keys: list[str], routers: list[str]) -> DataFrame:
    """The 22 features of each burst, its start, protocol and hosts.

    Needs frame_len, ts, ts_delta, outbound, local_ip, remote_ip, protocol,
    trans_proto and host. A burst's median length is taken in a window over its
    keys, so that all features come from one grouped aggregate on the same
    partitioning, and the packets are read once.
    """
    local = net.is_local_traffic(F.col("local_ip"), F.col("remote_ip"), routers)
    rows = rows.withColumn("_local", local).withColumn("_middle", F.median("frame_len").over(Window.partitionBy(*keys)))
    ways = {"out_external": F.col("outbound") & ~F.col("_local"), "in_external": ~F.col("outbound") & ~F.col("_local"), "out_local": F.col("outbound") & F.col("_local"), "in_local": ~F.col("outbound") & F.col("_local")}
    names = F.collect_set("protocol")
    protocol = F.concat_ws(";", F.sort_array(F.filter(names, lambda p: p.isin(*net.INFRASTRUCTURE))))
    hosts = F.concat_ws(";", F.sort_array(F.collect_set(F.when(F.col("host") != "", net.collapse_cloud(F.col("host"))))))
    out = rows.groupBy(*keys).agg(
        F.avg("frame_len").alias("meanBytes"),
        F.min("frame_len").alias("minBytes"),
        F.max("frame_len").alias("maxBytes"),
        *moments("frame_len", "Length"),
        F.avg("ts_delta").alias("meanTBP"),
        F.coalesce(F.var_samp("ts_delta"), F.lit(0.0)).alias("varTBP"),
        F.median("ts_delta").alias("medianTBP"),
        *moments("ts_delta", "TBP"),
        F.count("*").alias("network_total"),
        F.count_if(~F.col("outbound")).alias("network_in"),
        F.count_if("outbound").alias("network_out"),
        F.count_if(~F.col("_local")).alias("network_external"),
        F.count_if("_local").alias("network_local"),
        F.count_if(ways["in_local"]).alias("network_in_local"),
        F.count_if(ways["out_local"]).alias("network_out_local"),
        *[F.coalesce(F.avg(F.when(on, F.col("frame_len"))), F.lit(0.0)).alias(f"meanBytes_{way}") for way, on in ways.items()],
        F.min("ts").alias("start_time"),
        protocol.alias("_infra"),
        F.min("trans_proto").alias("_trans"),
        hosts.alias("_hosts"),
        F.min("remote_ip").alias("_remote"),
        (F.median(F.abs(F.col("frame_len") - F.col("_middle"))) / MAD_SCALE).alias("medAbsDev"),
    )
    out = out.withColumn("protocol_name", F.coalesce(F.nullif("_infra", F.lit("")), F.when(F.col("_trans") == 6, "TCP").when(F.col("_trans") == 17, "UDP").otherwise("other")))
    return out.withColumn("hosts", F.coalesce(F.nullif("_hosts", F.lit("")), F.col("_remote"))).drop("_infra", "_trans", "_hosts", "_remote")
