"""Packets, flows, bursts, features and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import net
from flowlens.operators import flows, lookups, quantiles, scans

from .inputs import FINGERPRINTS_SQL, OUTBOUND_SQL, PACKETS_SQL, ROUTERS, fingerprints, outbound, packets, read
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

GAP = 20_000.0
_PRIVATE = "({0} like '10.%' or {0} like '127.%' or {0} like '192.168.%')"
_MULTI = "({0} like '224.%')"
_LOCAL = "((src_p and dst_p) or (src_p and ip_dst in ('192.168.10.1', '192.168.10.254')) or (dst_p and ip_src in ('192.168.10.1', '192.168.10.254')))"
_ORIENTED = f"""with {PACKETS_SQL},
o as (select *, {OUTBOUND_SQL} as outbound,
  case when {OUTBOUND_SQL} then ip_src else ip_dst end as local_ip, case when {OUTBOUND_SQL} then srcport else dstport end as local_port,
  case when {OUTBOUND_SQL} then ip_dst else ip_src end as remote_ip, case when {OUTBOUND_SQL} then dstport else srcport end as remote_port from p),
d as (select *, round(coalesce(ts - lag(ts) over f, 0), 6) as ts_delta from o window f as (partition by device, trans_proto, local_ip, local_port, remote_ip, remote_port order by ts, frame_num)),
k as (select * from d where not (contains(expert, 'retransmission') or contains(expert, 'Duplicate ACK'))),
i as (select *, sum(case when rn = 1 or ts_delta > {GAP} then 1 else 0 end) over f - 1 as burst, rn = 1 or ts_delta > {GAP} as opens
  from (select *, row_number() over f as rn from k window f as (partition by device, trans_proto, local_ip, local_port, remote_ip, remote_port order by ts, frame_num))
  window f as (partition by device, trans_proto, local_ip, local_port, remote_ip, remote_port order by ts, frame_num)),
b as (select * exclude (ts_delta, burst), burst::bigint as burst, case when opens then 0 else ts_delta end as ts_delta,
  min(ts) over (partition by device, trans_proto, local_ip, local_port, remote_ip, remote_port, burst) as burst_start from i),
m as (select * from (select *, count(*) over (partition by device, trans_proto, local_ip, local_port, remote_ip, remote_port, burst) as n from b) where n >= 2)
"""
KEYS = [*flows.FLOW, "burst"]
_KEYS = ", ".join(KEYS)


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows.oriented(packets(spark, sf_dir), outbound())
    cuts = scans.hot_cuts(rows, flows.FLOW, "ts")
    return flows.split_bursts(flows.without_retransmissions(flows.with_deltas(rows, flows.FLOW, cuts=cuts)), flows.FLOW, GAP, cuts=cuts)


@query(f"""with {PACKETS_SQL} select frame_num, ip_src, ip_dst, {_PRIVATE.format('ip_src')} as src_private, {_MULTI.format('ip_dst')} as dst_multicast,
  ({_PRIVATE.format('ip_src')} and {_PRIVATE.format('ip_dst')}) or ({_PRIVATE.format('ip_src')} and ip_dst in ('192.168.10.1', '192.168.10.254')) or ({_PRIVATE.format('ip_dst')} and ip_src in ('192.168.10.1', '192.168.10.254')) as local_traffic
  from p where frame_len >= 60 and ip_src is not null""")
def packet_predicates(spark, sf_dir):
    rows = packets(spark, sf_dir).where(net.is_ipv4(F.col("ip_src")) & (F.col("frame_len") >= 60))
    return rows.select("frame_num", "ip_src", "ip_dst", net.is_private(F.col("ip_src")).alias("src_private"), net.is_multicast(F.col("ip_dst")).alias("dst_multicast"), net.is_local_traffic(F.col("ip_src"), F.col("ip_dst"), ROUTERS).alias("local_traffic"))


@query(_ORIENTED + "select device, trans_proto, local_ip, local_port, remote_ip, remote_port, count(*) as n_packets, sum(frame_len)::bigint as n_bytes from o group by all")
def flow_groups(spark, sf_dir):
    return flows.oriented(packets(spark, sf_dir), outbound()).groupBy(*flows.FLOW).agg(F.count("*").alias("n_packets"), F.sum("frame_len").alias("n_bytes"))


@query(_ORIENTED + "select frame_num, ts_delta from d")
def packet_deltas(spark, sf_dir):
    return flows.with_deltas(flows.oriented(packets(spark, sf_dir), outbound()), flows.FLOW).select("frame_num", "ts_delta")


@query(_ORIENTED + "select frame_num, ts_delta, expert from k")
def retransmissions_removed(spark, sf_dir):
    rows = flows.with_deltas(flows.oriented(packets(spark, sf_dir), outbound()), flows.FLOW)
    return flows.without_retransmissions(rows).select("frame_num", "ts_delta", "expert")


@query(_ORIENTED + "select frame_num, burst, round(burst_start, 6) as burst_start, ts_delta from b")
def burst_split(spark, sf_dir):
    return _bursts(spark, sf_dir).select("frame_num", "burst", F.round("burst_start", 6).alias("burst_start"), "ts_delta")


@query(_ORIENTED + f"select {_KEYS}, count(*) as n_packets from m group by all")
def bursts_of_two(spark, sf_dir):
    return flows.at_least(_bursts(spark, sf_dir), KEYS, 2).groupBy(*KEYS).agg(F.count("*").alias("n_packets"))


_HOT = _ORIENTED.replace("device, trans_proto, local_ip, local_port, remote_ip, remote_port", "trans_proto")


@query(_HOT + "select frame_num, burst, round(burst_start, 6) as burst_start, ts_delta from b")
def sliced_bursts(spark, sf_dir):
    """Bursts of all TCP and all UDP packets: two keys, each cut in slices of about two thousand packets."""
    rows, keys = flows.oriented(packets(spark, sf_dir), outbound()), ["trans_proto"]
    cuts = scans.hot_cuts(rows, keys, "ts", 2000)
    rows = flows.without_retransmissions(flows.with_deltas(rows, keys, cuts=cuts))
    return flows.split_bursts(rows, keys, GAP, cuts=cuts).select("frame_num", "burst", F.round("burst_start", 6).alias("burst_start"), "ts_delta")


_MOMENTS = """case when var_pop({x}) > 0 then avg(power({x} - {x}_m, 3)) / power(var_pop({x}), 1.5) else 0 end as skew{n},
  case when var_pop({x}) > 0 then avg(power({x} - {x}_m, 4)) / power(var_pop({x}), 2) - 3 else -3 end as kurtosis{n}"""


@query(_ORIENTED + f""", c as (select *, {_PRIVATE.format('local_ip')} as src_p, {_PRIVATE.format('remote_ip')} as dst_p from m),
l as (select *, (src_p and dst_p) or (src_p and remote_ip in ('192.168.10.1', '192.168.10.254')) or (dst_p and local_ip in ('192.168.10.1', '192.168.10.254')) as loc,
  avg(frame_len) over w as frame_len_m, avg(ts_delta) over w as ts_delta_m, median(frame_len) over w as med from c window w as (partition by {_KEYS})),
g as (select {_KEYS}, avg(frame_len) as meanBytes, min(frame_len) as minBytes, max(frame_len) as maxBytes, {_MOMENTS.format(x='frame_len', n='Length')},
  avg(ts_delta) as meanTBP, coalesce(var_samp(ts_delta), 0) as varTBP, median(ts_delta) as medianTBP, {_MOMENTS.format(x='ts_delta', n='TBP')},
  count(*) as network_total, count_if(not outbound)::bigint as network_in, count_if(outbound)::bigint as network_out, count_if(not loc)::bigint as network_external, count_if(loc)::bigint as network_local,
  count_if(not outbound and loc)::bigint as network_in_local, count_if(outbound and loc)::bigint as network_out_local,
  coalesce(avg(frame_len) filter (where outbound and not loc), 0) as meanBytes_out_external, coalesce(avg(frame_len) filter (where not outbound and not loc), 0) as meanBytes_in_external,
  coalesce(avg(frame_len) filter (where outbound and loc), 0) as meanBytes_out_local, coalesce(avg(frame_len) filter (where not outbound and loc), 0) as meanBytes_in_local,
  min(ts) as start_time, median(abs(frame_len - med)) / 0.6744897501960817 as medAbsDev,
  coalesce(string_agg(distinct protocol, ';' order by protocol) filter (where protocol = 'DNS'), case min(trans_proto) when 6 then 'TCP' else 'UDP' end) as protocol_name,
  coalesce(string_agg(distinct case when host like 'ec2%' then '*.compute.amazonaws.com' else host end, ';' order by case when host like 'ec2%' then '*.compute.amazonaws.com' else host end) filter (where host <> ''), min(remote_ip)) as hosts
  from l group by {_KEYS})
select {_KEYS}, round(meanBytes, 4) as meanBytes, minBytes, maxBytes, round(skewLength, 4) as skewLength, round(kurtosisLength, 4) as kurtosisLength, round(meanTBP, 4) as meanTBP, round(varTBP, 2) as varTBP, round(medianTBP, 4) as medianTBP,
  round(skewTBP, 4) as skewTBP, round(kurtosisTBP, 4) as kurtosisTBP, network_total, network_in, network_out, network_external, network_local, network_in_local, network_out_local,
  round(meanBytes_out_external, 4) as meanBytes_out_external, round(meanBytes_in_external, 4) as meanBytes_in_external, round(meanBytes_out_local, 4) as meanBytes_out_local, round(meanBytes_in_local, 4) as meanBytes_in_local,
  round(start_time, 6) as start_time, round(medAbsDev, 4) as medAbsDev, protocol_name, hosts from g""")
def flow_burst_features(spark, sf_dir):
    out = flows.burst_features(flows.at_least(_bursts(spark, sf_dir), KEYS, 2), KEYS, ROUTERS)
    places = {"varTBP": 2, "start_time": 6}
    return out.select(*[F.round(c, places.get(c, 4)).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@query(f"with {PACKETS_SQL} select frame_num, device, ts from p where ts between 1704672000 and 1705276800 or device in ('dev3', 'dev7')")
def time_range(spark, sf_dir):
    return packets(spark, sf_dir).where(F.col("ts").between(1704672000, 1705276800) | F.col("device").isin("dev3", "dev7")).select("frame_num", "device", "ts")


@query(f"with {PACKETS_SQL} select frame_num, protocol, host from p where protocol not in ('DNS', 'MDNS', 'NTP', 'SSDP', 'DHCP') and not {_MULTI.format('ip_dst')} and not {_MULTI.format('ip_src')} and host not like '%192%' and not contains(host, ':')")
def without_infrastructure(spark, sf_dir):
    rows = packets(spark, sf_dir).where(~F.col("protocol").isin(*net.INFRASTRUCTURE))
    return rows.where(~net.is_multicast(F.col("ip_dst")) & ~net.is_multicast(F.col("ip_src")) & ~F.col("host").contains("192") & ~F.col("host").contains(":")).select("frame_num", "protocol", "host")


@query(f"""with {PACKETS_SQL} select frame_num, case when contains(protocol, 'TCP') or contains(protocol, 'MQTT') or contains(protocol, 'TLS') then 'TCP' when contains(protocol, 'UDP') then 'UDP' else protocol end as protocol,
  lower(case when host like 'ec2%' then '*.compute.amazonaws.com' else host end) as host, case label when 'alexa_lamp_on' then 'lamp_on_off' when 'android_lan_lamp_off' then 'lamp_on_off' when 'local_watch' then 'watch' else label end as activity from p""")
def normalised_names(spark, sf_dir):
    host = net.main_host(net.collapse_cloud(F.col("host")))
    return packets(spark, sf_dir).select("frame_num", net.transport(F.col("protocol")).alias("protocol"), host.alias("host"), net.activity(F.col("label")).alias("activity"))


@query("""with h as (select distinct concat('n', cast(c_nationkey as varchar), '.s', cast(c_custkey % 7 as varchar), case when c_custkey % 4 = 0 then '' else '.svc' end, '.example.com') as host from customer),
s as (select host, array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') as suffix, len(string_split(host, '.')) as n from h),
c as (select suffix, count(*) as k, max(n) as longest from s group by suffix)
select host, case when k >= 2 and longest >= 4 then '*.' || s.suffix else host end as domain from s join c on c.suffix = s.suffix""")
def collapsed_domains(spark, sf_dir):
    from pyspark.sql.window import Window

    hosts = read(spark, sf_dir, "customer").selectExpr("concat('n', c_nationkey, '.s', c_custkey % 7, case when c_custkey % 4 = 0 then '' else '.svc' end, '.example.com') as host").distinct()
    rows = hosts.withColumn("suffix", net.suffix(F.col("host")))
    w = Window.partitionBy("suffix")
    shared = (F.count("*").over(w) >= 2) & (F.max(net.labels_of(F.col("host"))).over(w) >= 4)
    return rows.select("host", F.when(shared, F.concat(F.lit("*."), F.col("suffix"))).otherwise(F.col("host")).alias("domain"))


@query("""select c_custkey, device, case
  when starts_with(device, 'tplink') and host = 'n-devs.tplinkcloud.com' then 'devs.tplinkcloud.com'
  when starts_with(device, 'wink-hub2') and host = '3.90.178.36' then '*.compute-1.amazonaws.com'
  when starts_with(device, 'wyze-cam') and host = '45.56.113.17' then '*.ip.linodeusercontent.com'
  else host end as host
from (select c_custkey, ['tplink-bulb', 'wink-hub2', 'wyze-cam', 'nest-tstat'][1 + c_custkey % 4] as device,
  ['n-devs.tplinkcloud.com', '3.90.178.36', '45.56.113.17', 'www.example.com', null][1 + c_nationkey % 5] as host from customer)""")
def aliased_hosts(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "array('tplink-bulb', 'wink-hub2', 'wyze-cam', 'nest-tstat')[int(c_custkey % 4)] as device",
        "array('n-devs.tplinkcloud.com', '3.90.178.36', '45.56.113.17', 'www.example.com', null)[int(c_nationkey % 5)] as host",
    )
    return rows.select("c_custkey", "device", net.aliased_host(F.col("host"), F.col("device")).alias("host"))


@query(f"""with {PACKETS_SQL}, h as (select remote, us, max(name) as name from (select case when event_id % 2 = 0 then concat('10.1.0.', cast(user_id % 40 as varchar)) else 'x' end as remote, epoch_us(ts) as us, concat('h', cast(event_id as varchar)) as name from events where event_id % 10 = 4) group by all),
q as (select frame_num, us, concat('10.1.0.', cast(user_id % 43 as varchar)) as remote from p),
a as (select q.*, h.name as prior from q asof left join h on h.remote = q.remote and h.us <= q.us),
f as (select remote, arg_min(name, us) as first_name from h group by remote)
select frame_num, coalesce(prior, first_name) as name, case when prior is not null then 'prior' when first_name is not null then 'after' else 'blank' end as outcome from a left join f on f.remote = a.remote""")
def host_resolution(spark, sf_dir):
    rows = packets(spark, sf_dir).selectExpr("frame_num", "us", "concat('10.1.0.', user_id % 43) as remote")
    history = packets(spark, sf_dir).where("frame_num % 10 = 4").selectExpr("case when frame_num % 2 = 0 then concat('10.1.0.', user_id % 40) else 'x' end as remote", "us", "concat('h', frame_num) as name")
    return lookups.as_of(rows, history, ["remote"], "us", "name", scans.hot_cuts(rows, ["remote"], "us")).select("frame_num", "name", "outcome")


@query(ORACLE_SQL["host_resolution"].replace("when event_id % 2 = 0 then concat('10.1.0.', cast(user_id % 40 as varchar)) else 'x' end", "when event_id % 2 = 0 then 'y' else 'x' end").replace("concat('10.1.0.', cast(user_id % 43 as varchar))", "case when frame_num % 3 > 0 then 'x' when frame_num < 5 then 'z' else 'y' end"))
def sliced_resolution(spark, sf_dir):
    """Names of two addresses that have nearly all packets, each cut in slices of about two thousand."""
    rows = packets(spark, sf_dir).selectExpr("frame_num", "us", "case when frame_num % 3 > 0 then 'x' when frame_num < 5 then 'z' else 'y' end as remote")
    history = packets(spark, sf_dir).where("frame_num % 10 = 4").selectExpr("case when frame_num % 2 = 0 then 'y' else 'x' end as remote", "us", "concat('h', frame_num) as name")
    return lookups.as_of(rows, history, ["remote"], "us", "name", scans.hot_cuts(rows, ["remote"], "us", 2000)).select("frame_num", "name", "outcome")


@query(ORACLE_SQL["host_resolution"].replace("select frame_num, coalesce(prior, first_name) as name, case", "select outcome, count(*) as n from (select case").replace("on f.remote = a.remote", "on f.remote = a.remote) group by outcome"))
def host_outcomes(spark, sf_dir):
    return host_resolution(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


_NAMED = f"with {PACKETS_SQL}, {FINGERPRINTS_SQL}, t as (select frame_num, case when contains(protocol, 'TCP') or contains(protocol, 'MQTT') or contains(protocol, 'TLS') then 'TCP' when contains(protocol, 'UDP') then 'UDP' else protocol end as protocol, host from p where host <> '')"
_MATCH = "t.protocol = fp.protocol and (t.host = fp.host_pattern or fp.host_pattern like '*.%' and ends_with('.' || t.host, substr(fp.host_pattern, 2)) or fp.host_pattern = '*.compute.amazonaws.com' and ends_with(t.host, '.compute-1.amazonaws.com'))"


def _named(spark, sf_dir):
    return packets(spark, sf_dir).where("host <> ''").select("frame_num", net.transport(F.col("protocol")).alias("protocol"), "host")


@query(f"{_NAMED} select t.frame_num, t.host, t.protocol, fp.host_pattern, fp.period from t join fp on {_MATCH}")
def fingerprint_match(spark, sf_dir):
    return lookups.match_fingerprints(_named(spark, sf_dir), F.broadcast(fingerprints(spark)), ["protocol"]).select("frame_num", "host", "protocol", "host_pattern", "period")


_ALIASED = """with r as (select c_custkey, ['tplink-bulb', 'wink-hub2', 'wyze-cam', 'nest-tstat'][1 + c_custkey % 4] as device, ['n-devs.tplinkcloud.com', '3.90.178.36', '45.56.113.17', 'www.example.com', null][1 + c_nationkey % 5] as host from customer),
t as (select c_custkey, device, case when starts_with(device, 'tplink') and host = 'n-devs.tplinkcloud.com' then 'devs.tplinkcloud.com' when starts_with(device, 'wink-hub2') and host = '3.90.178.36' then '*.compute-1.amazonaws.com'
  when starts_with(device, 'wyze-cam') and host = '45.56.113.17' then '*.ip.linodeusercontent.com' else host end as host from r),
fp(host_pattern, period) as (values ('devs.tplinkcloud.com', 60.0::double), ('*.tplinkcloud.com', 30.0::double), ('*.compute-1.amazonaws.com', 600.0::double), ('*.linodeusercontent.com', 900.0::double), ('*.example.com', 10.0::double))"""


@query(f"{_ALIASED} select c_custkey, t.device, t.host, fp.host_pattern, fp.period from t join fp on t.host = fp.host_pattern or ends_with('.' || t.host, substr(fp.host_pattern, 2)) and starts_with(fp.host_pattern, '*.')")
def aliased_fingerprint_match(spark, sf_dir):
    """Hosts under the names that fingerprints use, then matched."""
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", "array('tplink-bulb', 'wink-hub2', 'wyze-cam', 'nest-tstat')[int(c_custkey % 4)] as device", "array('n-devs.tplinkcloud.com', '3.90.178.36', '45.56.113.17', 'www.example.com', null)[int(c_nationkey % 5)] as host")
    prints = spark.createDataFrame([("devs.tplinkcloud.com", 60.0), ("*.tplinkcloud.com", 30.0), ("*.compute-1.amazonaws.com", 600.0), ("*.linodeusercontent.com", 900.0), ("*.example.com", 10.0)], "host_pattern string, period double")
    return lookups.match_fingerprints(lookups.with_aliased_hosts(rows), prints, []).select("c_custkey", "device", "host", "host_pattern", "period")


@query(f"{_NAMED} select distinct protocol, host from t where not exists (select 1 from fp where {_MATCH})")
def new_destinations(spark, sf_dir):
    return lookups.unmatched(_named(spark, sf_dir), fingerprints(spark), ["protocol"])


@query(f"{_NAMED} select protocol, host_pattern, period from fp where not exists (select 1 from t where {_MATCH})")
def gone_destinations(spark, sf_dir):
    return lookups.gone(_named(spark, sf_dir), fingerprints(spark), ["protocol"]).select("protocol", "host_pattern", "period")


_NEED = [("lamp", "a.api.example.com", "TCP"), ("lamp", "cdn.example.net", "TCP"), ("clock", "time.example.org", "UDP;QUIC"), ("dns", "b.api.example.com", "DNS")]


@query(f"""with {PACKETS_SQL}, need(activity, host, protocol) as (values {', '.join(map(str, _NEED))}),
w as (select distinct device, (us // 86400000000)::bigint as win, host, protocol from p),
a as (select activity, count(*) as k from need group by activity),
g as (select device, win, activity, count(*) as n from w join need using (host, protocol) group by all)
select device, win, g.activity from g join a on a.activity = g.activity and n = k""")
def complete_fingerprints(spark, sf_dir):
    rows = packets(spark, sf_dir).selectExpr("device", "us div 86400000000 as win", "host", "protocol")
    return lookups.complete_windows(rows, spark.createDataFrame(_NEED, "activity string, host string, protocol string"), ["device", "win"])


@query("""select l_orderkey, l_linenumber, coalesce(case when l_linenumber % 3 = 0 then null else l_quantity end, -1) as quantity, coalesce(case when l_linenumber % 2 = 0 then null else l_tax end, -1) as tax from lineitem""")
def feature_matrix(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "case when l_linenumber % 3 = 0 then null else l_quantity end as quantity", "case when l_linenumber % 2 = 0 then null else l_tax end as tax")
    return rows.na.fill(-1, ["quantity", "tax"])


@query("""select l_suppkey, count(*) as n, round(case when var_pop(q) > 0 then avg(power(q - m, 3)) / power(var_pop(q), 1.5) else 0 end, 6) as skewQuantity, round(case when var_pop(q) > 0 then avg(power(q - m, 4)) / power(var_pop(q), 2) - 3 else -3 end, 6) as kurtosisQuantity,
  round(mad(q) / 0.6744897501960817, 6) as deviation, median(q) as middle, round(quantile_cont(q, 0.1), 6) as p10, round(quantile_cont(q, 0.9), 6) as p90
  from (select l_suppkey, l_quantity as q, avg(l_quantity) over (partition by l_suppkey) as m from lineitem) group by l_suppkey""")
def robust_statistics(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    q = F.percentile("l_quantity", F.array(F.lit(0.1), F.lit(0.9)))
    out = rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), *flows.moments("l_quantity", "Quantity"), F.median("l_quantity").alias("middle"), q.alias("_q"))
    out = out.join(flows.with_median_deviation(rows, ["l_suppkey"], "l_quantity", "deviation"), "l_suppkey")
    return out.select("l_suppkey", "n", F.round("skewQuantity", 6).alias("skewQuantity"), F.round("kurtosisQuantity", 6).alias("kurtosisQuantity"), F.round("deviation", 6).alias("deviation"), "middle", F.round(F.get("_q", 0), 6).alias("p10"), F.round(F.get("_q", 1), 6).alias("p90"))


@query("""select l_returnflag, l_linestatus, median(l_extendedprice) as middle, round(quantile_cont(l_extendedprice, 0.1), 6) as p10, round(quantile_cont(l_extendedprice, 0.9), 6) as p90, round(mad(l_extendedprice) / 0.6744897501960817, 6) as deviation from lineitem group by all""")
def large_group_quantiles(spark, sf_dir):
    """Exact quantiles and deviations of a handful of groups that have all rows, none of which gathers more than two thousand values."""
    rows, keys = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag", "l_linestatus"]
    out = quantiles.exact_quantiles(rows, keys, "l_extendedprice", [0.5, 0.1, 0.9], 2000).join(flows.with_median_deviation(rows, keys, "l_extendedprice", "deviation", 2000), keys)
    q = F.col("quantiles")
    return out.select(*keys, q[0].alias("middle"), F.round(q[1], 6).alias("p10"), F.round(q[2], 6).alias("p90"), F.round("deviation", 6).alias("deviation"))


#: Packets with protocols and addresses of the link and network layers among them.
_LINK = {"protocol": "case when frame_num % 17 = 0 then 'ICMP' when frame_num % 19 = 0 then 'CLASSIC-STUN' else protocol end", "ip_src": "case when frame_num % 23 = 0 then 'fe80::1:2' when frame_num % 29 = 0 then '' else ip_src end"}


@query(f"""with {PACKETS_SQL}, l as (select frame_num, {_LINK["protocol"]} as protocol, {_LINK["ip_src"]} as ip_src, ip_dst from p)
select frame_num, protocol, ip_src, ip_dst from l where protocol not in ('ICMP', 'CLASSIC-STUN') and regexp_full_match(ip_src, '[0-9]+([.][0-9]+){{3}}') and regexp_full_match(ip_dst, '[0-9]+([.][0-9]+){{3}}')""")
def decodable_packets(spark, sf_dir):
    rows = packets(spark, sf_dir).selectExpr("frame_num", *[f"{e} as {n}" for n, e in _LINK.items()], "ip_dst")
    return flows.decodable(rows, idle=True)


_NAMED = "case frame_num % 9 when 0 then 'multicast' when 1 then 'ff:ff:ff:ff:ff:ff' when 2 then '3a:00:11:22:33:44' when 3 then device when 4 then 'dev99' else host end"


@query(f"""with {PACKETS_SQL}, n as (select frame_num, {_NAMED} as host from p)
select frame_num, host from n where host <> 'multicast' and not contains(host, ':') and host not in (select concat('dev', cast(c_custkey as varchar)) from customer where c_custkey < 8)""")
def without_local_hosts(spark, sf_dir):
    devices = read(spark, sf_dir, "customer").where("c_custkey < 8").selectExpr("concat('dev', cast(c_custkey as string)) as name")
    return lookups.without_local(packets(spark, sf_dir).selectExpr("frame_num", f"{_NAMED} as host"), devices).select("frame_num", "host")
