"""Names of activities, hosts and owners, folds in time order, and watched machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import folds, lookups, monitor, naming, summaries, traces

from . import activity_queries, machine_queries, periodic_queries
from .inputs import PACKETS_SQL, ROUTERS, packets, read
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

_DEVICES = ["nest-tstat", "magichome-strip", "yi-camera", "ring-camera", "echospot", "lamp"]
_LABELS = ["android_lan_on", "android_wan_off", "color", "dim", "local_lock", "alexa_unlock", "watch", "android_wan_volume", "local_volume", "temp", "alexa_scene"]
_pick = lambda values, n: "element_at(array(" + ", ".join(f"'{v}'" for v in values) + f"), cast({n} % {len(values)} as int) + 1)"
_list = lambda values, n: "(['" + "', '".join(values) + f"'])[{n} % {len(values)} + 1]"


@query(f"""with r as (select o_orderkey, {_list(_DEVICES, 'o_custkey')} as device, {_list(_LABELS, 'o_orderkey')} as label from orders),
b as (select *, case when device = 'echospot' and label = 'android_wan_volume' then 'on_off' when device = 'echospot' and label = 'local_volume' then 'voice'
  when regexp_matches(label, '^(alexa|android_lan|android_wan|local)_') then string_split(label, '_')[-1] else label end as bare from r)
select o_orderkey, device, label, case
  when device = 'magichome-strip' and bare in ('on', 'off', 'scene') then 'toggle'
  when device in ('nest-tstat', 'echospot') and bare in ('on', 'off') then 'on_off' when device in ('nest-tstat', 'echospot') and bare in ('color', 'dim') then 'color_dim'
  when device in ('nest-tstat', 'echospot') and bare in ('lock', 'unlock') then 'lock_unlock' when device = 'nest-tstat' and bare = 'temp' then 'set'
  when device = 'yi-camera' and bare = 'watch' then 'audio_photo_recording_watch' when device = 'ring-camera' and bare = 'watch' then 'audio_stop_watch_motion' else bare end as activity from b""")
def label_merges(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_pick(_DEVICES, 'o_custkey')} as device", f"{_pick(_LABELS, 'o_orderkey')} as label")
    training = rows.where("device <> 'magichome-strip' or label in ('android_lan_on', 'color')")
    return naming.merged_labels(rows, training, "device", "label")


@query(f"""with {PACKETS_SQL}, h as (select device, ip_dst as ip, ts, max(concat('h', frame_num)) as name from p where frame_num % 70 = 10 group by all),
f as (select device, ip, arg_min(name, ts) as first_name from h group by all),
c as (select frame_num, device, ts, ip_dst, case when ip_dst like '224.%' then 'multicast'
  when ip_src similar to '(10|192.168|127)[.].*' and ip_dst similar to '(10|192.168|127)[.].*' or ip_src similar to '(10|192.168|127)[.].*' and ip_dst in ('192.168.10.1', '192.168.10.254') or ip_dst similar to '(10|192.168|127)[.].*' and ip_src in ('192.168.10.1', '192.168.10.254') then 'local'
  when ip_dst similar to '(10|192.168|127)[.].*' then 'private' end as fixed from p),
a as (select c.*, h.name as prior from c asof left join h on h.device = c.device and h.ip = c.ip_dst and h.ts <= c.ts)
select frame_num, case when fixed = 'multicast' then 'Multicast' when fixed = 'local' then 'local' when fixed = 'private' then '' else coalesce(prior, first_name, case when ip_dst = '8.8.8.8' then 'dns.google' else '' end) end as host,
  coalesce(fixed, case when prior is not null then 'prior' when first_name is not null then 'after' when ip_dst = '8.8.8.8' then 'whois' else 'blank' end) as outcome
from a left join f on f.device = a.device and f.ip = a.ip_dst""")
def resolved_hosts(spark, sf_dir):
    rows = packets(spark, sf_dir).select("frame_num", "device", "ts", "ip_src", "ip_dst")
    history = rows.where("frame_num % 70 = 10").selectExpr("device", "ip_dst as ip", "ts", "concat('h', frame_num) as name")
    reverse = spark.createDataFrame([("8.8.8.8", "DNS.google")], "ip string, name string")
    return naming.resolve_hosts(rows, history, reverse, ROUTERS).select("frame_num", "host", "outcome")


_OWNERS = [("amazonaws.com", "Amazon Technologies"), ("example.org", "Akamai Technologies")]
_FIRST = {"dev1": ["example.com"], "dev2": ["amazon", "nest"]}
_SUPPORT = ["aka", "amazon"]
_OWNED = f"""with {PACKETS_SQL}, d as (select device, protocol, host as domain, event_type, ts, frame_num from p where host <> ''), w(name, owner) as (values {', '.join(map(str, _OWNERS))}),
o as (select d.*, coalesce(owner, array_to_string(string_split(domain, '.')[-2:], '.')) as org from d left join w on w.name = array_to_string(string_split(domain, '.')[-2:], '.')),
y as (select *, case when device = 'dev1' and contains(lower(org), 'example.com') or device = 'dev2' and (contains(lower(org), 'amazon') or contains(lower(org), 'nest')) then 1 when contains(lower(org), 'aka') or contains(lower(org), 'amazon') then 2 else 3 end as party from o)
"""


def _parties(spark, rows):
    owners = spark.createDataFrame(_OWNERS, "name string, org string")
    return naming.destinations(rows, owners, spark.createDataFrame(list(_FIRST.items()), "device string, orgs array<string>"), _SUPPORT)


def _domains(spark, sf_dir):
    return packets(spark, sf_dir).where("host <> ''").selectExpr("device", "protocol", "host as domain", "event_type", "ts", "frame_num")


@query(_OWNED + "select distinct device, protocol, domain, org, party from y where protocol <> 'DHCP'")
def periodic_destinations(spark, sf_dir):
    return _parties(spark, _domains(spark, sf_dir).where("protocol <> 'DHCP'").select("device", "protocol", "domain").distinct())


@query(_OWNED + "select device, protocol, domain, arg_min(event_type, ts) as event_type, org, party from y group by all")
def activity_destinations(spark, sf_dir):
    return _parties(spark, naming.first_of_each(_domains(spark, sf_dir), ["device", "protocol", "domain"], "ts", "event_type"))


@query(_OWNED + "select device, domain, count(*) as n_flows, org, party from y group by all")
def aperiodic_destinations(spark, sf_dir):
    return _parties(spark, _domains(spark, sf_dir).groupBy("device", "domain").agg(F.count("*").alias("n_flows")))


_NEED = [("view", "a.api.example.com", "TLSv1.2"), ("click", "cdn.example.net", "TCP")]


@query(activity_queries._ANCHORED + activity_queries._VOTES + f""", need(activity, host, protocol) as (values {', '.join(map(str, _NEED))}),
s as (select distinct a.device, a.win, p.host, p.protocol from a join p on p.frame_num = a.frame_num),
d as (select distinct device, win from v), z as (select d.device, d.win, coalesce(w.label, 'unknown') as voted from d left join w on w.device = d.device and w.win = d.win and rn = 1)
select z.device, z.win as window, case when exists (select 1 from need n where n.activity = z.voted and not exists (select 1 from s where s.device = z.device and s.win = z.win and s.host = n.host and s.protocol = n.protocol)) then 'unknown' else voted end as voted from z""")
def complete_votes(spark, sf_dir):
    """A window's voted activity holds only if every host of the activity's fingerprint occurs in the window."""
    votes = activity_queries._votes(spark, sf_dir)
    won = traces.vote(votes, ["device", "window"], "label", "value", "frame_num")
    need = spark.createDataFrame(_NEED, "activity string, host string, protocol string")
    rows = votes.select("device", "window", "frame_num").join(packets(spark, sf_dir).select("frame_num", "host", "protocol"), "frame_num")
    return lookups.gated_votes(won, lookups.complete_windows(rows, need, ["device", "window"]), need, ["device", "window"])


@query("""with r as (select l_returnflag as truth, case when l_quantity > 30 then 'N' else l_returnflag end as predicted from lineitem),
c as (select k.c as label, count_if(truth = k.c and predicted = k.c) as tp, count_if(truth <> k.c and predicted = k.c) as fp, count_if(truth = k.c and predicted <> k.c) as fn from r, (select distinct truth as c from r) k group by k.c)
select round(sum(tp) / sum(tp + fn), 6) as micro_f1, round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) as macro_precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 6) as macro_recall, round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) as macro_f1 from c""")
def averaged_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag as truth", "case when l_quantity > 30 then 'N' else l_returnflag end as predicted")
    out = summaries.averaged_metrics(rows, "truth", "predicted")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_MORE = "[300.0, 5000.0]"
_RANKED = periodic_queries._TIMED.replace("with p", "with recursive p", 1) + ", k as (select *, row_number() over (partition by device order by t, frame_num) as rn from t)"
_ON = "abs(k.t - a.t - {0}) <= greatest(1, 0.05 * {0})"


def _several(spark, sf_dir):
    return periodic_queries._timed(spark, sf_dir).withColumn("others", F.array(F.lit(300.0), F.lit(5000.0)))


@query(f"""{_RANKED},
a as (select device, frame_num, rn, t, null::double as gap, 0.0::double as drift, false as ok, false as early from k where rn = 1
  union all select k.device, k.frame_num, k.rn, k.t, k.t - a.t, case when {_ON.format('k.period')} then k.t - a.t - k.period when k.t - a.t <= 1 - a.drift then a.drift when {_ON.format('300.0')} then k.t - a.t - 300.0 when {_ON.format('5000.0')} then k.t - a.t - 5000.0 else a.drift end,
  {_ON.format('k.period')} or not k.t - a.t <= 1 - a.drift and ({_ON.format('300.0')} or {_ON.format('5000.0')}), not {_ON.format('k.period')} and k.t - a.t <= 1 - a.drift
  from a join k on k.device = a.device and k.rn = a.rn + 1)
select frame_num, gap, case when ok and not coalesce(lead(early) over (partition by device order by rn), false) then 1 else -1 end as label from a""")
def several_period_labels(spark, sf_dir):
    return folds.timing_labels_of_several(_several(spark, sf_dir), ["device"], "t", "frame_num", "period", "others").select("frame_num", "gap", "label")


@query(f"""{_RANKED},
a as (select device, frame_num, rn, t, null::double as gap, period::double as cur from k where rn = 1
  union all select k.device, k.frame_num, k.rn, k.t, k.t - a.t, case when k.t - a.t > a.cur + 1 and (abs(k.t - a.t - 300.0) <= 1 or k.t - a.t <= 300.0) then 300.0 when k.t - a.t > a.cur + 1 and (abs(k.t - a.t - 5000.0) <= 1 or k.t - a.t <= 5000.0) then 5000.0 else a.cur end
  from a join k on k.device = a.device and k.rn = a.rn + 1)
select frame_num, cur as current, round(ln(1 + case when gap >= cur then (gap - cur) / cur else least(gap, cur - gap) / cur end), 6) as score from a""")
def switching_scores(spark, sf_dir):
    out = folds.switching_periods(_several(spark, sf_dir), ["device"], "t", "frame_num", "period", "others")
    return out.select("frame_num", "current", F.round("score", 6).alias("score"))


@query()
def watched_machine(spark, sf_dir):
    """Shares, z and alerts of every step as traces arrive; a machine's limits depend on all steps before."""
    steps = machine_queries._steps(spark, sf_dir)
    return monitor.watched(steps, ["device"], ["started", "trace", "pos"], "started").select("device", "trace", "pos", "src", "dst", F.round("prob", 9).alias("prob"), F.round("z", 6).alias("z"), "alert")


@query()
def node_paths(spark, sf_dir):
    """Paths through a machine that has two nodes for views; SQL has no search for the fewest missing edges."""
    rows = traces.paths(machine_queries._traces(spark, sf_dir), ["device", "trace"], "pos", "event_type")
    nodes = spark.createDataFrame([(1, "view"), (2, "view"), (3, "click"), (4, "purchase"), (5, "error"), (6, "TERMINAL")], "id int, label string")
    edges = spark.createDataFrame([(1, 3), (1, 2), (2, 4), (2, 6), (3, 2), (3, 4), (4, 6), (4, 1), (5, 1), (5, 6)], "src int, dst int")
    return monitor.node_paths(rows, nodes, edges).select("device", "trace", "nodes", "n_missing")


@query(f"with {PACKETS_SQL} select frame_num, host, strftime(make_timestamp(us), '%m/%d/%Y, %H:%M:%S') as written from p where device in (select concat('dev', n_nationkey) from nation where n_regionkey < 2) and not (protocol = 'DNS' or protocol = 'NTP')")
def registered_devices(spark, sf_dir):
    registry_rows = read(spark, sf_dir, "nation").where("n_regionkey < 2").selectExpr("concat('dev', n_nationkey) as device")
    rows = packets(spark, sf_dir).where(~F.col("protocol").isin("DNS", "NTP")).join(registry_rows, "device", "left_semi")
    return rows.select("frame_num", "host", F.date_format(F.timestamp_micros("us"), "MM/dd/yyyy, HH:mm:ss").alias("written"))
