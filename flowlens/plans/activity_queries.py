"""Windows, votes, fingerprints of activities, scaling, clustering, sampling and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.functions import net
from flowlens.operators import folds, models, summaries, traces

from .inputs import PACKETS_SQL, packets, read
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

_SMALL = f"with recursive {PACKETS_SQL}, q as (select frame_num, device, round(ts, 3) as t, event_type, round(value, 2) as value from p)"
_ANCHORED = f"""{_SMALL}, r as (select *, row_number() over (partition by device order by t, frame_num) as rn from q),
a as (select device, frame_num, rn, 0::bigint as win, floor(t) + 7200 as bound from r where rn = 1
  union all select r.device, r.frame_num, r.rn, case when r.t <= a.bound then a.win else a.win + 1 end, case when r.t <= a.bound then a.bound else floor(r.t) + 7200 end from a join r on r.device = a.device and r.rn = a.rn + 1)"""


def _small(spark, sf_dir):
    return packets(spark, sf_dir).select("frame_num", "device", F.round("ts", 3).alias("t"), "event_type", F.round("value", 2).alias("value"))


def _anchored(spark, sf_dir):
    return folds.anchored_windows(_small(spark, sf_dir), ["device"], "t", "frame_num", 7200)


@query(_ANCHORED + " select device, frame_num, win as window from a")
def anchored_windows(spark, sf_dir):
    return _anchored(spark, sf_dir).select("device", "frame_num", "window")


_VOTES = """, v as (select q.*, a.win, case when event_type = 'error' then 'unknown' else event_type end as label from q join a using (device, frame_num)),
t as (select device, win, label, count(*) as n, max(value) as best, min(frame_num) as first from v where label <> 'unknown' group by all),
w as (select device, win, label, row_number() over (partition by device, win order by n desc, best desc, first) as rn from t)"""


def _votes(spark, sf_dir):
    return _anchored(spark, sf_dir).withColumn("label", F.when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type")))


@query(_ANCHORED + _VOTES + " select d.device, d.win as window, coalesce(w.label, 'unknown') as voted from (select distinct device, win from v) d left join w on w.device = d.device and w.win = d.win and rn = 1")
def window_votes(spark, sf_dir):
    return traces.vote(_votes(spark, sf_dir), ["device", "window"], "label", "value", "frame_num")


@query(_ANCHORED + " select device, win as window, arg_min(frame_num, t) as frame_num, min(t) as t from a join q using (device, frame_num) group by all")
def first_of_window(spark, sf_dir):
    w = Window.partitionBy("device", "window").orderBy("t", "frame_num")
    return _anchored(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("device", "window", "frame_num", "t")


@query("""select l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) as l_linenumber, max(l_extendedprice) as proba from lineitem group by l_orderkey""")
def top_probability(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("l_linenumber"), F.max("l_extendedprice").alias("proba"))


_FLOWS = f"with {PACKETS_SQL}, x as (select event_type as activity, host, case when contains(protocol, 'UDP') then 'UDP' else 'TCP' end as protocol, concat(device, '/', cast(us // 43200000000 as varchar)) as event, ts from p where host <> '')"


def _activity_flows(spark, sf_dir):
    return packets(spark, sf_dir).where("host <> ''").selectExpr("event_type as activity", "host", "case when contains(protocol, 'UDP') then 'UDP' else 'TCP' end as protocol", "concat(device, '/', us div 43200000000) as event", "ts")


@query(_FLOWS + """, e as (select activity, count(distinct event) as n_events from x group by activity), r as (select activity, host, protocol, count(distinct event) as n_with from x group by all),
s as (select r.*, n_events, n_with / n_events as support, max(n_with / n_events) over (partition by activity) as best from r join e using (activity))
select activity, host, protocol, n_with, n_events, round(support, 6) as support from s where support >= 0.5 or best < 0.5 and support >= 0.2""")
def fingerprint_support(spark, sf_dir):
    out = summaries.fingerprint_support(_activity_flows(spark, sf_dir), [], "event", 0.5, 0.2)
    return out.select("activity", "host", "protocol", "n_with", "n_events", F.round("support", 6).alias("support"))


@query(_FLOWS + ", s as (select activity, event, max(ts) - min(ts) as span from x group by all) select activity, round(avg(span), 4) as avg_span, count(*) as n_events from s group by activity")
def event_spans(spark, sf_dir):
    spans = _activity_flows(spark, sf_dir).groupBy("activity", "event").agg((F.max("ts") - F.min("ts")).alias("span"))
    return spans.groupBy("activity").agg(F.round(F.avg("span"), 4).alias("avg_span"), F.count("*").alias("n_events"))


@query(_FLOWS + ", d as (select distinct case when activity in ('view', 'click') then 'look' else activity end as merged, activity, host, protocol from x), k as (select merged, count(distinct activity) as n from d group by merged), c as (select merged, host, protocol, count(*) as m from d group by all) select c.merged, host, protocol from c join k on k.merged = c.merged and k.n = c.m")
def merged_fingerprints(spark, sf_dir):
    merged = F.when(F.col("activity").isin("view", "click"), "look").otherwise(F.col("activity"))
    pairs = _activity_flows(spark, sf_dir).select(merged.alias("merged"), "activity", "host", "protocol").distinct()
    need = pairs.groupBy("merged").agg(F.count_distinct("activity").alias("n"))
    return pairs.groupBy("merged", "host", "protocol").agg(F.count("*").alias("m")).join(need, "merged").where("m = n").select("merged", "host", "protocol")


FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("""with f as (select l_suppkey % 20 as device, avg(l_quantity) as m1, stddev_pop(l_quantity) as s1, avg(l_extendedprice) as m2, stddev_pop(l_extendedprice) as s2 from lineitem where l_orderkey % 2 = 0 group by 1)
select l_orderkey, l_linenumber, round((l_quantity - m1) / case when s1 > 0 then s1 else 1 end, 6) as l_quantity, round((l_extendedprice - m2) / case when s2 > 0 then s2 else 1 end, 6) as l_extendedprice from lineitem join f on f.device = l_suppkey % 20""")
def standardised_features(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("device", F.col("l_suppkey") % 20)
    features = FEATURES[:2]
    scaler = models.fit_scaler(rows.where("l_orderkey % 2 = 0"), ["device"], features)
    out = models.scale(rows.select("l_orderkey", "l_linenumber", "device", *features), scaler, ["device"], features)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in features])


@query()
def density_clusters(spark, sf_dir):
    """Rows of each device joined to clusters fitted to its first 5000 rows, as the reference does; no SQL follows neighbours of neighbours."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 4).alias("device"), "l_quantity", (F.col("l_discount") * 100).alias("discount"))
    rows = rows.withColumn("place", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    cores = models.fit_clusters(rows, ["device"], ["l_quantity", "discount"], "place", eps=1.5, least=5, most=5000)
    return models.assign_clusters(rows, cores, ["device"], ["l_quantity", "discount"], eps=1.5).select("l_orderkey", "l_linenumber", "device", "cluster")


@query()
def activity_forests(spark, sf_dir):
    """One forest for each event type over frame features, scored on the rows left out; no SQL grows trees."""
    rows = packets(spark, sf_dir).select("frame_num", "event_type", F.col("frame_len").cast("double").alias("x1"), (F.crc32("event_type") % 50 + F.col("frame_num") % 7).cast("double").alias("x2"))
    fitted = models.train_activities(models.dealt_for_training(rows.where("frame_num % 3 <> 0"), "frame_num"), ["x1", "x2"], "event_type", ["view", "click", "error", "purchase", "signup"], trees=100)
    out = models.predict_activities(rows.where("frame_num % 3 = 0"), fitted, ["x1", "x2"])
    return out.select("frame_num", "event_type", "activity", F.round("proba", 6).alias("proba"))


_PREDICTED = "with r as (select l_shipdate, l_returnflag as label, l_orderkey, (l_quantity > 25)::int as truth, (l_extendedprice > 40000)::int as predicted from lineitem)"


def _predicted(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_returnflag as label", "cast(l_quantity > 25 as int) as truth", "cast(l_extendedprice > 40000 as int) as predicted")


@query(_PREDICTED + """, c as (select label, count_if(truth = 1 and predicted = 1)::bigint as tp, count_if(truth = 0 and predicted = 1)::bigint as fp, count_if(truth = 1 and predicted = 0)::bigint as fn, count_if(truth = 0 and predicted = 0)::bigint as tn from r group by label)
select label, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) as fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) as fnr from c""")
def classification_metrics(spark, sf_dir):
    out = summaries.classification_metrics(_predicted(spark, sf_dir), "truth", "predicted", ["label"])
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@query(_PREDICTED + ", h as (select label, l_orderkey, max((truth = predicted)::int) as hit from r group by all) select label, count(*) as events, sum(hit)::bigint as hit, round(avg(hit), 6) as recall from h group by label")
def event_recall(spark, sf_dir):
    return summaries.event_recall(_predicted(spark, sf_dir), "l_orderkey", "truth", "predicted", ["label"]).withColumn("recall", F.round("recall", 6))


@query(_PREDICTED + " select truth, predicted, count(*) as n from r group by all")
def confusion_matrix(spark, sf_dir):
    return summaries.confusion(_predicted(spark, sf_dir), "truth", "predicted")


@query("select o_orderkey, case when o_orderdate < timestamp '1999-01-01' then 'train' else 'test' end as part, case when o_orderdate < timestamp '1997-01-01' then 0 when o_orderdate < timestamp '1998-01-01' then 1 when o_orderdate < timestamp '1999-01-01' then 2 when o_orderdate < timestamp '2000-01-01' then 3 else 4 end as fold, (o_orderkey % 5)::int as stride_fold from orders")
def time_splits(spark, sf_dir):
    d = F.col("o_orderdate")
    day = lambda y: F.lit(f"{y}-01-01").cast("timestamp_ntz")
    fold = F.when(d < day(1997), 0).when(d < day(1998), 1).when(d < day(1999), 2).when(d < day(2000), 3).otherwise(4)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(d < day(1999), "train").otherwise("test").alias("part"), fold.alias("fold"), (F.col("o_orderkey") % 5).cast("int").alias("stride_fold"))


@query()
def undersampled_background(spark, sf_dir):
    """As many background rows as positives, chosen by a hash that SQL engines don't share."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type")
    positives = rows.where("event_type = 'view'")
    return positives.unionByName(models.undersample(rows.where("event_type <> 'view'"), positives.count(), seed=7))


@query("with r as (select l_suppkey, l_extendedprice as v, row_number() over (partition by l_suppkey order by l_extendedprice desc) as rn from lineitem) select l_suppkey, max(v) filter (where rn = 6) as sixth, max(v) filter (where rn = 1) as best, max(v) filter (where rn = 2) as second from r group by l_suppkey")
def kth_largest(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"))
    top = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice").withColumn("rn", F.row_number().over(w)).where("rn <= 6")
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("l_extendedprice")))
    return top.groupBy("l_suppkey").agg(at(6).alias("sixth"), at(1).alias("best"), at(2).alias("second"))


@query(f"with {PACKETS_SQL} select (us // 1000000)::bigint as second, concat(device, '-', label) as event, frame_num from p where event_type <> 'error' union all select epoch_us(o_orderdate) // 1000000, concat('order-', o_orderstatus), o_orderkey from orders")
def merged_log(spark, sf_dir):
    a = packets(spark, sf_dir).where("event_type <> 'error'").selectExpr("us div 1000000 as second", "concat(device, '-', label) as event", "frame_num")
    b = read(spark, sf_dir, "orders").selectExpr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) div 1000000 as second", "concat('order-', o_orderstatus) as event", "o_orderkey as frame_num")
    return a.unionByName(b).orderBy("second", "frame_num")


@query("select c_nationkey as k, 'both' as side from customer intersect select s_nationkey, 'both' from supplier union all (select c_nationkey, 'left' from customer except select s_nationkey, 'left' from supplier)")
def set_operations(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("left")))


@query("with g as (select o_custkey, o_orderkey, epoch_us(o_orderdate) / 1000000.0 as t from orders), d as (select *, t - lag(t) over w as gap from g window w as (partition by o_custkey order by t, o_orderkey)) select o_orderkey, gap - lag(gap) over (partition by o_custkey order by t, o_orderkey) as turn from d")
def second_difference(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) / 1000000.0 as t")
    w = Window.partitionBy("o_custkey").orderBy("t", "o_orderkey")
    return rows.withColumn("gap", (F.col("t") - F.lag("t").over(w)).cast("double")).select("o_orderkey", (F.col("gap") - F.lag("gap").over(w)).alias("turn"))


@query("select l_suppkey, count(*) as n_rows, count(distinct l_orderkey) as n_events, count(distinct l_returnflag) as n_states, round(count(distinct l_orderkey) filter (where l_quantity > 10) / count(distinct l_orderkey), 6) as left_ratio from lineitem group by l_suppkey")
def distinct_counters(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey")
    left = F.count_distinct(F.when(F.col("l_quantity") > 10, F.col("l_orderkey")))
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("l_orderkey").alias("n_events"), F.count_distinct("l_returnflag").alias("n_states"), F.round(left / F.count_distinct("l_orderkey"), 6).alias("left_ratio"))


@query(f"with {PACKETS_SQL} select device, count_if(frame_len > 700)::bigint as large, count_if(frame_len <= 700)::bigint as small, round(coalesce(avg(frame_len) filter (where trans_proto = 17), 0), 6) as udp_mean from p group by device")
def conditional_means(spark, sf_dir):
    udp = F.coalesce(F.avg(F.when(F.col("trans_proto") == 17, F.col("frame_len"))), F.lit(0.0))
    return packets(spark, sf_dir).groupBy("device").agg(F.count_if(F.col("frame_len") > 700).alias("large"), F.count_if(F.col("frame_len") <= 700).alias("small"), F.round(udp, 6).alias("udp_mean"))


#: Fingerprints (activity, host pattern, protocol) and what makes their models' probabilities: no forest, so SQL has the same.
_AT_HOSTS = [("ring", "*.example.com", "TCP", 37), ("watch", "a.api.example.com", "TCP", 53), ("watch", "cdn.example.net", "UDP", 71), ("lamp", "*.example.net", "UDP", 29), ("lamp", "time.example.org", "TCP", 83)]
_TRANSPORT = "case when contains(protocol, 'UDP') then 'UDP' else 'TCP' end"


@query(f"""with {PACKETS_SQL}, f(activity, host_pattern, protocol, k) as (values {", ".join(map(str, _AT_HOSTS))}),
x as (select frame_num, host, {_TRANSPORT} as protocol from p),
m as (select frame_num, activity, (frame_num * k % 101) / 100.0 as proba from x join f on f.protocol = x.protocol and (host = host_pattern or (starts_with(host_pattern, '*') and suffix(host, substr(host_pattern, 3)))) where frame_num * k % 101 >= 50)
select x.frame_num, coalesce(arg_max(activity, (proba, activity)), 'unknown') as activity, coalesce(max(proba), 0) as proba from x left join m on m.frame_num = x.frame_num group by x.frame_num""")
def host_predictions(spark, sf_dir):
    rows = packets(spark, sf_dir).selectExpr("frame_num", "host", f"{_TRANSPORT} as protocol")
    proba = lambda k: F.col("frame_num") * k % 101 / 100.0
    scores = F.array(*[F.struct(F.lit(a).alias("activity"), F.lit(h).alias("host_pattern"), F.lit(p).alias("protocol"), proba(k).alias("proba"), (proba(k) >= 0.5).alias("predicted")) for a, h, p, k in _AT_HOSTS])
    best = rows.select("frame_num", models.best_at_host(F.col("host"), F.col("protocol"), scores).alias("b"))
    return best.select("frame_num", F.coalesce("b.activity", F.lit("unknown")).alias("activity"), F.coalesce("b.proba", F.lit(0.0)).alias("proba"))


@query()
def forest_host_predictions(spark, sf_dir):
    """A forest for each activity, host pattern and protocol, each speaking for rows of its own host only; no SQL grows trees."""
    rows = packets(spark, sf_dir).where("host <> ''").select("frame_num", "event_type", "host", net.transport(F.col("protocol")).alias("protocol"), F.col("frame_len").cast("double").alias("x1"), (F.crc32("event_type") % 50 + F.col("frame_num") % 7).cast("double").alias("x2"))
    named = [("view", "*.example.com", "TCP"), ("click", "cdn.example.net", "TCP"), ("purchase", "*.example.com", "TCP"), ("signup", "time.example.org", "UDP")]
    data = models.dealt_for_training(rows.where("frame_num % 3 <> 0"), "frame_num")
    fitted = models.train_activities(data, ["x1", "x2"], "event_type", sorted({a for a, *_ in named}), trees=20)
    out = models.predict_at_hosts(rows.where("frame_num % 3 = 0"), {n: fitted[n[0]] for n in named}, ["x1", "x2"])
    return out.select("frame_num", "host", "protocol", "activity", F.round("proba", 6).alias("proba"))
