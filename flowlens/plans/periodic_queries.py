"""Timing rules, deviation scores, signals and periods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.operators import periodic, summaries

from .inputs import PACKETS_SQL, packets, read
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

#: One period, in seconds, for each device; gaps in the events are long.
_PERIOD = "(600 + 60 * cast(substr(device, 4) as int)) * 4.0"
_TIMED = f"with {PACKETS_SQL}, t as (select frame_num, device, round(ts, 0) as t, {_PERIOD} as period from p)"


def _timed(spark, sf_dir):
    return packets(spark, sf_dir).selectExpr("frame_num", "device", "round(ts, 0) as t", f"{_PERIOD} as period")


@query(f"""{_TIMED},
g as (select *, t - lag(t) over w as gap from t window w as (partition by device order by t, frame_num)),
m as (select *, coalesce(abs(gap - period) <= 1 or abs(gap - period) <= 0.05 * period, false) as ok from g),
r as (select *, coalesce(last_value(case when ok then gap - period end ignore nulls) over (partition by device order by t, frame_num rows between unbounded preceding and 1 preceding), 0) as drift from m),
e as (select *, gap is not null and not ok and gap <= 1 - drift as early from r)
select frame_num, gap, case when ok and not coalesce(lead(early) over (partition by device order by t, frame_num), false) then 1 else -1 end as label from e""")
def timing_labels(spark, sf_dir):
    return periodic.timing_labels(_timed(spark, sf_dir), ["device"], "t", "frame_num", "period").select("frame_num", "gap", "label")


@query(f"""{_TIMED}, g as (select *, t - lag(t) over (partition by device order by t, frame_num) as gap from t)
select frame_num, coalesce(abs(gap - 300) <= 1 or abs(gap - 300) <= 15 or abs(gap - 1200) <= 60 or abs(gap - 5000) <= 250, false) as on_time from g""")
def multi_period_match(spark, sf_dir):
    w = Window.partitionBy("device").orderBy("t", "frame_num")
    rows = _timed(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(w))
    return rows.select("frame_num", periodic.matches_any_period(F.col("gap"), F.array(F.lit(300.0), F.lit(1200.0), F.lit(5000.0))).alias("on_time"))


_SCORED = f"""{_TIMED}, g as (select *, t - lag(t) over (partition by device order by t, frame_num) as gap from t),
s as (select frame_num, device, round(ln(1 + case when gap >= period then (gap - period) / period else least(gap, period - gap) / period end), 6) as score from g where gap is not null)"""


def _scored(spark, sf_dir):
    w = Window.partitionBy("device").orderBy("t", "frame_num")
    rows = _timed(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(w)).where("gap is not null")
    return rows.select("frame_num", "device", F.round(periodic.deviation_score(F.col("gap"), F.col("period")), 6).alias("score"))


@query(_SCORED + " select frame_num, score, score > 1.65 as significant from s")
def deviation_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("frame_num", "score", (F.col("score") > 1.65).alias("significant"))


@query(_SCORED + ", c as (select round(score, 1) as score, count(*) as n from s group by 1) select score, n, round(sum(n) over (order by score) / sum(n) over (), 9) as cdf from c")
def empirical_cdf(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.round("score", 1).alias("score"))
    return summaries.empirical_cdf(rows, "score").withColumn("cdf", F.round("cdf", 9))


@query(f"""with {PACKETS_SQL}, b as (select device, event_type, (us // 21600000000)::bigint as bin from p),
l as (select device, min(bin) as lo, max(bin) as hi from b group by device), k as (select distinct device, event_type from b),
g as (select k.device, k.event_type, unnest(range(lo, hi + 1)) as bin from k join l on l.device = k.device)
select g.device, g.event_type, g.bin, count(b.bin) as n from g left join b on b.device = g.device and b.event_type = g.event_type and b.bin = g.bin group by all""")
def binned_signal(spark, sf_dir):
    return periodic.binned_signal(packets(spark, sf_dir).select("device", "event_type", "ts"), ["device", "event_type"], "ts", 21600.0, ["device"])


@query("""with g as (select o_custkey, d, d - lag(d) over w as gap from (select distinct o_custkey % 997 as o_custkey, epoch_us(o_orderdate) / 1000000.0 as d from orders where o_orderkey % 5 = 0) window w as (partition by o_custkey order by d)),
t as (select *, abs(gap - lag(gap) over (partition by o_custkey order by d)) as turn from g)
select o_custkey, count(*) as n_times, round(avg(gap), 3) as period from t group by o_custkey having count(*) between 4 and 6 and max(turn) <= 86400 * 900""")
def sparse_periods(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").selectExpr("o_custkey % 997 as o_custkey", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) / 1000000.0 as d")
    return periodic.sparse_periods(rows, ["o_custkey"], "d", most=86400.0 * 900).select("o_custkey", "n_times", F.round("period", 3).alias("period"))


@query("""with g as (select o_custkey, d, d - lag(d) over w as gap from (select distinct o_custkey, epoch_us(o_orderdate) / 1000000.0 as d from orders) window w as (partition by o_custkey order by d)),
t as (select *, abs(gap - lag(gap) over (partition by o_custkey order by d)) as turn from g)
select o_custkey, count(*) as n_times, round(avg(gap), 3) as period from t group by o_custkey having count(*) between 4 and 12 and max(turn) <= 86400 * 900""")
def sparse_order_periods(spark, sf_dir):
    """Sparse periods of every customer over all orders."""
    rows = read(spark, sf_dir, "orders").selectExpr("o_custkey", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) / 1000000.0 as d")
    return periodic.sparse_periods(rows, ["o_custkey"], "d", high=12, most=86400.0 * 900).select("o_custkey", "n_times", F.round("period", 3).alias("period"))


@query("""with fine as (select p_partkey % 50 as k, min(p_size)::double as period from part where p_partkey % 3 <> 0 group by 1), coarse as (select p_partkey % 60 as k, min(p_size) / 10.0 as period from part where p_partkey % 4 <> 0 group by 1)
select coalesce(fine.k, coarse.k) as k, coalesce(fine.period, coarse.period * 10) as period, case when fine.period <> coarse.period * 10 then coarse.period * 10 end as period2 from fine full join coarse on fine.k = coarse.k""")
def fingerprint_rates_merged(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    fine = part.where("p_partkey % 3 <> 0").groupBy((F.col("p_partkey") % 50).alias("k")).agg(F.min("p_size").cast("double").alias("period"))
    coarse = part.where("p_partkey % 4 <> 0").groupBy((F.col("p_partkey") % 60).alias("k")).agg((F.min("p_size") / 10.0).alias("period"))
    return periodic.merge_rates(fine, coarse, ["k"], 10.0)


@query()
def period_detection(spark, sf_dir):
    """Periods of all packets of each device and event type, in the bins of ``binned_signal``, nulls where there is none; no SQL for spectra."""
    keys = ["device", "event_type"]
    rows = packets(spark, sf_dir).select(*keys, "ts")
    found = periodic.detect_periods(periodic.binned_signal(rows, keys, "ts", 21600.0, keys[:1]), keys, 21600.0)
    return rows.select(*keys).distinct().join(found, keys, "left").withColumn("strength", F.round("strength", 6))


@query("""with t as (select p_partkey as k, case when p_partkey % 3 = 0 then 0 else p_partkey % 50 + 2 end as true_period from part), f as (select p_partkey as k, p_size + 0.0 as period from part where p_partkey % 4 <> 0 union all select ps, (ps % 50 + 3) + 0.0 from (select p_partkey as ps from part where p_partkey % 5 = 0)),
h as (select t.k, true_period, coalesce(bool_or(abs(period - true_period) <= 1), false) as hit, count(period) > 0 as found from t left join f on f.k = t.k group by all)
select count(*) filter (where true_period <> 0 and hit) as tp, count(*) filter (where true_period <> 0 and not hit) as fn, count(*) filter (where true_period = 0 and found) as fp, count(*) filter (where true_period = 0 and not found) as tn from h""")
def period_evaluation(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    truth = part.selectExpr("p_partkey as k", "case when p_partkey % 3 = 0 then 0 else p_partkey % 50 + 2 end as true_period")
    found = part.where("p_partkey % 4 <> 0").selectExpr("p_partkey as k", "cast(p_size as double) as period").unionByName(part.where("p_partkey % 5 = 0").selectExpr("p_partkey as k", "cast(p_partkey % 50 + 3 as double) as period"))
    return periodic.period_evaluation(truth, found, ["k"], slack=1.0)


def spike_train(period: int, length: int, noise: float = 0.0, seed: int = 0) -> np.ndarray:
    """A binned signal with one event a period, and others by chance."""
    x = np.zeros(length)
    x[::period] = 1
    return np.maximum(x, np.random.default_rng(seed).random(length) < noise)
