"""State machines over traces of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import machine, scans, traces

from .inputs import PACKETS_SQL, packets
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

GAP = 14_400.0
#: Traces that start before this time train the machine.
CUT = 1_705_500_000.0
#: Rows of a slice of a device.
SLICE = 50_000
_TRACES = f"""with {PACKETS_SQL},
o as (select frame_num, device, ts, event_type, coalesce((ts - lag(ts) over w > {GAP})::int, 0) as opens from p window w as (partition by device order by ts, frame_num)),
n as (select *, (sum(opens) over (partition by device order by ts, frame_num))::bigint as trace from o),
t as (select *, row_number() over w - 1 as pos, ts - min(ts) over (partition by device, trace) as rel_ts, min(ts) over (partition by device, trace) as started from n window w as (partition by device, trace order by ts, frame_num)),
s as (select device, trace, started, pos, event_type as src, coalesce(lead(event_type) over (partition by device, trace order by pos), 'TERMINAL') as dst from t
  union all select device, trace, started, -1, 'INITIAL', event_type from t where pos = 0),
e as (select src, dst, count(*) as cnt, (sum(count(*)) over (partition by src))::bigint as total from s where started < {CUT} group by src, dst),
m as (select *, cnt / total as prob from e),
x as (select device, trace, started, count(*) as n_steps, count_if(prob is null)::bigint as n_new, 1 - sum(ln(coalesce(prob, 0.5))) as deviation from s left join m using (src, dst) group by all)
"""


def _traces(spark, sf_dir):
    rows = packets(spark, sf_dir).select("frame_num", "device", "ts", "event_type")
    rows = traces.split_traces(rows, ["device"], "ts", "frame_num", GAP, scans.hot_cuts(rows, ["device"], "ts", SLICE))
    return rows.withColumn("started", F.round(F.col("ts") - F.col("rel_ts"), 6))


def _steps(spark, sf_dir):
    return traces.transitions(_traces(spark, sf_dir), ["device", "trace", "started"], "pos", "event_type")


def _model(spark, sf_dir):
    return machine.edges(_steps(spark, sf_dir).where(F.col("started") < CUT))


def _scores(spark, sf_dir):
    return machine.trace_scores(_steps(spark, sf_dir), _model(spark, sf_dir), ["device", "trace", "started"])


@query(_TRACES + "select frame_num, trace, pos, round(rel_ts, 6) as rel_ts from t")
def trace_split(spark, sf_dir):
    return _traces(spark, sf_dir).select("frame_num", "trace", "pos", F.round("rel_ts", 6).alias("rel_ts"))


@query("""with e as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over w) >= 3600000000 then 1 else 0 end as opens from events window w as (partition by user_id order by ts)),
s as (select *, sum(opens) over (partition by user_id order by ts) as n from e)
select user_id, min(ts) as start, count(*) as n_events from s group by user_id, n""")
def session_windows(spark, sf_dir):
    from .inputs import read

    return traces.session_counts(read(spark, sf_dir, "events"), ["user_id"], "ts", "1 hour")


@query(_TRACES + "select device, trace, string_agg(event_type, ' > ' order by pos) || ' > TERMINAL' as path from t group by all")
def event_paths(spark, sf_dir):
    return traces.paths(_traces(spark, sf_dir), ["device", "trace"], "pos", "event_type").select("device", "trace", F.array_join("path", " > ").alias("path"))


@query(_TRACES + """, q as (select device, trace, started, string_agg(event_type, ' ' order by pos) as seq from t group by all)
select distinct seq from q where started >= """ + f"{CUT} and seq not in (select seq from q where started < {CUT})")
def unseen_traces(spark, sf_dir):
    rows = traces.paths(_traces(spark, sf_dir), ["device", "trace", "started"], "pos", "event_type").withColumn("seq", F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), " "))
    return rows.where(F.col("started") >= CUT).select("seq").distinct().join(rows.where(F.col("started") < CUT).select("seq"), "seq", "left_anti")


@query(_TRACES + "select src, dst, cnt, total, round(prob, 9) as prob from m")
def transition_probabilities(spark, sf_dir):
    return _model(spark, sf_dir).withColumn("prob", F.round("prob", 9))


@query(_TRACES + "select device, trace, n_steps, n_new, round(deviation, 6) as deviation, round(exp(1 - deviation), 9) as probability from x")
def trace_probability(spark, sf_dir):
    return _scores(spark, sf_dir).select("device", "trace", "n_steps", "n_new", F.round("deviation", 6).alias("deviation"), F.round(F.exp(1 - F.col("deviation")), 9).alias("probability"))


@query(_TRACES + """, d as (select *, avg(deviation) over () as mu from x where started < """ + f"{CUT})" + """
select count(*) as n, round(max(deviation), 6) as max, round(min(deviation), 6) as min, round(avg(deviation), 6) as mean, round(stddev_pop(deviation), 6) as std, round(avg(power(deviation - mu, 3)) / power(var_pop(deviation), 1.5), 5) as skew,
  round(avg(power(deviation - mu, 4)) / power(var_pop(deviation), 2) - 3, 5) as kurtosis, round(avg(deviation) + 3 * stddev_pop(deviation), 6) as threshold from d""")
def trace_score_summary(spark, sf_dir):
    out = machine.score_summary(_scores(spark, sf_dir).where(F.col("started") < CUT))
    return out.select(*[F.round(c, 5 if c in ("skew", "kurtosis") else 6).alias(c) if c != "n" else F.col(c) for c in out.columns])


@query(_TRACES + f", h as (select avg(deviation) + 2 * stddev_pop(deviation) as threshold from x where started < {CUT}) select device, trace, round(deviation, 6) as deviation from x, h where started >= {CUT} and deviation > threshold")
def short_term_alerts(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    limit = machine.score_summary(scores.where(F.col("started") < CUT), 2.0).select("threshold")
    late = scores.where(F.col("started") >= CUT).join(F.broadcast(limit), F.col("deviation") > F.col("threshold"))
    return late.select("device", "trace", F.round("deviation", 6).alias("deviation"))


@query(_TRACES + f", h as (select avg(deviation) + stddev_pop(deviation) as threshold from x where started < {CUT}) select device, trace, round(deviation, 6) as deviation from x, h where deviation > threshold")
def deviating_traces(spark, sf_dir):
    """All traces that lie more than one deviation above the mean of earlier ones; unlike later ones alone, some do in the tables."""
    scores = _scores(spark, sf_dir)
    limit = machine.score_summary(scores.where(F.col("started") < CUT), 1.0).select("threshold")
    return scores.join(F.broadcast(limit), F.col("deviation") > F.col("threshold")).select("device", "trace", F.round("deviation", 6).alias("deviation"))


@query(_TRACES + f""", w as (select src, dst, count(*) as c, sum(count(*)) over (partition by src) as n from s where started >= {CUT} group by src, dst),
z as (select w.src, w.dst, c / n as prob_now, n::bigint as n_now, case when prob = 1 then 0.999 else prob end as q from w join m on m.src = w.src and m.dst = w.dst)
select src, dst, n_now, round((prob_now - q) / sqrt(q * (1 - q) / n_now), 6) as z, abs((prob_now - q) / sqrt(q * (1 - q) / n_now)) > 1.96 as alert from z""")
def transition_z(spark, sf_dir):
    now = machine.edges(_steps(spark, sf_dir).where(F.col("started") >= CUT))
    return machine.transition_z(now, _model(spark, sf_dir)).select("src", "dst", "n_now", F.round("z", 6).alias("z"), "alert")


@query(_TRACES + """select src, dst, total, round(prob - 1.96 * sqrt(prob * (1 - prob) / total), 9) as lower, round(prob + 1.96 * sqrt(prob * (1 - prob) / total), 9) as upper
from m where ((total * prob >= 6 and total * (1 - prob) >= 6) or (prob >= 0.9 and total >= 3)) and dst <> 'TERMINAL'""")
def transition_boundaries(spark, sf_dir):
    return machine.boundaries(_model(spark, sf_dir)).select("src", "dst", "total", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


@query(_TRACES + """, i as (select device, trace, min(pos) filter (where event_type = 'view') as v0, max(pos) filter (where event_type = 'view') as v1, min(pos) filter (where event_type = 'purchase') as p0, max(pos) filter (where event_type = 'purchase') as p1 from t group by all)
select device, trace, p0 is null or coalesce(v0 < p0, false) as precedes_ok, v1 is null or coalesce(p1 > v1, false) as followed_ok from i""")
def trace_invariants(spark, sf_dir):
    rows = traces.paths(_traces(spark, sf_dir), ["device", "trace"], "pos", "event_type")
    return machine.invariants(rows, "view", "purchase").select("device", "trace", "precedes_ok", "followed_ok")


@query(_TRACES + """, l as (select device, trace, n_steps - 1 as length, exp(1 - deviation) as prob from x), g as (select length, count(*) as n, avg(prob) as mean_prob from l group by length)
select length, n, round(mean_prob, 9) as mean_prob, round(power(mean_prob / nullif(lag(mean_prob) over (order by length), 0), 1.0 / (length - lag(length) over (order by length))), 6) as decay from g""")
def probability_by_length(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = _scores(spark, sf_dir).groupBy((F.col("n_steps") - 1).alias("length")).agg(F.count("*").alias("n"), F.avg(F.exp(1 - F.col("deviation"))).alias("mean_prob"))
    w = Window.orderBy("length")
    decay = F.pow(F.try_divide(F.col("mean_prob"), F.lag("mean_prob").over(w)), 1.0 / (F.col("length") - F.lag("length").over(w)))
    return rows.select("length", "n", F.round("mean_prob", 9).alias("mean_prob"), F.round(decay, 6).alias("decay"))


@query(_TRACES + """, g as (select n_steps - 1 as length, avg(exp(1 - deviation)) as p from x group by n_steps),
r as (select length, lag(p) over w / p as ratio, case when length - lag(length) over w > 1 then length - lag(length) over w + 1 else length - lag(length) over w end as n from g window w as (order by length))
select sum(n)::bigint as steps, round(exp(sum(ln(ratio)) / (sum(n) + 1)), 6) as factor from r where length < 23 and ratio is not null""")
def decay_factor(spark, sf_dir):
    rows = _scores(spark, sf_dir).groupBy((F.col("n_steps") - 1).alias("length")).agg(F.avg(F.exp(1 - F.col("deviation"))).alias("mean_prob"))
    return machine.decay_factor(rows).withColumn("factor", F.round("factor", 6))


@query(_TRACES + """, b as (select device, started, src, dst, count(*) as n from s group by all), a as (select *, floor((started - min(started) over (partition by device)) / 604800) as age from b)
select device, round(started, 3) as started, src, dst, round(sum(n * power(2.0, age)) over (partition by device, src, dst order by started) / power(2.0, age), 6) as cnt from a""")
def online_counts(spark, sf_dir):
    rows = machine.online_update(_steps(spark, sf_dir), "device", "started", halve_after=604800.0)
    return rows.select("device", F.round("started", 3).alias("started"), "src", "dst", F.round("cnt", 6).alias("cnt"))


@query(_TRACES + ", h as (select src, dst, cnt * 0.5 as cnt from m where cnt * 0.5 >= 1) select src, dst, cnt, round(cnt / sum(cnt) over (partition by src), 9) as prob from h")
def halved_machine(spark, sf_dir):
    return machine.decayed(_model(spark, sf_dir)).select("src", "dst", F.col("cnt").cast("double").alias("cnt"), F.round("prob", 9).alias("prob"))


@query(_TRACES + """select device, trace, c::int as copy, count(*) as n from t, range(3) r(c) group by all""")
def duplicated_traces(spark, sf_dir):
    return traces.duplicated(_traces(spark, sf_dir), 2).groupBy("device", "trace", "copy").agg(F.count("*").alias("n"))


@query()
def mutated_traces(spark, sf_dir):
    """Paths with one event inserted, altered and removed, by a hash that SQL engines don't share."""
    rows = traces.paths(_traces(spark, sf_dir), ["device", "trace"], "pos", "event_type").withColumn("path", F.slice("path", F.lit(1), F.size("path") - 1))
    key = F.concat_ws("/", "device", "trace")
    return rows.select("device", "trace", "path", *[traces.mutated(F.col("path"), key, ["view", "click", "error", "purchase", "signup"], kind).alias(kind) for kind in ("insert", "alter", "remove")])
