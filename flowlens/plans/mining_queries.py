"""Machines and invariants mined from traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import mining, monitor, traces
from flowlens.operators.periodic import checkpointed

from .machine_queries import _TRACES, CUT, SLICE, _traces
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

_KEYS = ["device", "trace", "started"]
_PLACES = """, l as (select device, trace, started, event_type as label, min(pos) as f, max(pos) as z from t group by all)"""
_MINED = _PLACES + """, g as (select x.label as a, y.label as b, count(*) as n, count_if(y.z > x.z) as fo, count_if(x.f < y.f) as pr, count_if(x.f < y.z) as la from l x join l y using (device, trace, started) where {on} group by all),
h as (select g.*, u.n as na, v.n as nb from g join g u on u.a = g.a and u.b = g.a join g v on v.a = g.b and v.b = g.b),
i as (select 'AlwaysFollowedBy' as kind, a, b, na as support from h where fo = na and na >= 2 union all select 'AlwaysPrecedes', a, b, nb from h where pr = nb and nb >= 2 union all select 'NeverFollowedBy', a, b, n from h where la = 0 and n >= 2)"""
#: Traces that end with an event of their device's number; made from the tables' so that some rules hold in all of them.
_ENDED = """, t2 as (select device, trace, started, pos, event_type from t union all
  select device, trace, started, max(pos) + 1, 'off' from t group by all having count_if(event_type = 'purchase') > 0 union all
  select device, trace, started, -1, 'hello' from t group by all having count_if(event_type = 'error') > 0)"""
_OVER_ENDED = _PLACES.replace("from t group", "from t2 group")


def _ended(spark, sf_dir):
    """Traces with a closing event after purchases and an opening one before errors."""
    rows = _traces(spark, sf_dir).select(*_KEYS, F.col("pos").cast("long").alias("pos"), "event_type")
    has = lambda event: rows.groupBy(*_KEYS).agg(F.max("pos").alias("_last"), F.count_if(F.col("event_type") == event).alias("_n")).where("_n > 0")
    off = has("purchase").select(*_KEYS, (F.col("_last") + 1).alias("pos"), F.lit("off").alias("event_type"))
    hello = has("error").select(*_KEYS, F.lit(-1).cast("long").alias("pos"), F.lit("hello").alias("event_type"))
    return rows.unionByName(off).unionByName(hello)


@query(_TRACES + _ENDED + _MINED.replace("from t group", "from t2 group").format(on="true") + " select kind, a, b, support from i")
def mined_invariants(spark, sf_dir):
    return mining.mined_invariants(_ended(spark, sf_dir), _KEYS, "pos", "event_type")


@query(_TRACES + _ENDED + _OVER_ENDED + _MINED.removeprefix(_PLACES).format(on=f"started < {CUT}") + f""", r as (select device, trace, event_type as label, min(pos) as f, max(pos) as z from t where started >= {CUT} group by all),
k as (select x.device, x.trace, kind, a, b, case kind when 'AlwaysFollowedBy' then coalesce(y.z > x.z, false) when 'AlwaysPrecedes' then coalesce(y.f < x.f, false) else not coalesce(y.z > x.f, false) end as kept
  from r x join i on x.label = case when kind = 'AlwaysPrecedes' then b else a end left join r y on y.device = x.device and y.trace = x.trace and y.label = case when kind = 'AlwaysPrecedes' then a else b end)
select device, trace, kind, a, b from k where not kept""")
def broken_invariants(spark, sf_dir):
    """Later traces, without their opening and closing events, against the invariants of earlier ones that have them."""
    held = mining.mined_invariants(_ended(spark, sf_dir).where(F.col("started") < CUT), _KEYS, "pos", "event_type")
    later = _traces(spark, sf_dir).where(F.col("started") >= CUT)
    return mining.broken_invariants(later, ["device", "trace"], "pos", "event_type", held)


@query(_TRACES + """, u as (select device, trace, started, pos, event_type as label from t union all select device, trace, started, max(pos) + 1, 'TERMINAL' from t group by all),
v as (select *, concat_ws(' > ', label, lead(label) over w, lead(label, 2) over w) as node from u window w as (partition by device, trace, started order by pos)),
y as (select coalesce(lag(node) over w, 'INITIAL') as src, coalesce(lag(label) over w, 'INITIAL') as src_label, node as dst, label as dst_label from v window w as (partition by device, trace, started order by pos)),
z as (select src, dst, src_label, dst_label, count(*) as cnt from y group by all)
select *, (sum(cnt) over (partition by src))::bigint as total, round(cnt / sum(cnt) over (partition by src), 9) as prob from z""")
def mined_machine(spark, sf_dir):
    return mining.mined_machine(_traces(spark, sf_dir), _KEYS, "pos", "event_type", 2).withColumn("prob", F.round("prob", 9))


@query()
def refined_machine(spark, sf_dir):
    """One node a label, split until the mined invariants hold on every path; SQL has no such loop."""
    rows = checkpointed(_ended(spark, sf_dir))
    held = mining.mined_invariants(rows, _KEYS, "pos", "event_type")
    nodes = checkpointed(mining.refined_nodes(rows, _KEYS, "pos", "event_type", held, most=SLICE))
    return mining.machine_of(nodes, _KEYS, SLICE)


@query()
def mined_paths(spark, sf_dir):
    """Later traces through the machine mined from earlier ones; SQL has no search for the fewest missing edges."""
    rows = _traces(spark, sf_dir)
    nodes, edges = mining.numbered(mining.mined_machine(rows.where(F.col("started") < CUT), _KEYS, "pos", "event_type", 1))
    later = traces.paths(rows.where(F.col("started") >= CUT), ["device", "trace"], "pos", "event_type")
    return monitor.node_paths(later, nodes, edges).select("device", "trace", "nodes", "n_missing")
