"""Rules that depend on the rows before, over keys of any size: anchored windows, ordered filters and density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import net
from flowlens.operators import folds, grid, scans

from .activity_queries import ORACLE_SQL as _ACTIVITY
from .inputs import PACKETS_SQL, packets, read
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

#: Seq, protocol, pattern and period of the rules of every device, and the core points of some of them.
_RULES = [(0, "TCP", "a.api.example.com", 3600.0), (1, "TCP", "*.example.com", 1800.0), (2, "TCP", "cdn.example.net", 5400.0), (3, "UDP", "time.example.org", 7000.0), (4, "TCP", "*.com", 900.0), (5, "TCP", "*.org", 86400.0)]
_CORES = [("TCP", "*.example.com", 0, 0, 300.0, 10.0), ("TCP", "*.com", 0, 0, 900.0, 20.0), ("TCP", "cdn.example.net", 0, 0, 500.0, 5.0), ("TCP", "*.net", 0, 0, 700.0, 40.0)]
_EPS = 60.0


def _matches(pattern: str) -> str:
    return f"ends_with('.' || host, '{pattern[1:]}')" if pattern.startswith("*.") else f"host = '{pattern}'"


def _rule_sql() -> str:
    steps, left = [], "t"
    for n, protocol, pattern, period in _RULES:
        if period > 7200:
            continue
        w = "(partition by device order by ts, frame_num)"
        steps.append(f"""m{n} as (select *, ts - lag(ts) over {w} as gap from {left} where protocol = '{protocol}' and {_matches(pattern)}),
o{n} as (select *, coalesce(abs(gap - {period}) <= 1 or abs(gap - {period}) <= 0.05 * {period}, false) as ontime from m{n}),
d{n} as (select *, coalesce(last_value(case when ontime then gap - {period} end ignore nulls) over (partition by device order by ts, frame_num rows between unbounded preceding and 1 preceding), 0) as drift from o{n}),
e{n} as (select *, gap is not null and not ontime and gap <= 1 - drift as early from d{n}),
k{n} as materialized (select device, frame_num, '{pattern}' as taken_by from (select *, lead(early) over {w} as next_early from e{n}) where ontime and not coalesce(next_early, false)),
l{n} as materialized (select * from {left} anti join k{n} using (device, frame_num))""")
        left = f"l{n}"
    taken = " union all ".join(f"select * from k{n}" for n, *_, period in _RULES if period <= 7200)
    near = " union all ".join(f"select device, frame_num, '{p}' as taken_by from {left} where protocol = '{q}' and {_matches(p)} and sqrt(power(frame_len - {x}, 2) + power(f2 - {y}, 2)) < {_EPS}" for q, p, _, _, x, y in _CORES)
    return ",\n".join(steps) + f", timed as ({taken}), near as (select device, frame_num, min(taken_by) as taken_by from ({near}) group by all)"


@query(_ACTIVITY["anchored_windows"])
def jumped_windows(spark, sf_dir):
    """Anchored windows by pointers that double, in slices of about two thousand events."""
    rows = packets(spark, sf_dir).select("frame_num", "device", F.round("ts", 3).alias("t"))
    cuts = scans.hot_cuts(rows, ["device"], "t", 2000)
    return folds.anchored_windows_by_jumps(rows, ["device"], "t", "frame_num", 7200, cuts).select("device", "frame_num", "window")


@query(f"""with {PACKETS_SQL}, t as (select frame_num, device, ts, host, frame_len::double as frame_len, (frame_num % 50)::double as f2,
  case when contains(protocol, 'TCP') or contains(protocol, 'MQTT') or contains(protocol, 'TLS') then 'TCP' when contains(protocol, 'UDP') then 'UDP' else protocol end as protocol from p where host <> ''),
{_rule_sql()}
select t.frame_num, coalesce(timed.taken_by, near.taken_by) as taken_by, case when timed.taken_by is not null then 'timing' when near.taken_by is not null then 'cluster' end as how
from t left join timed on timed.device = t.device and timed.frame_num = t.frame_num left join near on near.device = t.device and near.frame_num = t.frame_num""")
def aperiodic_rows(spark, sf_dir):
    """Which rule takes each packet, in order: timing first, then clusters; those that none takes are aperiodic."""
    rows = packets(spark, sf_dir).where("host <> ''")
    rows = rows.select("frame_num", "device", "ts", "host", net.transport(F.col("protocol")).alias("protocol"), F.col("frame_len").cast("double").alias("frame_len"), (F.col("frame_num") % 50).cast("double").alias("f2"))
    devices = rows.select("device").distinct()
    each = lambda named: devices.select("device", F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in named])))
    rules = each([dict(zip(("seq", "protocol", "host_pattern", "period"), r, strict=True)) for r in _RULES])
    cores = each([dict(zip(("protocol", "host_pattern", "core", "cluster", "point"), (*c[:4], [*c[4:]]), strict=True)) for c in _CORES])
    out = folds.filtered_rows(rows, rules, cores, ["device", "protocol"], "ts", "frame_num", ["frame_len", "f2"], _EPS)
    return out.select("frame_num", "taken_by", "how")


@query()
def grid_clusters(spark, sf_dir):
    """Core points of each device's rows of all orders, without a limit on rows; no SQL follows neighbours of neighbours."""
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("device"), "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    return grid.grid_clusters(rows, ["device"], ["l_quantity", "price"], eps=1.5, least=5)
