"""State machines and temporal invariants mined from traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scans
from .periodic import checkpointed
from .traces import INITIAL, TERMINAL

FOLLOWED, PRECEDES, NEVER = "AlwaysFollowedBy", "AlwaysPrecedes", "NeverFollowedBy"
#: Joins the labels of a node's name.
THEN = " > "


def _same(keys: list[str], a: str, b: str):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def label_places(traces: DataFrame, keys: list[str], pos: str, event: str) -> DataFrame:
    """keys, label, first and last place of every label in every trace."""
    return traces.groupBy(*keys, F.col(event).alias("label")).agg(F.min(pos).alias("first"), F.max(pos).alias("last"))


def mined_invariants(traces: DataFrame, keys: list[str], pos: str, event: str, least: int = 2) -> DataFrame:
    """kind, a, b and support of every invariant that holds in all traces, for labels that share at least one.

    AlwaysFollowedBy: after every ``a`` comes a ``b``. AlwaysPrecedes: before
    every ``b`` comes an ``a``. NeverFollowedBy: no ``b`` comes after an ``a``.
    ``support`` is the number of traces with ``a``, ``b`` or both, and reaches
    ``least``. A trace becomes one row a label first, so what is paired is the
    labels of a trace, never its events. Labels that share no trace can't follow
    each other either and aren't listed; null labels are no labels.
    """
    at = label_places(traces, keys, pos, event).where("label is not null")
    both = at.alias("x").join(at.alias("y"), _same(keys, "x", "y"))
    pairs = both.groupBy(F.col("x.label").alias("a"), F.col("y.label").alias("b")).agg(
        F.count("*").alias("together"),
        F.count_if(F.col("y.last") > F.col("x.last")).alias("_followed"),
        F.count_if(F.col("x.first") < F.col("y.first")).alias("_preceded"),
        F.count_if(F.col("x.first") < F.col("y.last")).alias("_later"),
    )
    own = pairs.where("a = b").select(F.col("a").alias("label"), F.col("together").alias("n"))
    rows = pairs.join(own.select(F.col("label").alias("a"), F.col("n").alias("_na")), "a").join(own.select(F.col("label").alias("b"), F.col("n").alias("_nb")), "b")
    holds = lambda kind, on, n: F.when(on & (F.col(n) >= least), F.struct(F.lit(kind).alias("kind"), F.col(n).alias("support")))
    kinds = F.array_compact(F.array(holds(FOLLOWED, F.col("_followed") == F.col("_na"), "_na"), holds(PRECEDES, F.col("_preceded") == F.col("_nb"), "_nb"), holds(NEVER, F.col("_later") == 0, "together")))
    return rows.select("a", "b", F.explode(kinds).alias("k")).select("k.kind", "a", "b", "k.support")


def broken_invariants(traces: DataFrame, keys: list[str], pos: str, event: str, invariants: DataFrame) -> DataFrame:
    """keys, kind, a, b of every invariant that a trace breaks. ``invariants`` has kind, a and b, each once."""
    at = label_places(traces, keys, pos, event)
    # The label that binds a trace to an invariant: of a precedence it is the later one.
    late = F.col("kind") == PRECEDES
    bound = invariants.select("kind", "a", "b", F.when(late, F.col("b")).otherwise(F.col("a")).alias("label"), F.when(late, F.col("a")).otherwise(F.col("b")).alias("_other"))
    mine = at.join(bound, "label")
    rows = mine.alias("x").join(at.alias("y"), _same(keys, "x", "y") & (F.col("x._other") == F.col("y.label")), "left")
    first, last, first_other, last_other = (F.col(c) for c in ("x.first", "x.last", "y.first", "y.last"))
    kept = F.when(F.col("kind") == FOLLOWED, last_other > last).when(late, first_other < first).otherwise(~F.coalesce(last_other > first, F.lit(False)))
    return rows.where(~F.coalesce(kept, F.lit(False))).select(*[F.col(f"x.{k}").alias(k) for k in keys], "kind", "a", "b")


def tail_nodes(traces: DataFrame, keys: list[str], pos: str, event: str, k: int) -> DataFrame:
    """keys, pos, label and node of every event and of each trace's terminal one; a node is a label and the next ``k`` labels.

    That is what ``k`` rounds of refinement give, in which a round tells nodes
    apart by the nodes that follow: all of them are places of one window.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = traces.select(*keys, F.col(pos).cast("long").alias("pos"), F.col(event).alias("label"))
    rows = rows.unionByName(rows.groupBy(*keys).agg((F.max("pos") + 1).alias("pos"), F.lit(TERMINAL).alias("label")))
    return rows.withColumn("node", F.concat_ws(THEN, "label", *[F.lead("label", i).over(w) for i in range(1, k + 1)]))


def machine_of(nodes: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """src, dst, src_label, dst_label, cnt, total and prob of every step between nodes, from the initial one on.

    ``nodes`` is one row for each event as from ``tail_nodes`` or ``refined_nodes``.
    With ``most``, traces of more rows than that are cut in slices, each of
    which takes over the last node before it.
    """
    cuts = scans.hot_cuts(nodes, keys, "pos", most) if most else None
    rows = scans.dealt(scans.sliced(nodes, keys, "pos", cuts), keys, cuts)
    last = lambda table, w: table.withColumn("_last", F.last("_end", ignorenulls=True).over(scans.before(w)))
    rows = scans.carried(rows, keys, cuts, [F.max_by(F.struct("node", "label"), "pos").alias("_end")], last, {"_last": "struct<node:string,label:string>"})
    w = Window.partitionBy(*keys, "_slice").orderBy("pos")
    prior = lambda c: F.coalesce(F.when(F.row_number().over(w) == 1, F.col("_last")[c]).otherwise(F.lag(c).over(w)), F.lit(INITIAL))
    steps = rows.select(prior("node").alias("src"), prior("label").alias("src_label"), F.col("node").alias("dst"), F.col("label").alias("dst_label"))
    counts = steps.groupBy("src", "dst", "src_label", "dst_label").agg(F.count("*").alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy("src"))
    return counts.withColumn("total", total).withColumn("prob", F.col("cnt") / F.col("total"))


def mined_machine(traces: DataFrame, keys: list[str], pos: str, event: str, k: int = 2) -> DataFrame:
    """A machine whose nodes are events with the same label and the same next ``k`` labels; columns of ``machine_of``."""
    return machine_of(tail_nodes(traces, keys, pos, event, k), keys)


def _reached(start: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """kind, avoid, node of all nodes that ``start`` reaches along ``edges`` (src, dst) without a node labelled ``avoid``.

    Each step follows only what the last one found, and is written, so its plan
    doesn't grow.
    """
    named = edges.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("_label")), "dst")
    found = new = checkpointed(start.distinct())
    while not new.isEmpty():
        further = new.join(named, F.col("node") == F.col("src")).where(F.col("_label") != F.col("avoid")).select("kind", "avoid", F.col("dst").alias("node")).distinct()
        new = checkpointed(further.join(found, ["kind", "avoid", "node"], "left_anti"))
        found = found.unionByName(new)
    return found


def breaking_nodes(machine: DataFrame, invariants: DataFrame) -> DataFrame:
    """kind, avoid (a label) and node on paths of a machine that no trace may take: after an ``a`` to the end without ``b``, or from the start to a ``b`` without ``a``.

    Paths of all invariants that avoid one label are followed together, so rows
    grow with labels times nodes. ``invariants`` of other kinds are left out.
    """
    edges = machine.select("src", "dst").distinct()
    labels = machine.select(F.col("dst").alias("node"), F.col("dst_label").alias("label")).unionByName(machine.select(F.col("src").alias("node"), F.col("src_label").alias("label"))).distinct()
    edges, labels = checkpointed(edges), checkpointed(labels)
    kept = invariants.where(F.col("kind").isin(FOLLOWED, PRECEDES))
    groups = kept.select("kind", F.when(F.col("kind") == FOLLOWED, F.col("b")).otherwise(F.col("a")).alias("avoid"), F.when(F.col("kind") == FOLLOWED, F.col("a")).otherwise(F.col("b")).alias("label"))
    inner = groups.join(labels, "label").select("kind", "avoid", "node")
    outer = groups.select("kind", "avoid", F.when(F.col("kind") == FOLLOWED, F.lit(TERMINAL)).otherwise(F.lit(INITIAL)).alias("node"))
    side = lambda rows, kind: rows.where(F.col("kind") == kind)
    sources, targets = side(inner, FOLLOWED).unionByName(side(outer, PRECEDES)), side(outer, FOLLOWED).unionByName(side(inner, PRECEDES))
    onward = _reached(sources, edges, labels)
    back = _reached(targets, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), labels)
    return checkpointed(onward.join(back, ["kind", "avoid", "node"]))


def refined_nodes(traces: DataFrame, keys: list[str], pos: str, event: str, invariants: DataFrame, k: int = 0, most: int | None = None) -> DataFrame:
    """Nodes as from ``tail_nodes``, split so that no path of their machine breaks an invariant (AlwaysFollowedBy or AlwaysPrecedes) of the traces.

    A node on a path that breaks an invariant is split by whether the label that
    the path avoids comes later in an event's trace (AlwaysFollowedBy) or came
    before it (AlwaysPrecedes). A path that avoids the label can't change that
    answer on its way, and its two ends have different ones, so it is gone, and
    one round mends every invariant. Nodes split off are named by a hash of 64
    bits. What is joined are an event and the invariants that break at its node.
    """
    nodes = checkpointed(tail_nodes(traces, keys, pos, event, k))
    breaking = breaking_nodes(machine_of(nodes, keys, most), invariants).where(~F.col("node").isin(INITIAL, TERMINAL))
    met = nodes.join(breaking, "node")
    at = label_places(traces, keys, pos, event)
    seen = met.alias("x").join(at.alias("y"), _same(keys, "x", "y") & (F.col("x.avoid") == F.col("y.label")), "left")
    flag = F.coalesce(F.when(F.col("kind") == FOLLOWED, F.col("y.last") > F.col("x.pos")).otherwise(F.col("y.first") < F.col("x.pos")), F.lit(False))
    own = [F.col(f"x.{c}").alias(c) for c in (*keys, "pos", "label", "node")]
    split = seen.select(*own, F.struct("kind", "avoid", flag.alias("flag")).alias("_f")).groupBy(*keys, "pos", "label", "node").agg(F.sort_array(F.collect_list("_f")).alias("_f"))
    split = split.select(*keys, "pos", "label", F.concat("label", F.lit("#"), F.lower(F.hex(F.xxhash64("node", F.to_json("_f"))))).alias("node"))
    return split.unionByName(nodes.join(breaking.select("node").distinct(), "node", "left_anti").select(split.columns))


def numbered(machine: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, node) and edges (src, dst, cnt, prob by ids) of a machine, as ``monitor.node_paths`` takes them; ids from 1 by name."""
    ends = machine.select(F.col("src").alias("node"), F.col("src_label").alias("label")).unionByName(machine.select(F.col("dst").alias("node"), F.col("dst_label").alias("label"))).distinct()
    nodes = checkpointed(ends.withColumn("id", F.row_number().over(Window.orderBy("node"))))  # one row a node
    side = lambda end: nodes.select(F.col("node").alias(end), F.col("id").alias(f"_{end}"))
    edges = machine.join(side("src"), "src").join(side("dst"), "dst")
    return nodes.select("id", "label", "node"), edges.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "cnt", "prob")
