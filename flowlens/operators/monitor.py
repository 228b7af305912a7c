"""State machines that are watched trace by trace, and machines with several nodes for one label."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_in_order
from .machine import NEARLY_ONE, SIGNIFICANT
from .traces import TERMINAL

WEEK = 604_800.0
#: Times a step must be seen, and its alternatives too, before it is watched; on refreshing, fewer do.
ADOPTED, REFRESHED = 8, 6
#: Most edges of a machine that path search sends to every task.
MOST_EDGES = 100_000


class Monitor:
    """Counts of one machine's steps, the shares they had when last accepted, and the limits of those shares."""

    def __init__(self):
        self.counts: dict[str, dict[str, float]] = {}
        self.accepted: dict[tuple[str, str], tuple[float, float]] = {}
        self.limits: dict[tuple[str, str], tuple[float, float]] = {}
        self.week = self.month = None

    def _accept(self, src: str, dst: str, p: float, n: float) -> None:
        half = SIGNIFICANT * math.sqrt(p * (1 - p) / n)
        self.accepted[src, dst], self.limits[src, dst] = (p, n), (p - half, p + half)

    def maintain(self, now: float) -> None:
        """Limits are taken anew after a week, and counts halved before that after four."""
        self.week, self.month = (now, now) if self.week is None else (self.week, self.month)
        if now - self.week <= WEEK:
            return
        if now - self.month > 4 * WEEK:
            self.month = now
            self.counts = {s: {d: c / 2 for d, c in to.items()} for s, to in self.counts.items()}
        self.week = now
        for s, to in self.counts.items():
            n = sum(to.values())
            for d, c in to.items():
                if d != TERMINAL and ((s, d) in self.limits or (c >= REFRESHED and n - c >= REFRESHED)):
                    self._accept(s, d, c / n, n)

    def step(self, src: str, dst: str) -> tuple[float, float | None, str]:
        """Share of the step with this one counted, its z against the accepted share, and HIGH, LOW or nothing."""
        to = self.counts.setdefault(src, {})
        to[dst] = to.get(dst, 0) + 1
        n = sum(to.values())
        p, z, alert = to[dst] / n, None, ""
        if (src, dst) in self.limits:
            q, of = self.accepted[src, dst]
            q = min(q, NEARLY_ONE)
            z, (low, high) = (p - q) / math.sqrt(q * (1 - q) / of), self.limits[src, dst]
            if not low <= p <= high:
                alert = "HIGH" if p > high else "LOW"
                self._accept(src, dst, p, n)
        elif dst != TERMINAL and to[dst] >= ADOPTED and n - to[dst] >= ADOPTED:
            self._accept(src, dst, p, n)
        return p, z, alert


    def dump(self) -> str:
        pairs = lambda x: [[*k, *v] for k, v in x.items()]
        return json.dumps([self.counts, pairs(self.accepted), pairs(self.limits), self.week, self.month])

    @classmethod
    def load(cls, text: str) -> Monitor:
        out = cls()
        out.counts, accepted, limits, out.week, out.month = json.loads(text)
        out.accepted, out.limits = ({(s, d): (a, b) for s, d, a, b in x} for x in (accepted, limits))
        return out


#: Schemas of the streaming update below.
WATCHED = "machine string, time double, src string, dst string, prob double, z double, alert string"
MONITOR = "monitor string"


def watch_stream(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State update for ``applyInPandasWithState``: steps (time in seconds, src, dst) of a machine in time order, with its upkeep.

    Steps behind the watermark are late and don't count. A timer for the next
    week's upkeep is set after every call, so a machine without traffic is kept
    too; it gives no rows.
    """
    monitor = Monitor.load(state.get[0]) if state.exists else Monitor()
    mark = state.getCurrentWatermarkMs() / 1000
    if state.hasTimedOut:
        monitor.maintain(mark)
    else:
        rows = pd.concat(frames).sort_values(["time", "src", "dst"], kind="stable")
        out = []
        for now, src, dst in rows.loc[rows["time"] >= mark, ["time", "src", "dst"]].itertuples(index=False):
            monitor.maintain(now)
            out.append((key[0], now, src, dst, *monitor.step(src, dst)))
        yield pd.DataFrame(out, columns=["machine", "time", "src", "dst", "prob", "z", "alert"])
    if monitor.week is not None:
        state.update((monitor.dump(),))
        state.setTimeoutTimestamp(int(max(monitor.week + WEEK, mark) * 1000) + 1)


def watched(steps: DataFrame, keys: list[str], order: list[str], time: str) -> DataFrame:
    """Adds prob, z and alert to every step (src, dst) in order of each machine, with weekly and four-weekly upkeep by ``time``."""

    def step(state: Monitor, now: float, src: str, dst: str) -> tuple:
        state.maintain(now)
        return state, state.step(src, dst)

    return fold_in_order(steps, keys, order, [time, "src", "dst"], Monitor, step, "prob double, z double, alert string")


def node_path(labels: list[str], nodes: dict[str, list[int]], edges: set[tuple[int, int]]) -> tuple[list[int | None], int]:
    """Nodes of the labels with the fewest missing edges, of those the first by node order; and how many edges are missing.

    A label without nodes has none, and its steps are missing.
    """
    if not labels:
        return [], 0
    options = [nodes.get(e) or [None] for e in labels]
    cost: list[dict] = [{n: 0 for n in options[-1]}]
    for here, after in zip(reversed(options[:-1]), reversed(options[1:]), strict=True):
        cost.append({m: min(cost[-1][n] + ((m, n) not in edges) for n in after) for m in here})
    cost.reverse()
    total = min(cost[0].values())
    at = next(n for n in options[0] if cost[0][n] == total)
    out = [at]
    for i in range(1, len(labels)):
        at = next(n for n in options[i] if cost[i][n] + ((out[-1], n) not in edges) == cost[i - 1][out[-1]])
        out.append(at)
    return out, total


def node_paths(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds nodes and n_missing to rows with an array ``path`` of labels.

    ``nodes`` has id and label, ``edges`` src and dst. A machine describes
    labels, not events, so it is small; larger ones are refused.
    """
    held = edges.select("src", "dst").distinct().limit(MOST_EDGES + 1).collect()
    named = nodes.select("label", F.col("id").cast("int").alias("id")).distinct().limit(MOST_EDGES + 1).collect()
    if max(len(held), len(named)) > MOST_EDGES:
        raise ValueError(f"a machine may have {MOST_EDGES} edges and nodes at most")
    links = {(int(r["src"]), int(r["dst"])) for r in held}
    ids: dict[str, list[int]] = {}
    for r in sorted(named, key=lambda r: r["id"]):
        ids.setdefault(r["label"], []).append(r["id"])

    @F.pandas_udf("nodes array<int>, n_missing int")
    def search(column: pd.Series) -> pd.DataFrame:
        found = [node_path([] if p is None else list(p), ids, links) for p in column]
        return pd.DataFrame({"nodes": [f[0] for f in found], "n_missing": [f[1] for f in found]})

    return paths.withColumn("_s", search("path")).select(*paths.columns, "_s.nodes", "_s.n_missing")
