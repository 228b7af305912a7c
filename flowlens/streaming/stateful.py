"""Host resolution, burst splitting and watched machines on streams, with keyed state and event-time timers.

All need Spark's RocksDB state store: set spark.sql.streaming.stateStore.providerClass
to org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider. Rows
behind the watermark are late and are dropped, names as well as packets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators.monitor import WATCHED, WEEK, Monitor

RESOLVED = "device string, ip string, frame_num long, ts double, name string, outcome string"
BURSTS = "flow string, burst long, burst_start double, burst_end double, n_packets long, n_bytes long"


def _ms(seconds: float) -> int:
    return math.ceil(seconds * 1000)


class NameResolver(StatefulProcessor):
    """Names of one address: packets wait until the watermark has passed them, and if no name precedes them for ``wait`` seconds more.

    Of the names before the watermark only the last can still precede a packet,
    so older ones are forgotten once no waiting packet needs them; the first
    name is kept for packets that none precedes.
    """

    def __init__(self, wait: float):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "ts double", "name string")
        self.waiting = handle.getMapState("waiting", "frame_num long", "ts double")
        self.first = handle.getValueState("first", "ts double, name string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = self.first.get() if self.first.exists() else None
        soonest = math.inf
        for frame in rows:
            for ts, frame_num, name in frame[["ts", "frame_num", "name"]].itertuples(index=False):
                if not pd.isna(frame_num):
                    self.waiting.updateValue((int(frame_num),), (ts,))
                    soonest = min(soonest, ts)
                elif name is not None:
                    held = self.names.getValue((ts,))
                    name = name if held is None else max(name, held[0])  # of names at one time the largest counts
                    self.names.updateValue((ts,), (name,))
                    if first is None or (ts, first[1]) <= (first[0], name):
                        first = (ts, name)
        if first is not None:
            self.first.update(first)
        if soonest < math.inf:
            self.handle.registerTimer(max(_ms(soonest), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        names = sorted((k[0], v[0]) for k, v in self.names.iterator())
        first = self.first.get() if self.first.exists() else None
        out, left = [], []
        for (frame_num,), (ts,) in sorted(self.waiting.iterator()):
            prior = next((n for t, n in reversed(names) if t <= ts), None)
            if _ms(ts) <= mark and prior is not None:
                out.append((*key, frame_num, ts, prior, "prior"))
            elif _ms(ts + self.wait) <= mark:
                out.append((*key, frame_num, ts, first[1] if first else None, "after" if first else "blank"))
            else:
                left.append(ts + self.wait if _ms(ts) <= mark else ts)
                continue
            self.waiting.removeKey((frame_num,))
        needed = min([mark / 1000, *(ts for _, (ts,) in self.waiting.iterator())])
        before = [t for t, _ in names if t <= needed]
        for t in before[:-1]:
            self.names.removeKey((t,))
        if left:
            self.handle.registerTimer(max(_ms(min(left)), mark + 1))
        yield pd.DataFrame(out, columns=["device", "ip", "frame_num", "ts", "name", "outcome"])

    def close(self) -> None:
        pass


def resolved_stream(packets: DataFrame, history: DataFrame, late: str, wait: float) -> DataFrame:
    """``lookups.as_of`` on two streams: device, ip, frame_num, ts, name and outcome of each packet, once it is certain.

    ``packets`` has device, ip, frame_num and at, a timestamp; ``history`` has
    device, ip, name and at. Streams may be up to ``late`` out of order. Rows
    equal the batch's where a packet's first name, if none precedes it, comes
    within ``wait`` seconds after it.
    """
    mine = packets.select("device", "ip", "at", F.col("frame_num").cast("long").alias("frame_num"), F.lit(None).cast("string").alias("name"))
    names = history.select("device", "ip", "at", F.lit(None).cast("long").alias("frame_num"), "name")
    both = mine.unionByName(names).withColumn("ts", F.unix_micros("at") / 1e6).withWatermark("at", late)
    return both.groupBy("device", "ip").transformWithStateInPandas(NameResolver(wait), RESOLVED, "Append", "EventTime")


class BurstCloser(StatefulProcessor):
    """Bursts of one flow: packets wait for the watermark and are then taken in order; a burst closes at the next gap, or by a timer."""

    def __init__(self, gap: float):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts double, frame_num long", "frame_len long")
        self.open = handle.getValueState("open", "burst long, start double, last double, n_packets long, n_bytes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        soonest = math.inf
        for frame in rows:
            for ts, frame_num, frame_len in frame[["ts", "frame_num", "frame_len"]].itertuples(index=False):
                self.waiting.updateValue((ts, int(frame_num)), (int(frame_len),))
                soonest = min(soonest, ts)
        self.handle.registerTimer(max(_ms(soonest), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        burst, start, last, n, size = self.open.get() if self.open.exists() else (-1, 0.0, None, 0, 0)
        out, later = [], math.inf
        for (ts, frame_num), (frame_len,) in sorted(self.waiting.iterator()):
            if _ms(ts) > mark:
                later = ts
                break
            if last is None or round(ts - last, 6) > self.gap or n == 0:
                if n:
                    out.append((*key, burst, start, last, n, size))
                burst, start, n, size = burst + 1, ts, 0, 0
            last, n, size = ts, n + 1, size + frame_len
            self.waiting.removeKey((ts, frame_num))
        if n and _ms(last + self.gap) < mark:  # whatever still comes, comes after the gap
            out.append((*key, burst, start, last, n, size))
            n, size = 0, 0
        self.open.update((burst, start, last, n, size))
        ahead = min(later, last + self.gap + 0.001 if n else math.inf)
        if ahead < math.inf:
            self.handle.registerTimer(max(_ms(ahead), mark + 1))
        yield pd.DataFrame(out, columns=["flow", "burst", "burst_start", "burst_end", "n_packets", "n_bytes"])

    def close(self) -> None:
        pass


def burst_stream(packets: DataFrame, keys: list[str], gap: float, late: str) -> DataFrame:
    """Closed bursts of a stream of packets: the ``keys``, burst, burst_start, burst_end, n_packets and n_bytes.

    ``packets`` has frame_num, frame_len and at, a timestamp, and may be up to
    ``late`` out of order. Bursts are those of ``flows.split_bursts``; the last
    of a flow closes when the watermark has passed it by more than ``gap``. A
    frame that arrives twice counts once.
    """
    flow = F.to_json(F.struct(*keys))
    rows = packets.select(flow.alias("flow"), "at", F.col("frame_num").cast("long").alias("frame_num"), F.col("frame_len").cast("long").alias("frame_len")).withColumn("ts", F.unix_micros("at") / 1e6).withWatermark("at", late)
    out = rows.groupBy("flow").transformWithStateInPandas(BurstCloser(gap), BURSTS, "Append", "EventTime")
    kinds = ", ".join(f"`{k}` {packets.schema[k].dataType.simpleString()}" for k in keys)
    return out.withColumn("_k", F.from_json("flow", kinds)).select("_k.*", "burst", "burst_start", "burst_end", "n_packets", "n_bytes")


class MachineWatcher(StatefulProcessor):
    """Steps of one machine; a batch reads and writes the state of the sources it has steps from, weekly upkeep that of all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sources = handle.getMapState("sources", "src string", "dst array<string>, cnt array<double>, watched array<string>, p array<double>, n array<double>, low array<double>, high array<double>")
        self.clock = handle.getValueState("clock", "week double, month double")

    def _monitor(self) -> Monitor:
        out = Monitor()
        if self.clock.exists():
            out.week, out.month = self.clock.get()
        return out

    def _take(self, monitor: Monitor, src: str, held) -> None:
        if src in monitor.counts or held is None:
            return
        monitor.counts[src] = {d: float(c) for d, c in zip(held[0], held[1], strict=True)}
        for d, p, n, low, high in zip(*held[2:], strict=True):
            monitor.accepted[src, d], monitor.limits[src, d] = (p, n), (low, high)

    def _kept(self, monitor: Monitor, now: float) -> bool:
        """Whether upkeep was due at ``now``, which takes the state of all sources."""
        if monitor.week is not None and now - monitor.week > WEEK:
            for (src,), held in list(self.sources.iterator()):
                self._take(monitor, src, held)
        week = monitor.week
        monitor.maintain(now)
        return monitor.week != week

    def _put(self, monitor: Monitor) -> None:
        for src, to in monitor.counts.items():
            watched = [d for d in to if (src, d) in monitor.limits]
            of = [(*monitor.accepted[src, d], *monitor.limits[src, d]) for d in watched]
            self.sources.updateValue((src,), (list(to), list(map(float, to.values())), watched, *[[float(x[i]) for x in of] for i in range(4)]))
        self.clock.update((monitor.week, monitor.month))

    def _wake(self, monitor: Monitor, mark: int) -> None:
        self.handle.registerTimer(max(_ms(monitor.week + WEEK), mark) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, monitor, due, out = timerValues.getCurrentWatermarkInMs(), self._monitor(), False, []
        steps = pd.concat([frame[["time", "src", "dst"]] for frame in rows]).sort_values(["time", "src", "dst"], kind="stable")
        for now, src, dst in steps.loc[steps["time"] >= mark / 1000].itertuples(index=False):
            due |= self._kept(monitor, now)
            if src not in monitor.counts:
                self._take(monitor, src, self.sources.getValue((src,)))
            out.append((*key, now, src, dst, *monitor.step(src, dst)))
        if out:
            self._put(monitor)
        if due:
            self._wake(monitor, mark)
        yield pd.DataFrame(out, columns=["machine", "time", "src", "dst", "prob", "z", "alert"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, monitor = timerValues.getCurrentWatermarkInMs(), self._monitor()
        if self._kept(monitor, mark / 1000):  # else upkeep came with a step, which set a later timer
            self._put(monitor)
            self._wake(monitor, mark)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def watched_by_source(steps: DataFrame, by: str, time: str, late: str) -> DataFrame:
    """The rows of ``streams.watched_updates``, with state kept by source: a batch costs its own sources, not the whole machine.

    Steps (``time``, src, dst) behind the watermark, ``late`` behind the newest,
    don't count; sources and ends of steps must not be null.
    """
    rows = steps.select(F.col(by).cast("string").alias("machine"), F.col(time).alias("at"), "src", "dst").withColumn("time", F.unix_micros("at") / 1e6).withWatermark("at", late)
    return rows.groupBy("machine").transformWithStateInPandas(MachineWatcher(), WATCHED, "Append", "EventTime")
