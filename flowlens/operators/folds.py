"""Rules that carry a state from row to row in time order."""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from . import scans
from .lookups import host_patterns
from .models import assign_clusters
from .periodic import checkpointed, deviation_score


def fold_in_order(rows: DataFrame, keys: list[str], order: list[str], reads: list[str], start: Callable, step: Callable, added: str) -> DataFrame:
    """Adds the columns of the DDL ``added``, made by ``step(state, *reads) -> (state, values)`` in order of each key.

    Rows are dealt by key, sorted, and stream through a task in batches with one
    state, so memory doesn't follow the length of a key. ``start()`` makes the
    state of a key's first row. Null keys are a key of their own.
    """
    new = StructType.fromDDL(added)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            made = []
            for key, *values in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_key", *reads)], strict=True):
                if key != held:
                    held, state = key, start()
                state, out = step(state, *values)
                made.append(out)
            columns = [pa.array([m[i] for m in made], to_arrow_type(f.dataType)) for i, f in enumerate(new)]
            kept = [i for i, n in enumerate(batch.schema.names) if n != "_key"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *columns], names=[*[batch.schema.names[i] for i in kept], *new.names])

    dealt = rows.withColumn("_key", F.to_json(F.struct(*keys))).repartition("_key").sortWithinPartitions("_key", *order)
    return dealt.mapInArrow(each, StructType([*rows.schema.fields, *new.fields]))


def anchored_windows(events: DataFrame, keys: list[str], seconds: str, tie: str, length: int) -> DataFrame:
    """Adds window: a first event opens one that holds all events to floor(its time) + ``length``; the next event opens another."""

    def step(state: tuple, t: float) -> tuple:
        bound, window = state
        if window < 0 or t > bound:
            bound, window = t // 1 + length, window + 1
        return (bound, window), (window,)

    return fold_in_order(events, keys, [seconds, tie], [seconds], lambda: (0.0, -1), step, "window long")


def timing_labels_of_several(rows: DataFrame, keys: list[str], ts: str, tie: str, period: str, others: str) -> DataFrame:
    """Adds gap and label like ``timing_labels``, for hosts with ``others``, an array of further periods.

    A row that misses the main period and doesn't come early by the last drift
    may be on time for another period, whose drift then counts. That makes each
    row's rule depend on the one before, so it is a fold.
    """

    def on_time(gap: float, p: float) -> bool:
        return abs(gap - p) <= max(1.0, 0.05 * p)

    def step(state: tuple | None, t: float, p: float, more: list[float] | None) -> tuple:
        if state is None:
            return (t, 0.0), (None, False, False)
        gap, drift = t - state[0], state[1]
        if on_time(gap, p):
            return (t, gap - p), (gap, True, False)
        if gap <= 1 - drift:
            return (t, drift), (gap, False, True)
        for q in more or []:
            if on_time(gap, q):
                return (t, gap - q), (gap, True, False)
        return (t, drift), (gap, False, False)

    rows = rows.withColumns({period: F.col(period).cast("double"), others: F.col(others).cast("array<double>")})
    out = fold_in_order(rows, keys, [ts, tie], [ts, period, others], lambda: None, step, "gap double, _on boolean, _early boolean")
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    label = F.when(F.col("_on") & ~F.coalesce(F.lead("_early").over(w), F.lit(False)), 1).otherwise(-1)
    return out.withColumn("label", label).drop("_on", "_early")


def switching_periods(rows: DataFrame, keys: list[str], ts: str, tie: str, period: str, others: str) -> DataFrame:
    """Adds gap, current (the period that holds at a row) and score.

    A gap over the current period by more than a second switches to the first
    of ``others`` that it meets within a second or lies below. The score is
    taken against the period after that switch; a key's first row has none.
    """

    def step(state: tuple | None, t: float, p: float, more: list[float] | None) -> tuple:
        if state is None:
            return (t, p), (None, p)
        gap, now = t - state[0], state[1]
        if gap > now + 1:
            now = next((q for q in more or [] if abs(gap - q) <= 1 or gap <= q), now)
        return (t, now), (gap, now)

    rows = rows.withColumns({period: F.col(period).cast("double"), others: F.col(others).cast("array<double>")})
    out = fold_in_order(rows, keys, [ts, tie], [ts, period, others], lambda: None, step, "gap double, current double")
    return out.withColumn("score", deviation_score(F.col("gap"), F.col("current")))


def anchored_windows_by_jumps(events: DataFrame, keys: list[str], seconds: str, tie: str, length: int, cuts: DataFrame | None = None) -> DataFrame:
    """The rows of ``anchored_windows`` for keys too long for one task; ``length`` is at least 1.

    Which event opens the next window depends on the second of the one that
    opened this one alone, so each second gets a pointer to it. Pointers double
    every round, and the seconds reached from a key's first event double with
    them, so the rounds are the logarithm of the number of windows. Windows are
    then numbered by counting openers. ``cuts``, from ``scans.hot_cuts`` for the
    same keys and time, spreads each large key over many tasks in the two scans.
    """
    if length < 1:
        raise ValueError("windows last a second at least")
    key = F.to_json(F.struct(*keys)).alias("_key")
    cuts = None if cuts is None else cuts.select(key, "_cuts")
    events = events.withColumn("_key", key)
    times = events.select("_key", F.col(seconds).cast("double").alias("_t")).distinct()
    probes = times.select("_key", (F.floor("_t") + length).cast("double").alias("_t"), F.floor("_t").alias("_s")).distinct()
    both = scans.sliced(times.withColumn("_s", F.lit(None).cast("long")).unionByName(probes), ["_key"], "_t", cuts)
    time = F.when(F.col("_s").isNull(), F.col("_t"))
    after = lambda table, w: table.withColumn("_later", F.min("_m").over(w.rowsBetween(1, Window.unboundedFollowing)))
    both = scans.carried(both, ["_key"], cuts, [F.min(time).alias("_m")], after, {"_later": "double"})
    # From the latest on, with a probe before an event of its own time, what was seen last is what comes next.
    back = Window.partitionBy("_key", "_slice").orderBy(F.col("_t").desc(), F.col("_s").isNull())
    upcoming = F.coalesce(F.last(time, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.col("_later"))
    pointers = checkpointed(both.withColumn("_next", upcoming).where("_s is not null and _next is not null").select("_key", "_s", "_next"))
    first = checkpointed(times.groupBy("_key").agg(F.min("_t").alias("_t")))
    reached = checkpointed(first.select("_key", F.floor("_t").alias("_s")))
    jumps = pointers.select("_key", "_s", F.floor("_next").alias("_to"))
    while True:
        new = checkpointed(reached.join(jumps, ["_key", "_s"]).select("_key", F.col("_to").alias("_s")))
        if new.isEmpty():
            break
        reached = checkpointed(reached.unionByName(new))
        jumps = checkpointed(jumps.join(jumps.select("_key", F.col("_s").alias("_to"), F.col("_to").alias("_far")), ["_key", "_to"]).select("_key", "_s", F.col("_far").alias("_to")))
    openers = first.unionByName(reached.join(pointers, ["_key", "_s"]).select("_key", F.col("_next").alias("_t"))).withColumn("_open", F.lit(1))
    rows = events.withColumns({"_t": F.col(seconds).cast("double"), "_open": F.lit(0)}).unionByName(openers, allowMissingColumns=True)
    rows = scans.sliced(rows, ["_key"], "_t", cuts)
    so_far = lambda table, w: table.withColumn("_count", F.sum("_n").over(scans.before(w)))
    rows = scans.carried(rows, ["_key"], cuts, [F.sum("_open").alias("_n")], so_far, {"_count": "long"})
    order = Window.partitionBy("_key", "_slice").orderBy("_t", F.col("_open").desc())
    opened = F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_count", F.lit(0)) - 1
    out = rows.withColumn("window", opened.cast("long")).where("_open = 0")
    return out.drop("_key", "_t", "_open", "_slice", "_count")


class _Rule:
    """One fingerprint of a key: the last time and drift of its rows, and rows that wait for the next one."""

    def __init__(self):
        self.last, self.drift, self.queue = None, 0.0, deque()


class OrderedRules:
    """The timing rules of one key in order, each fed with the rows that those before it leave.

    Whether a row that is on time leaves depends on the next row of its rule,
    which takes the label away if it comes early. Until that row, or a time at
    which none could come early any more, the row waits, and later ones behind
    it, so every rule sees its rows in order of time.
    """

    def __init__(self, taken: Callable[[object, int], None]):
        self.taken, self.order, self.rules = taken, [], {}

    def feed(self, t: float, row: object, periods: dict[int, float]) -> None:
        for place in periods:
            if place not in self.rules:
                self.rules[place] = _Rule()
                insort(self.order, place)
        self._push(0, (t, row, periods))

    def close(self) -> None:
        for i, place in enumerate(self.order):
            if self.rules[place].queue:
                self._settle(i, place, True)

    def _settle(self, i: int, place: int, leaves: bool) -> None:
        queue = self.rules[place].queue
        waiting, self.rules[place].queue = list(queue), deque()
        if leaves:
            self.taken(waiting[0][1], place)
        for row in waiting[1:] if leaves else waiting:
            self._push(i + 1, row)

    def _push(self, i: int, row: tuple) -> None:
        for at in range(i, len(self.order)):
            place = self.order[at]
            rule, t, mine = self.rules[place], row[0], place in row[2]
            if mine:
                period, gap = row[2][place], None if rule.last is None else t - rule.last
                on = gap is not None and (abs(gap - period) <= 1.0 or abs(gap - period) <= 0.05 * period)
                if rule.queue:
                    self._settle(at, place, on or gap > 1 - rule.drift)
                rule.last = t
                if on:
                    rule.drift = gap - period
                    rule.queue.append(row)
                    return
            elif rule.queue:
                if t - rule.queue[0][0] <= 1 - rule.drift:
                    rule.queue.append(row)
                    return
                self._settle(at, place, True)


def taken_by_timing(rows: DataFrame, fingerprints: DataFrame, key: list[str], ts: str, tie: str, most_period: float = 7200.0) -> DataFrame:
    """key, tie and host_pattern of the rows that ``periodic.without_periodic`` drops, in one pass however many fingerprints there are.

    A row lists the fingerprints that its host matches, and the rows of a key
    stream through one task in order of time with one state a fingerprint.
    Memory is that of the rows within about a second, or a drift, of each other.
    """
    order = Window.partitionBy(*key).orderBy("seq", "host_pattern", "period")
    acting = fingerprints.where((F.col("period") <= most_period) & ~F.col("protocol").isin("DNS", "NTP"))
    acting = acting.select(*key, "host_pattern", F.col("period").cast("double").alias("_period"), F.row_number().over(order).alias("_place"))
    met = rows.select(*key, F.col(ts).cast("double").alias("_t"), F.col(tie).cast("long").alias("_tie"), F.explode(host_patterns(F.col("host"))).alias("host_pattern"))
    met = met.join(acting, [*key, "host_pattern"]).select(F.to_json(F.struct(*key)).alias("_key"), "_t", "_tie", "_place", "_period")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, rules = None, None, None
        out: list[tuple] = []

        def fed() -> None:
            if now is not None:
                rules.feed(*now)

        for batch in batches:
            for k, t, row, place, period in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != held:
                    fed()
                    if rules:
                        rules.close()
                    held, now = k, None
                    rules = OrderedRules(lambda row, place, k=k: out.append((k, row, place)))
                if now is None or now[1] != row:
                    fed()
                    now = (t, row, {})
                now[2][place] = period
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["_key", "_tie", "_place"])
                out.clear()
        fed()
        if rules:
            rules.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["_key", "_tie", "_place"])

    taken = met.repartition("_key").sortWithinPartitions("_key", "_t", "_tie", "_place").mapInArrow(each, "_key string, _tie long, _place long")
    named = acting.select(F.to_json(F.struct(*key)).alias("_key"), F.col("_place").cast("long"), *key, "host_pattern")
    return taken.join(named, ["_key", "_place"]).select(*key, F.col("_tie").alias(tie), "host_pattern")


def filtered_rows(rows: DataFrame, fingerprints: DataFrame, cores: DataFrame, key: list[str], ts: str, tie: str, features: list[str], eps: float = 5.0) -> DataFrame:
    """Adds taken_by (a host_pattern) and how: timing or cluster for the rows that fingerprints explain, null for those that stay.

    Timing rules act first, in order, each on what those before it left; rows
    that stay go if they are nearer than ``eps`` to a core of a fingerprint that
    their host matches, of several patterns the first by name. ``cores`` has the
    key, host_pattern, core, cluster and point. ``tie`` tells the rows of a key apart.
    """
    timed = taken_by_timing(rows, fingerprints, key, ts, tie).withColumnRenamed("host_pattern", "_timed")
    rows = checkpointed(rows.join(timed, [*key, tie], "left"))
    listed = rows.where("_timed is null").select(*key, tie, *features, F.explode(host_patterns(F.col("host"))).alias("host_pattern"))
    near = assign_clusters(listed.join(cores.select(*key, "host_pattern").distinct(), [*key, "host_pattern"]), cores, [*key, "host_pattern"], features, eps)
    near = near.where("cluster >= 0").groupBy(*key, tie).agg(F.min("host_pattern").alias("_near"))
    out = rows.join(near, [*key, tie], "left")
    how = F.when(F.col("_timed").isNotNull(), "timing").when(F.col("_near").isNotNull(), "cluster")
    return out.withColumns({"taken_by": F.coalesce("_timed", "_near"), "how": how}).drop("_timed", "_near")
