"""Activity traces: splitting, paths, folds and changes made for tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from . import scans

TERMINAL = "TERMINAL"
INITIAL = "INITIAL"


def split_traces(events: DataFrame, keys: list[str], ts: str, tie: str, gap: float, cuts: DataFrame | None = None) -> DataFrame:
    """Adds trace (from 0 in each key), pos (from 0 in the trace) and rel_ts; a trace ends where a gap exceeds ``gap``.

    ``cuts``, from ``scans.hot_cuts`` for the same keys, spreads each large key
    over many tasks, also where it is one trace; a slice then takes over the
    traces before it, and the start and rows of the one that is open.
    """
    rows = scans.previous_time(scans.sliced(events, keys, ts, cuts).transform(lambda df: scans.dealt(df, keys, cuts)), keys, ts, tie, cuts)
    rows = rows.withColumn("_opens", F.coalesce((F.col(ts) - F.col("_before") > gap).cast("int"), F.lit(0)))
    rows = rows.withColumn("_in", F.sum("_opens").over(Window.partitionBy(*keys, "_slice").orderBy(ts, tie)).cast("long")).drop("_opens", "_before")
    part = Window.partitionBy(*keys, "_slice", "_in")
    rows = rows.withColumns({"_at": F.row_number().over(part.orderBy(ts, tie)).cast("long"), "_start": F.min(ts).over(part)})

    def carry(table: DataFrame, w: WindowSpec) -> DataFrame:
        table = table.select("*", F.sum("_z._in").over(scans.before(w)).alias("_traces"), F.sum((F.col("_z._in") > 0).cast("int")).over(w).alias("_g"))
        g = Window.partitionBy(*keys, "_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
        table = table.select("*", F.sum("_z._at").over(g).alias("_held"), F.min("_z._start").over(g).alias("_from"))
        return table.select("*", F.lag("_held").over(w).alias("_rows"), F.lag("_from").over(w).alias("_since"))

    states = [F.max_by(F.struct("_in", "_at", "_start"), F.struct(ts, tie)).alias("_z")]
    rows = scans.carried(rows, keys, cuts, states, carry, {"_traces": "long", "_rows": "long", "_since": events.schema[ts].dataType.simpleString()})
    goes_on = F.col("_in") == 0
    pos = F.col("_at") - 1 + F.when(goes_on, F.coalesce("_rows", F.lit(0))).otherwise(0)
    start = F.when(goes_on, F.coalesce("_since", "_start")).otherwise(F.col("_start"))
    rows = rows.withColumns({"trace": F.col("_in") + F.coalesce("_traces", F.lit(0)), "pos": pos.cast("long"), "rel_ts": F.col(ts) - start})
    return rows.drop("_slice", "_in", "_at", "_start", "_traces", "_rows", "_since")


def session_counts(events: DataFrame, keys: list[str], time: str, gap: str) -> DataFrame:
    """Events of each session, by Spark's session window; the same call works on a stream with a watermark."""
    return events.groupBy(*keys, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n_events")).select(*keys, F.col("session.start").alias("start"), "n_events")


def paths(traces: DataFrame, keys: list[str], pos: str, event: str) -> DataFrame:
    """One row for each trace: its events in order, with the terminal one, as an array."""
    events = F.transform(F.sort_array(F.collect_list(F.struct(pos, event))), lambda x: x[event])
    return traces.groupBy(*keys).agg(F.array_append(events, F.lit(TERMINAL)).alias("path"))


def transitions(traces: DataFrame, keys: list[str], pos: str, event: str) -> DataFrame:
    """(keys, pos, src, dst) of every step, from the initial to the terminal state."""
    w = Window.partitionBy(*keys).orderBy(pos)
    steps = traces.select(*keys, F.col(pos).alias("pos"), F.col(event).alias("src"), F.coalesce(F.lead(event).over(w), F.lit(TERMINAL)).alias("dst"))
    first = traces.withColumn("_first", F.row_number().over(w) == 1).where("_first").select(*keys, F.lit(-1).cast("long").alias("pos"), F.lit(INITIAL).alias("src"), F.col(event).alias("dst"))
    return steps.withColumn("pos", F.col("pos").cast("long")).unionByName(first)


def vote(rows: DataFrame, window: list[str], label: str, score: str, pos: str, unknown: str = "unknown") -> DataFrame:
    """Each window's most frequent label, unknown ones aside: ties go to the larger best score, then to the first."""
    known = rows.where(F.col(label) != unknown)
    tally = known.groupBy(*window, label).agg(F.count("*").alias("n"), F.max(score).alias("_best"), F.min(pos).alias("_first"))
    won = tally.groupBy(*window).agg(F.max_by(label, F.struct("n", "_best", -F.col("_first"))).alias("voted"))
    return rows.select(*window).distinct().join(won, window, "left").withColumn("voted", F.coalesce("voted", F.lit(unknown)))


def duplicated(traces: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` + 1 times, told apart by copy."""
    return traces.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times))))


def mutated(path: Column, key: Column, events: list[str], kind: str) -> Column:
    """A path with one event inserted, altered or removed at a place chosen by a hash of the key."""
    n = F.size(path)
    at = F.pmod(F.crc32(key.cast("string")), F.greatest(n, F.lit(1))).cast("int")
    event = F.get(F.array(*[F.lit(e) for e in events]), F.pmod(F.crc32(F.concat(F.lit("e"), key.cast("string"))), F.lit(len(events))).cast("int"))
    head, tail = F.slice(path, F.lit(1), at), F.slice(path, at + 1, n)
    if kind == "insert":
        return F.concat(head, F.array(event), tail)
    rest = F.slice(path, at + 2, n)
    return F.concat(head, F.array(event), rest) if kind == "alter" else F.concat(head, rest)
