"""Scans in order of time over keys too large for one task: such a key is cut in slices, and a small table carries states between them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .periodic import checkpointed

#: Rows of a key that one task still sorts.
MOST_ROWS = 1_000_000
#: Slices of a key; beyond MOST_ROWS times this many rows, slices grow.
MOST_SLICES = 1000
#: Rows up to which the table of cuts, or of carried states, is broadcast; it is counted first, and joined by key beyond.
MOST_BROADCAST = 100_000


def hot_cuts(rows: DataFrame, keys: list[str], ts: str, most: int = MOST_ROWS) -> DataFrame | None:
    """keys and _cuts, the times between the slices, of every key with more than ``most`` rows; None if there is none.

    Counting combines before its shuffle; cuts are approximate quantiles of the
    key's own times, so slices have about ``most`` rows however times bunch.
    Rows of one time aren't cut apart.
    """
    hot = checkpointed(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most))
    largest, n_keys = hot.agg(F.max("_n"), F.count("*")).first()
    if not n_keys:
        return None
    slices = min(-(-largest // most), MOST_SLICES)
    mine = _joined(rows, hot.drop("_n"), keys, n_keys, "left_semi")
    return checkpointed(mine.groupBy(*keys).agg(F.percentile_approx(ts, [i / slices for i in range(1, slices)], max(10_000, 20 * slices)).alias("_cuts")))


def _joined(rows: DataFrame, small: DataFrame, on: list[str], n: int, how: str = "left") -> DataFrame:
    """``rows`` joined to ``small`` of ``n`` rows on columns that may be null."""
    other = small.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return rows.join(F.broadcast(other) if n <= MOST_BROADCAST else other, same, how).drop(*[f"_on_{c}" for c in on])


def sliced(rows: DataFrame, keys: list[str], ts: str, cuts: DataFrame | None) -> DataFrame:
    """Adds _slice: -1 for keys without cuts, else the slice of the row's time, from 0; times grow from slice to slice."""
    if cuts is None:
        return rows.withColumn("_slice", F.lit(-1))
    placed = _joined(rows, cuts, keys, cuts.count())
    # By halves: a look at each cut would cost rows times slices, and slices grow with rows.
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(MOST_SLICES.bit_length()))])
    cut = lambda n: F.get("_cuts", n - 1)
    below = F.aggregate(halves, F.lit(0), lambda n, step: F.when(cut(n + step) < F.col(ts), n + step).otherwise(n))
    return placed.withColumn("_slice", F.when(F.col("_cuts").isNull(), -1).otherwise(below)).drop("_cuts")


def dealt(rows: DataFrame, keys: list[str], cuts: DataFrame | None, slices: int = 5) -> DataFrame:
    """Sliced rows in about ``slices`` slices a task, however many tasks that takes, so a task's memory doesn't follow the rows."""
    if cuts is None:
        return rows
    n = cuts.agg(F.sum(F.size("_cuts") + 1)).first()[0]
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // slices)), *keys, "_slice")


def carried(rows: DataFrame, keys: list[str], cuts: DataFrame | None, states: list[Column], carry: Callable[[DataFrame, WindowSpec], DataFrame], empty: dict[str, str]) -> DataFrame:
    """Adds to each row of a sliced key what its slice takes over from the key's others, null for other keys.

    ``states`` sums up a slice in one row; ``carry`` adds the columns of
    ``empty``, given there with their types, to those rows by a window that has
    the slices of a key in order.
    """
    if cuts is None:
        return rows.withColumns({name: F.lit(None).cast(kind) for name, kind in empty.items()})
    table = rows.where("_slice >= 0").groupBy(*keys, "_slice").agg(*states)
    table = checkpointed(carry(table, Window.partitionBy(*keys).orderBy("_slice")).select(*keys, "_slice", *empty))
    return _joined(rows, table, [*keys, "_slice"], table.count())


def before(w: WindowSpec) -> WindowSpec:
    """The slices before a row's own."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def previous_time(rows: DataFrame, keys: list[str], ts: str, tie: str, cuts: DataFrame | None, name: str = "_before") -> DataFrame:
    """Adds the time of the row before in order of a key, over the borders of slices; ``rows`` are sliced."""
    rows = carried(rows, keys, cuts, [F.max(ts).alias("_t")], lambda table, w: table.withColumn("_carry", F.max("_t").over(before(w))), {"_carry": rows.schema[ts].dataType.simpleString()})
    w = Window.partitionBy(*keys, "_slice").orderBy(ts, tie)
    return rows.withColumn(name, F.coalesce(F.lag(ts).over(w), F.col("_carry"))).drop("_carry")
