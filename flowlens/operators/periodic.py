"""Periodic traffic: timing rules, deviation scores and period detection."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def is_on_time(gap: Column, period: Column, slack: float = 1.0, share: float = 0.05) -> Column:
    return (F.abs(gap - period) <= slack) | (F.abs(gap - period) <= share * period)


def timing_labels(rows: DataFrame, keys: list[str], ts: str, tie: str, period: str, cuts: DataFrame | None = None) -> DataFrame:
    """Adds gap and label: 1 for rows that come a period after the last, else -1.

    A row that comes too early by the drift of the last one on time takes its
    predecessor's label away too; a key's first row has -1. ``cuts``, from
    ``scans.hot_cuts`` for the same keys, spreads each large key over many
    tasks; a slice then takes over the last time and drift, and gives back
    whether its first row came early.
    """
    from . import scans

    rows = scans.previous_time(scans.sliced(rows, keys, ts, cuts), keys, ts, tie, cuts).withColumn("gap", F.col(ts) - F.col("_before"))
    rows = rows.withColumn("_on", F.coalesce(is_on_time(F.col("gap"), F.col(period)), F.lit(False)))
    rows = rows.withColumn("_drift", F.when(F.col("_on"), F.col("gap") - F.col(period)))
    at = F.when(F.col("_on"), F.struct(ts, tie))
    rows = scans.carried(rows, keys, cuts, [F.max_by("_drift", at).alias("_d")], lambda table, w: table.withColumn("_carry", F.last("_d", ignorenulls=True).over(scans.before(w))), {"_carry": "double"})
    w = Window.partitionBy(*keys, "_slice").orderBy(ts, tie)
    last = F.coalesce(F.last("_drift", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"), F.lit(0.0))
    rows = rows.withColumn("_early", F.col("gap").isNotNull() & ~F.col("_on") & (F.col("gap") <= 1 - last)).drop("_carry", "_before")
    rows = scans.carried(rows, keys, cuts, [F.min_by("_early", F.struct(ts, tie)).alias("_e")], lambda table, w: table.withColumn("_next", F.lead("_e").over(w)), {"_next": "boolean"})
    label = F.when(F.col("_on") & ~F.coalesce(F.lead("_early").over(w), F.col("_next"), F.lit(False)), 1).otherwise(-1)
    return rows.withColumn("label", label).drop("_on", "_drift", "_early", "_next", "_slice")


def matches_any_period(gap: Column, periods: Column) -> Column:
    """Whether a gap is on time for one of several periods; none, or no gap: false."""
    return F.coalesce(F.exists(periods, lambda p: is_on_time(gap, p)), F.lit(False))


def deviation_score(gap: Column, period: Column) -> Column:
    """ln(1 + share of the period by which a gap is late, or away from the nearest beat)."""
    ratio = F.when(gap >= period, (gap - period) / period).otherwise(F.least(gap, period - gap) / period)
    return F.log1p(ratio)


def binned_signal(rows: DataFrame, keys: list[str], ts: str, width: float, span: list[str]) -> DataFrame:
    """Events in each bin of ``width`` from the first to the last bin of a ``span`` of keys, zeros included."""
    bins = rows.withColumn("bin", F.floor(F.col(ts) / width).cast("long"))
    counts = bins.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    limits = bins.groupBy(*span).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    grid = counts.select(*keys).distinct().join(limits, span).select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("bin"))
    return grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def sparse_periods(rows: DataFrame, keys: list[str], ts: str, low: int = 4, high: int = 6, most: float = 3600.0) -> DataFrame:
    """Mean gap of groups of few distinct times whose gaps change by at most ``most``."""
    w = Window.partitionBy(*keys).orderBy(ts)
    once = rows.select(*keys, ts).distinct()
    gaps = once.withColumn("_gap", F.col(ts) - F.lag(ts).over(w)).withColumn("_turn", F.abs(F.col("_gap") - F.lag("_gap").over(w)))
    out = gaps.groupBy(*keys).agg(F.count("*").alias("n_times"), F.avg("_gap").alias("period"), F.max("_turn").alias("_worst"))
    return out.where(F.col("n_times").between(low, high) & (F.col("_worst") <= most)).drop("_worst")


def find_periods(counts: np.ndarray, width: float, seed: int, shuffles: int = 100, quantile: int = 6, shortest: int = 0) -> list[tuple[float, float]]:
    """Up to two (period, autocorrelation) of a binned signal, the strongest first.

    Frequencies whose strength beats the ``quantile``-th largest peak of
    shuffled signals are candidates, if their period has ``shortest`` bins or
    more and isn't that of the candidate before; each must show as a peak of the
    autocorrelation near its period that exceeds 3.315 / sqrt(n).
    """
    x = np.asarray(counts, dtype=float)
    n = len(x)
    if n < 8 or not x.std():
        return []
    rng = np.random.default_rng(seed)
    strength = np.abs(np.fft.rfft(x))[: n // 2]
    peaks = sorted(np.abs(np.fft.rfft(rng.permutation(x)))[2 : n // 2].max() for _ in range(shuffles))
    candidates: list[int] = []
    for k in np.flatnonzero(strength > peaks[-quantile]):
        if k >= 2 and round(n / k) >= shortest and not (candidates and round(n / k) == round(n / candidates[-1])):
            candidates.append(int(k))
    centred = x - x.mean()
    spectrum = np.abs(np.fft.rfft(centred, 2 * n)) ** 2
    acf = np.fft.irfft(spectrum)[:n]
    acf /= acf[0]
    found: dict[int, float] = {}
    for k in candidates:
        low, high = max(2, n // (k + 1)), min(n - 1, -(-n // (k - 1)))
        lag = low + int(np.argmax(acf[low : high + 1]))
        if acf[lag] >= 3.315 / np.sqrt(n) and acf[lag] >= acf[max(1, lag - 1)] and acf[lag] >= acf[min(n - 1, lag + 1)]:
            found[lag] = float(acf[lag])
    best = sorted(found.items(), key=lambda p: (-p[1], p[0]))[:2]
    return [(lag * width, a) for lag, a in best]


def detect_periods(signal: DataFrame, keys: list[str], width: float, seed: int = 1) -> DataFrame:
    """keys, rank, period, strength of each key's binned signal (columns bin and n).

    A group is one key's signal; its length is bounded by the observed time over
    the bin width. Bins of up to ten minutes are too fine for periods of fewer
    than ten bins.
    """
    shortest = 0 if width > 600 else 10
    schema = ", ".join(f"`{k}` {signal.schema[k].dataType.simpleString()}" for k in keys) + ", rank int, period double, strength double"

    def each(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = find_periods(group.sort_values("bin")["n"].to_numpy(), width, seed, shortest=shortest)
        return pd.DataFrame([(*key, i + 1, p, s) for i, (p, s) in enumerate(found)], columns=[*keys, "rank", "period", "strength"])

    return signal.groupBy(*keys).applyInPandas(each, schema)


def period_evaluation(truth: DataFrame, found: DataFrame, keys: list[str], slack: float = 0.0) -> DataFrame:
    """One row tp, fn, fp, tn of found periods (keys, period) against ``truth`` (keys, true_period; 0 or null: none).

    A key with a period is right if one of its found periods is within ``slack``
    of it; a key without is wrong if it has any.
    """
    rows = truth.join(found.select(*keys, "period"), keys, "left").groupBy(*keys, F.coalesce("true_period", F.lit(0)).alias("t"))
    hit = rows.agg(F.coalesce(F.bool_or(F.abs(F.col("period") - F.col("true_period")) <= slack), F.lit(False)).alias("hit"), (F.count("period") > 0).alias("any"))
    t = F.col("t") != 0
    return hit.agg(F.count_if(t & F.col("hit")).alias("tp"), F.count_if(t & ~F.col("hit")).alias("fn"), F.count_if(~t & F.col("any")).alias("fp"), F.count_if(~t & ~F.col("any")).alias("tn"))


def merge_rates(fine: DataFrame, coarse: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Periods found at two bin widths: the fine one, and the coarse one scaled by ``factor`` unless they are equal."""
    both = fine.select(*keys, F.col("period").alias("period_1")).join(coarse.select(*keys, (F.col("period") * factor).alias("period_2")), keys, "full_outer")
    return both.select(*keys, F.coalesce("period_1", "period_2").alias("period"), F.when(F.col("period_1") != F.col("period_2"), F.col("period_2")).alias("period2"))


def without_periodic(rows: DataFrame, fingerprints: DataFrame, key: list[str], ts: str, tie: str, most_period: float = 7200.0) -> DataFrame:
    """Rows that no fingerprint explains by its timing; fingerprints act in their order.

    ``fingerprints`` has the key, host_pattern, seq and period; those of longer
    periods than ``most_period`` and of DNS and NTP don't act. A row that one
    fingerprint takes is gone for those that follow. Rows need the key, protocol
    and host, and a ``tie``, a long that tells the rows of a key apart.
    """
    from .folds import taken_by_timing

    return rows.join(taken_by_timing(rows, fingerprints, key, ts, tie, most_period).select(*key, tie).distinct(), [*key, tie], "left_anti")


def _shared_folder(rows: DataFrame) -> str:
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.gettempdir() + "/flowlens-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows as read from the folder in spark.checkpoint.dir; where that is unset, as in tests, one of this machine."""
    _shared_folder(rows)
    return rows.checkpoint()


def parted(rows: DataFrame, *by: str) -> DataFrame:
    """The rows as read from a table in that folder with a part for each value of ``by``, so a filter on these reads its own part only."""
    path = f"{_shared_folder(rows)}/parted-{uuid.uuid4().hex}"
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
