"""The incremental forms of sessions, windows and state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from flowlens.operators import machine, monitor


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Closed sessions of a stream; events later than ``late`` behind the newest are dropped."""
    rows = events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n_events"))
    return rows.select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n_events")


def counts_by_window(events: DataFrame, keys: list[str], time: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Events in tumbling or sliding windows of a stream."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    rows = events.withWatermark(time, late).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n_events"))
    return rows.select(*keys, F.col("w.start").alias("start"), "n_events")


def machine_updates(steps: DataFrame, by: str) -> DataFrame:
    """Counts, shares and alerts of each machine's steps (src, dst) as they arrive; state follows the steps seen."""
    return steps.groupBy(F.col(by).alias("machine")).applyInPandasWithState(machine.update_stream, machine.UPDATE, machine.STATE, "update", GroupStateTimeout.NoTimeout)


def watched_updates(steps: DataFrame, by: str, time: str, late: str) -> DataFrame:
    """Share, z and alert of each machine's steps (``time``, src, dst) as they arrive, with upkeep every week and every fourth.

    Upkeep follows event time: machines that have steps are kept before the next
    one, others by a timer once the watermark, ``late`` behind the newest step,
    has passed the week. Later steps don't count.
    """
    seconds = (F.unix_micros("at") / 1e6).alias("time")
    rows = steps.select(F.col(by).alias("machine"), F.col(time).alias("at"), "src", "dst").withWatermark("at", late).select("machine", "at", seconds, "src", "dst")
    return rows.groupBy("machine").applyInPandasWithState(monitor.watch_stream, monitor.WATCHED, monitor.MONITOR, "append", GroupStateTimeout.EventTimeTimeout)
