"""Lookups in time and by host pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from flowlens.functions import net

from . import scans


def as_of(rows: DataFrame, history: DataFrame, keys: list[str], ts: str, value: str, cuts: DataFrame | None = None) -> DataFrame:
    """Adds ``value`` and ``outcome``: the history's last value at or before the row's time, else the key's first one.

    ``outcome`` is prior, after or blank (key not in the history). Rows and
    history are united and carried forward in one window, so neither side is
    collected nor multiplied, however long a key's history is. Of values at one
    time the largest counts. ``cuts``, from ``scans.hot_cuts`` of the rows for
    the same keys, spreads each large key over many tasks; a slice then takes
    over the last value before it and the key's first one.
    """
    kind = history.schema[value].dataType.simpleString()
    mine = rows.withColumn("_row", F.lit(1)).withColumn("_value", F.lit(None).cast(kind))
    past = history.groupBy(*keys, ts).agg(F.max(value).alias("_value")).withColumn("_row", F.lit(0))
    both = scans.sliced(mine.unionByName(past, allowMissingColumns=True), keys, ts, cuts)
    known = F.when(F.col("_value").isNotNull(), F.col(ts))
    states = [F.max_by("_value", known).alias("_last"), F.min_by("_value", known).alias("_first")]

    def carry(table: DataFrame, w: WindowSpec) -> DataFrame:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return table.withColumns({"_prior": F.last("_last", ignorenulls=True).over(scans.before(w)), "_any": F.first("_first", ignorenulls=True).over(whole)})

    both = scans.carried(both, keys, cuts, states, carry, {"_prior": kind, "_any": kind})
    order = Window.partitionBy(*keys, "_slice").orderBy(ts, "_row")
    prior = F.coalesce(F.last("_value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("_prior"))
    first = F.coalesce(F.col("_any"), F.first("_value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = both.withColumn(value, F.coalesce(prior, first)).withColumn("outcome", F.when(prior.isNotNull(), "prior").when(first.isNotNull(), "after").otherwise("blank"))
    return out.where("_row = 1").drop("_row", "_value", "_prior", "_any", "_slice")


def host_patterns(host: Column) -> Column:
    """Every fingerprint pattern that a host can match: itself, and a wildcard before each of its suffixes."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    wild = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.lit("*."), F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), ".")))
    cloud = F.when(host.rlike(r"\.compute-1\.amazonaws\.com$"), F.array(F.lit(net.CLOUD))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(host), wild, cloud))


def with_aliased_hosts(rows: DataFrame, host: str = "host", device: str = "device") -> DataFrame:
    """Rows whose host is the name that the device's fingerprints use; do this before any match with fingerprints."""
    return rows.withColumn(host, net.aliased_host(F.col(host), F.col(device)))


def match_fingerprints(rows: DataFrame, fingerprints: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows joined to fingerprints of the same ``keys`` whose host_pattern is the host or a wildcard suffix of it.

    Patterns a host can match are listed first, which makes the join an equality
    on all keys instead of a comparison of every row with every fingerprint.
    """
    listed = rows.withColumn("host_pattern", F.explode(host_patterns(F.col("host"))))
    return listed.join(fingerprints, [*keys, "host_pattern"], how)


def unmatched(rows: DataFrame, fingerprints: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, host) of traffic that no fingerprint covers."""
    seen = rows.select(*keys, "host").distinct()
    return seen.join(match_fingerprints(seen, fingerprints, keys).select(*keys, "host").distinct(), [*keys, "host"], "left_anti")


def gone(rows: DataFrame, fingerprints: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprints that no traffic matches."""
    listed = rows.select(*keys, F.explode(host_patterns(F.col("host"))).alias("host_pattern")).distinct()
    return fingerprints.join(listed, [*keys, "host_pattern"], "left_anti")


def without_local(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """Rows whose host is no device of the network (column ``name``) and no name of hardware or multicast; null hosts stay."""
    return rows.where(~net.is_link_host(F.col("host"))).join(devices.select(F.col("name").alias("host")).distinct(), "host", "left_anti")


def complete_windows(rows: DataFrame, fingerprints: DataFrame, window: list[str]) -> DataFrame:
    """(window, activity) where every (host, protocol) of the activity's fingerprint occurs."""
    need = fingerprints.groupBy("activity").agg(F.count_distinct("host", "protocol").alias("needed"))
    met = rows.select(*window, "host", "protocol").distinct().join(fingerprints.select("activity", "host", "protocol").distinct(), ["host", "protocol"])
    return met.groupBy(*window, "activity").agg(F.count("*").alias("met")).join(need, "activity").where("met = needed").select(*window, "activity")


def gated_votes(votes: DataFrame, complete: DataFrame, fingerprints: DataFrame, window: list[str], unknown: str = "unknown") -> DataFrame:
    """Votes (window, voted) whose activity has no fingerprint or a complete one in the window; others become unknown."""
    has = fingerprints.select(F.col("activity").alias("voted")).distinct().withColumn("_needs", F.lit(True))
    met = complete.select(*window, F.col("activity").alias("voted")).withColumn("_met", F.lit(True))
    rows = votes.join(has, "voted", "left").join(met, [*window, "voted"], "left")
    return rows.select(*window, F.when(F.col("_needs") & F.col("_met").isNull(), unknown).otherwise(F.col("voted")).alias("voted"))
