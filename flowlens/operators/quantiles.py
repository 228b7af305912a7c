"""Exact quantiles of groups too large for one task, by counting in ever finer bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .periodic import checkpointed
from .scans import MOST_BROADCAST, _joined

#: Values of a group that one task may gather.
MOST_VALUES = 1_000_000
#: Bins of a round.
BINS = 1024


def exact_quantiles(rows: DataFrame, keys: list[str], x: str, shares: list[float], most: int = MOST_VALUES) -> DataFrame:
    """keys and quantiles, an array with the value of each of ``shares``, between neighbours in proportion as ``percentile`` has it.

    Groups of at most ``most`` values are gathered by Spark's own aggregate. Of
    larger ones the values around each rank are sought: a round counts a group's
    values in ``BINS`` equal parts of what is left of its range, which combines
    before the shuffle, and keeps the part that holds the rank, with the least
    and largest value in it. When it has ``most`` values or fewer, or all are
    equal, they are ranked. Nulls and NaN don't count; groups without values
    have null quantiles.
    """
    value = F.col(x).cast("double")
    kept = rows.select(*keys, F.when(~F.isnan(value), value).alias("_x"))
    sizes = checkpointed(kept.groupBy(*keys).agg(F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where(F.col("_n") > most))
    n_hot = sizes.count()
    plain = lambda df: df.groupBy(*keys).agg(F.percentile("_x", F.array(*[F.lit(float(s)) for s in shares])).alias("quantiles"))
    if not n_hot:
        return plain(kept)
    hot = checkpointed(sizes.select(*keys, F.col("_n").alias("_size")))
    few = _joined(kept, hot.drop("_size"), keys, n_hot, "left_anti")
    many = _joined(kept.where("_x is not null"), hot.drop("_size"), keys, n_hot, "left_semi")
    at = F.array(*[F.struct(F.lit(i).alias("share"), (F.lit(s) * (F.col("_n") - 1)).alias("pos")) for i, s in enumerate(shares)])
    ranks = sizes.withColumn("_t", F.explode(at)).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_t.pos"), F.ceil("_t.pos")))))
    targets = checkpointed(ranks.groupBy(*keys, "_rank").agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_n").alias("_n")).withColumn("_below", F.lit(0).cast("long")))
    interval = [*keys, "_lo", "_hi"]
    while targets.where((F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        # Only values between the limits of some rank are counted; of one group they are at most as many parts as ranks.
        wide = targets.where((F.col("_n") > most) & (F.col("_lo") < F.col("_hi")))
        met = _within(many, wide.select(*interval).distinct(), keys)
        # Halves are subtracted, so that a range wider than the largest double doesn't overflow.
        part = (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bins = met.withColumn("_bin", F.least(F.floor(part * BINS), F.lit(BINS - 1)).cast("int")).groupBy(*interval, "_bin").agg(F.count("*").alias("_m"), F.min("_x").alias("_new_lo"), F.max("_x").alias("_new_hi"))
        bins = bins.withColumn("_before", F.sum("_m").over(Window.partitionBy(*interval).orderBy("_bin")) - F.col("_m"))
        same = " and ".join(f"w.`{c}` <=> b.`{c}`" for c in interval)
        holds = F.expr("w._rank - w._below >= b._before and w._rank - w._below < b._before + b._m")
        found = wide.alias("w").join(bins.alias("b"), F.expr(same) & holds)
        narrowed = found.select(*[F.col(f"w.{k}").alias(k) for k in keys], F.col("w._rank"), F.col("_new_lo").alias("_lo"), F.col("_new_hi").alias("_hi"), F.col("_m").alias("_n"), (F.col("_below") + F.col("_before")).alias("_below"))
        done = targets.where((F.col("_n") <= most) | (F.col("_lo") >= F.col("_hi")))
        targets = checkpointed(narrowed.unionByName(done.select(narrowed.columns)))
    settled = targets.where(F.col("_lo") >= F.col("_hi")).select(*keys, "_rank", F.col("_lo").alias("_v"))
    open_ = targets.where(F.col("_lo") < F.col("_hi"))
    ranked = _within(many, open_.select(*interval).distinct(), keys).withColumn("_place", F.row_number().over(Window.partitionBy(*interval).orderBy("_x")) - 1)
    same = " and ".join(f"o.`{c}` <=> r.`{c}`" for c in interval)
    picked = open_.alias("o").join(ranked.alias("r"), F.expr(same + " and o._rank - o._below = r._place"))
    values = settled.unionByName(picked.select(*[F.col(f"o.{k}").alias(k) for k in keys], F.col("o._rank"), F.col("r._x").alias("_v")))
    by_rank = _joined(values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_by")), hot, keys, n_hot)

    def quantile(s: float):
        pos = F.lit(s) * (F.col("_size") - 1)
        low, high = F.element_at("_by", F.floor(pos)), F.element_at("_by", F.ceil(pos))
        return F.when(F.floor(pos) == F.ceil(pos), low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high)

    return plain(few).unionByName(by_rank.select(*keys, F.array(*[quantile(s) for s in shares]).alias("quantiles")))


def _within(values: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the limits _lo and _hi between which they lie; intervals of a group don't overlap and are few."""
    same = " and ".join(["v._x between i._lo and i._hi", *[f"v.`{k}` <=> i.`{k}`" for k in keys]])
    small = F.broadcast(intervals) if intervals.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else intervals
    return values.alias("v").join(small.alias("i"), F.expr(same)).select("v.*", "i._lo", "i._hi")
