"""Destinations by party, roll-ups, distributions and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .periodic import checkpointed

PARTIES = {1: "first", 2: "support", 3: "third"}


def party(org: Column, first_parties: Column, support: list[str]) -> Column:
    """1 if the organisation names one of the device's own, 2 if it names a supporting one, else 3; null organisations: 3."""
    name = F.lower(F.coalesce(org, F.lit("")))
    own = F.coalesce(F.exists(first_parties, lambda o: F.contains(name, F.lower(o))), F.lit(False))
    helps = F.lit(False)
    for s in support:
        helps = helps | name.contains(s)
    return F.when(own, 1).when(helps, 2).otherwise(3)


def party_counts(rows: DataFrame, keys: list[str], party: str = "party") -> DataFrame:
    """Rows of each party and in all, for each key; zeros for parties without any."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(party) == p).alias(name) for p, name in PARTIES.items()], F.count("*").alias("total"))


def category_totals(counts: DataFrame, category: str) -> DataFrame:
    """Sums by category, and a row Total over all."""
    cols = [*PARTIES.values(), "total"]
    sums = counts.rollup(category).agg(*[F.sum(c).alias(c) for c in cols], F.grouping(category).alias("_all"))
    return sums.withColumn(category, F.when(F.col("_all") == 1, "Total").otherwise(F.col(category))).drop("_all")


def outer_sum(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sums of two tables by key; what one side lacks counts 0."""
    x = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns])
    y = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    return x.join(y, keys, "full_outer").select(*keys, *[(F.coalesce(f"_a_{c}", F.lit(0)) + F.coalesce(f"_b_{c}", F.lit(0))).alias(c) for c in columns])


def empirical_cdf(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """value, n and cdf: the share of rows at or below each distinct value."""
    counts = rows.groupBy(*(by or []), value).agg(F.count("*").alias("n"))
    if not by:
        n_all = rows.agg(F.count("*")).first()[0]
        return ranked(counts, [F.col(value).asc()], "n", "_upto").withColumn("cdf", F.col("_upto") / F.lit(n_all)).drop("_upto")
    w = Window.partitionBy(*by)
    return counts.withColumn("cdf", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w))


def ranked(counts: DataFrame, order: list[Column], value: str, total: str) -> DataFrame:
    """Adds ``total``, the sum of ``value`` over all rows up to this one in ``order``, which must tell rows apart.

    Rows are dealt to partitions by range; each sums its own, and adds the sums
    of the partitions before, of which there are as many as partitions.
    """
    parts = checkpointed(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(before, "_part").withColumn(total, within + F.col("_before")).drop("_part", "_before")


def shares(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as per cent of their sum; all zero gives zeros."""
    total = sum((F.col(c) for c in columns), F.lit(0))
    return rows.withColumns({f"{c}_percent": F.coalesce(F.try_divide(F.col(c) * 100.0, total), F.lit(0.0)) for c in columns})


def classification_metrics(rows: DataFrame, truth: str, predicted: str, by: list[str]) -> DataFrame:
    """Counts, precision, recall, F1 and error rates of a binary prediction; 0 where there is nothing to divide by."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    out = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"precision": over("tp", tp + fp), "recall": over("tp", tp + fn), "f1": F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)), "fpr": over("fp", fp + tn), "fnr": over("fn", fn + tp)})


def averaged_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: micro F1, and precision, recall and F1 averaged over the labels that are true somewhere.

    Pairs of labels are counted first, so only their table is read again for each label.
    """
    pairs = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("side")), F.struct(F.col("p").alias("label"), F.lit("p").alias("side")))).alias("s"), "t", "p", "n")
    on = lambda side: F.sum(F.when(F.col("s.side") == side, F.col("n")).otherwise(0))
    tp = F.sum(F.when((F.col("s.side") == "t") & (F.col("t") == F.col("p")), F.col("n")).otherwise(0))
    by = sides.groupBy("s.label").agg(tp.alias("tp"), on("t").alias("true"), on("p").alias("made")).where(F.col("true") > 0)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return by.agg(share(F.sum("tp"), F.sum("true")).alias("micro_f1"), F.avg(share(F.col("tp"), F.col("made"))).alias("macro_precision"), F.avg(share(F.col("tp"), F.col("true"))).alias("macro_recall"), F.avg(share(2.0 * F.col("tp"), F.col("true") + F.col("made"))).alias("macro_f1"))


def event_recall(rows: DataFrame, event: str, truth: str, predicted: str, by: list[str]) -> DataFrame:
    """Share of events of which at least one flow has the right label."""
    hit = rows.groupBy(*by, event).agg(F.max((F.col(truth) == F.col(predicted)).cast("int")).alias("_hit"))
    return hit.groupBy(*by).agg(F.count("*").alias("events"), F.sum("_hit").alias("hit"), F.avg("_hit").alias("recall"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def fingerprint_support(rows: DataFrame, keys: list[str], event: str, high: float = 0.9, low: float = 0.8) -> DataFrame:
    """(activity, host, protocol) with the share of the activity's events they occur in.

    Pairs of at least ``high`` stay; an activity without any keeps those of at
    least ``low``.
    """
    events = rows.groupBy("activity").agg(F.count_distinct(*keys, event).alias("n_events"))
    pairs = rows.groupBy("activity", "host", "protocol").agg(F.count_distinct(*keys, event).alias("n_with"))
    ratio = pairs.join(events, "activity").withColumn("support", F.col("n_with") / F.col("n_events"))
    best = F.max("support").over(Window.partitionBy("activity"))
    return ratio.withColumn("_best", best).where((F.col("support") >= high) | ((F.col("_best") < high) & (F.col("support") >= low))).drop("_best")
