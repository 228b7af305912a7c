"""Operator 8: a mix of sources at target weights, fitted to the word by subset sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, packed, unpacked, with_row_keys
from .words import WORD_PATTERN

WEIGHTS = (3, 1, 2)
#: Budget and cap, as shares of all sizes and of a source's size.
BUDGET, CAP = 1.5, 2.0
#: Largest remaining budget, in words, that dynamic programming fills.
TABLE_WORDS = 1 << 16
#: About how many documents of one source and size are ranked together; which are chosen doesn't depend on it.
RANK_ROWS = 50_000


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """Adds ``name``, the place of each row in a total order from 0, without bringing all rows to one task."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # one row for each partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_at", within).join(before, "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """One row for each source: ``source``, ``source_rank``, ``source_size``, ``target``.

    ``sizes`` has source and size. Sources in code point order, null last, get
    the weights in turn and share ``budget`` times all sizes; a target stops at
    ``cap`` times its source's size and the excess is shared again among the
    rest by weight. Each round of that is one aggregate over the sources.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    stats = ranked(sums, "source_rank", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    stats = materialize(stats.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))), "sources")
    total = budget * (stats.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > F.col("most")
        row = stats.agg(F.count_if(above), F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if row[0] == stopped or not row[2]:
            break
        stopped, level = row[0], (total - row[1]) / row[2]
    target = F.least(F.lit(level) * F.col("weight"), F.col("most"))
    return stats.select("source", "source_rank", "source_size", target.alias("target"))


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below ``budget`` as found.

    Takes the same share of each length first, then single documents, longest
    lengths first, until ``table`` or fewer words remain; a bounded knapsack over
    what is left then fills those.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
    left = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if left <= table:
            break
        if lengths[i] > 0:
            k = min(int(counts[i] - taken[i]), (left - table + int(lengths[i]) - 1) // int(lengths[i]), left // int(lengths[i]))
            taken[i] += k
            left -= k * int(lengths[i])
    reached = np.zeros(left + 1, dtype=bool)
    reached[0] = True
    came_by = np.full(left + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for i in order:
        size, free, k = int(lengths[i]), int(counts[i] - taken[i]), 1
        while size and free > 0 and size <= left and not reached[left]:
            k = min(k, free)
            weight = k * size
            if weight > left:
                break
            fresh = np.flatnonzero(reached[: left + 1 - weight] & ~reached[weight:]) + weight
            came_by[fresh] = len(items)
            reached[fresh] = True
            items.append((int(i), k))
            free, k = free - k, 2 * k
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, k = items[came_by[at]]
        taken[i] += k
        at -= k * int(lengths[i])
    return taken


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``.

    A size is a text's words (null: 0). A document is taken whole, once for each
    time its source's size fits into the target, and the rest of the target is
    filled with documents chosen by a seeded hash among those of equal length,
    as many of each length as ``fill`` says; ``taken`` is size times copies, at
    most twice the size. Sources, null included, are groups of any size. Rows
    that repeat an id count as documents of their own. Documents without words
    take 0. An empty table gives no rows. Reruns agree.
    """
    return _mix(docs, [], weights, budget, cap, seed)


def _mix(docs: DataFrame, keys: list[str], weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = 11) -> DataFrame:
    """``mix`` with the columns ``keys``, which tell rows of equal ids apart."""
    sizes = materialize(docs.select(*keys, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size")), "sizes")
    targets = materialize(source_targets(sizes, weights, budget, cap), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    rows = materialize(sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).select(*keys, "doc_id", "size", "source_rank", "source_size", "target", "whole", "rest"), "rows")
    by_length = rows.groupBy("source_rank", "rest", "size").agg(F.count("*").alias("n"))

    def choose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        picks = fill(group["size"].to_numpy(), group["n"].to_numpy(), int(key[1]))
        return pd.DataFrame({"source_rank": group["source_rank"], "size": group["size"], "n": group["n"], "picks": picks})

    picks = materialize(by_length.groupBy("source_rank", "rest").applyInPandas(choose, "source_rank long, size long, n long, picks long"), "picks")
    order = F.xxhash64(F.lit(seed), "doc_id")
    # slots are ranges of the hash, so the first documents of a length are the same ones however many slots there are
    slots = F.greatest(F.lit(1), F.ceil(F.col("n") / RANK_ROWS))
    dealt = rows.join(picks, ["source_rank", "size"]).withColumn("order", order).withColumn("slot", F.shiftright((F.shiftright("order", 40) + (1 << 23)) * slots, 24))
    group = ["source_rank", "size", "slot"]
    counts = dealt.groupBy(*group).agg(F.count("*").alias("in_slot"))
    before = F.sum("in_slot").over(Window.partitionBy("source_rank", "size").orderBy("slot")) - F.col("in_slot")
    place = F.row_number().over(Window.partitionBy(*group).orderBy("order", "doc_id", *keys))
    chosen = dealt.withColumn("place", place).join(counts.withColumn("before", before), group)
    extra = F.when(F.col("place") + F.col("before") <= F.col("picks"), 1).otherwise(0)
    return chosen.select(*keys, "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + extra)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row of ``docs`` as often as the mix takes it, columns unchanged.

    Every row is a document of its own, also if its id is null or repeats. Rows
    whose documents have no words stay once, as they take nothing from any budget.
    """
    own = ("doc_id", "text", "source")
    keyed = with_row_keys(packed(docs, own), "_row")
    copies = _mix(keyed, ["_row"], **options).select("_row", F.when(F.col("size") > 0, F.expr("cast(taken div size as int)")).otherwise(1).alias("_copies"))
    return unpacked(keyed.join(copies, "_row").where("_copies > 0").withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))), docs, own)
