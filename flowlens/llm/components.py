"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every id that has a link.

    ``links`` has long columns ``a`` and ``b``; direction, repeats, loops and
    nulls don't matter. Returns ``id`` and ``component``; ids without a link to
    another are absent, and an empty table gives an empty one.

    Alternates the large-star and small-star steps, which hang every id on the
    smallest id near it. Each step is a grouped minimum, which Spark combines
    before the shuffle, and a join back, whose hot ids adaptive execution can
    split; rounds grow with the logarithm of the longest chain. Every round is
    written to the shared folder.
    """
    edges = materialize(_oriented(links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))), "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = _oriented(large)
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = materialize(_oriented(small.unionByName(low.select("u", F.col("low").alias("v")))), "links")
        state = _state(after)
        discard(edges)
        edges = after
        if state == before:
            break
        before = state
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller id."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of links: their number and two sums of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)") - F.col("v").cast("decimal(38,0)"))).first())
