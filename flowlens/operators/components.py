"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .periodic import checkpointed


def components(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id and component, the smallest id of its links' component, of every id in ``links`` (keys, a, b).

    Each round an id takes the smallest component among its links' ends, and
    then that of the id that this one names, so names jump and rounds grow with
    the logarithm of the longest chain where ids fall along it. Null keys aren't
    linked. A round's minima combine before they are shuffled.
    """
    both = links.select(*keys, "a", "b").unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(links.select(*keys, "a", F.col("a").alias("b")))
    edges = checkpointed(both.unionByName(links.select(*keys, F.col("b").alias("a"), "b")).distinct())
    named = checkpointed(edges.groupBy(*keys, F.col("a").alias("id")).agg(F.min("b").alias("component")))
    while True:
        met = edges.join(named.select(*keys, F.col("id").alias("b"), F.col("component").alias("_c")), [*keys, "b"])
        low = met.groupBy(*keys, F.col("a").alias("id")).agg(F.min("_c").alias("_c"))
        # An id also tells the one it is named after, which hangs whole trees on smaller roots.
        roots = low.join(named, [*keys, "id"]).groupBy(*keys, F.col("component").alias("id")).agg(F.min("_c").alias("_c"))
        best = low.unionByName(roots).groupBy(*keys, "id").agg(F.min("_c").alias("_low"))
        hung = checkpointed(best)
        jumped = hung.join(hung.select(*keys, F.col("id").alias("_low"), F.col("_low").alias("_far")), [*keys, "_low"]).select(*keys, "id", F.least("_low", "_far").alias("component"))
        after = checkpointed(jumped)
        changed = after.join(named.withColumnRenamed("component", "_old"), [*keys, "id"]).where("component <> _old")
        if changed.isEmpty():
            return after
        named = after
