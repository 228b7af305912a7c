"""Operator 1: near-duplicate embeddings by navigable small-world graphs, one for each shard."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hnsw import Graph
from .shared import discard, materialize

THRESHOLD = 0.98
#: Vectors of a shard; a label with more has several shards of about equal size.
SHARD_ROWS = 8192
#: First beam of a query, queries of each kind that brute force answers too, and the share of their links that the graph must find.
BEAM, AUDITED, RECALL = 24, 96, 0.995
#: Bytes of a row that carries a part of a shard.
CHUNK = 1 << 20
#: Slack for single precision in the graph; pairs are verified in double precision.
SLACK = 1e-4


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Rows link if their labels are equal and not null, their embeddings as long,
    and their cosine in double precision is at least ``threshold``. Embeddings
    that are null, empty, zero or hold null or non-finite components link with
    nothing. ``n_links`` counts the other rows linked directly, ``component_id``
    is the smallest vec_id reachable, itself included. A row that repeats an id
    counts as a row of its own; a row with a null id has itself as component,
    null, and links nothing. Other columns are not read. Empty tables give no rows.

    Equal vectors of a label become one, with its number, before the search. The
    rest is dealt to shards by hash and each shard's graph is built once. Every
    shard is then queried with the vectors of every shard of its label, both
    directions of a pair of shards at once. A query task compares a sample of
    its queries, and made ones that have links for certain, with brute force and
    doubles its beams until the recall holds; where it never does, the task
    compares its queries with every vector of the shard.
    Tasks return sums and one row for each linked vector, never pairs.
    """
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keys = [F.xxhash64(F.lit(s), "label", "embedding").alias(k) for s, k in ((1, "k1"), (2, "k2"))]
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), *keys, F.coalesce(good, F.lit(False)).alias("good"))
    usable = rows.where("good")
    distinct = usable.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("width", F.size("embedding"))
    distinct = materialize(distinct, "vectors")
    shards = materialize(_shards(distinct, shard_rows), "shards")
    found = materialize(_search(shards, threshold), "near")
    links = found.groupBy("rep").agg(F.sum("n_links").alias("others"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of = distinct.select("k1", "k2", "rep", "n").join(links, "rep", "left").join(parts, F.col("rep") == F.col("id"), "left")
    of = of.select("k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = usable.select("vec_id", "k1", "k2").join(of, ["k1", "k2"]).select("vec_id", F.col("n_links").cast("long"), "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _shards(distinct: DataFrame, shard_rows: int) -> DataFrame:
    """label, width, shard, shards, part, octets: the graph of each shard, cut into rows of bounded size."""
    counts = distinct.groupBy("label", "width").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = distinct.join(counts, ["label", "width"]).withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("shards")).cast("int"))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        raw = np.stack(group["embedding"].to_numpy())
        unit = unit_vectors(raw)
        narrow = raw.astype(np.float32)
        octets = pickle.dumps((group["rep"].to_numpy(), group["n"].to_numpy(), narrow if (narrow == raw).all() else raw, Graph(unit).to_bytes()), protocol=5)
        parts = [octets[i : i + CHUNK] for i in range(0, len(octets), CHUNK)]
        return pd.DataFrame({"label": key[0], "width": key[1], "shard": key[2], "shards": int(group["shards"].iloc[0]), "part": range(len(parts)), "octets": parts})

    tasks = 4 * (counts.agg(F.sum("shards")).first()[0] or 1)
    key = ["label", "width", "shard"]
    return dealt.select(*key, "shards", "rep", "n", "embedding").repartition(tasks, *key).groupBy(*key).applyInPandas(build, "label string, width int, shard int, shards int, part int, octets binary")


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    raw = np.asarray(raw, dtype=np.float64)
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _search(shards: DataFrame, threshold: float) -> DataFrame:
    """rep, n_links, root: each vector's linked rows in one pair of shards, and the smallest rep it hangs on there."""
    pairs = shards.withColumn("a", F.explode(F.sequence(F.lit(0), "shard"))).withColumnRenamed("shard", "own").withColumn("b", F.col("own"))
    asked = shards.withColumn("b", F.explode(F.expr("sequence(shard, shards - 1)"))).where("b > shard").withColumnRenamed("shard", "own").withColumn("a", F.col("own"))
    columns = ["label", "width", "a", "b", "own", "part", "octets"]

    def query(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, b = int(key[2]), int(key[3])
        held = {own: pickle.loads(b"".join(g.sort_values("part")["octets"])) for own, g in group.groupby("own")}
        reps, ns, raw, octets = held[b]
        from_reps, from_ns, from_raw, _ = held[a]
        units = unit_vectors(raw)
        return links_of(Graph.from_bytes(octets, units), units, from_reps, from_ns, unit_vectors(from_raw), reps, ns, threshold, same=a == b)

    rows = pairs.select(*columns).unionByName(asked.select(*columns))
    count = shards.where("part = 0").agg(F.sum(F.col("shard") + 1)).first()[0] or 1
    return rows.repartition(int(count), "label", "width", "a", "b").groupBy("label", "width", "a", "b").applyInPandas(query, "rep long, n_links long, root long")


def made_queries(units: np.ndarray, threshold: float, count: int, seed: int = 3) -> np.ndarray:
    """Vectors just above the threshold from as many of ``units``, in seeded directions: queries that have a link for certain."""
    rng = np.random.default_rng(seed)
    of = units[rng.choice(len(units), min(count, len(units)), replace=False)]
    aside = rng.normal(size=of.shape)
    aside -= (aside * of).sum(axis=1, keepdims=True) * of
    length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    near = threshold + 0.1 * (1 - threshold)
    return near * of + np.sqrt(1 - near * near) * np.divide(aside, length, out=np.zeros_like(aside), where=length > 0)


def audited_beam(graph: Graph, units: np.ndarray, queries: np.ndarray, threshold: float, same: bool) -> tuple[int, float]:
    """The beam at which the graph finds RECALL of the links that brute force finds for a sample of queries, and the share it finds.

    The sample holds rows of the table, whose links to themselves don't count,
    and made queries, so there are links to confirm where the table's are rare.
    Beams double, at the latest until they hold the whole shard.
    """
    picked = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    made = made_queries(units, threshold, AUDITED)
    asked = np.concatenate([queries[picked], made])
    own = [*(picked.tolist() if same else [-1] * len(picked)), *[-1] * len(made)]
    true = [set(np.flatnonzero(units @ q >= threshold).tolist()) - {i} for q, i in zip(asked, own, strict=True)]
    beam, wanted = BEAM, sum(map(len, true))
    while True:
        met = sum(len(want.intersection(graph.within(q, threshold - SLACK, beam))) for q, want in zip(asked.astype(np.float32), true, strict=True) if want)
        if met >= RECALL * wanted or beam >= len(units):
            return beam, met / wanted if wanted else 1.0
        beam *= 2


def links_of(graph: Graph, units: np.ndarray, from_reps: np.ndarray, from_ns: np.ndarray, queries: np.ndarray, reps: np.ndarray, ns: np.ndarray, threshold: float, same: bool) -> pd.DataFrame:
    """rep, n_links and root of every vector with a link in a pair of shards; of one shard with itself each pair counts once.

    What a query finds is verified in double precision and goes at once into
    counts and a union-find, so memory follows the vectors and never the links.
    Where no beam passes the audit, each query is compared with the whole shard.
    """
    beam, recall = audited_beam(graph, units, queries, threshold, same)
    narrow = queries.astype(np.float32)
    at = 0 if same else len(queries)
    ids = reps if same else np.concatenate([from_reps, reps])
    links, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

    def roots(nodes: np.ndarray) -> np.ndarray:
        above = parent[nodes]
        while ((up := parent[above]) != above).any():
            above = up
        return above

    for i in range(len(queries)):
        if recall >= RECALL:
            found = np.array(graph.within(narrow[i], threshold - SLACK, beam), dtype=np.int64)
        else:
            found = np.flatnonzero(units @ queries[i] >= threshold)
        if same:
            found = found[found > i]
        if len(found):
            found = found[units[found] @ queries[i] >= threshold]
        if len(found):
            links[i] += ns[found].sum()
            links[found + at] += from_ns[i]
            nodes = np.append(found + at, i)
            tops = np.unique(roots(nodes))
            parent[tops] = parent[nodes] = tops[ids[tops].argmin()]
    linked = np.flatnonzero(links)
    return pd.DataFrame({"rep": ids[linked], "n_links": links[linked], "root": ids[roots(linked)]})
