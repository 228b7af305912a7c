"""Scaling, density clustering and activity classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.functions import net

from .periodic import checkpointed, parted


def fit_scaler(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """One row for each key: mean and population deviation of every feature."""
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in features], *[F.stddev_pop(c).alias(f"std_{c}") for c in features])


def scale(rows: DataFrame, scaler: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Features less their mean, over their deviation; one without deviation is only shifted. Nulls become -1 first."""
    out = rows.na.fill(-1, features).join(scaler, keys)
    return out.select(*[c for c in rows.columns if c not in features], *[((F.col(c) - F.col(f"mean_{c}")) / F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(1.0)).alias(c) for c in features])


def _near(points: np.ndarray, others: np.ndarray, eps: float, block: int = 1 << 22) -> Iterator[tuple[slice, np.ndarray]]:
    """For blocks of ``points`` which of the others are within ``eps``, so memory doesn't follow the product of their numbers."""
    step = max(1, block // max(1, others.size))
    for at in range(0, len(points), step):
        part = points[at : at + step]
        yield slice(at, at + len(part)), np.sqrt(((part[:, None] - others[None]) ** 2).sum(2)) <= eps


def density_clusters(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    """DBSCAN labels from 0 in order of the first core point, -1 for noise; border points join the first cluster that reaches them."""
    return _labels_and_cores(points, eps, least)[0]


def _labels_and_cores(points: np.ndarray, eps: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(points)
    near = [row for _, hits in _near(points, points, eps) for row in map(np.flatnonzero, hits)]
    core = np.array([len(x) >= least for x in near], bool)
    labels, current = np.full(n, -1), 0
    for i in range(n):
        if labels[i] >= 0 or not core[i]:
            continue
        labels[i], todo = current, [i]
        while todo:
            j = todo.pop()
            if core[j]:
                fresh = near[j][labels[near[j]] < 0]
                labels[fresh] = current
                todo.extend(fresh.tolist())
        current += 1
    return labels, core


def fit_clusters(rows: DataFrame, keys: list[str], features: list[str], order: str, eps: float = 5.0, least: int = 5, most: int = 5000) -> DataFrame:
    """keys, core (place), cluster and point of every core point; each key is fitted to its first ``most`` rows by ``order``."""
    first = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_at") <= most)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", core int, cluster int, point array<double>"

    def each(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        points = group.sort_values("_at")[features].to_numpy(dtype=float)
        labels, is_core = _labels_and_cores(points, eps, least)
        core = np.flatnonzero(is_core)
        return pd.DataFrame({**{k: [v] * len(core) for k, v in zip(keys, key, strict=True)}, "core": core.astype(np.int32), "cluster": labels[core].astype(np.int32), "point": [points[i].tolist() for i in core]})

    return first.select(*keys, "_at", *features).groupBy(*keys).applyInPandas(each, schema)


def assign_clusters(rows: DataFrame, cores: DataFrame, keys: list[str], features: list[str], eps: float = 5.0, salts: int = 16) -> DataFrame:
    """Adds cluster: that of the first core point nearer than ``eps``, else -1; rows with a null key or feature have -1.

    Cores are listed for the cells, ``eps`` wide in the first two features, in
    and around which they lie, and a row goes to its own cell. A cell's cores
    and then its rows stream through a task in batches, which holds the cores of
    one cell; rows of a cell are dealt to ``salts`` tasks, each with its cores.
    """
    axes = range(min(2, len(features)))
    place = lambda at: F.to_json(F.struct(*keys, *[F.floor(x / eps).cast("long").alias(f"c{i}") for i, x in enumerate(at)]))
    near = cores.select(*keys, F.col("core").cast("long").alias("_core"), F.col("cluster").cast("long").alias("_cluster"), F.col("point").alias("_at"), *[F.col("point")[i].alias(f"_x{i}") for i in axes])
    for i in axes:
        near = near.withColumn(f"_x{i}", F.explode(F.array(*[F.col(f"_x{i}") + d * eps for d in (-1, 0, 1)])))
    near = near.select(place([F.col(f"_x{i}") for i in axes]).alias("_cell"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.lit(0).alias("_row"), "_core", "_cluster", "_at", F.lit(None).cast(rows.schema).alias("_kept"))
    here = F.array(*[F.col(c).cast("double") for c in features])
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    mine = rows.select(place([F.col(features[i]).cast("double") for i in axes]).alias("_cell"), salt.alias("_salt"), F.lit(1).alias("_row"), F.lit(0).cast("long").alias("_core"), F.lit(-1).cast("long").alias("_cluster"), here.alias("_at"), F.struct(*rows.columns).alias("_kept"))
    dealt = near.unionByName(mine).repartition("_cell", "_salt").sortWithinPartitions("_cell", "_salt", "_row", "_core")
    width = len(features)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, points, clusters = None, [], []
        for batch in batches:
            cell, salted, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            label, at = batch.column(4).to_numpy(), batch.column(5).to_pylist()
            edges = np.flatnonzero((cell[1:] != cell[:-1]) | (salted[1:] != salted[:-1]) | (kind[1:] != kind[:-1])) + 1
            found = np.full(batch.num_rows, -1, np.int64)
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                if (cell[a], salted[a]) != held:
                    held, points, clusters = (cell[a], salted[a]), [], []
                if kind[a] == 0:
                    points += at[a:b]
                    clusters += label[a:b].tolist()
                elif points:
                    whole = [i for i in range(a, b) if None not in at[i]]
                    asked, others = np.array([at[i] for i in whole], float).reshape(-1, width), np.array(points, float)
                    step = max(1, (1 << 22) // others.size)
                    for k in range(0, len(whole), step):
                        hits = np.sqrt(((asked[k : k + step, None] - others[None]) ** 2).sum(2)) < eps
                        some = hits.any(1)
                        found[np.array(whole[k : k + step])[some]] = np.array(clusters)[hits.argmax(1)[some]]
            mine = np.flatnonzero(kind == 1)
            if len(mine):
                yield pa.RecordBatch.from_arrays([batch.column(6).take(pa.array(mine)), pa.array(found[mine], pa.int32())], names=["_kept", "cluster"])

    kept = rows.schema.simpleString()
    return dealt.mapInArrow(each, f"_kept {kept}, cluster int").select("_kept.*", "cluster")


def undersample(negatives: DataFrame, n_positive: int, seed: int, floor: int = 30) -> DataFrame:
    """At most as many negatives as positives, at least ``floor``, chosen by a hash.

    Rows are counted by the upper 16 bits of their hash; whole ranges are taken
    until the next one would be too many, and only that one is ranked, so no
    task sees more than a range and the counts.
    """
    most, columns = max(floor, n_positive), negatives.columns
    rows = negatives.withColumn("_hash", F.xxhash64(F.lit(seed), *[F.col(c) for c in sorted(columns)])).withColumn("_range", F.shiftright("_hash", 48))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # at most 65536 rows
    sums = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_range")))
    last = sums.where(F.col("_upto") >= most).orderBy("_range").first()
    if last is None:
        return negatives
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", *sorted(columns)))
    edge = rows.where(F.col("_range") == last["_range"]).withColumn("_place", within).where(F.col("_place") <= most - last["_upto"] + last["_n"])
    return rows.where(F.col("_range") < last["_range"]).select(*columns).unionByName(edge.select(*columns))


def dealt_for_training(rows: DataFrame, order: str, most: int = 250_000) -> DataFrame:
    """The rows in parts of about ``most``, four at least, sorted by ``order`` and written once for all forests; rows of equal parts give equal forests."""
    return checkpointed(rows.repartition(max(4, -(-rows.count() // most)), order).sortWithinPartitions(order))


def train_activities(rows: DataFrame, features: list[str], label: str, activities: list[str], trees: int = 20, seed: int = 100) -> dict[str, RandomForestClassificationModel]:
    """One forest for each activity against the rest."""
    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(rows.na.fill(-1, features)).withColumns({f"_y{i}": (F.col(label) == a).cast("double") for i, a in enumerate(activities)})
    return {a: RandomForestClassifier(featuresCol="_x", labelCol=f"_y{i}", numTrees=trees, seed=seed).fit(data) for i, a in enumerate(activities)}


def predict_activities(rows: DataFrame, models: dict[str, RandomForestClassificationModel], features: list[str], unknown: str = "unknown") -> DataFrame:
    """Adds activity and proba: the activity of the largest probability among those predicted, else unknown."""
    out = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(rows.na.fill(-1, features))
    votes = []
    for i, (name, model) in enumerate(models.items()):
        out = model.setPredictionCol(f"_y{i}").setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").transform(out)
        p = F.get(vector_to_array(F.col(f"_p{i}")), 1)
        votes.append(F.when(F.col(f"_y{i}") == 1, F.struct(p.alias("p"), F.lit(name).alias("a"))))
    best = F.array_max(F.array_compact(F.array(*votes)))
    return out.select(*rows.columns, F.coalesce(best["a"], F.lit(unknown)).alias("activity"), F.coalesce(best["p"], F.lit(0.0)).alias("proba"))


def best_at_host(host: Column, protocol: Column, scores: Column) -> Column:
    """proba and activity of the largest probability among the predicted ``scores`` whose fingerprint the host and protocol match; null if none.

    ``scores`` is an array of structs activity, host_pattern, protocol, proba
    and predicted. Of equal probabilities the last activity by name counts.
    """
    fits = F.filter(scores, lambda s: s["predicted"] & (s["protocol"] == protocol) & net.is_of_pattern(host, s["host_pattern"]))
    return F.array_max(F.transform(fits, lambda s: F.struct(s["proba"].alias("proba"), s["activity"].alias("activity"))))


def predict_at_hosts(rows: DataFrame, models: dict[tuple[str, str, str], RandomForestClassificationModel], features: list[str], unknown: str = "unknown") -> DataFrame:
    """Adds activity and proba, where each model speaks for one (activity, host_pattern, protocol) of a fingerprint.

    A model counts for rows of its own host and protocol only; rows need host
    and protocol, those that no model claims are unknown with probability 0. Of
    equal probabilities the last activity by name counts.

    Rows are written once, to a part for each model that they belong to, and a
    model reads its own part, so no row meets a forest that can't speak for it.
    Only rows of several models are shuffled. No column may be of type void.
    """
    names = list(models)
    fits = [F.when((F.col("protocol") == protocol) & net.is_of_pattern(F.col("host"), F.lit(pattern)), F.lit(i)) for i, (_, pattern, protocol) in enumerate(names)]
    claims = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<int>")
    kept = rows.select(F.struct(*rows.columns).alias("_row"), claims.alias("_of"), F.monotonically_increasing_id().alias("_id"))
    asked = parted(kept.select("_row", "_id", (F.size("_of") > 1).alias("_shared"), F.explode_outer("_of").alias("_model")).na.fill(-1, ["_model"]), "_shared", "_model")
    assemble = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")

    def scored(i: int, shared: bool) -> DataFrame:
        mine = asked.where((F.col("_model") == i) & (F.col("_shared") == shared))
        wide = mine.select("_id", "_row", *[F.coalesce(F.col("_row")[c].cast("double"), F.lit(-1.0)).alias(c) for c in features])
        out = models[names[i]].setPredictionCol("_y").setProbabilityCol("_p").setRawPredictionCol("_r").transform(assemble.transform(wide))
        best = F.struct(F.get(vector_to_array("_p"), 1).alias("proba"), F.lit(names[i][0]).alias("activity"))
        return out.select("_id", "_row", F.when(F.col("_y") == 1, best).alias("_best"))

    none = asked.where("_model = -1").select("_row", F.lit(None).cast("struct<proba:double,activity:string>").alias("_best"))
    parts = asked.select("_shared", "_model").where("_model >= 0").distinct().collect()  # at most two for each model
    alone = [scored(r["_model"], False).drop("_id") for r in parts if not r["_shared"]]
    several = [scored(r["_model"], True) for r in parts if r["_shared"]]
    if several:
        alone.append(reduce(DataFrame.unionByName, several).groupBy("_id").agg(F.first("_row").alias("_row"), F.max("_best").alias("_best")).drop("_id"))
    out = reduce(DataFrame.unionByName, alone, none)
    return out.select(*[F.col("_row")[c].alias(c) for c in rows.columns], F.coalesce("_best.activity", F.lit(unknown)).alias("activity"), F.coalesce("_best.proba", F.lit(0.0)).alias("proba"))
