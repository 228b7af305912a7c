"""Density clusters of keys too large for one task: a grid whose cells are clustered by themselves and joined where they share core points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .models import _near
from .periodic import checkpointed

#: Width of a cell in eps; wider cells have fewer copies of points near their borders, and more points.
CELL = 4


def _copied(points: DataFrame, axes: int, eps: float) -> DataFrame:
    """Each point in its own cell (_own) and as a copy in every cell that it is within ``eps`` of; cells are of the first ``axes`` features."""
    width = CELL * eps
    for i in range(axes):
        x = F.col("_point")[i]
        cell, within = F.floor(x / width).cast("long"), x - F.floor(x / width) * width
        # A little more than eps, so that rounding loses no copy.
        near = F.array_compact(F.array(cell, F.when(within <= eps * 1.001, cell - 1), F.when(width - within <= eps * 1.001, cell + 1)))
        points = points.withColumn(f"_home{i}", cell).withColumn(f"_c{i}", F.explode(near))
    own = [F.col(f"_home{i}") == F.col(f"_c{i}") for i in range(axes)]
    flag = F.lit(True)
    for o in own:
        flag = flag & o
    return points.withColumn("_own", flag).drop(*[f"_home{i}" for i in range(axes)])


def _small_cells(at: np.ndarray, eps: float) -> np.ndarray:
    """Number of each point's small cell, all of whose points are within ``eps`` of each other."""
    width = eps / at.shape[1] ** 0.5 * (1 - 1e-6)
    cell = np.unique(np.floor(at / width), axis=0, return_inverse=True)[1].ravel() if width > 0 else np.arange(len(at))
    low, high, *_ = _boxes(at, cell)
    # Of values so large that rounding widens a cell, each point is a cell.
    return cell if (np.sqrt(((high - low) ** 2).sum(1)) <= eps).all() else np.arange(len(at))


def _boxes(at: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest corner of each cell's points, the points in order of cells, and where each cell starts there."""
    order = np.argsort(cell, kind="stable")
    starts = np.searchsorted(cell[order], np.arange(cell.max() + 1))
    return np.minimum.reduceat(at[order], starts), np.maximum.reduceat(at[order], starts), order, starts


def _meet(a: np.ndarray, b: np.ndarray, eps: float, first: int = 32) -> bool:
    """Whether a point of ``a`` is within ``eps`` of one of ``b``; crowded cells mostly tell by their first points."""
    if any(hits.any() for _, hits in _near(a[:first], b[:first], eps)):
        return True
    away = lambda points, box: np.sqrt((np.maximum(0, np.maximum(points - box.max(0), box.min(0) - points)) ** 2).sum(1))
    a, b = a[away(a, b) <= eps], b[away(b, a) <= eps]
    return len(a) > 0 and len(b) > 0 and any(hits.any() for _, hits in _near(a, b, eps, 1 << 16))


def _joined_cells(at: np.ndarray, eps: float) -> np.ndarray:
    """For core points, the number of a small cell that stands for each one's cluster; cells are joined, not points."""
    cell = _small_cells(at, eps)
    low, high, order, starts = _boxes(at, cell)
    parts = np.split(at[order], starts[1:])
    label = np.full(len(starts), -1)
    for start in range(len(starts)):
        if label[start] >= 0:
            continue
        label[start], todo = start, [start]
        while todo:
            c = todo.pop()
            free = np.flatnonzero(label < 0)
            gap = np.maximum(0, np.maximum(low[free] - high[c], low[c] - high[free]))
            span = np.maximum(high[free] - low[c], high[c] - low[free])
            sure = np.sqrt((span**2).sum(1)) <= eps
            maybe = free[(np.sqrt((gap**2).sum(1)) <= eps) & ~sure]
            fresh = [*free[sure].tolist(), *[k for k in maybe.tolist() if _meet(parts[c], parts[k], eps)]]
            label[fresh] = start
            todo.extend(fresh)
    return label[cell]


def grid_clusters(rows: DataFrame, keys: list[str], features: list[str], eps: float = 5.0, least: int = 5) -> DataFrame:
    """keys, point (array of double), weight and cluster of every core point of all rows; ``cluster`` is the smallest point number of its cluster.

    DBSCAN without a limit on a key's rows. Equal points are counted first, so a
    point that repeats is one with a weight. The plane of the first two features
    is cut in cells; a cell with copies of the points around it tells which of
    its own are core, since all their neighbours are there. Core points then
    cluster in each cell by themselves, and clusters of neighbouring cells are
    one where they share a core point; only such clusters are linked, not their
    points. No task holds more than the distinct points of a cell and its rim.
    In a cell, points are dealt to small cells whose points are all within
    ``eps`` of each other: one that holds ``least`` rows has core points only,
    and those of one small cell are of one cluster, so distances are taken for
    the few others and between small cells. Rows with a null key or a feature
    that is null or not finite have no part.
    """
    axes = min(2, len(features))
    cells = [f"_c{i}" for i in range(axes)]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    counted = rows.dropna(subset=[*keys, *features]).groupBy(*keys, F.array(*[F.col(c).cast("double") + 0.0 for c in features]).alias("_point")).agg(F.count("*").alias("_weight"))
    counted = counted.where(F.forall("_point", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
    points = checkpointed(counted.withColumn("_id", F.monotonically_increasing_id()))

    def flagged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        at, weight, own = np.stack(group["_point"]), group["_weight"].to_numpy(), group["_own"].to_numpy(bool)
        cell = _small_cells(at, eps)
        core = np.bincount(cell, weight)[cell] >= least
        mine = np.flatnonzero(own & ~core)
        for part, hits in _near(at[mine], at, eps):
            core[mine[part]] = hits @ weight >= least
        return group.iloc[np.flatnonzero(own & core)][[*keys, "_id", "_point", "_weight"]]

    copies = _copied(points, axes, eps)
    schema = f"{kinds}, _id long, _point array<double>, _weight long"
    cores = checkpointed(copies.groupBy(*keys, *cells).applyInPandas(flagged, schema))

    def labelled(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        first = group["_id"].groupby(_joined_cells(np.stack(group["_point"]), eps)).transform("min")
        return group[[*keys, "_id", "_point", "_weight", "_own"]].assign(_label=first)

    local = checkpointed(_copied(cores, axes, eps).groupBy(*keys, *cells).applyInPandas(labelled, f"{schema}, _own boolean, _label long"))
    shared = local.groupBy(*keys, "_id").agg(F.min("_label").alias("b"), F.collect_set("_label").alias("_a"))
    found = components(shared.select(*keys, F.explode("_a").alias("a"), "b").distinct(), keys)
    out = local.where("_own").join(found.select(*keys, F.col("id").alias("_label"), F.col("component").alias("cluster")), [*keys, "_label"])
    return out.select(*keys, F.col("_point").alias("point"), F.col("_weight").alias("weight"), "cluster")
