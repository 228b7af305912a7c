from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from flowlens.llm import embeddings
from flowlens.llm.hnsw import Graph

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    usable = [(i, np.array(v, dtype=np.float32).astype(np.float64), y) for i, v, y in rows if y is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=np.float32)).all() and np.any(v)]
    root = {i: i for i, _, _ in rows}
    links = dict.fromkeys(root, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, v, y) in enumerate(usable):
        for j, w, z in usable[n + 1 :]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, links[i], find(i), find(i) == i) for i in root}


def vectors(seed, n, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, width))
    rows = []
    for i in range(n):
        if rng.random() < 0.6:
            v = centres[rng.integers(len(centres))] + rng.normal(size=width) * rng.choice([0.0, 0.02, 0.1, 0.2])
        else:
            v = rng.normal(size=width)
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(3))))
    return rows


def got(df):
    return {tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()}


def test_equals_brute_force_over_several_shards(spark):
    rows = vectors(1, 600)
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0, None] * 8, 1), (1003, [float("nan")] * 16, 1), (1004, [float("inf")] + [1.0] * 15, 1), (1005, rows[0][1], None), (1006, rows[0][1], rows[0][2]), (1007, [x * 1e30 for x in rows[0][1]], rows[0][2]), (1008, [x * 1e-38 for x in rows[0][1]], rows[0][2]), (1009, [1.0, 2.0], 1), (1010, [2.0, 4.0], 1), (1011, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([r for r in rows if r[0] != 1008])
    out = got(embeddings.near_duplicates(df.where("vec_id <> 1008"), shard_rows=60))
    assert out == want
    assert got(embeddings.near_duplicates(df.where("vec_id <> 1008"))) == want


def test_copies_nulls_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(i, v, 1) for i in range(50)] + [(60, v, 2), (7, v, 1), (None, v, 1)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", rep string, n int")
    out = [tuple(r) for r in embeddings.near_duplicates(df).collect()]
    assert sorted(out, key=str) == sorted([(i, 50, 0, i == 0) for i in [*range(50), 7]] + [(60, 0, 60, True), (None, 0, None, True)], key=str)
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_finds_dense_groups():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(1, 32))
    points = np.concatenate([centre + rng.normal(size=(400, 32)) * 0.01, rng.normal(size=(1500, 32))])
    units = embeddings.unit_vectors(points[rng.permutation(len(points))])
    graph = Graph.from_bytes(Graph(units).to_bytes(), units)
    ids, ones = np.arange(len(units)) * 3 + 5, np.ones(len(units), dtype=np.int64)
    out = embeddings.links_of(graph, units, ids, ones, units, ids, ones, 0.98, same=True)
    close = units @ units.T >= 0.98
    np.fill_diagonal(close, False)
    want = dict(zip(ids.tolist(), close.sum(axis=1).tolist(), strict=True))
    found = dict(zip(out["rep"], out["n_links"], strict=True))
    assert all(found[i] <= want[i] for i in found) and sum(found.values()) >= 0.99 * sum(want.values())
    assert set(out["root"]) == {min(found)}


def test_audit_has_links_where_the_table_has_none():
    rng = np.random.default_rng(8)
    units = embeddings.unit_vectors(rng.normal(size=(3000, 48)))
    graph = Graph(units)
    beam, recall = embeddings.audited_beam(graph, units, units[:500], 0.98, same=False)
    assert recall >= embeddings.RECALL
    made = embeddings.made_queries(units, 0.98, 96)
    assert ((made @ units.T).max(axis=1) >= 0.98).all() and np.allclose((made * made).sum(axis=1), 1)
    # a graph that has lost its links fails the audit until the beams hold the whole shard
    graph.degree[:] = 0
    beam, recall = embeddings.audited_beam(graph, units, units[:500], 0.98, same=False)
    assert beam >= len(units) and recall < embeddings.RECALL


@pytest.mark.parametrize("same", [True, False])
def test_shards_whose_graph_fails_the_audit_are_answered_whole(same):
    rng = np.random.default_rng(11)
    centres = np.repeat(rng.normal(size=(60, 24)), 10, axis=0)
    units = embeddings.unit_vectors(centres + rng.normal(size=centres.shape) * 0.04)
    others = units if same else embeddings.unit_vectors(centres[::2] + rng.normal(size=(300, 24)) * 0.04)
    graph = Graph(units)
    graph.degree[:] = 0
    assert embeddings.audited_beam(graph, units, others, 0.98, same)[1] < embeddings.RECALL
    ids, mine = np.arange(len(units)), np.arange(len(others)) + (0 if same else 1000)
    ns, counts = rng.integers(1, 4, len(units)), rng.integers(1, 4, len(others))
    counts = ns if same else counts
    out = embeddings.links_of(graph, units, mine, counts, others, ids, ns, 0.98, same=same).set_index("rep")
    near = units @ others.T >= 0.98
    if same:
        np.fill_diagonal(near, False)
        want = {i: int(ns[near[i]].sum()) for i in ids if near[i].any()}
    else:
        want = {i: int(counts[near[i]].sum()) for i in ids if near[i].any()} | {int(m): int(ns[near[:, j]].sum()) for j, m in enumerate(mine) if near[:, j].any()}
    assert len(want) > 100 and out["n_links"].to_dict() == want
    for rep, root in out["root"].items():  # groups lie far from each other
        assert root <= rep and (root // 10 == rep // 10 if rep < 1000 else root // 10 == (rep - 1000) // 5)


def test_memory_follows_vectors_not_links():
    rng = np.random.default_rng(4)
    n = 3000
    units = embeddings.unit_vectors(rng.normal(size=(1, 16)) + rng.normal(size=(n, 16)) * 1e-3)
    ids, ones = np.arange(n), np.full(n, 2)

    class All:
        vectors = units

        def within(self, q, least, beam):
            return list(range(n))

    tracemalloc.start()
    out = embeddings.links_of(All(), units, ids, ones, units, ids + n, ones, 0.98, same=False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 2 * n and (out["n_links"] == 2 * n).all() and set(out["root"]) == {0}
    assert most < 64 * 2**20  # the 9 million pairs alone would take 144 MB
