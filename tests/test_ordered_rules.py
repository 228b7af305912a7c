from __future__ import annotations

import random

import pytest

from flowlens.operators import components, folds, grid, models, periodic, scans


def brute_windows(times, length):
    out, bound, window = [], None, -1
    for t in times:
        if bound is None or t > bound:
            bound, window = t // 1 + length, window + 1
        out.append(window)
    return out


@pytest.mark.parametrize(("length", "most"), [(1, None), (5, 30), (60, 40), (10_000, 25)])
def test_jumps_give_the_windows_of_the_fold(spark, length, most):
    rng, rows, t = random.Random(length), [], 0.0
    for i in range(400):
        t += rng.choice([0.0, 0.25, 1.0, 3.5, 40.0])
        rows.append((rng.choice(["hot"] * 9 + ["cold", None]), t, i))
    df = spark.createDataFrame(rows, "k string, t double, id long").repartition(3)
    cuts = scans.hot_cuts(df, ["k"], "t", most) if most else None
    got = {r["id"]: r["window"] for r in folds.anchored_windows_by_jumps(df, ["k"], "t", "id", length, cuts).collect()}
    want = {}
    for k in ("hot", "cold", None):
        mine = [r for r in rows if r[0] == k]
        want.update(zip([r[2] for r in mine], brute_windows([r[1] for r in mine], length), strict=True))
    assert got == want
    plain = folds.anchored_windows(df, ["k"], "t", "id", length)
    assert {r["id"]: r["window"] for r in plain.collect()} == want


def brute_rules(rows, prints):
    """One pass over all rows for each fingerprint, as the rules are stated."""
    left, taken = sorted(rows, key=lambda r: (r[0], r[3])), {}
    for pattern, period in prints:
        fits = lambda h, p=pattern: h == p or (p.startswith("*.") and ("." + h).endswith(p[1:]))
        mine = [r for r in left if fits(r[2])]
        state, drift = [], 0.0
        for i, r in enumerate(mine):
            gap = None if i == 0 else r[0] - mine[i - 1][0]
            on = gap is not None and (abs(gap - period) <= 1 or abs(gap - period) <= 0.05 * period)
            state.append((on, gap is not None and not on and gap <= 1 - drift))
            drift = gap - period if on else drift
        for i, r in enumerate(mine):
            if state[i][0] and not (i + 1 < len(mine) and state[i + 1][1]):
                taken[r[3]] = pattern
        left = [r for r in left if r[3] not in taken]
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_rules_in_one_pass_equal_a_pass_for_each(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.x.com", "b.x.com", "x.com", "a.y.net", "z.org"]
    prints = [("a.x.com", 10.0), ("*.x.com", 7.0), ("*.com", 12.0), ("x.com", 3.0), ("*.net", 40.0)]
    rng.shuffle(prints)
    t, rows = 0.0, []
    for i in range(500):
        t += rng.choice([0.1, 0.4, 1.0, 2.0, 3.0, 3.0, 5.0])
        rows.append((round(t, 2), "TCP", rng.choice(hosts), i))
    df = spark.createDataFrame([("d" if i % 11 else "e", *r) for i, r in enumerate(rows)], "device string, t double, protocol string, host string, id long").repartition(4)
    fp = spark.createDataFrame([(d, "TCP", n, p, q) for d in ("d", "e") for n, (p, q) in enumerate(prints)] + [("d", "TCP", 9, "z.org", 9000.0), ("d", "DNS", 9, "z.org", 2.0)], "device string, protocol string, seq int, host_pattern string, period double")
    got = folds.taken_by_timing(df, fp, ["device", "protocol"], "t", "id").collect()
    want = {}
    for d in ("d", "e"):
        want.update(brute_rules([r for i, r in enumerate(rows) if ("d" if i % 11 else "e") == d], prints))
    assert len(got) == len(want) and {r["id"]: r["host_pattern"] for r in got} == want and len(set(want.values())) >= 4
    assert periodic.without_periodic(df, fp, ["device", "protocol"], "t", "id").count() == len(rows) - len(want)


def test_plan_does_not_grow_with_fingerprints(spark):
    rows = spark.createDataFrame([(n, "d", "TCP", "h.example.com", float(n)) for n in range(50)], "id long, device string, protocol string, host string, t double")
    size = []
    for n in (1, 40):
        fp = spark.createDataFrame([("d", "TCP", "*.example.com", k, 10.0 + k) for k in range(n)], "device string, protocol string, host_pattern string, seq int, period double")
        size.append(folds.taken_by_timing(rows, fp, ["device", "protocol"], "t", "id")._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert size[0] == size[1]


def test_clusters_take_what_timing_leaves(spark):
    rows = [("d", "TCP", "a.x.com", 10.0 * i, i, 1.0 + i % 2, 5.0) for i in range(6)] + [("d", "TCP", "b.x.com", 3.0, 50, 40.0, 40.0), ("d", "TCP", "q.net", 4.0, 51, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "device string, protocol string, host string, t double, id long, f double, g double")
    fp = spark.createDataFrame([("d", "TCP", 0, "a.x.com", 10.0)], "device string, protocol string, seq int, host_pattern string, period double")
    cores = spark.createDataFrame([("d", "TCP", "*.x.com", 0, 0, [1.0, 5.0])], "device string, protocol string, host_pattern string, core int, cluster int, point array<double>")
    got = {r["id"]: (r["taken_by"], r["how"]) for r in folds.filtered_rows(df, fp, cores, ["device", "protocol"], "t", "id", ["f", "g"], 2.0).collect()}
    assert got == {0: ("*.x.com", "cluster"), **{i: ("a.x.com", "timing") for i in range(1, 6)}, 50: (None, None), 51: (None, None)}


def brute_cores(points, eps, least):
    near = [[j for j, q in enumerate(points) if sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5 <= eps] for p in points]
    core = [len(n) >= least for n in near]
    group = list(range(len(points)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, n in enumerate(near):
        for j in n:
            if core[i] and core[j]:
                group[root(i)] = root(j)
    parts = {}
    for i, c in enumerate(core):
        if c:
            parts.setdefault(root(i), set()).add(tuple(points[i]))
    return {frozenset(p) for p in parts.values()}


@pytest.mark.parametrize("width", [1, 2, 3])
def test_grid_equals_brute_force(spark, width):
    rng = random.Random(width)
    centres = [[rng.uniform(-30, 30) for _ in range(width)] for _ in range(12)]
    points = [[round(rng.gauss(c, 1.5), 1) for c in rng.choice(centres)] for _ in range(500)]
    points += [[0.1 * i] + [50.0] * (width - 1) for i in range(-150, 150)]  # a chain through many cells
    rows = [("d" if i % 4 else "e", *p) for i, p in enumerate(points)]
    names = [f"x{i}" for i in range(width)]
    df = spark.createDataFrame([*rows, ("d", *[None] * width), (None, *points[0])], "k string, " + ", ".join(f"{n} double" for n in names))
    got = {}
    for r in grid.grid_clusters(df, ["k"], names, eps=1.0, least=4).collect():
        got.setdefault((r["k"], r["cluster"]), set()).add(tuple(r["point"]))
    for k in ("d", "e"):
        assert {frozenset(p) for (key, _), p in got.items() if key == k} == brute_cores([list(r[1:]) for r in rows if r[0] == k], 1.0, 4)


def test_components_of_chains_and_cycles(spark):
    rng = random.Random(1)
    ids = list(range(300))
    rng.shuffle(ids)
    links = [("a", ids[i], ids[i + 1]) for i in range(200)] + [("a", ids[210 + i], ids[210 + (i + 1) % 40]) for i in range(40)] + [("b", 5, 7), ("b", 7, 7)]
    got = {(r["k"], r["id"]): r["component"] for r in components.components(spark.createDataFrame(links, "k string, a long, b long"), ["k"]).collect()}
    assert {v for (k, i), v in got.items() if k == "a" and i in ids[:201]} == {min(ids[:201])}
    assert {v for (k, i), v in got.items() if k == "a" and i in ids[210:250]} == {min(ids[210:250])}
    assert got["b", 5] == got["b", 7] == 5 and len(got) == 243


def test_rows_without_a_cell_have_no_cluster(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", None, 2.0), (None, 1.0, 2.0), ("j", 1.0, 2.0)], "k string, x double, y double")
    cores = spark.createDataFrame([("k", 0, 3, [1.0, 2.5])], "k string, core int, cluster int, point array<double>")
    got = models.assign_clusters(df, cores, ["k"], ["x", "y"], 1.0)
    assert got.columns == ["k", "x", "y", "cluster"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("k", 1.0, 2.0, 3), ("k", None, 2.0, -1), (None, 1.0, 2.0, -1), ("j", 1.0, 2.0, -1)], key=repr)


def test_crowded_cells_take_few_distances(monkeypatch):
    import numpy as np

    rng, taken = np.random.default_rng(5), []
    near = grid._near

    def counted(points, others, *args):
        for part, hits in near(points, others, *args):
            taken.append(hits.size)
            yield part, hits

    monkeypatch.setattr(grid, "_near", counted)
    at = np.concatenate([rng.uniform(0, 9, (20_000, 2)), rng.uniform(0, 9, (5000, 2)) + [10.1, 0], [[30.0, 30.0], [1e150, 1e150]]])
    label = grid._joined_cells(at, 1.0)
    assert len(set(label[:20_000])) == len(set(label[20_000:25_000])) == 1 and len(set(label)) == 4
    assert sum(taken) < 20 * len(at)  # of 625 million pairs
    for width in (1, 2, 3, 9):
        few = rng.uniform(-3, 3, (300, width)).round(1)
        got = {}
        for point, k in zip(few, grid._joined_cells(few, 0.5 * width), strict=True):
            got.setdefault(k, set()).add(tuple(point))
        assert {frozenset(p) for p in got.values()} == brute_cores(few.tolist(), 0.5 * width, 1)


def test_values_that_are_not_finite_have_no_cluster(spark):
    df = spark.createDataFrame([("d", x, 1.0) for x in (0.0, 0.5, float("nan"), float("nan"), float("inf"), float("inf"))], "k string, x double, y double")
    assert sorted(r["point"] for r in grid.grid_clusters(df, ["k"], ["x", "y"], eps=1.0, least=2).collect()) == [[0.0, 1.0], [0.5, 1.0]]
