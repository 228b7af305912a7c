from __future__ import annotations

import random

import pytest

from flowlens.operators import mining, monitor, traces

SCHEMA = "device string, trace long, pos long, event string"


def frame(spark, paths):
    return spark.createDataFrame([("d" if i % 5 else None, i, 10 + 2 * p, e) for i, path in enumerate(paths) for p, e in enumerate(path)], SCHEMA).repartition(4)


def brute_invariants(paths, least=2):
    labels = sorted({e for p in paths for e in p})
    out = set()
    for a in labels:
        for b in labels:
            together = [p for p in paths if a in p and b in p]
            if not together:
                continue
            with_a, with_b = [p for p in paths if a in p], [p for p in paths if b in p]
            if len(with_a) >= least and all(b in p[i + 1 :] for p in with_a for i, e in enumerate(p) if e == a):
                out.add(("AlwaysFollowedBy", a, b, len(with_a)))
            if len(with_b) >= least and all(a in p[:i] for p in with_b for i, e in enumerate(p) if e == b):
                out.add(("AlwaysPrecedes", a, b, len(with_b)))
            if len(together) >= least and not any(b in p[i + 1 :] for p in together for i, e in enumerate(p) if e == a):
                out.add(("NeverFollowedBy", a, b, len(together)))
    return out


def made(n, seed):
    rng = random.Random(seed)
    paths = [[rng.choice("abcd") for _ in range(rng.randrange(1, 7))] for _ in range(n)]
    # x is always followed by y and z is always preceded by w; without a split, labels alone allow other paths
    return [["w", *p, "z"] if i % 3 == 0 else [*p[:1], "x", *p[1:], "y"] if i % 3 == 1 else p for i, p in enumerate(paths)]


@pytest.mark.parametrize("seed", [1, 2])
def test_invariants_equal_brute_force(spark, seed):
    paths = made(25, seed)
    got = mining.mined_invariants(frame(spark, paths), ["device", "trace"], "pos", "event")
    assert {tuple(r) for r in got.collect()} == brute_invariants(paths)


def test_broken_invariants_equal_brute_force(spark):
    held, later = made(12, 3), made(40, 4)
    rules = brute_invariants(held)
    table = spark.createDataFrame([r[:3] for r in rules], "kind string, a string, b string")
    got = mining.broken_invariants(frame(spark, later), ["device", "trace"], "pos", "event", table)

    def broken(p, kind, a, b):
        if kind == "AlwaysFollowedBy":
            return any(e == a and b not in p[i + 1 :] for i, e in enumerate(p))
        if kind == "AlwaysPrecedes":
            return any(e == b and a not in p[:i] for i, e in enumerate(p))
        return any(e == a and b in p[i + 1 :] for i, e in enumerate(p))

    want = {(i, *r[:3]) for i, p in enumerate(later) for r in rules if broken(p, *r[:3])}
    assert want and {(r["trace"], r["kind"], r["a"], r["b"]) for r in got.collect()} == want


def machine(nodes_of):
    edges = {}
    for nodes in nodes_of:
        for s, d in zip(["INITIAL", *nodes], [*nodes, "TERMINAL"], strict=True):
            edges[s, d] = edges.get((s, d), 0) + 1
    return edges


@pytest.mark.parametrize("k", [0, 1, 2])
def test_tails_equal_brute_force(spark, k):
    paths = made(30, 5)
    name = lambda p, i: mining.THEN.join([*p, "TERMINAL"][i : i + k + 1])
    want = machine([[name(p, i) for i in range(len(p))] for p in paths])
    got = mining.mined_machine(frame(spark, paths), ["device", "trace"], "pos", "event", k).collect()
    assert {(r["src"], r["dst"]): r["cnt"] for r in got} == want
    totals = {}
    for r in got:
        totals[r["src"]] = totals.get(r["src"], 0) + r["prob"]
    assert all(abs(t - 1) < 1e-9 for t in totals.values())


def reachable(starts, edges, avoid):
    found, todo = set(starts), list(starts)
    while todo:
        n = todo.pop()
        for s, d in edges:
            if s == n and d not in found and avoid != d[1]:
                found.add(d)
                todo.append(d)
    return found


@pytest.mark.parametrize("seed", [6, 7])
def test_refined_machine_takes_all_traces_and_keeps_all_invariants(spark, seed):
    paths = made(20, seed)
    rows = frame(spark, paths)
    rules = mining.mined_invariants(rows, ["device", "trace"], "pos", "event")
    nodes = mining.refined_nodes(rows, ["device", "trace"], "pos", "event", rules)
    steps = mining.machine_of(nodes, ["device", "trace"]).collect()
    edges = {((r["src"], r["src_label"]), (r["dst"], r["dst_label"])) for r in steps}
    every = {n for e in edges for n in e}
    start, end = ("INITIAL", "INITIAL"), ("TERMINAL", "TERMINAL")
    for kind, a, b, _ in brute_invariants(paths):
        if kind == "AlwaysFollowedBy":
            assert end not in reachable([n for n in every if n[1] == a], edges, b), (kind, a, b)
        elif kind == "AlwaysPrecedes":
            assert not any(n[1] == b for n in reachable([start], edges, a)), (kind, a, b)
    assert sum(r["cnt"] for r in steps) == sum(len(p) + 1 for p in paths)
    assert len({e for p in paths for e in p}) + 2 < len(every) < sum(map(len, paths))
    named, links = mining.numbered(mining.machine_of(nodes, ["device", "trace"]))
    found = monitor.node_paths(traces.paths(rows, ["device", "trace"], "pos", "event"), named, links)
    assert [r["n_missing"] for r in found.collect()] == [0] * len(paths)


def test_no_traces(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rules = mining.mined_invariants(empty, ["device", "trace"], "pos", "event")
    assert rules.collect() == [] and mining.machine_of(mining.refined_nodes(empty, ["device", "trace"], "pos", "event", rules), ["device", "trace"]).collect() == []


def test_mutations_equal_a_twin(spark):
    import zlib

    from pyspark.sql import functions as F

    events, paths = ["p", "q", "r"], [["a"], ["a", "b", "c"], ["b"] * 7, []]
    df = spark.createDataFrame([(f"k{i}", p) for i, p in enumerate(paths * 5)], "k string, path array<string>")
    got = df.select("k", "path", *[traces.mutated(F.col("path"), F.col("k"), events, kind).alias(kind) for kind in ("insert", "alter", "remove")]).collect()
    for r in got:
        at = zlib.crc32(r["k"].encode()) % max(len(r["path"]), 1)
        event = events[zlib.crc32(b"e" + r["k"].encode()) % len(events)]
        head, tail = r["path"][:at], r["path"][at:]
        assert (r["insert"], r["alter"], r["remove"]) == ([*head, event, *tail], [*head, event, *tail[1:]], [*head, *tail[1:]])
