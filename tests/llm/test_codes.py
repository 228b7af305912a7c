from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from flowlens.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def brute(rows, entries=codes.ENTRIES, parts=4, rounds=4):
    """The contract, row by row in Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    w = len(q[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in q]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for i, members in groups.items():
                books[p][i] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, found, errors, strict=True)]


def same(spark, rows, **kw):
    got = codes.compress(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5), **kw)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows, **kw), key=repr)


def test_equals_brute_force_with_ties_nulls_and_copies(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.25, -0.001, 0.0, 0.5, 0.5004]) for _ in range(8)], rng.choice([1, 2, None])) for i in range(400)]
    rows += [(7, rows[7][1], 1), (None, [0.5] * 8, None), (900, None, 1), (901, [0.1] * 7 + [None], 1), (902, [0.1] * 7 + [float("nan")], 2), (903, [float("inf")] + [0.0] * 7, 2)]
    same(spark, rows)
    same(spark, rows, entries=30, rounds=2)


def test_fewer_rows_than_entries(spark):
    same(spark, [(i, [i / 3, -i / 7, 0.1, 2.0], 1) for i in range(5)])


def test_large_components_stay_exact(spark):
    rng = random.Random(5)
    same(spark, [(i, [rng.choice([1e5, -3e6, 0.1, 12345.678]) * rng.random() for _ in range(8)], i % 3) for i in range(60)], entries=20)


def test_empty_table_other_lengths_and_decoding(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(1, [0.5] * 8, 1, ""), (2, [0.25] * 4, 1, ""), (3, [], None, ""), (4, [0.75] * 8, 2, "")], SCHEMA)
    got = {r["vec_id"]: r for r in codes.compress(rows).collect()}
    assert got[2]["code"] is None and got[3]["error"] is None and got[1]["code"] == "00000000" and got[4]["code"] == "01010101"
    dimensions, books = codes.fit_codebooks(codes.kept_vectors(rows))
    assert dimensions == 8
    back = codes.decoded(codes.compress(rows).where("code is not null"), books).select("vec_id", "decoded").collect()
    assert {r["vec_id"]: r["decoded"] for r in back} == {1: [0.5] * 8, 4: [0.75] * 8}


def test_lengths_that_dont_divide_have_no_code(spark):
    rows = spark.createDataFrame([(1, [0.5] * 6, 1, ""), (2, [0.5] * 6, None, "")], SCHEMA)
    assert [(r["code"], r["error"], r["label_error"]) for r in codes.compress(rows).collect()] == [(None, None, None)] * 2


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    for size, width in ((1, 3), (13, 1), (256, 4), (200, 16)):
        entries = rng.integers(-5, 6, (size, width))
        points = rng.integers(-7, 8, (500, width))
        found, squares = codes.BallTree(entries.tolist()).nearest(points)
        scan = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (found == scan.argmin(1)).all() and (squares == scan.min(1)).all()
