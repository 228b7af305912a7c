from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np

from flowlens.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(spark, rows, near=0):
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    of = defaultdict(int)
    for i, _, s in rows:
        of[s] += size[i]
    targets, source = brute_targets(of), {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == of[source[r["doc_id"]]]
        assert abs(r["target"] - targets[source[r["doc_id"]]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[source[r["doc_id"]]] += r["taken"]
    for s in of:
        assert -1e-6 <= targets[s] - taken[s] < near + 1, s
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))


def test_targets_and_words_taken(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 7, 50, 400, 90])), rng.choice(["a", "a", "a", "a", "B", "é", "zz", None, "\U0001f600", "￮"])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "empty"), (5002, "  ", None)]
    check(spark, rows)


def test_one_source_one_document_and_empty(spark):
    check(spark, [(1, "a b c", "x")], near=3)
    check(spark, [(1, None, "x"), (2, "", None)])
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_length_is_ranked_in_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 10)
    check(spark, [(i, "a b c", "x" if i % 3 else "y") for i in range(500)], near=3)


def test_mixed_documents_repeat_rows(spark):
    rows = [(i, "a b " * (i % 5 + 1), "xyz"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(df).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in want.items() if v}


def test_fill_reaches_the_budget():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = np.unique(rng.integers(1, 300, rng.integers(1, 30)))
        counts = rng.integers(1, 50, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        taken = mixing.fill(lengths, counts, budget, table=500)
        words = int((lengths * taken).sum())
        assert (taken >= 0).all() and (taken <= counts).all() and words <= budget
        if budget <= (lengths * counts).sum():
            assert budget - words < lengths.max()
    assert mixing.fill(np.array([5]), np.array([3]), 14).tolist() == [2]
    assert mixing.fill(np.array([3, 5]), np.array([2, 2]), 11).tolist() == [2, 1]


def test_choice_is_the_same_however_documents_are_dealt(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.choice([1, 2, 3]) for _ in range(rng.choice([3, 5, 8]))), "ab"[i % 3 == 0], "x", 1) for i in range(3000)] + [(7, "w w w", "a", "x", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string, place int")
    one = sorted(tuple(r) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "RANK_ROWS", 50)
    assert sorted(tuple(r) for r in mixing.mix(df).collect()) == one
    assert len(one) == len(rows)


def test_long_texts(spark):
    rows = [(1, "w " * 300_000, "a"), (2, "w", "a"), (3, "x y z", "b"), (4, None, None)]
    out = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [out[i]["size"] for i in (1, 2, 3, 4)] == [300_000, 1, 3, 0] and out[4]["taken"] == 0
