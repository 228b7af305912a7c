from __future__ import annotations

import random

import pytest
import xxhash

from flowlens.llm import simhash

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text, width=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, most_bits=4):
    prints = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= most_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, f"{prints[i]:016x}", find(i)) for i in ids}


def got(df):
    return {tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()}


def test_equals_brute_force_with_near_copies(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)] + ["É", "ß", "Ünd"]
    base = [[rng.choice(words) for _ in range(rng.choice([5, 60, 400]))] for _ in range(60)]
    rows = []
    for b in base:
        rows.append(" ".join(b))
        for _ in range(rng.randrange(4)):
            c = list(b)
            c[rng.randrange(len(c))] = "changed"
            rows.append("\t".join(c) if rng.random() < 0.5 else " ".join(c).upper())
    rows += ["", None, " \n ", "one two", "one two", "ONE Two", "a b c d", "x " * 3000]
    rows = list(enumerate(rows))
    assert got(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute_components(rows)


def test_empty_null_and_clashing_columns(spark):
    assert got(simhash.near_duplicates(spark.createDataFrame([], SCHEMA))) == set()
    rows = [(1, None, "x", "y", "z"), (1, None, "x", "y", "z"), (None, "a b c", "x", "y", "z"), (3, "a b c", "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string, rep string")
    assert sorted(map(str, (tuple(r) for r in simhash.near_duplicates(df).collect()))) == sorted(
        map(str, [(1, "0" * 16, 1), (1, "0" * 16, 1), (None, f"{brute_fingerprint('a b c'):016x}", 3), (3, f"{brute_fingerprint('a b c'):016x}", 3)])
    )
    kept = simhash.keep_first_of_each_group(df)
    assert kept.columns == df.columns


def test_thresholds_add_up_and_cover():
    import numpy as np

    cost, reach = simhash.allocate([[0, 5, 50, 500]] * 3, 2)
    assert sum(reach) == 2 and cost == 105
    groups = simhash.group_bits(np.random.default_rng(1).random((64, 64)), 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


@pytest.mark.parametrize("reach", [0, 1, 2])
def test_flip_masks_meet_once(reach):
    bits = 0b1011 << 60
    masks = simhash.flip_masks(simhash._signed(bits), reach)
    u = (1 << 64) - 1
    values = [sum(1 << b for k, b in enumerate((60, 61, 63)) if v >> k & 1) for v in range(8)]
    for a in values:
        for b in values:
            met = sum((x & u) == (a ^ b) and not a & (t & u) for x, t in masks) + sum((x & u) == (a ^ b) and not b & (t & u) for x, t in masks)
            assert met == (2 if a == b else int((a ^ b).bit_count() <= reach))


def test_rows_without_id_bridge_others(spark, monkeypatch):
    prints = {"a": 0, "b": 0b1111, "c": 0b11111111, "d": -1}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: spark.createDataFrame([(r["doc_id"], prints[r["text"]]) for r in docs.collect()], "doc_id long, fp long"))
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c"), (None, "d"), (None, "d")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 1), (None, 1), (3, 1), (None, None), (None, None)], key=repr)
