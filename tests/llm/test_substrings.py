from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flowlens.llm import substrings

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def corpus(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    text = lambda k: [f"w{rng.randrange(vocabulary)}" for _ in range(k)]
    passages = [text(k) for k in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(n):
        w = text(rng.choice([3, 40, 150, 700]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    loop = " ".join(["a", "b", "c"] * 60)
    rows += [(n, loop), (n + 1, "x " * 36), (n + 2, "x " * 35), (n + 3, rows[0][1]), (n + 3, rows[0][1]), (n + 4, rows[1][1].replace("\n", " ") + " tail")]
    return [*rows, (None, rows[2][1] + " é"), (900, None), (901, ""), (902, " ")]


@pytest.mark.parametrize(("seed", "window", "anchor"), [(1, 35, 8), (2, 35, 8), (3, 6, 2)])
def test_equals_brute_force(spark, seed, window, anchor):
    rows = corpus(seed, vocabulary=400 if window > 9 else 60)
    assert got(substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), window, anchor)) == brute(rows, window)


def test_text_columns_and_empty(spark):
    assert got(substrings.remove_repeats(spark.createDataFrame([], SCHEMA))) == []
    rows = [(1, "a b c d e f", "x", 1), (2, "z a b c d e", "y", 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", g string, start int")
    out = {r["doc_id"]: r["kept"] for r in substrings.remove_repeats(df, 5, 2, with_text=True).collect()}
    assert out == {1: "f", 2: "z"}


def test_rolling_hashes_depend_on_the_words_only():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    hashes = substrings.rolling_hashes(values, 35, substrings.BASES[0])
    assert len(np.unique(hashes)) == len(hashes)
    assert (substrings.rolling_hashes(values[100:300], 35, substrings.BASES[0]) == hashes[100:266]).all()
    assert len(substrings.rolling_hashes(values[:34], 35, substrings.BASES[0])) == 0
