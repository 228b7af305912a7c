from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from flowlens.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top, longest=5, share=100):
    count, n = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            count.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *words), a in candidates.items():
        cuts = [(1000 * a * n[lang] // (count[lang, *words[:k]] * count[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        m = len(words)
        inside = any(q[0] == lang and len(q) - 1 > m and 100 * b >= share * a and any(list(q[1 + j : 1 + j + m]) == words for j in range(len(q) - m)) for q, b in candidates.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), count[lang, *words[:k]], count[lang, *words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["New", "york", "City", "of", "the", "émile", "a", "b", " x", "it's", "\x1c"]
    seps = [" ", " ", " ", "  ", "\t", " \t", ", ", "\n", ". "]
    text = lambda: "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(60)))
    return [(text(), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(n)] + [(None, "en"), ("", None), (" \t ", "fr"), ("A b" * 2000, "en")]


@pytest.mark.parametrize("cells", [phrases.CELLS, (1 << 16, 1 << 16), (1 << 24, 1 << 24)])
def test_equals_brute_force(spark, cells):
    docs = made(300)
    frame = spark.createDataFrame([(None if i % 7 == 0 else i, t, g, "p", 1) for i, (t, g) in enumerate(docs)], SCHEMA).repartition(5)
    got = phrases.collocations(frame, least=12, top=25, cells=cells)
    want = brute(docs, 12, 25)
    assert len(want) > 40 and sorted(map(tuple, got.collect())) == want


def test_small_chunks_and_pieces_longer_than_them(spark, monkeypatch):
    docs = made(40, 2) + [("x y z " * 3000, "en"), ("p q. " * 500, "de")]
    monkeypatch.setattr(phrases, "CHUNK", 256)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([g or "und" for _, g in docs]), pa.array([t or "" for t, _ in docs])], names=["lang", "text"])
    counted = Counter()
    for chunk in phrases._chunks(iter([batch])):
        for n in range(1, 6):
            places, _ = chunk.grams(n)
            counted.update((chunk.lang, chunk.phrase(p, n)) for p in places.tolist())
    want = Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang or "und", " ".join(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    assert counted == want


def test_subsumed_by_share(spark):
    docs = [("a b c", "en")] * 9 + [("a b", "en")] * 3
    frame = spark.createDataFrame([(i, t, g, "", 0) for i, (t, g) in enumerate(docs)], SCHEMA)
    for share in (100, 70, 76):
        assert sorted(map(tuple, phrases.collocations(frame, least=5, share=share).collect())) == brute(docs, 5, 2000, share=share)


def test_empty_and_nothing_frequent(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "a b a b", "en", "", 0), (2, None, None, "", 0)], SCHEMA)).collect() == []


def test_products_beyond_64_bits_are_exact(spark):
    big = 9 * 10**14
    ngrams = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 7), ("en", 2, "a b", big - 9)], "lang string, n_words int, phrase string, f long")
    totals = spark.createDataFrame([("en", 8 * 10**18 // 10)], "lang string, n long")
    row = phrases.score(ngrams, totals).first()
    assert row["score"] == 1000 * (big - 9) * (8 * 10**17) // (big * (big - 7))


def test_sketch_keeps_everything_frequent():
    rng = np.random.default_rng(7)
    one, two = rng.integers(0, 2**63, 1000).astype(np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64)
    size = 1 << 16
    bits = []
    for row in range(phrases.DEPTH):
        marks = np.zeros(size, bool)
        marks[phrases._cells([one, two], row, size)[:500]] = True
        bits.append(np.packbits(marks))
    kept = phrases.Survivors(bits, size).has([one, two])
    assert kept[:500].all() and kept[500:].sum() < 5


def test_rows_of_the_exact_pass_follow_cores_not_parts_of_the_input(spark, monkeypatch):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    docs = [(f"a b c d{i % 5} e. f g", ("en", "de")[i // 2 % 2]) for i in range(6400)]
    frame = spark.createDataFrame([(i, t, g, "", 0) for i, (t, g) in enumerate(docs)], SCHEMA).repartition(160)
    made, plain = Observation(), type(frame).mapInArrow

    def watched(self, func, schema, *rest, **named):
        out = plain(self, func, schema, *rest, **named)
        return out.observe(made, F.count(F.lit(1)).alias("rows")) if "phrase" in schema else out

    monkeypatch.setattr(type(frame), "mapInArrow", watched)
    ngrams, totals = phrases.frequent_ngrams(frame)
    assert sorted(map(tuple, totals.collect())) == [("de", 3200 * 7), ("en", 3200 * 7)]
    assert made.get["rows"] <= spark.sparkContext.defaultParallelism * (ngrams.count() + 2)


@pytest.mark.parametrize("bits", [64, 5])
def test_counts_of_a_task_with_few_held_and_equal_first_hashes(monkeypatch, bits):
    import pyarrow as pa

    docs = made(80, 3)
    plain = phrases.WordHashes.of
    monkeypatch.setattr(phrases.WordHashes, "of", lambda self, *a: [plain(self, *a)[0] & np.uint64((1 << bits) - 1), plain(self, *a)[1]])
    for name, value in (("CHUNK", 256), ("HELD", 300), ("BATCH", 16)):
        monkeypatch.setattr(phrases, name, value)
    keeps = phrases.Survivors([np.full(1 << 13, 255, np.uint8)] * phrases.DEPTH, 1 << 16)
    batch = pa.RecordBatch.from_arrays([pa.array([g or "und" for _, g in docs]), pa.array([t or "" for t, _ in docs])], names=["lang", "text"])
    counted = Counter()
    for part in phrases._counts(iter([batch]), 5, keeps, None):
        assert part.num_rows <= 16
        for row in part.to_pylist():
            counted[row["lang"], row["n_words"], row["phrase"]] += row["f"]
    want = Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            want[lang or "und", 0, ""] += len(words)
            want.update((lang or "und", k, " ".join(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    assert counted == want
