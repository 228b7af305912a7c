from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from flowlens.llm import crf, toxicity

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def all_labellings(chain, scores):
    out = {}
    for y in itertools.product((0, 1), repeat=len(scores)):
        z = chain.start[y[0]] + chain.end[y[-1]] + sum(e for e, t in zip(scores, y, strict=True) if t)
        out[y] = z + sum(chain.step[a][b] for a, b in itertools.pairwise(y))
    return out


def test_marginals_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        r = rng.normal(size=9).tolist()
        chain = crf.Chain({}, r[0], ((r[1], r[2]), (r[3], r[4])), (r[5], r[6]), (r[7], r[8]))
        at = sorted(rng.choice(n, int(rng.integers(1, n + 1)), replace=False).tolist())
        own = rng.normal(size=len(at)).tolist()
        scores = [own[at.index(i)] if i in at else chain.bias for i in range(n)]
        z = all_labellings(chain, scores)
        total = sum(math.exp(v) for v in z.values())
        want = [sum(math.exp(v) for y, v in z.items() if y[i]) / total for i in at]
        assert chain.marginals(n, at, own) == pytest.approx(want, abs=1e-9)
        assert z[tuple(chain.best(scores))] == pytest.approx(max(z.values()))
    assert crf.Chain().best([]) == [] and crf.Chain().marginals(0, [], []) == []


def test_training_raises_the_likelihood():
    rng = random.Random(1)
    seqs, labels = [], []
    for _ in range(150):
        y = [0]
        for _ in range(rng.randrange(1, 12)):
            y.append(y[-1] if rng.random() < 0.8 else 1 - y[-1])
        seqs.append([["a" if rng.random() < (0.9 if t else 0.2) else "b"] for t in y])
        labels.append(y)
    chain = crf.train(seqs, labels)
    right = sum(a == b for s, y in zip(seqs, labels, strict=True) for a, b in zip(chain.best([chain.bias + chain.weights[i[0]] for i in s]), y, strict=True))
    assert right / sum(map(len, labels)) > 0.8
    assert chain.step[0][0] + chain.step[1][1] > chain.step[0][1] + chain.step[1][0]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, toxicity.train_model(docs, labels)).collect()}
    assert len(out) == docs.count() and all(r["held_out"] == held(i) for i, r in out.items())
    known = [(out[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if r["doc_id"] in out and held(r["doc_id"])]
    wrong = sum(p > t for p, t in known)
    assert wrong == 0 and sum(p and t for p, t in known) >= 0.75 * sum(t for _, t in known)


def test_small_and_odd_tables(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(words) for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(60), rng.choice(["Vilest", "vilestly", "ROTTEN!", "rottener"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, " \n"), (None, "w1 vilest rotten w2 vilest rotten"), (903, "w1 vilest rotten w2  vilest rotten"), (903, "w1")]
    docs = spark.createDataFrame([(*r, 1.5, "x") for r in rows], DOCS + ", score double, toxic string")
    labels = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], LABELS)
    out = toxicity.score_documents(docs, toxicity.train_model(docs, labels)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and held(i))
        if i is not None and i < 900:
            assert r["predicted"] == (i % 3 == 0)
        if i in (900, 901, 902):
            assert r["predicted"] == 0 and not r["spans"]
    odd = [r for r in out if r["doc_id"] is None]
    assert odd[0]["predicted"] == 1 and [tuple(s) for s in odd[0]["spans"]] == [(3, 16), (20, 33)]
    stay = toxicity.without_toxic(docs, labels)
    assert stay.columns == docs.columns and stay.count() == sum(r["predicted"] == 0 for r in out)
    empty = spark.createDataFrame([], LABELS)
    assert toxicity.score_documents(docs, toxicity.train_model(docs, empty)).where("predicted = 1").count() == 0
    assert toxicity.score_documents(spark.createDataFrame([], DOCS), toxicity.Model()).count() == 0


def test_scores_equal_enumerated_labels(spark):
    """The query's scores are those of marginals summed over every labelling of a short text."""
    rng = random.Random(8)
    clean, bad = [f"w{i}" for i in range(60)], ["vile", "viler", "rotten"]
    texts = [(" ".join(rng.choice(clean + bad * 6 * (i % 2)) for _ in range(40)), i % 2) for i in range(200)]
    model = toxicity.fit(texts)
    rows = [(i, " ".join(rng.choice(clean[:3] + bad) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    rows += [(100, "w1 " * 200_000 + "vile rotten viler"), (101, "x" * 300_000)]
    out = {r["doc_id"]: r for r in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    chain = model.chain
    for i, text in rows[:-2]:
        words = text.split()
        scores = [chain.bias + model.word_score(w.encode()) for w in words]
        one, total = [0.0] * len(words), 0.0
        for labels in itertools.product((0, 1), repeat=len(words)):
            inner = sum(chain.step[a][b] for a, b in itertools.pairwise(labels))
            weight = math.exp(chain.start[labels[0]] + chain.end[labels[-1]] + inner + sum(s for s, y in zip(scores, labels, strict=True) if y))
            total += weight
            for k, y in enumerate(labels):
                one[k] += weight * y
        evident = [p / total for p, w in zip(one, words, strict=True) if model.word_score(w.encode())]
        z = model.document[0] + model.document[1] * math.log1p(sum(evident)) + model.document[2] * max(evident, default=0.0)
        assert abs(out[i]["score"] - 1 / (1 + math.exp(-z))) < 1e-9
    assert out[100]["spans"] and 0 <= out[101]["score"] <= 1


def test_training_takes_one_row_an_id_and_bounded_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows: seen.append(rows))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100)
    docs = spark.createDataFrame([(i % 9, f"text {i % 9:02d}") for i in range(900)] + [(20, "x" * 99), (21, None), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(25)] + [(3, 1)], "doc_id long, toxic int")
    toxicity.train_model(docs, labels, 3, 50)
    texts = [t for t, _ in seen[0]]
    assert len(texts) <= 13 and len(texts) == len({(t, y) for t, y in seen[0]}) and sum(len(t) for t, y in seen[0] if y == 0) <= 100
