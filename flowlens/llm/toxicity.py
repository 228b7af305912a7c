"""Operator 10: toxic spans by a conditional random field over words, and scores of whole documents from its marginals."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import crf
from .words import WORD_PATTERN, WordCache, words_of

#: Labelled documents that a model learns from at most, chosen by a hash of the id.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1000, 3000
#: Bytes of text of each label that a model learns from at most.
SAMPLE_BYTES = 64 << 20
#: Lengths of word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6, 7)
#: Words kept on either side of a marked one in a training sequence, and the longest such sequence.
AROUND, LONGEST = 4, 40
#: A feature marks words if it is this many times as frequent in toxic documents, and that is no chance.
LIFT = 5.0
THRESHOLD = 0.7
FEATURES = 20_000


def features(word: str) -> list[str]:
    """The word in small letters without what isn't a letter or digit at its ends, and its beginnings."""
    w = re.sub(r"^[\W_]+|[\W_]+$", "", word.lower())
    return [f"={w}", *(w[:k] for k in PREFIXES if len(w) > k)] if w else []


@dataclass
class Model:
    chain: crf.Chain = field(default_factory=crf.Chain)
    #: Logistic weights of a document's evidence: bias, log(1 + sum of marginals), largest marginal.
    document: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def word_score(self, word: bytes) -> float:
        """Score of label 1 above the bias; 0 if no feature is known."""
        weights = self.chain.weights
        return sum(weights.get(f, 0.0) for f in features(word.decode("utf-8", "surrogatepass")))

    def marks(self, words: list[bytes], scores: WordScores) -> tuple[list[int], list[float]]:
        """Places of the words with evidence, and the marginal probability of each to be toxic."""
        found = np.fromiter(map(scores.__getitem__, words), dtype=np.float64, count=len(words))
        at = np.flatnonzero(found)
        if not len(at):
            return [], []
        return at.tolist(), self.chain.marginals(len(words), at.tolist(), (found[at] + self.chain.bias).tolist())

    def score(self, marginals: list[float]) -> float:
        z = self.document[0] + self.document[1] * math.log1p(sum(marginals)) + self.document[2] * max(marginals, default=0.0)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


class WordScores(WordCache):
    """Remembers the score of each word."""


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learnt from: crc32 of its id as text, modulo 3, is 1. Null ids: false."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train_model(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE) -> Model:
    """Learns from a bounded sample of labelled documents that aren't held out.

    Ids are chosen first, in the order of a hash, so only the sample's texts
    reach the driver: at most ``toxic_sample`` and ``clean_sample`` documents,
    and of each label those that come before ``SAMPLE_BYTES`` of text are full.
    Of rows that repeat an id the smallest text counts.
    Without documents of both labels the model has no evidence and scores all
    documents alike, below the threshold.
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit(3), "doc_id")
    chosen = [known.where(F.col("toxic") == t).dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(n) for t, n in ((1, toxic_sample), (0, clean_sample))]
    ids = chosen[0].unionByName(chosen[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # At most one row a sampled id is left, so one task orders them.
    before = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("toxic").orderBy(order, "doc_id"))
    rows = rows.withColumn("_upto", before).where(F.col("_upto") <= SAMPLE_BYTES).orderBy(order, "doc_id").select("text", "toxic").collect()
    return fit([(r["text"] or "", r["toxic"]) for r in rows])


def _words(text: str) -> list[str]:
    """Words as scoring cuts them."""
    return [w.decode("utf-8", "surrogatepass") for w in words_of(text)]


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from texts and labels of whole documents.

    Words are labelled first: features far more frequent in toxic documents than
    in clean ones, counted once for equal neighbours as copies have them, mark
    the words of toxic documents that have them. The chain is
    trained on the marked words with their neighbours, on words of clean
    documents with such a feature, and on other words of clean documents.
    """
    toxic, clean = ([t for t, y in rows if y == label] for label in (1, 0))
    if not toxic or not clean:
        return Model()
    of = lru_cache(maxsize=50_000)(features)
    in_toxic = Counter(f for text in toxic for f in {f for w in set(_words(text)) for f in of(w)})
    often = {f: n for f, n in in_toxic.items() if n >= 3}
    del in_toxic
    in_clean = Counter(f for text in clean for f in {f for w in set(_words(text)) for f in of(w) if f in often})
    frequent = {f: n for f, n in often.items() if _lift(n, len(toxic), in_clean[f], len(clean), len(often))}
    places: dict[str, set[tuple[str, str]]] = {f: set() for f in frequent}
    for text in toxic:
        words = ["", *_words(text), ""]
        for before, w, after in zip(words, words[1:], words[2:], strict=False):
            for f in of(w):
                if f in places:
                    places[f].add((before, after))
    apart = {f: min(n, len(places[f])) for f, n in frequent.items()}  # copies of one document are one place
    marked = set(sorted((f for f, n in apart.items() if _lift(n, len(toxic), in_clean[f], len(clean), len(often))), key=lambda f: (-apart[f], f))[:FEATURES])
    sequences, labels = [], []
    for label, texts in ((1, toxic), (0, clean)):
        for n, text in enumerate(texts):
            words = _words(text)
            evident = {w for w in set(words) if not marked.isdisjoint(of(w))}
            hits = {i for i, w in enumerate(words) if w in evident}
            near = sorted({j for i in hits for j in range(max(0, i - AROUND), min(len(words), i + AROUND + 1))})
            if not hits and label == 0:
                begin = n * 7919 % max(1, len(words))
                near = list(range(begin, min(len(words), begin + 2 * AROUND)))
            runs: list[list[int]] = []
            for j in near:
                if runs and j == runs[-1][-1] + 1 and len(runs[-1]) < LONGEST:
                    runs[-1].append(j)
                else:
                    runs.append([j])
            for run in runs:
                sequences.append([[f for f in of(words[j]) if f in marked] for j in run])
                labels.append([int(label == 1 and j in hits) for j in run])
    model = Model(crf.train(sequences, labels, rounds=80))
    scores = WordScores(model.word_score, limit=50_000)
    evidence = [(model.marks(words_of(text), scores)[1], y) for y, texts in ((1, toxic), (0, clean)) for text in texts]
    model.document = _logistic(evidence)
    return model


def _lift(a: int, n_a: int, b: int, n_b: int, tests: int) -> bool:
    """Whether a of n_a is LIFT times b of n_b and more than chance makes of so many tests, by a likelihood ratio."""
    if a / n_a < LIFT * (b + 0.1) / n_b:
        return False
    p = (a + b) / (n_a + n_b)
    term = lambda x, n, q: (x * math.log(q) if x else 0.0) + ((n - x) * math.log(1 - q) if n > x else 0.0)
    return term(a, n_a, a / n_a) + term(b, n_b, b / n_b) - term(a, n_a, p) - term(b, n_b, p) > math.log(tests) + 3


def _logistic(evidence: list[tuple[list[float], int]], rounds: int = 400, l2: float = 1e-3) -> tuple[float, float, float]:
    x = np.array([[1.0, math.log1p(sum(p)), max(p, default=0.0)] for p, _ in evidence])
    y = np.array([float(t) for _, t in evidence])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + (l2 + 1e-6) * np.eye(3)
        step = np.linalg.solve(h, x.T @ (p - y) / len(y) + l2 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every row of ``docs``.

    ``spans`` are (begin, end) in code points of runs of words that are more
    likely toxic than not. Words without any known feature are never reported,
    but their number between others counts. Null, empty and blank texts have no
    evidence and get the score of that. Null ids stay and aren't held out;
    repeated rows come back as often. Labels, language, source and id are not
    part of a score; other columns are not read.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = WordScores(model.word_score)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                at, marginals = model.marks(words_of(text), scores)
                rows.append((doc_id, model.score(marginals), _spans(text, at, marginals) if at else []))
            out = pd.DataFrame(rows, columns=["doc_id", "score", "spans"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(each, "doc_id long, score double, spans array<struct<begin:int,end:int>>")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def _spans(text: str, at: list[int], marginals: list[float]) -> list[dict[str, int]]:
    toxic = {i for i, p in zip(at, marginals, strict=True) if p >= 0.5}
    out: list[dict[str, int]] = []
    last = -2
    for i, m in enumerate(re.finditer(WORD_PATTERN, text)):
        if i in toxic:
            if last == i - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"begin": m.start(), "end": m.end()})
            last = i
    return out


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that a model trained on ``labels`` doesn't reject, all columns as they are; no shuffle."""
    model = train_model(docs, labels)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(model.word_score)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(model.marks(words_of(t), scores)[1]) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
