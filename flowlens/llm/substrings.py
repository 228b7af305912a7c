"""Operator 7: word passages that repeat anywhere in a corpus, found by rolling hashes of every window."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, shared_folder
from .words import WordCache, words_of

WINDOW = 35
#: Words of an anchor. The least anchor of a window stands for it in the first count.
ANCHOR = 8
#: Most bytes of texts in a bucket on average, so buckets grow in number with the corpus.
BUCKET_BYTES = 64 << 20
#: Odd bases of the rolling hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes], cache: WordCache) -> np.ndarray:
    """Two 64-bit hashes of every word."""
    return np.frombuffer(b"".join(map(cache.__getitem__, words)), dtype="<u8").reshape(-1, 2)


def rolling_hashes(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of every run of ``width`` values.

    Differences of one running sum give all of them at once: the sum weighs
    value j with the inverse base to the power j, and each difference is raised
    again by a power of the base.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    inverse = pow(base, -1, 1 << 64)
    down = np.full(len(values), inverse, dtype=np.uint64)
    down[0] = 1
    up = np.full(n, base, dtype=np.uint64)
    up[0] = pow(base, width - 1, 1 << 64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * np.cumprod(down), dtype=np.uint64)])
    return (sums[width:] - sums[:-width]) * np.cumprod(up)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or largest of every ``width`` neighbours, in steps that double."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``anchor`` words, and for each window the least of those inside it."""
    grams = rolling_hashes(hashes[:, 0], anchor, BASES[0])
    return grams, _sliding(grams, window - anchor + 1, np.minimum)


def anchor_places(grams: np.ndarray, least: np.ndarray, reach: int) -> np.ndarray:
    """Whether a run is the least of some window that holds it."""
    pad = np.zeros(reach - 1, dtype=np.uint64)
    return _sliding(np.concatenate([pad, least, pad]), reach, np.maximum) == grams


def covered(starts: np.ndarray, window: int, words: int) -> np.ndarray:
    """Which words lie in a window that begins at one of ``starts``: the union of the removal intervals."""
    edge = np.zeros(words + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _new_cache() -> WordCache:
    return WordCache(xxhash.xxh3_128_digest)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``; ``with_text`` adds the kept words.

    A word goes if a window of ``window`` words covers it whose word sequence
    begins anywhere else too, in this text or another. Null, empty and short
    texts lose nothing; rows with equal texts, repeated rows among them, lose
    every word if they have a window. Null ids stay. Other columns are not read.

    1. Equal texts become one row, combined before the shuffle, and are written
       once in buckets of their key, so that nothing later shuffles texts.
    2. Every text gives its anchors: in each window the least hash of ``anchor``
       words. A window that repeats has an anchor that repeats, so only windows
       whose anchor was counted twice go on. This drops no window that counts.
    3. The rolling hashes of those windows, 128 bits, are counted with partial
       sums before the shuffle, so a passage in every document is no hot group.
       A window counted once goes back to its text, with no join; all others of
       step 2 repeat.
    4. Each text unites its repeated windows to intervals and drops their words.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2"))
    texts = _distinct_texts(keyed)
    found = materialize(_anchor_rows(texts, window, anchor), "anchors")
    often = found.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g")
    wanted = materialize(found.join(often, "g").groupBy("k1", "k2").agg(F.collect_list("g").alias("gs")), "wanted")
    discard(found)
    held = texts.join(wanted, ["k1", "k2"], "left")
    counted = _window_rows(held, window, anchor).groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("k1", "k2", "start")])
    once = materialize(counted.where("n = 1").groupBy("k1", "k2").agg(F.collect_list("start").alias("starts")), "once")
    results = _kept(held.join(once, ["k1", "k2"], "left"), window, anchor, with_text)
    columns = [F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("kept_sha256")]
    if with_text:
        columns.append(F.coalesce("kept", F.lit("")).alias("kept"))
    return keyed.select("doc_id", "k1", "k2").join(results, ["k1", "k2"], "left").select("doc_id", *columns)


def _distinct_texts(keyed: DataFrame) -> DataFrame:
    """k1, k2, text and copied (whether more than one row has the text), in buckets of (k1, k2) in the shared folder."""
    spark = keyed.sparkSession
    octets = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-octets // BUCKET_BYTES))
    name = f"flowlens_texts_{uuid.uuid4().hex}"
    texts = keyed.where("text is not null").groupBy("k1", "k2").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("copied"))
    texts.write.bucketBy(parts, "k1", "k2").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _anchor_rows(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """k1, k2, g, n: the anchors of each text and at how many places they are anchors there."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _new_cache()
        for batch in batches:
            for part in _slices(batch):
                rows = []
                for k1, k2, text in zip(part["k1"], part["k2"], part["text"], strict=True):
                    words = words_of(text)
                    if len(words) >= window:
                        grams, least = anchors(word_hashes(words, cache), window, anchor)
                        g, n = np.unique(grams[anchor_places(grams, least, window - anchor + 1)], return_counts=True)
                        rows.append((np.full(len(g), k1), np.full(len(g), k2), g.view(np.int64), n))
                if rows:
                    yield _frame(rows, ["k1", "k2", "g", "n"])

    return texts.select("k1", "k2", "text").mapInPandas(each, "k1 long, k2 long, g long, n long")


def _candidates(words: list[bytes], gs: np.ndarray | None, cache: WordCache, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the starts of the windows whose anchor is one of ``gs``."""
    if gs is None or len(words) < window:
        return np.zeros((0, 2), dtype=np.uint64), np.zeros(0, dtype=np.int64)
    hashes = word_hashes(words, cache)
    _, least = anchors(hashes, window, anchor)
    gs = np.sort(np.asarray(gs, dtype=np.int64).view(np.uint64))
    at = np.minimum(np.searchsorted(gs, least), len(gs) - 1)
    return hashes, np.flatnonzero(gs[at] == least)


def _window_rows(held: DataFrame, window: int, anchor: int) -> DataFrame:
    """h1, h2, k1, k2, start of every window that may repeat; h2 is 32 bits wide."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _new_cache()
        for batch in batches:
            for part in _slices(batch):
                rows = []
                for k1, k2, text, gs in zip(part["k1"], part["k2"], part["text"], part["gs"], strict=True):
                    hashes, starts = _candidates(words_of(text), gs, cache, window, anchor)
                    if len(starts):
                        h1, h2 = (rolling_hashes(hashes[:, c], window, BASES[c])[starts] for c in (0, 1))
                        rows.append((h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(starts), k1), np.full(len(starts), k2), starts.astype(np.int32)))
                if rows:
                    yield _frame(rows, ["h1", "h2", "k1", "k2", "start"])

    return held.where("gs is not null").select("k1", "k2", "text", "gs").mapInPandas(each, "h1 long, h2 int, k1 long, k2 long, start int")


def _kept(held: DataFrame, window: int, anchor: int, with_text: bool) -> DataFrame:
    """k1, k2, n_words, n_removed, kept_sha256 and, if asked for, the kept words of each text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _new_cache()
        for batch in batches:
            rows = []
            for k1, k2, text, copied, gs, once in zip(batch["k1"], batch["k2"], batch["text"], batch["copied"], batch["gs"], batch["starts"], strict=True):
                words = words_of(text)
                if copied and len(words) >= window:
                    kept = []
                else:
                    _, starts = _candidates(words, gs, cache, window, anchor)
                    if once is not None and len(starts):
                        starts = np.setdiff1d(starts, np.asarray(once, dtype=np.int64), assume_unique=True)
                    kept = words
                    if len(starts):
                        gone = covered(starts, window, len(words))
                        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(kept)
                rows.append((k1, k2, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *([joined.decode("utf-8", "surrogatepass")] if with_text else [])))
            yield pd.DataFrame(rows, columns=["k1", "k2", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])])

    return held.select("k1", "k2", "text", "copied", "gs", "starts").mapInPandas(each, "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))


def _slices(batch: pd.DataFrame, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about ``chars`` characters, so that what is made of them stays small."""
    part = batch["text"].str.len().cumsum() // chars
    for _, rows in batch.groupby(part, sort=False):
        yield rows


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({name: np.concatenate([r[i] for r in rows]) for i, name in enumerate(names)})
