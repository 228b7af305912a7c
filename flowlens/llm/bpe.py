"""Byte-level BPE encoding and decoding: pieces of equal length class are merged together as rows of one padded matrix."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordCache

#: Widths of the matrices; a piece goes to the narrowest that holds its bytes.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024)
#: Cells of one matrix, which bounds a task's memory.
CELLS = 1 << 21
#: Pieces that a task holds before it encodes them together, and ids in one batch that it returns.
HELD_PIECES = 1 << 18
#: No pair: larger than every rank.
NONE = np.iinfo(np.int32).max


class PairTable:
    """Rank of every pair of ids that makes a token, in an open-addressed hash table that numpy probes for many pairs at once."""

    def __init__(self, pairs: dict[tuple[int, int], int], size: int):
        self.size = size
        bits = max(4, (2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        ranks = np.array(list(pairs.values()), np.int32)
        at = self._slots(keys)
        while len(keys):  # of pairs that want one free slot the first takes it, the others go on to the next
            free = np.flatnonzero(self.keys[at] < 0)
            took = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[took]], self.ranks[at[took]] = keys[took], ranks[took]
            left = np.ones(len(keys), bool)
            left[took] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, ``NONE`` for those that make no token."""
        keys = left.astype(np.int64) * self.size + right
        at = self._slots(keys)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (held >= 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out


class Vocabulary:
    """Ranks of a ``.tiktoken`` file: lines of a token in base 64 and its rank, which is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing}")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get, self.pairs = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        self.table = PairTable(self.pairs, max(self.tokens) + 1)

    def encode_many(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers."""
        octets = [p.encode("utf-8") for p in pieces]
        out: list[bytes] = [b""] * len(octets)
        buckets: dict[int, list[int]] = {}
        for i, o in enumerate(octets):
            whole = self.ranks.get(o)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif o:
                buckets.setdefault(int(np.searchsorted(WIDTHS, len(o))), []).append(i)
        for k, members in buckets.items():
            if k == len(WIDTHS):
                for i in members:
                    out[i] = self.merged_by_heap(octets[i])
                continue
            step = max(1, CELLS // WIDTHS[k])
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self.merged_in_matrix([octets[i] for i in part], WIDTHS[k]), strict=True):
                    out[i] = ids
        return out

    def merged_in_matrix(self, octets: list[bytes], width: int) -> list[bytes]:
        """Merges rows of at most ``width`` bytes: each round every row merges its leftmost pair of least rank.

        A row that merges loses one cell, so all rows left are moved together
        into a matrix one column narrower; rows without a pair leave it.
        """
        length = np.fromiter(map(len, octets), np.int64, len(octets))
        cells = np.frombuffer(b"".join(o.ljust(width, b"\0") for o in octets), np.uint8).reshape(-1, width)
        ids = self.of_byte[cells]
        rank = np.full((len(octets), width - 1), NONE, np.int32)
        r, c = np.nonzero(np.arange(width - 1) < length[:, None] - 1)
        rank[r, c] = self.table.lookup(ids[r, c], ids[r, c + 1])
        rows, out = np.arange(len(octets)), [b""] * len(octets)
        while len(rows):
            place = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), place] if rank.shape[1] else np.full(len(rows), NONE, np.int32)
            done = np.flatnonzero(least == NONE)
            if len(done):
                final = ids[done].astype("<i4")
                for k, row, n in zip(range(len(done)), rows[done].tolist(), length[done].tolist(), strict=True):
                    out[row] = final[k, :n].tobytes()
                on = np.flatnonzero(least != NONE)
                rows, ids, rank, length, place, least = rows[on], ids[on], rank[on], length[on], place[on], least[on]
                if not len(rows):
                    break
            width, length, every = ids.shape[1] - 1, length - 1, np.arange(len(rows))
            columns = np.arange(width)
            ids = np.take_along_axis(ids, columns + (columns > place[:, None]), axis=1)
            ids[every, place] = least
            rank = np.take_along_axis(rank, columns[:-1] + (columns[:-1] >= place[:, None]), axis=1)
            for at, on in ((place - 1, place > 0), (place, place + 1 < length)):
                r = np.flatnonzero(on)
                rank[r, at[r]] = self.table.lookup(ids[r, at[r]], ids[r, at[r] + 1])
        return out

    def merged_by_heap(self, octets: bytes) -> bytes:
        """The same merges for a piece wider than any matrix, in time near its length."""
        ids = self.of_byte[np.frombuffer(octets, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                rank = pairs.get((ids[i], ids[j]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:  # one of the two has merged since
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x >= 0], "<i4").tobytes()


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each Python worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text.

    Each match of ``pattern`` is encoded by itself with the ranks of the file at
    ``path``, which every executor must have. A null or empty text has no ids;
    repeated rows and null ids are rows like others; other columns of ``docs``
    aren't returned. Pieces seen before come from a bounded cache of the task,
    new ones are encoded together. Memory follows the longest text of a batch.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, find = vocabulary(path), regex.compile(pattern).findall
        cache = WordCache(lambda piece: vocab.encode_many([piece])[0], encode_many=vocab.encode_many)

        def encoded(doc_ids: list, held: list[list[str]]) -> pa.RecordBatch:
            cache.learn(held)
            texts = [b"".join(map(cache.__getitem__, pieces)) for pieces in held]
            offsets = np.concatenate([[0], np.cumsum([len(t) // 4 for t in texts])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(texts), "<i4")))
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), ids], names=["doc_id", "ids"])

        for batch in batches:
            doc_ids, held, total = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                held.append(find(text.as_py() or ""))
                total += len(held[-1])
                if total >= HELD_PIECES:
                    yield encoded(doc_ids, held)
                    doc_ids, held, total = [], [], 0
            if held:
                yield encoded(doc_ids, held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (binary): the bytes of the ids; null where ids are null or hold a null or an id that is no token."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        token = [tokens.get(i) for i in range(max(tokens) + 1)]

        def octets(ids: pa.Array) -> bytes | None:
            if ids.null_count:
                return None
            ids = ids.to_numpy()
            if len(ids) and (ids.min() < 0 or ids.max() >= len(token)):
                return None
            found = [token[i] for i in ids.tolist()]
            return None if None in found else b"".join(found)

        for batch in batches:
            ids = batch.column(1)
            decoded = pa.array([None if x.values is None else octets(x.values) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], names=["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(each, "doc_id long, ids array<int>, decoded binary")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what ``decode`` returns."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
