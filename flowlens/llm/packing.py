"""Operator 4: documents packed into token sequences of a fixed size by bounded-space online best-fit."""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .words import WordCache

SEQUENCE_TOKENS = 4096
END_ID = 1
OPEN_BINS = 1024
#: Most tokens and pieces that one packing task gets. Each task ends with a few bins that aren't full.
TASK_TOKENS, TASK_PIECES = 1 << 24, 1 << 18
#: Unknown words encoded in one call, and words of documents looked up together.
ENCODED_TOGETHER, LEARNT_TOGETHER = 4096, 400_000
#: Words of small Latin letters (UTF-8), each of which stays one letter; the vocabulary takes them as one piece.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: A mark between a letter and white space is a piece of its own, so it may stand alone.
MARK = re.compile(rb"(?<=[a-z])([.,;:!?])(?=[\x20\x09-\x0D]|\Z)")
_STOP = object()
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    last = np.zeros(tokenizer.get_vocab_size(), dtype=bool)  # whether a token ends a piece of a word
    last[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    to_bytes = lambda ids: np.array(ids, dtype="<u4").tobytes()

    def one(word: bytes) -> bytes:
        return to_bytes(tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids)

    def together(words: list[bytes]) -> list[bytes]:
        done = tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0]
        ids = np.array(done.ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(last[ids]) + 1)
        if len(ends) != len(words):  # another vocabulary may cut words of letters
            return [one(w) for w in words]
        ids, ends = ids.tobytes(), ends.tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def many(words: list[bytes]) -> list[bytes]:
        plain = [w for w in words if PLAIN(w)]
        out: dict[bytes, bytes] = {}
        for i in range(0, len(plain), ENCODED_TOGETHER):
            part = plain[i : i + ENCODED_TOGETHER]
            out.update(zip(part, together(part), strict=True))
        return [out[w] if w in out else one(w) for w in words]

    return WordCache(one, encode_many=many)


def token_bytes(texts: Iterable[str | None], encoder: WordCache, end_id: int = END_ID) -> Iterator[bytes]:
    """Ids of each text and the end id, as little-endian unsigned 32-bit numbers.

    This vocabulary takes small and capital letters alike and never joins what
    white space separates, so each word is encoded once and remembered; the words
    of some texts are looked up together.
    """
    held: list[list[bytes]] = []
    total, last = 0, end_id.to_bytes(4, "little")
    for text in itertools.chain(texts, [_STOP]):
        if text is _STOP or total >= LEARNT_TOGETHER:
            encoder.learn(held)
            for words in held:
                yield b"".join(map(encoder.__getitem__, words)) + last
            held, total = [], 0
        if text is not _STOP:
            held.append(_pieces(text))
            total += len(held[-1])


def _pieces(text: str | None) -> list[bytes]:
    octets = text.encode("utf-8", "surrogatepass") if text else b""
    if b"<|" in octets:  # its special tokens have small letters only
        return octets.split()
    return MARK.sub(rb" \1", octets.lower()).split()


def token_pieces(docs: DataFrame, tokenizer: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``sequence_tokens`` of every document's ids; only longer documents are cut.

    A null or empty text has the end id alone. ``with_ids`` adds the ids as a
    binary column of little-endian unsigned 32-bit numbers.
    """
    step = 4 * sequence_tokens

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].array, token_bytes(batch["text"].array, encoder), strict=True):
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(each, PIECES + (", ids binary" if with_ids else ""))


class OpenBins:
    """A fixed number of open bins, found by free space through a bitset; the fullest closes when another must open."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.free, self.at, self.open, self.made = 0, [[] for _ in range(size + 1)], 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of the next piece: the open bin that it leaves fullest, else a new one."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            found = self._take(room)
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            room, found = self.size, self.made
            self.made += 1
            self.open += 1
        left = room - length
        if left:
            self.at[left].append(found)
            self.free |= 1 << left
        else:
            self.open -= 1
        return found, self.size - room

    def _take(self, room: int) -> int:
        bins = self.at[room]
        found = bins.pop()
        if not bins:
            self.free &= ~(1 << room)
        return found


def pack(docs: DataFrame, tokenizer: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, seed: int = 7) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, and its sequence_id and offset there.

    Pieces are dealt by hash to as many tasks as their tokens and number ask
    for, so neither a large source nor a long document makes a task larger.
    Within a task they come in the order of a hash, which makes a task that runs
    again pack the same. Repeated rows pack as often as they come; null texts
    count as empty; null ids are kept; an empty table gives no rows. Other
    columns are not read.
    """
    pieces = materialize(token_pieces(docs, tokenizer, sequence_tokens), "pieces")
    return place_pieces(pieces, sequence_tokens, open_bins, seed)


def place_pieces(pieces: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, seed: int = 7) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length."""
    total, count = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = max(1, -(-total // TASK_TOKENS), -(-count // TASK_PIECES))
    order = F.xxhash64(F.lit(seed), "doc_id", "piece")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def each(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bins = OpenBins(sequence_tokens, open_bins)
        group = group.sort_values(["_order", "doc_id", "piece"], kind="stable")
        placed = [bins.place(n) for n in group["length"].tolist()]
        group["sequence_id"] = [(int(key[0]) << 32) + b for b, _ in placed]
        group["offset"] = [at for _, at in placed]
        return group.drop(columns=["_order", "_task"])

    dealt = pieces.withColumn("_order", order).withColumn("_task", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "piece"), F.lit(tasks)))
    return dealt.repartition(tasks, "_task").groupBy("_task").applyInPandas(each, schema)


def sequences(docs: DataFrame, tokenizer: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, seed: int = 7) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens and ids (little-endian unsigned 32-bit numbers)."""
    pieces = materialize(token_pieces(docs, tokenizer, sequence_tokens, with_ids=True).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = place_pieces(pieces.drop("ids"), sequence_tokens, open_bins, seed).select("row", "sequence_id", "offset")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = placed.join(pieces.select("row", "ids"), "row")
    return rows.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate(F.col("parts.ids"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids")).withColumn("n_tokens", F.expr("octet_length(ids) div 4"))
