"""Words of a text, shared by the operators that run Python inside tasks.

A word is a maximal run of characters other than space and U+0009 to U+000D.
On UTF-8 bytes that is exactly what ``bytes.split()`` returns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: The same words for Spark's regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Entries of the newer half of a per-task word cache; when it is full, it becomes the older half.
CACHE_ENTRIES = 300_000
#: Longer words are rare and aren't remembered, so that the number of entries bounds the memory.
CACHED_LENGTH = 256


class WordCache(dict):
    """Maps a word to the bytes that ``encode`` makes of it.

    Words used since the last change of halves stay, so frequent words outlive
    the many that occur once. ``encode_many`` does a list of words at once, for
    ``learn``.
    """

    def __init__(self, encode: Callable[[bytes], bytes], limit: int = CACHE_ENTRIES, encode_many: Callable[[list[bytes]], list[bytes]] | None = None):
        super().__init__()
        self.encode, self.limit, self.encode_many, self.older = encode, limit, encode_many, {}

    def __missing__(self, word: bytes) -> bytes:
        self._turn()
        out = self.older.get(word)
        if out is None:
            out = self.encode(word)
        if len(word) <= CACHED_LENGTH:
            self[word] = out
        return out

    def _turn(self) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()

    def learn(self, texts: list[list[bytes]]) -> None:
        """Encodes the words of some texts that aren't known yet, together."""
        self._turn()
        fresh = set().union(*texts).difference(self)
        known = {w: self.older[w] for w in fresh & self.older.keys()}
        self.update(known)
        fresh = [w for w in fresh.difference(known) if len(w) <= CACHED_LENGTH]
        self.update(zip(fresh, self.encode_many(fresh), strict=True))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each begins and ends in it."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends
