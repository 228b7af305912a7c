"""Phrase mining: count-min sketches rule out rare n-grams, a second pass counts the rest exactly, then scores and subsumes."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

LONGEST = 5
LEAST_COUNT = 100
TOP = 2000
#: Rows of a sketch: independent hashes of each n-gram.
DEPTH = 2
#: Blocks of a sketch row, which travel and merge by themselves; a chunk of text makes as many rows at every size.
BLOCKS = 64
#: Least and most cells of a sketch row. Between them it has about one for eight bytes of text, and a bit for each goes to all tasks.
CELLS = (1 << 20, 1 << 27)
#: Phrases that a task counts before it hands the rarer ones on, and most rows that it hands on at once.
HELD, BATCH = 1 << 21, 1 << 16
#: Bytes of text that a task looks at in one go.
CHUNK = 1 << 21

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Two 64-bit hashes of every word of a buffer, from running sums of bytes times powers of two odd bases."""

    def __init__(self):
        self.powers: list[np.ndarray] = []
        self.inverses: list[np.ndarray] = []

    def _grow(self, n: int) -> None:
        if self.powers and len(self.powers[0]) >= n:
            return
        size = max(n, CHUNK)
        self.powers, self.inverses = [], []
        for base in (0x100000001B3, 0x5851F42D4C957F2D):
            for held, factor in ((self.powers, base), (self.inverses, pow(base, -1, 1 << 64))):
                out = np.full(size, factor, np.uint64)
                out[0] = 1
                held.append(np.cumprod(out, dtype=np.uint64))

    def of(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        self._grow(len(buffer) + 1)
        out = []
        for powers, inverses in zip(self.powers, self.inverses, strict=True):
            sums = np.zeros(len(buffer) + 1, np.uint64)
            np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers[: len(buffer)], out=sums[1:])
            out.append(_mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * _A))
        return out


class Chunk:
    """Words and n-grams of some whole pieces of text of one language."""

    def __init__(self, lang: str, octets: bytes, hashes: WordHashes):
        self.lang, self.octets = lang, octets.translate(_LOWER)
        buffer = np.frombuffer(self.octets, np.uint8)
        kind = _KIND[buffer]
        edge = np.diff(np.concatenate([[0], (kind == 0).astype(np.int8), [0]]))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2)[self.starts]
        salt = np.uint64((zlib.crc32(lang.encode("utf-8", "surrogatepass")) + 1) * int(_B) % (1 << 64))
        self.words = hashes.of(buffer, self.starts, self.ends)
        self.first = [w ^ salt for w in self.words]

    def grams(self, n: int, before: tuple | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places of the first words of all n-grams, and their two hashes; ``before`` are the (n-1)-grams to lengthen."""
        if n == 1:
            return np.arange(len(self.starts)), self.first
        places, held = before or self.grams(n - 1)
        on = places + n - 1 < len(self.starts)
        on[on] = self.piece[places[on]] == self.piece[places[on] + n - 1]
        places = places[on]
        return places, [_mixed(h[on] * _A + w[places + n - 1]) for h, w in zip(held, self.words, strict=True)]

    def phrase(self, place: int, n: int) -> str:
        return b" ".join(self.octets[self.starts[place] : self.ends[place + n - 1]].split()).decode("utf-8", "surrogatepass")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Texts of a language are joined, and cut between pieces near every ``CHUNK`` bytes."""
    hashes, held = WordHashes(), {}
    cuts = b".,;:!?\n\x0b\x0c\r"

    def parts(octets: bytes) -> Iterator[bytes]:
        at = 0
        while len(octets) - at > CHUNK:
            end = max(octets.rfind(bytes([c]), at, at + CHUNK) for c in cuts)
            if end < 0:
                end = min((k for k in (octets.find(bytes([c]), at + CHUNK) for c in cuts) if k >= 0), default=len(octets) - 1)
            yield octets[at : end + 1]
            at = end + 1
        yield octets[at:]

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            octets = (text.as_py() or "").encode("utf-8", "surrogatepass")
            texts, total = held.get(lang, ([], 0))
            texts.append(octets)
            total += len(octets) + 1
            if total >= CHUNK:
                for part in parts(b"\n".join(texts)):
                    yield Chunk(lang, part, hashes)
                texts, total = [], 0
            held[lang] = (texts, total)
    for lang, (texts, _) in held.items():
        if texts:
            for part in parts(b"\n".join(texts)):
                yield Chunk(lang, part, hashes)


def _cells(hashes: list[np.ndarray], row: int, size: int) -> np.ndarray:
    """Cell of each n-gram in a row of the sketch; ``size`` is a power of two."""
    return (_mixed(hashes[0] + np.uint64(row + 1) * hashes[1]) & np.uint64(size - 1)).astype(np.int64)


class Survivors:
    """One bit for each cell of a merged sketch: whether its count reaches the least count."""

    def __init__(self, bits: list[np.ndarray], size: int):
        self.bits, self.size = bits, size

    def has(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Whether no row of the sketch rules an n-gram out; those that are frequent always stay."""
        out = np.ones(len(hashes[0]), bool)
        for row, bits in enumerate(self.bits):
            at = _cells(hashes, row, self.size)
            out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out


def _levels(chunk: Chunk, lengths: tuple[int, ...], short: Survivors | None, long: Survivors | None) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """n, places and hashes of the n-grams that the sketches so far don't rule out; all of theirs of one and two words must stay too."""
    grams = None
    for n in range(1, max(lengths) + 1):
        places, held = grams = chunk.grams(n, grams)
        if short and n <= 2:
            on = short.has(held)
            if n == 2:
                pairs = np.zeros(len(chunk.starts) + 1, bool)
                pairs[places[on]] = True
        elif short:
            on = pairs[places] & pairs[places + n - 2]
            if long:
                on[on] = long.has([h[on] for h in held])
        else:
            on = np.ones(len(places), bool)
        if short and n >= 2:
            places, held = grams = places[on], [h[on] for h in held]
            on = np.ones(len(places), bool)
        if n in lengths:
            yield n, places[on], [h[on] for h in held]


def _sketch(rows: DataFrame, lengths: tuple[int, ...], size: int, least: int, short) -> Survivors:
    """Counts the n-grams of all rows in a count-min sketch and keeps which cells reach ``least``.

    Each task counts a chunk of text by cell, capped at ``least``, which changes
    no comparison with it. Counts travel as one row for each chunk and block of
    cells, are merged block by block, and only the bits come to the driver:
    ``DEPTH * size / 8`` bytes.
    """
    kind, block_cells = np.min_scalar_type(least), size // BLOCKS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            held = [h for _, _, h in _levels(chunk, lengths, short.value if short else None, None)]
            both = [np.concatenate([h[i] for h in held]) for i in (0, 1)]
            if not len(both[0]):
                continue
            for row in range(DEPTH):
                cells, counts = np.unique(_cells(both, row, size), return_counts=True)
                counts = np.minimum(counts, least).astype(kind)
                blocks, at = np.unique(cells // block_cells, return_index=True)
                parts = [packed(cells[a:b] % block_cells, counts[a:b]) for a, b in zip(at, np.append(at[1:], len(cells)), strict=True)]
                columns = [pa.array(np.full(len(blocks), row, np.int32)), pa.array(blocks.astype(np.int32)), *[pa.array([p[i] for p in parts], pa.binary()) for i in (0, 1)]]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "block", "gaps", "n"])

    def packed(offsets: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
        """Gaps between the cells of a block in 16 bits, and their counts; a wider gap is several, whose cells between count 0."""
        gaps = np.diff(offsets, prepend=0)
        last = np.cumsum(gaps // 0xFFFF + 1) - 1
        steps, ns = np.full(last[-1] + 1, 0xFFFF, "<u2"), np.zeros(last[-1] + 1, kind)
        steps[last], ns[last] = gaps % 0xFFFF, counts
        return steps.tobytes(), ns.tobytes()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["row", "block", "bits"])

        for batch in batches:
            for row, block, gaps, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (row, block) != now:
                    if now:
                        yield out()
                    now, total = (row, block), np.zeros(block_cells, np.uint64)
                ns = np.frombuffer(n, kind)
                total[np.cumsum(np.frombuffer(gaps, "<u2"), dtype=np.int64)[ns > 0]] += ns[ns > 0]
        if now:
            yield out()

    parts = rows.mapInArrow(counted, "row int, block int, gaps binary, n binary")
    blocks = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(merged, "row int, block int, bits binary")
    bits = [np.zeros(size // 8, np.uint8) for _ in range(DEPTH)]
    for row, block, octets in blocks.collect():
        bits[row][block * block_cells // 8 : (block + 1) * block_cells // 8] = np.frombuffer(octets, np.uint8)
    return Survivors(bits, size)


class Held:
    """Counts of phrases of one language and length in the order of their first hash, and each phrase's words from where it was met first."""

    def __init__(self):
        self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.f, self.phrases = np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, chunk: Chunk, n: int, places: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[list[str], list[int]]:
        """Counts n-grams of a chunk. Returned with their counts are those that equal another phrase in the first hash only, which aren't held."""
        _, first, back, found = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
        apart = two != two[first[back]]
        phrases, fs = [chunk.phrase(p, n) for p in places[apart].tolist()], [1] * int(apart.sum())
        if phrases:
            places, one, two = places[~apart], one[~apart], two[~apart]
            _, first, found = np.unique(one, return_index=True, return_counts=True)
        places, one, two = places[first], one[first], two[first]
        at = np.searchsorted(self.one, one)
        met = at < len(self.one)
        met[met] = self.one[at[met]] == one[met]
        same = met.copy()
        same[met] = self.two[at[met]] == two[met]
        self.f[at[same]] += found[same]
        new, other = ~met, met & ~same
        if new.any():
            words = np.array([chunk.phrase(p, n) for p in places[new].tolist()], object)
            self.one, self.two, self.f, self.phrases = (np.insert(a, at[new], b) for a, b in ((self.one, one[new]), (self.two, two[new]), (self.f, found[new]), (self.phrases, words)))
        return phrases + [chunk.phrase(p, n) for p in places[other].tolist()], fs + found[other].tolist()

    def taken(self, on: np.ndarray) -> tuple[list[str], list[int]]:
        """Phrases and counts at ``on``, which are held no longer."""
        out = self.phrases[on].tolist(), self.f[on].tolist()
        self.one, self.two, self.f, self.phrases = (a[~on] for a in (self.one, self.two, self.f, self.phrases))
        return out


def _counts(batches: Iterator[pa.RecordBatch], longest: int, short: Survivors, long: Survivors | None) -> Iterator[pa.RecordBatch]:
    """One row for each phrase of all batches that the sketches keep; more for rare ones, where there are more than ``HELD``. A language's words are its row of no words."""
    held, words = defaultdict(Held), Counter()

    def out(lang: str, n: int, phrases: list[str], fs: list[int]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(fs), BATCH):
            part = fs[at : at + BATCH]
            columns = [pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), n, np.int32)), pa.array(phrases[at : at + BATCH], pa.string()), pa.array(part, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "n_words", "phrase", "f"])

    for chunk in _chunks(batches):
        words[chunk.lang] += len(chunk.starts)
        for n, places, (one, two) in _levels(chunk, tuple(range(1, longest + 1)), short, long):
            if len(places):
                yield from out(chunk.lang, n, *held[chunk.lang, n].add(chunk, n, places, one, two))
        if sum(len(h.f) for h in held.values()) >= HELD:
            for (lang, n), h in held.items():
                if len(h.f):
                    yield from out(lang, n, *h.taken(h.f <= np.median(h.f)))
    for (lang, n), h in held.items():
        yield from out(lang, n, *h.taken(np.ones(len(h.f), bool)))
    for lang, n in words.items():
        yield from out(lang, 0, [""], [n])


def frequent_ngrams(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, cells: tuple[int, int] = CELLS) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``least`` occurrences: lang, n_words, phrase, f; and lang, n, the words of each language.

    Two sketches are made, of one and two words, then of longer phrases all of
    whose pairs the first one keeps; both only overestimate, so nothing frequent
    is lost. The exact pass counts what both keep, first in a task, where 128
    bits of hash tell phrases apart, then by phrase in Spark. A task hands on a
    row a phrase whatever it read, so there is one task for each core and not
    for each part of the input. Null texts are empty, null languages are
    ``und``. A sketch too small for its corpus lets more phrases through and
    changes no result; ``cells`` sets the least and most cells of a row. A piece
    longer than ``CHUNK`` bytes is read whole.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    octets = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    size = 1 << min(max(int(octets // 8).bit_length(), cells[0].bit_length() - 1), cells[1].bit_length() - 1)
    context = docs.sparkSession.sparkContext
    short = context.broadcast(_sketch(rows, (1, 2), size, least, None))
    long = context.broadcast(_sketch(rows, tuple(range(3, longest + 1)), size, least, short)) if longest > 2 else None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counts(batches, longest, short.value, long and long.value)

    made = rows.coalesce(context.defaultParallelism).mapInArrow(counted, "lang string, n_words int, phrase string, f long")
    exact = materialize(made.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("n_words") == 0)), "phrases")
    return exact.where("n_words > 0"), exact.where("n_words = 0").select("lang", F.col("f").alias("n"))


def _part(phrase: str, begin, length) -> F.Column:
    return F.array_join(F.slice(F.split(phrase, " "), begin, length), " ")


def score(ngrams: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, n_words, phrase, a, l, r, n and score of every phrase of two words or more, by its lowest-scoring cut.

    Both parts of a phrase occur at least as often as it, so they are among
    ``ngrams`` too. Products are decimals of 38 digits and the division is one
    of integers, so scores are exact.
    """
    cuts = ngrams.where("n_words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "n_words", "phrase", F.col("f").alias("a"), "k", _part("phrase", F.lit(1), F.col("k")).alias("left"), _part("phrase", F.col("k") + 1, F.col("n_words")).alias("right"))
    side = lambda name, n: ngrams.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"_over": (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)")).cast("decimal(19,0)") * wide("n"), "_under": wide("l") * wide("r")})
    cuts = cuts.withColumn("score", F.expr("_over div _under"))
    best = cuts.groupBy("lang", "n_words", "phrase", "a", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("_cut"))
    return best.select("lang", "n_words", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")


def without_subsumed(scored: DataFrame, share: int = 100) -> DataFrame:
    """Rows whose words don't lie inside a longer phrase that occurs in at least ``share`` percent of their occurrences."""
    inside = scored.where("n_words > 2").withColumn("_m", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1))).withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("_m") + 1)))
    most = inside.groupBy("lang", _part("phrase", F.col("_at"), F.col("_m")).alias("phrase")).agg(F.max("a").alias("_most"))
    rows = scored.join(most, ["lang", "phrase"], "left")
    return rows.where(F.col("_most").isNull() | (100 * F.col("_most") < share * F.col("a"))).drop("_most")


def top_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each language by score and count, largest first, then by phrase in byte order.

    Rows are ranked in 64 hashed parts of each language first, so a language
    with most of the phrases isn't sorted in one task.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = parts.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, top: int = TOP, share: int = 100, cells: tuple[int, int] = CELLS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to ``longest`` words.

    Repeated rows count every time; an empty table, or one without a frequent
    phrase, gives no row; other columns of ``docs`` than lang and text aren't looked at.
    """
    ngrams, totals = frequent_ngrams(docs, longest, least, cells)
    return top_phrases(without_subsumed(score(ngrams, totals), share), top)


ORACLE_SQL = f"""with d as (select row_number() over () as id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select id, lang, generate_subscripts(pieces, 1) as piece, unnest(pieces) as text from (select id, lang, regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]') as pieces from d)),
w as (select lang, list_filter(regexp_split_to_array(text, '[\\x20\\x09]+'), lambda x: x <> '') as w from p),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, {LONGEST + 1}) r(k))),
f as materialized (select lang, k, phrase, count(*) as f from g group by all having count(*) >= {LEAST_COUNT}),
c as (select lang, k as m, phrase, f as a, unnest(range(1, k)) as cut, string_split(phrase, ' ') as w from f where k > 1),
s as (select c.lang, c.phrase, c.m, c.a, x.f as l, y.f as r, n.n, cut, (1000 * c.a::hugeint * n.n) // (x.f::hugeint * y.f) as score
  from c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : cut], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[cut + 1 : m], ' ') join n on n.lang = c.lang),
b as materialized (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
i as (select lang, a, array_to_string(w[j : j + q - 1], ' ') as phrase from (select lang, a, w, q, unnest(range(1, m - q + 2)) as j from (select lang, a, m, string_split(phrase, ' ') as w, unnest(range(2, m)) as q from b))),
o as (select lang, phrase, max(a) as most from i group by all),
k as (select b.* from b left join o on o.lang = b.lang and o.phrase = b.phrase where most is null or 100 * most < 100 * a)
select lang, rank, phrase, a, l, r, n, score::bigint as score from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from k) where rank <= {TOP}"""
