"""Operator 3: near-duplicate documents by SimHash and generalised pigeonhole search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize, packed, unpacked, with_row_keys
from .words import word_spans, words_of

BITS = 64
#: Rows of hashes unpacked to bits at a time.
BLOCK = 8192
#: Relative cost of writing a probe or index row and of checking a candidate pair.
ROW_COST, CANDIDATE_COST = 1.0, 0.5
#: Most flip masks a partition may probe with.
MOST_MASKS = 1024


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of the shingles of ``width`` words, A-Z lower-cased, repeats counted.

    Fewer words than ``width``: the whole sequence is one shingle. No words, or
    a null text: 0. A bit is 1 if it is set in over half of the XXH64 values.
    """
    words = [w.lower() for w in words_of(text)]  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined, starts, ends = word_spans(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), dtype=np.uint64, count=len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        octets = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.array([fingerprint(t, width) for t in batch["text"]], dtype=np.int64)})

    return docs.select("doc_id", "text").mapInPandas(each, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, width: int = 4, most_bits: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    Fingerprints link at ``most_bits`` or fewer differing bits; the component
    is the smallest doc_id reachable, itself included. Texts that are null,
    empty or blank have fingerprint zero and link like any other. Repeated
    rows each come back; a null doc_id links like any other, and has a null
    component only where all of its component's ids are null. Other columns are not read. An
    empty table gives an empty one.

    Equal fingerprints become one row before the search, so a group of copies
    costs one row whatever its size.
    """
    prints = materialize(fingerprints(docs, width), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    links = similar_pairs(distinct.select("fp", F.col("fp").alias("rep")), most_bits)
    found = connected_components(links)
    roots = distinct.join(found, distinct["fp"] == found["id"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    of = roots.join(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_pairs(distinct: DataFrame, most_bits: int) -> DataFrame:
    """Links ``a``, ``b`` between the ``rep`` of fingerprints at most ``most_bits`` apart.

    ``distinct`` has one row for each ``fp``. Bits are grouped into partitions
    and each gets a threshold, all together ``most_bits - partitions + 1``, so a
    pair within ``most_bits`` is within the threshold of some partition. Index
    rows hold a partition's bits, probe rows the same with up to its threshold
    of them flipped. Of two values that differ, only the one without the
    highest differing bit probes, so a pair meets once in a partition.
    """
    plan = plan_partitions(distinct, most_bits)
    masks = [F.struct(F.lit(p).alias("part"), F.lit(bits).alias("bits")) for p, (bits, _) in enumerate(plan)]
    flips = [F.struct(F.lit(p).alias("part"), F.lit(bits).alias("bits"), F.lit(flip).alias("flip"), F.lit(top).alias("top")) for p, (bits, reach) in enumerate(plan) for flip, top in flip_masks(bits, reach)]
    index = distinct.select("fp", "rep", F.explode(F.array(*masks)).alias("m")).select(F.col("m.part").alias("part"), F.col("fp").bitwiseAND(F.col("m.bits")).alias("value"), F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    probe = (
        distinct.select("fp", "rep", F.explode(F.array(*flips)).alias("m"))
        .where(F.col("fp").bitwiseAND(F.col("m.top")) == 0)
        .select(F.col("m.part").alias("part"), F.col("fp").bitwiseAND(F.col("m.bits")).bitwiseXOR(F.col("m.flip")).alias("value"), F.col("fp").alias("fp_a"), F.col("rep").alias("a"), (F.col("m.flip") != 0).alias("flipped"))
    )
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= most_bits
    on = (probe["part"] == index["part"]) & (probe["value"] == index["value"]) & near & (F.col("flipped") | (F.col("fp_a") < F.col("fp_b")))
    return probe.join(index, on).where("a is not null and b is not null").select("a", "b")


def flip_masks(bits: int, reach: int) -> list[tuple[int, int]]:
    """Every choice of up to ``reach`` bits of a partition, with the highest bit chosen; both as signed longs."""
    at = [i for i in range(BITS) if bits & 0xFFFFFFFFFFFFFFFF & (1 << i)]
    return [(_signed(sum(1 << i for i in chosen)), _signed(1 << max(chosen)) if chosen else 0) for k in range(reach + 1) for chosen in combinations(at, k)]


def plan_partitions(distinct: DataFrame, most_bits: int) -> list[tuple[int, int]]:
    """Partitions as (mask of bits, threshold), those without probes left out.

    Every number of partitions that the pigeonhole allows is planned with
    statistics of all fingerprints, and the cheapest plan is taken. More rows
    lead to fewer, wider partitions with larger thresholds.
    """
    rows, ones, together = bit_statistics(distinct)
    correlation = _correlation(rows, ones, together)
    choices = {m: group_bits(correlation, m) for m in range(1, most_bits + 2) if comb(BITS // m, max(0, (most_bits - m + 1) // m)) <= MOST_MASKS}
    groups = {_signed(sum(1 << b for b in g)) for gs in choices.values() for g in gs}
    equal = equal_pairs(distinct, sorted(groups))
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for m, gs in choices.items():
        costs = []
        for g in gs:
            mask = _signed(sum(1 << b for b in g))
            costs.append(threshold_costs(rows, [ones[b] / max(rows, 1) for b in g], equal.get(mask, 0), most_bits))
        cost, reach = allocate(costs, most_bits - m + 1)
        if cost < best[0]:
            best = cost, [(_signed(sum(1 << b for b in g)), t) for g, t in zip(gs, reach, strict=True) if t >= 0]
    return best[1]


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, rows with each bit set, and rows with each two bits set."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            octets = batch["fp"].to_numpy(dtype=np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)
            total, rows = total + bits.T @ bits, rows + len(batch)
        yield pd.DataFrame({"pos": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), rows).astype(np.int64)})

    sums = distinct.select("fp").mapInPandas(count, "pos int, n long").groupBy("pos").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for pos, n in sums.collect():  # 4097 rows, whatever the table
        out[pos] = n
    together = out[:-1].reshape(BITS, BITS)
    return int(out[-1]), np.diag(together).copy(), together


def _correlation(rows: int, ones: np.ndarray, together: np.ndarray) -> np.ndarray:
    p = ones / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    c = np.abs((together / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(c, 0)
    return c


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size; each group grows by the free bit most correlated with it."""
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS * (k + 1) // parts - BITS * k // parts
        group = [max(sorted(free), key=lambda b: correlation[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: correlation[b, group].sum()))
            free.discard(group[-1])
        out.append(sorted(group))
    return out


def equal_pairs(distinct: DataFrame, masks: list[int]) -> dict[int, int]:
    """Pairs of rows that agree on all bits of a mask, for each mask."""
    values = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).groupBy("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value")).agg(F.count("*").alias("n"))
    pairs = values.groupBy("mask").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs"))
    return {mask: n for mask, n in pairs.collect()}  # one row for each of at most 15 masks


def threshold_costs(rows: int, p_one: list[float], equal: float, most_bits: int) -> list[float]:
    """Cost of a partition at thresholds -1 (not used), 0, 1 ... ``most_bits``.

    Pairs that agree on the partition are counted; pairs that differ in k of its
    bits are estimated from the share of ones in each bit.
    """
    differ = np.zeros(most_bits + 1)
    differ[0] = 1.0
    for p in p_one:
        d = 2 * p * (1 - p)
        differ[1:] = differ[1:] * (1 - d) + differ[:-1] * d
        differ[0] *= 1 - d
    pairs = rows * (rows - 1) / 2
    out, candidates, probes = [0.0], float(equal), 1.0
    for k in range(most_bits + 1):
        if k:
            candidates += pairs * differ[k]
            probes += comb(len(p_one), k) / 2
        out.append(float("inf") if probes > MOST_MASKS else CANDIDATE_COST * candidates + ROW_COST * rows * (probes + 1))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of -1 or more that add up to ``total`` at least cost, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for k, more in enumerate(c):
                at = done + k - 1
                if at not in then or cost + more < then[at][0]:
                    then[at] = cost + more, [*chosen, k - 1]
        best = then
    return best.get(total, (float("inf"), []))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def keep_first_of_each_group(docs: DataFrame, width: int = 4, most_bits: int = 4) -> DataFrame:
    """Of each group the row with the smallest doc_id, nulls last; all columns stay. Of rows that repeat an id and a text one stays."""
    own = ("doc_id", "text")
    keyed = with_row_keys(packed(docs, own), "_row")
    stay = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text"), width, most_bits).where("doc_id = component_id").select(F.col("doc_id").alias("_row"))
    return unpacked(keyed.join(stay, "_row", "left_semi"), docs, own)
