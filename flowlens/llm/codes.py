"""Vector codes: every part of a vector becomes the index of its nearest codebook entry, found in a ball tree over the entries."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: A component x becomes floor(SCALE * x).
SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Entries of a leaf of the tree.
LEAF = 12
#: Components from here on count as non-finite: their integers don't fit a long.
MOST = float(2**52)
#: Integers below this are exact in double precision.
EXACT = 2**53
LONGEST = 2**63 - 1


def _roots_up(squares: np.ndarray) -> np.ndarray:
    """At least the square root of every integer."""
    if squares.dtype == object:
        return np.array([math.isqrt(s) + 1 for s in squares], object)
    return np.ceil(np.sqrt(squares)) + 1


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries; exact for the types that ``BallTree`` picks."""
    if points.dtype == object:
        return np.array([[sum((a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in entries] for p in points], object).reshape(len(points), len(entries))
    return (points**2).sum(1)[:, None] + (entries**2).sum(1) - 2 * points @ entries.T


class BallTree:
    """Balls around integer centres that hold the entries of one part position.

    Distances are squares of integers, exact in double precision or, where
    numbers are too large for it, in Python's integers. A ball's radius and the
    root of a point's best square are rounded up, and a ball is left out only if
    its centre lies farther than both together, so no nearer or equal entry is
    missed; of equal ones the lowest index counts.
    """

    def __init__(self, entries: list[list[int]]):
        self.entries = entries
        self.largest = max((abs(x) for e in entries for x in e), default=0)
        self.root = self._built(list(range(len(entries))))
        self.made: dict[type, tuple] = {}

    def _built(self, members: list[int]) -> tuple:
        points = [self.entries[i] for i in members]
        centre = [sum(x) // len(x) for x in zip(*points, strict=True)]
        far = [sum((a - b) ** 2 for a, b in zip(p, centre, strict=True)) for p in points]
        radius = math.isqrt(max(far)) + 1
        if len(members) <= LEAF:
            return centre, radius, members, None, None
        pole = points[far.index(max(far))]
        order = sorted(zip([sum((a - b) ** 2 for a, b in zip(p, pole, strict=True)) for p in points], members, strict=True))
        ordered, half = [m for _, m in order], len(members) // 2
        return centre, radius, None, self._built(sorted(ordered[:half])), self._built(sorted(ordered[half:]))

    def _typed(self, node: tuple | None, kind: type) -> tuple | None:
        if node is None:
            return None
        centre, radius, members, left, right = node
        inside = None if members is None else (np.array(members), np.array([self.entries[i] for i in members], kind).reshape(len(members), -1))
        return np.array([centre], kind), radius, inside, self._typed(left, kind), self._typed(right, kind)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of every row's nearest entry; ``points`` are integers."""
        largest = max(self.largest, int(abs(points).max())) if points.size else self.largest
        kind = float if 4 * max(points.shape[1], 1) * (largest + 1) ** 2 < EXACT else object
        points = points.astype(kind)
        if kind not in self.made:
            self.made[kind] = self._typed(self.root, kind)
        found = np.zeros(len(points), np.int64)
        best = np.full(len(points), 4 * max(points.shape[1], 1) * (largest + 1) ** 2, kind)
        self._visit(self.made[kind], np.arange(len(points)), points, found, best)
        return found, best

    def _visit(self, node: tuple, rows: np.ndarray, points: np.ndarray, found: np.ndarray, best: np.ndarray) -> None:
        if not len(rows):
            return
        centre, radius, inside, left, right = node
        rows = rows[_squares(points[rows], centre)[:, 0] <= (radius + _roots_up(best[rows])) ** 2]
        if not len(rows):
            return
        if inside is not None:
            members, entries = inside
            squares = _squares(points[rows], entries)
            at = squares.argmin(1)
            least, index = squares[np.arange(len(rows)), at], members[at]
            better = (least < best[rows]) | ((least == best[rows]) & (index < found[rows]))
            found[rows[better]], best[rows[better]] = index[better], least[better]
            return
        to_left = _squares(points[rows], left[0])[:, 0] <= _squares(points[rows], right[0])[:, 0]
        for child, group in ((left, rows[to_left]), (right, rows[~to_left]), (right, rows[to_left]), (left, rows[~to_left])):
            self._visit(child, group, points, found, best)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of vectors that aren't null and have finite components only, those under ``MOST``."""
    return vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < MOST))).select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("embedding"))


def integers(embeddings: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors with ``dimensions`` components, and their integers as rows."""
    ends = embeddings.offsets.to_numpy()
    fits = np.flatnonzero(np.diff(ends) == dimensions)
    flat = embeddings.values.to_numpy(zero_copy_only=False)
    rows = flat[ends[fits][:, None] + np.arange(dimensions)] if dimensions else np.empty((len(fits), 0))
    return fits, np.floor(rows * SCALE).astype(np.int64)


def fit_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, list[list[list[int]]]]:
    """Dimensions and, for each part position, the codebook's entries.

    Codebooks start as the parts of the ``entries`` smallest ids (of equal ids
    those whose components are smaller, null ids last). A round is one pass over
    all rows: each task finds the nearest entries, adds up its parts by entry,
    and Spark adds the tasks' sums. What the driver gets is bounded by
    ``parts * entries`` rows of a part's width, whatever the number of vectors.
    Vectors are as long as the first one; others have no part here.
    """
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(1).collect()
    dimensions = len(first[0]["embedding"]) if first else 0
    if not first or dimensions % parts:
        return dimensions, []
    mine = kept.where(F.size("embedding") == dimensions)
    seeds = mine.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    width = dimensions // parts
    rows = [[math.floor(x * SCALE) for x in s["embedding"]] for s in seeds]
    books = [[r[p * width : (p + 1) * width] for r in rows] for p in range(parts)]
    for _ in range(rounds if width else 0):
        for part, entry, n, *sums in _sums(mine, books, dimensions).collect():
            books[part][entry] = [int(s) // n for s in sums]
    return dimensions, books


def _sums(kept: DataFrame, books: list[list[list[int]]], dimensions: int) -> DataFrame:
    """part, entry, n and the sum of every position over the parts nearest to an entry."""
    parts, width = len(books), dimensions // len(books)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books]
        counts, sums = np.zeros((parts, len(books[0])), np.int64), np.zeros((parts, len(books[0]), width), object)
        for batch in batches:
            rows = integers(batch.column(0), dimensions)[1]
            for p, tree in enumerate(trees):
                mine = rows[:, p * width : (p + 1) * width]
                found = tree.nearest(mine)[0]
                order = np.argsort(found, kind="stable")
                used, starts = np.unique(found[order], return_index=True)
                small = len(rows) * (int(abs(mine).max(initial=0)) + 1) < 2**63
                added = np.add.reduceat(mine[order] if small else mine[order].astype(object), starts, axis=0) if len(used) else mine[:0]
                sums[p, used] += added.astype(object)
                counts[p, used] += np.diff(np.append(starts, len(order)))
        p, e = np.nonzero(counts)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e])]
        columns += [pa.array([Decimal(int(x)) for x in sums[p, e, i]], pa.decimal128(38, 0)) for i in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    made = kept.select("embedding").mapInArrow(each, ", ".join(["part int, entry int, n long", *[f"s{i} decimal(38,0)" for i in range(width)]]))
    return made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])


def assign_codes(kept: DataFrame, books: list[list[list[int]]], dimensions: int) -> DataFrame:
    """vec_id, label, code (two hex digits a part; four from 257 entries on) and error (summed squares) of every row.

    Vectors of another length, or without codebooks, have null codes and errors;
    an error too large for a long is the largest long.
    """
    parts = max(len(books), 1)
    width, digits = dimensions // parts, 2 if not books or len(books[0]) <= 256 else 4

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books]
        for batch in batches:
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            if trees:
                places, rows = integers(batch.column(2), dimensions)
                found = [tree.nearest(rows[:, p * width : (p + 1) * width]) for p, tree in enumerate(trees)]
                for k, at in enumerate(places.tolist()):
                    codes[at] = "".join(f"{int(f[k]):0{digits}x}" for f, _ in found)
                    errors[at] = min(sum(int(e[k]) for _, e in found), LONGEST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "embedding").mapInArrow(each, f"vec_id long, label {label}, code string, error long")


def decoded(codes: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """Adds decoded, the vector (array of double) that a code stands for; null for a null code. ``codes`` needs code alone."""
    from pyspark.sql.pandas.functions import pandas_udf

    digits = 2 if not books or len(books[0]) <= 256 else 4

    @pandas_udf("array<double>")
    def vector(code):
        return code.map(lambda c: None if c is None else [x / SCALE for p, book in enumerate(books) for x in book[int(c[p * digits : (p + 1) * digits], 16)]])

    return codes.withColumn("decoded", vector("code"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that isn't null and is finite.

    label_error adds up the errors of all rows of a label, null labels together.
    Repeated rows and ids are rows of their own, an empty table gives an empty
    one, other columns of ``vectors`` aren't looked at. ``vectors`` is read once
    a round; write it first if it is costly.
    """
    kept = kept_vectors(vectors)
    dimensions, books = fit_codebooks(kept, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    rows = materialize(assign_codes(kept, books, dimensions), "codes")
    # Written first, so that its size is known and Spark joins by broadcast only if it is small; otherwise adaptive execution splits hot labels.
    sums = materialize(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).select(F.col("label").alias("_label"), F.when(F.col("total") > LONGEST, LONGEST).otherwise(F.col("total").cast("long")).alias("label_error")), "label-errors")
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    dot = lambda a, b: f"list_inner_product({a}, {b})"
    steps = [
        "k as (select *, row_number() over (order by vec_id) - 1 as rn from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "q as (select rn, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from k)",
        f"t as materialized (select rn, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] as v from q, range({PARTS}) r(p))",
        f"c0 as materialized (select p, rn as e, v from t where rn < {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} as materialized (select rn, t.p, min(({dot('t.v', 't.v')} + {dot('c.v', 'c.v')} - 2 * {dot('t.v', 'c.v')})::bigint * {ENTRIES} + e) as best from t join c{i} c on c.p = t.p group by rn, t.p)")
        if i < ROUNDS:
            mean = f"m{i} as (select p, e, list(m order by i) as v from (select p, e, i, floor(sum(x) / count(*)) as m from (select t.p, best % {ENTRIES} as e, unnest(t.v) as x, generate_subscripts(t.v, 1) as i from a{i} a join t on t.rn = a.rn and t.p = a.p) group by all) group by p, e)"
            steps += [mean, f"c{i + 1} as materialized (select c.p, c.e, coalesce(m.v, c.v) as v from c{i} c left join m{i} m on m.p = c.p and m.e = c.e)"]
    steps += [
        f"f as (select rn, string_agg(printf('%02x', best % {ENTRIES}), '' order by p) as code, sum(best // {ENTRIES})::bigint as error from a{ROUNDS} group by rn)",
        f"h as (select sha256(string_agg(array_to_string(list_transform(v, lambda x: x::bigint), ','), ',' order by p, e)) as codebooks_sha256 from c{ROUNDS})",
    ]
    return "with " + ",\n".join(steps) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from q join f on f.rn = q.rn, h"


ORACLE_SQL = _oracle()
