from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowlens.llm import lines

SCHEMA = "doc_id long, text string"


def edits(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b, k):
    """By characters."""
    e = abs(len(a) - len(b)) if abs(len(a) - len(b)) > k else edits(a, b)
    return e <= k and max(len(a), len(b)) >= 5 * e


def blank(s):
    return not s.strip(" \t\n\x0b\f\r")


def brute(rows, k):
    last = 1 << 62
    docs = [(last if i is None else i, t) for i, t in rows]
    place = {}
    for o, t in docs:
        for at, s in enumerate(dict.fromkeys(s if not blank(s) else n for n, s in enumerate((t or "").split("\n")))):
            if not isinstance(s, int):
                place[s] = min(place.get(s, (o, at, s.encode())), (o, at, s.encode()))
    first = {s: p[0] for s, p in place.items()}
    losers = {s for s in first for r in first if r != s and abs(len(r) - len(s)) <= k and place[r] < place[s] and near(r, s, k)}
    out = []
    for (o, t), (i, _) in zip(docs, rows, strict=True):
        kept, n, seen = [], 0, set()
        for s in (t or "").split("\n"):
            if not blank(s):
                n += 1
                if s in seen or first[s] < o or s in losers:
                    continue
                seen.add(s)
            kept.append(s)
        out.append((i, n, n - sum(not blank(s) for s in kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_removed", "kept_text").collect()), key=str)


def mutate(rng, s):
    at = rng.randrange(len(s) + 1)
    kind = rng.randrange(3)
    return s[:at] + rng.choice("abé ") * (kind != 1) + s[at + (kind > 0) :]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_equals_brute_force(spark, k):
    rng = random.Random(k)
    base = ["".join(rng.choice("abcdé ñ") for _ in range(rng.choice([1, 4, 5, 9, 12, 20, 47, 48, 49, 80, 130]))) for _ in range(40)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(6)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                s = mutate(rng, s)
            text.append(s)
            if rng.random() < 0.3:
                text.append(rng.choice(["", " ", "\t"]))
        rows.append((i, "\n".join(text)))
    rows += [(70, None), (71, ""), (72, "\n\n"), (None, rows[3][1]), (None, "only here and nowhere else"), (73, "x\nx\nx"), (5, rows[5][1])]
    assert got(lines.dedup_lines(spark.createDataFrame(rows, SCHEMA), k)) == brute(rows, k)


def test_edit_distance_in_a_band(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(30)))
        b = a
        for _ in range(rng.randrange(5)):
            b = mutate(rng, b)
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        out = df.select("a", "b", lines.linked(F.col("a"), F.col("b"), k).alias("x")).collect()
        wrong = [(r["a"], r["b"]) for r in out if r["x"] != (near(r["a"], r["b"], k) and bool(r["b"]))]
        assert not wrong


def test_stage_keeps_columns_and_drops_emptied(spark):
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "one line here", "s", 13, "z"), (2, "one line here", "s", 13, "z"), (3, "other\none line here", "s", 19, "z"), (4, "", "s", 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, h1 string")
    out = lines.without_repeated_lines(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "one line here", "s", 13, "z"), (3, "other", "s", 5, "z"), (4, "", "s", 0, "z")]


def hot_rows():
    """2000 near copies of a long line, of a line of digits and of a short one, each group with all its lines in one group of segments."""
    rng = random.Random(5)
    base = "The committee published its yearly report on the markets of the region, and all members agreed to the figures that it gave for the last quarter."
    rows = []
    for i in range(2000):
        s = list(base)
        for _ in range(rng.choice([1, 1, 1, 2, 2, 3, 4])):
            s[rng.randrange(len(s))] = rng.choice("abcdefghij")
        rows.append((i, "".join(s)))
    rows += [(i, f"page {rng.randrange(10**6):06d} of the book") for i in range(2000, 4000)]
    rows += [(i, f"Entry {rng.randrange(10**9)} by user{rng.randrange(10**7)} in a forum") for i in range(4000, 5000)]
    return rows


@pytest.mark.parametrize("k", [1, 2])
def test_large_groups_of_near_copies(spark, k):
    rows = hot_rows()
    out = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(8), k)
    gone = {r["doc_id"] for r in out.where("n_removed > 0").collect()}
    first, want = {}, set()
    for i, s in rows:
        if s in first:
            want.add(i)
        first.setdefault(s, i)
    # brute force over strings with k characters left out: lines link only if they have one in common
    of = {}
    for s, i in first.items():
        for cut in {s, *(s[:j] + s[j + 1 :] for j in range(len(s)))} if k == 1 else {s[a:b] for a, b in ((0, len(s) // 3), (len(s) // 3, 2 * len(s) // 3), (2 * len(s) // 3, len(s)))}:
            of.setdefault(cut, []).append((i, s))
    if k == 1:
        for found in of.values():
            found.sort()
            for n, (i, s) in enumerate(found):
                if i not in want and any(near(r, s, 1) for _, r in found[:n]):
                    want.add(i)
        assert gone == want
    else:
        # what went for one edit goes for two; of what stays, no line has an earlier one of equal length with two other characters
        stay = [(i, s) for s, i in first.items() if i not in gone]
        for i, s in stay:
            assert not any(j < i and len(r) == len(s) and sum(x != y for x, y in zip(r, s, strict=True)) <= min(2, len(s) // 5) for r, j in first.items())
        assert want <= gone


def test_very_long_lines_and_texts(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    many = "\n".join(f"line {n} of a long text with {n * 7919 % 20_011} in it" for n in range(20_000))
    rows = [(1, long), (2, long[:150_000] + "X" + long[150_001:]), (3, "Y" + long[:-1]), (4, "ZZZ" + long), (5, many), (6, many.replace("long", "lang", 1) + "\nnew words here that nobody else has")]
    out = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[i] for i in (1, 2, 3, 4)] == [(1, 0), (1, 1), (1, 1), (1, 0)]
    assert out[5][0] == 20_000 and out[6] == (20_001, 20_000)


def test_nulls_empty_tables_and_names(spark):
    rows = [(None, None, 1, "a", "b"), (None, "a line that is here twice", 1, "a", "b"), (3, "a line that is here twice", 1, "a", "b"), (4, "", 1, "a", "b"), (4, "\n \n", 1, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 int, ord string, keys string")
    out = [tuple(r) for r in lines.dedup_lines(df).collect()]
    assert sorted(map(str, out)) == sorted(map(str, [(None, 0, 0, None), (None, 1, 1, ""), (3, 1, 0, "a line that is here twice"), (4, 0, 0, ""), (4, 0, 0, "\n \n")]))
    assert lines.without_repeated_lines(df).columns == df.columns
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(empty).count() == 0 and lines.without_repeated_lines(empty).count() == 0
