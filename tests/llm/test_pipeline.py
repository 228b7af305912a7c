from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from flowlens.llm import lines, mixing, simhash
from tests.llm.test_lines import blank, mutate, near
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def sized(rows):
    return [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]


def rows_of(df):
    return Counter(map(tuple, df.select("doc_id", "text", "source").collect()))


def untidy_rows():
    """Unique texts, with null ids, ids of several texts, rows that come twice or three times, and null and empty texts."""
    rng = random.Random(4)
    text = lambda i: "\n".join(f"line {i} {k} " + " ".join(rng.choice("alpha beta gamma delta omega sigma kappa theta".split()) + str(rng.randrange(900)) for _ in range(30)) for k in range(rng.randrange(1, 4)))
    rows = [(i, text(i), "xyz"[i % 3]) for i in range(30)]
    rows += [(None, text(f"n{i}"), "xyz"[i % 3]) for i in range(6)]
    rows += [rows[3], rows[3], rows[7], rows[31], (9, text("other text of 9"), "x"), (None, rows[12][1], "z"), (None, "", "y"), (None, None, "x")]
    return rows


def without_lines(rows, k):
    """Every row is a document; a line stays where it first occurs unless it is near a line that comes before."""
    rows = in_order(rows)
    place = {}
    for n, (_, t, _) in enumerate(rows):
        for at, s in enumerate((t or "").split("\n")):
            if not blank(s):
                place.setdefault(s, (n, at))
    first = {s: p[0] for s, p in place.items()}
    losers = {s for s in first for r in first if place[r] < place[s] and near(r, s, k)}
    out = Counter()
    for n, (i, t, source) in enumerate(rows):
        kept, had, seen = [], False, set()
        for s in (t or "").split("\n"):
            if not blank(s):
                had = True
                if first[s] < n or s in losers or s in seen:
                    continue
                seen.add(s)
            kept.append(s)
        if not had or any(not blank(s) for s in kept):
            out[(i, None if t is None else "\n".join(kept), source)] += 1
    return out


def test_lines_of_null_and_repeated_ids(spark):
    rows = untidy_rows()
    out = rows_of(lines.without_repeated_lines(spark.createDataFrame(sized(rows), SCHEMA)))
    assert out == without_lines(rows, lines.MOST_EDITS)
    assert sum(i is None for i, _, _ in out.elements()) == 8 and max(out.values()) == 1


def test_stage_drops_near_lines_by_characters(spark):
    long = "Le comité a publié son rapport annuel sur les marchés européens, avec des données très détaillées."
    rows = [(1, long, "x"), (2, long.replace("é", "e", 1), "x"), (3, long.replace("é", "e", 3), "x"), (4, long.replace("é", "e", 4), "x")]
    rows += [(5, "Report of 10 May 2024 by Someone", "x"), (6, "Report of 21 May 2024 by Someone", "x"), (7, "Report of 21 Jun 2025 by Someone", "x"), (8, "abcd\nabce", "x"), (9, "abcde\nabcdé", "x")]
    assert rows_of(lines.without_repeated_lines(spark.createDataFrame(sized(rows), SCHEMA))) == without_lines(rows, lines.MOST_EDITS)
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdé ñ\U0001f600") for _ in range(rng.choice([4, 5, 9, 10, 14, 15, 30, 60, 130]))) for _ in range(30)]
    for i in range(20, 80):
        s = rng.choice(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            s = mutate(rng, s)
        rows.append((i, s, "x"))
    assert rows_of(lines.without_repeated_lines(spark.createDataFrame(sized(rows), SCHEMA))) == without_lines(rows, lines.MOST_EDITS)


def test_groups_of_null_and_repeated_ids(spark):
    rows = in_order(untidy_rows())
    of = {i: c for i, _, c in brute_components([(n, t) for n, (_, t, _) in enumerate(rows)])}
    out = rows_of(simhash.keep_first_of_each_group(spark.createDataFrame(sized(rows), SCHEMA)))
    # rows of one id and text are alike, and the one null and the one empty text link, so the choice between equals can't be told
    want = Counter(r for n, r in enumerate(rows) if of[n] == n)
    assert Counter((i, t or "", s) for i, t, s in out.elements() if t) == Counter((i, t, s) for i, t, s in want.elements() if t)
    assert out.total() == want.total() and max(out.values()) == 1


def test_mix_of_null_and_repeated_ids(spark):
    rows = untidy_rows()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = rows_of(mixing.mixed_documents(spark.createDataFrame(sized(rows), SCHEMA)))
    given = Counter(rows)
    assert all(n <= (2 if words(r[1]) else 1) * given[r] for r, n in out.items())
    assert all(out[r] == n for r, n in given.items() if not words(r[1]))
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    for _, t, s in out.elements():
        taken[s] += words(t)
    for s, target in brute_targets(sizes).items():
        assert 0 <= target - taken[s] < max(words(t) for _, t, _ in rows)
    assert any(i is None for i, t, _ in out if t)


def test_run_with_null_and_repeated_ids(spark, tmp_path, sf_dir):
    rows = untidy_rows()
    spark.createDataFrame(sized(rows), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    # train the toxicity model on documents that have labels
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    train.withColumn("doc_id", train["doc_id"] + 1_000_000).select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("doc_id", labels["doc_id"] + 1_000_000).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    stay = rows_of(kept.where("doc_id is null or doc_id < 1000000"))
    assert sum(i is None for i, _, _ in stay) >= 7
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where("doc_id is null").count() > 0
    assert {r["doc_id"] for r in out.where("doc_id < 1000000").select("doc_id").distinct().collect()} <= {i for i, _, _ in stay}


@pytest.mark.parametrize("stage", [lines.without_repeated_lines, mixing.mixed_documents, simhash.keep_first_of_each_group])
def test_columns_named_like_an_operators_own_stay(spark, stage):
    rows = [(i if i % 5 else None, f"{w} one line of words and more words\nand another {w} of {w}", "en", f"s{i % 3}", 50, f"a{i}", f"b{i}", f"c{i}", f"d{i}", f"e{i}", f"f{i}") for i, w in enumerate("apple brick cloud dance eagle flame grape house".split())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, kept_text string, _copies string, _rest string, size string, fp string")
    out = stage(docs)
    assert out.columns == docs.columns
    own = {r[5]: r for r in rows}
    got = out.collect()
    assert len({r["_row"] for r in got}) >= 5 and all(tuple(r)[5:] == own[r["_row"]][5:] and r["doc_id"] == own[r["_row"]][0] for r in got)
