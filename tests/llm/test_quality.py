from __future__ import annotations

import random
import re
from collections import Counter

from flowlens.llm import quality


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    n, chars = len(words), sum(map(len, words))
    symbols, capitals = sum(c in "#*$%&|<>" for c in text), sum(c.isupper() for c in text)
    dup = len(lines) - len(set(lines))
    failed = [n < 50, 100 * len(covered) > 50 * n, 4 * symbols > n, 2 * dup > len(lines), chars > 15 * n, chars < 2 * n, 10 * capitals > 4 * chars]
    return (n, chars, symbols, dup, len(covered), len(lines), capitals, sum(1 << k for k, f in enumerate(failed) if f))


def rows_of_all_kinds():
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "Beta", "#", "é", "a", "LOUD", "kappa", "$$", "of", "the", "averyverylongwordindeed"])
    rows = [(i, " ".join(word() + rng.choice(["", "\n", "\t"]) for _ in range(rng.choice([0, 1, 3, 49, 50, 51, 120])))) for i in range(120)]
    return [*rows, (200, None), (201, ""), (202, " \n\t\n"), (203, "x\nx\nx\n" * 40), (204, "a b c " * 60), (None, rows[5][1]), (3, rows[3][1]), (3, rows[3][1])]


def test_ledger_equals_brute_force(spark):
    rows = rows_of_all_kinds()
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, source string, extra int")
    out = quality.judged(quality.ledger(df)).collect()
    got = Counter((r["doc_id"], *[r[m] for m in quality.MEASURES], r["fail_bits"]) for r in out)
    assert got == Counter((i, *measured(t)) for i, t in rows)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (r["fail_bits"] == 0)
    assert quality.ledger(df.limit(0)).count() == 0


def test_long_text_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40_000))
    df = spark.createDataFrame([(1, text, 5, "y"), (2, None, 6, "z")], "doc_id long, text string, n_words int, fail_bits string")
    out = {r["doc_id"]: r for r in quality.ledger(df).collect()}
    assert out[1]["n_words"] == 40_000 and out[1]["n_repeat_words"] == 0 and out[2]["fail_bits"] == 1


def test_ablations_equal_brute_force(spark):
    rows = rows_of_all_kinds()
    bits = [measured(t)[-1] for _, t in rows]
    led = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    for policy, mask in quality.POLICIES.items():
        out = {r["rule"]: r for r in quality.ablations(led, policy).collect()}
        assert set(out) == {n for n, b in quality.BIT.items() if mask & b}
        for name, r in out.items():
            b = quality.BIT[name]
            assert r["n_failed"] == sum(bool(x & b) for x in bits) and r["n_failed_alone"] == sum(x & mask == b for x in bits)
            assert r["n_kept_without"] == sum(not x & mask & ~b for x in bits) and r["n_kept"] == sum(not x & mask for x in bits)
    assert all(r["n_failed"] == 0 for r in quality.ablations(led.limit(0)).collect())
