from __future__ import annotations

import random

import numpy as np
import pytest

from flowlens.operators import flows, quantiles

SHARES = [0.5, 0.0, 0.1, 0.333, 0.9, 1.0]


def made(seed):
    rng, rows = random.Random(seed), []
    for k, draw in (("normal", lambda: rng.gauss(0, 1)), ("tail", lambda: 10 ** rng.uniform(-12, 12)), ("ties", lambda: rng.choice([1.0, 1.0, 1.0, 2.5, -3.0])), ("same", lambda: 7.25), ("wide", lambda: rng.choice([-1.7e308, 1.7e308, 0.0, 1e-300]) * rng.random()), (None, lambda: rng.uniform(-5, 5))):
        rows += [(k, draw()) for _ in range(rng.choice([400, 401]))]
    rows += [("few", float(i)) for i in range(10)] + [("normal", None), ("normal", float("nan")), ("none", None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [20, 100, 10**6])
def test_equal_sorting(spark, most):
    rows = made(most)
    got = {r["k"]: r["quantiles"] for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, x double").repartition(4), ["k"], "x", SHARES, most).collect()}
    for k in {r[0] for r in rows}:
        values = sorted(x for g, x in rows if g == k and x is not None and x == x)
        if not values:
            assert got[k] is None
            continue
        for s, q in zip(SHARES, got[k], strict=True):
            pos = s * (len(values) - 1)
            lo, hi = int(np.floor(pos)), int(np.ceil(pos))
            want = values[lo] if lo == hi else (hi - pos) * values[lo] + (pos - lo) * values[hi]
            assert q == want or q == pytest.approx(want, rel=1e-12), (k, s)


def test_deviation_is_the_same_either_way(spark):
    df = spark.createDataFrame([(k, x) for k, x in made(5) if k in ("normal", "ties", "few") and x is not None and x == x], "k string, x double")
    plain, cut = ({r["k"]: r["d"] for r in flows.with_median_deviation(df, ["k"], "x", "d", most).collect()} for most in (None, 30))
    assert plain == cut
