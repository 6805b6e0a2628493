"""Sketches within their bounds at every horizon, and exact thresholds."""

import random

import numpy as np
import pytest

from pitlane.operators import quantiles


def test_sketches_merge_to_any_horizon(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), 20240101 + rng.randrange(20), f"u{int(3_000 * rng.random() ** 2)}" if rng.random() > 0.02 else None, rng.choice([None, float("nan"), 5.0, *[rng.expovariate(0.1)] * 20])) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "k string, date int, user string, x double").repartition(4)
    daily = quantiles.daily_sketches(df, ["k"], "user", "x")
    ranks = [0.05, 0.5, 0.95]
    horizons = spark.createDataFrame([(20231231,), (20240101,), (20240110,), (20240120,), (20240120,)], "horizon int")
    got = {(r.k, r.horizon): r for r in quantiles.up_to(daily, ["k"], horizons, ranks).collect()}
    assert len(got) == 6
    for (k, h), r in got.items():
        mine = [(u, x) for kk, d, u, x in rows if kk == k and d <= h]
        users, values = {u for u, _ in mine if u is not None}, np.array(sorted(x for _, x in mine if x is not None and x == x))
        assert r.n == len(mine) and abs(r.distinct - len(users)) <= 3 * quantiles.COUNT_ERROR * len(users) + 1
        for p, q in zip(ranks, r.quantiles, strict=True):
            low, high = (np.searchsorted(values, q, side) / len(values) for side in ("left", "right"))
            slack = 3 * quantiles.QUANTILE_ERROR + 1 / len(values)
            assert low - slack <= p <= high + slack
    nothing = spark.createDataFrame([("c", 20240101, None, None)], "k string, date int, user string, x double")
    r = quantiles.up_to(quantiles.daily_sketches(nothing, ["k"], "user", "x"), ["k"], horizons.limit(2), ranks).collect()
    assert [(x.n, x.distinct, x.quantiles) for x in r] == [(1, 0, None)]


def test_thresholds_and_their_fallbacks(spark):
    rng = np.random.default_rng(1)
    rows = []
    for b, n, share in ((0, 400, 0.4), (1, 99, 0.5), (2, 300, 0.05), (3, 150, 0.99), (None, 120, 0.5), (5, 1, 1.0)):
        for _ in range(n):
            y = int(rng.random() < share)
            rows.append((b, float(np.round(rng.normal(10 + 5 * y, 3), 1)), y))
    rows += [(0, None, 1), (0, float("nan"), 0), (0, 3.0, None), (7, None, 1)]
    out = {r.b: r for r in quantiles.class_thresholds(spark.createDataFrame(rows, "b int, x double, y int").repartition(3), "b", "x", "y").collect()}
    assert set(out) == {0, 1, 2, 3, None, 5, 7} and (out[7].n, out[7].threshold) == (0, None)
    for b in (0, 1, 2, 3, None, 5):
        mine = [(x, y) for k, x, y in rows if k == b and x is not None and x == x and y is not None]
        x, p0, p1 = (np.array([v for v, y in mine if y in of]) for of in ((0, 1), (0,), (1,)))
        few = len(x) < 100 or min(len(p0), len(p1)) < 20
        assert out[b].n == len(x) and out[b].threshold == pytest.approx(np.median(x) if few else (np.percentile(p0, 95) + np.percentile(p1, 5)) / 2)
        assert few == (b not in (0, None))
