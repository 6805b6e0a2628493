import random

import pytest
from pyspark.sql import functions as F

from pitlane.operators import cf, keys, metrics, pit, runs
from pitlane.sources.impressions import Fold


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("row_id").collect()]


def test_causal_prefix_golden(spark):
    rows = list(zip(range(6), (1, 1, 1, 2, 2, 1), (10, 20, 30, 10, 20, 40), (1, 0, 1, 1, 1, 1), (True,) * 5 + (False,), strict=True))
    df = spark.createDataFrame(rows, "row_id long, k int, time_ms long, y int, lab boolean")
    out = pit.causal_prefix(df, ["k"], "y", F.col("lab"))
    assert values(out, "prior_n", "prior_labelled", "prior_pos") == [(0, 0, 0), (1, 1, 1), (2, 2, 1), (0, 0, 0), (1, 1, 1), (3, 3, 2)]


def test_causal_prefix_horizon(spark):
    df = spark.createDataFrame([(0, 1, 1, 1, True), (1, 1, 2, 1, False), (2, 1, 3, 1, True)], "row_id long, k int, time_ms long, y int, lab boolean")
    assert values(pit.causal_prefix(df, ["k"], "y", F.col("lab")), "prior_n", "prior_labelled", "prior_pos") == [(0, 0, 0), (1, 1, 1), (2, 1, 1)]


@pytest.mark.parametrize("by_union", [False, True])
def test_frozen_prefix_golden(spark, by_union):
    rows = list(zip(range(6), (1, 1, 1, 1, 2, 2), (1, 2, 3, 4, 1, 3), (1, 0, 1, 1, 1, 0), strict=True))
    df = spark.createDataFrame(rows, "row_id long, k int, date int, y int")
    out = pit.frozen_prefix(df.withColumn("hz", F.lit(2)), ["k"], "y", by_union=by_union)
    assert values(out, "lab", "pos") == [(2, 1), (2, 1), (2, 1), (2, 1), (1, 1), (1, 1)]
    out = pit.frozen_prefix(df.withColumn("hz", F.lit(0)), ["k"], "y", by_union=by_union)
    assert values(out, "lab", "pos") == [(0, 0)] * 6


def test_frozen_plans_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(40), 20240100 + rng.randrange(1, 30), int(rng.random() < 0.3), 20240100 + rng.randrange(30), rng.random() < 0.85) for i in range(1500)]
    df = spark.createDataFrame(rows, "row_id long, k int, date int, y int, hz int, known boolean")
    want = []
    for _, k, _, _, hz, _ in rows:
        met = [r for r in rows if r[1] == k and r[2] <= hz and r[5]]
        want.append((len(met), sum(r[3] for r in met)))
    for by_union in (False, True):
        assert values(pit.frozen_prefix(df, ["k"], "y", F.col("known"), by_union=by_union), "lab", "pos") == want
    slow = pit.frozen_prefix_decayed(df.where("known"), ["k"], "y", half_life=1e9)
    for got, exact in zip(values(slow, "dlab", "dpos"), [w for w, r in zip(want, rows, strict=True) if r[5]], strict=True):
        assert got == pytest.approx(exact, abs=1e-3)


def test_window_horizons(spark):
    schedule = [(20220408, 20220421, 20220407), (20220422, 20220428, 20220421), (20220429, 20220508, 20220428)]
    df = spark.createDataFrame([(0, 20220410), (1, 20220425), (2, 20220502), (3, 20230101)], "row_id long, date int")
    assert values(df.withColumn("hz", keys.window_horizon(F.col("date"), schedule)), "hz") == [(20220407,), (20220421,), (20220428,), (-1,)]
    s = Fold("official").schedule()
    assert all(h < lo for lo, _, h in s) and [hi - lo + 1 for lo, hi, _ in s[:5]] == [3, 3, 3, 3, 2]


def test_stall_golden(spark):
    rows = [("a", i, v) for i, v in enumerate((0.5950, 0.5957, 0.5994))] + [("b", i, v) for i, v in enumerate((0.6, float("nan"), 0.6, float("nan"), 0.6))]
    out = runs.stall_state(spark.createDataFrame(rows, "run string, iteration int, valid double"), 0.6016)
    got = {(r.run, r.iteration): r.stall for r in out.collect()}
    assert got[("a", 2)] == 3 and [got[("b", i)] for i in range(5)] == [1, 1, 2, 2, 3]


def brute(rows, k=5):
    import math

    users = {}
    for i, u, y, s in rows:
        users.setdefault(u, []).append((i, y, s))
    weighted = total = 0.0
    ndcgs = []
    for items in users.values():
        pos, neg = [s for _, y, s in items if y], [s for _, y, s in items if not y]
        if pos and neg:
            wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
            weighted, total = weighted + len(pos) * wins / len(pos) / len(neg), total + len(pos)
        best = sorted(items, key=lambda x: (-x[2], x[0]))[:k]
        dcg = sum(y / math.log2(i + 2) for i, (_, y, _) in enumerate(best))
        ideal = sum(1 / math.log2(i + 2) for i in range(min(k, len(pos))))
        ndcgs.append(dcg / ideal if pos else 0.0)
    gauc, ndcg = weighted / total if total else 0.5, sum(ndcgs) / len(ndcgs) if ndcgs else 0.0
    return gauc, ndcg, (gauc + ndcg) / 2


@pytest.mark.parametrize("case", ["continuous", "ties", "constant", "sparse", "dense", "single"])
def test_metrics_equal_brute_force(spark, case):
    rng = random.Random(case)
    longest, rate = {"sparse": (3, 0.05), "dense": (3, 0.95), "single": (1, 0.5)}.get(case, (8, 0.35))
    score = {"ties": lambda: float(rng.randrange(3)), "constant": lambda: 0.0}.get(case, lambda: rng.gauss(0, 1))
    rows, i = [], 0
    for u in range(150):
        for _ in range(rng.randint(1, longest)):
            rows.append((i, u, int(rng.random() < rate), score()))
            i += 1
    df = spark.createDataFrame(rows, "row_id long, user_id int, long_view int, score double")
    got = metrics.evaluate(df, "long_view", "score").first()
    assert (got.gauc, got.ndcg5, got.primary) == pytest.approx(brute(rows), abs=1e-12)
    shifted = metrics.evaluate(df.withColumn("score", F.exp("score") + F.col("user_id")), "long_view", "score").first()
    assert shifted.primary == pytest.approx(got.primary, abs=1e-12)


def test_metrics_of_nothing(spark):
    got = metrics.evaluate(spark.createDataFrame([], "row_id long, user_id int, long_view int, score double"), "long_view", "score").first()
    assert (got.gauc, got.ndcg5, got.primary, got.users, got.rows) == (0.5, 0.0, 0.25, 0, 0)


def test_guards(spark):
    df = spark.createDataFrame([(1, 20240101, 1)], "row_id long, date int, long_view int")
    with pytest.raises(keys.OutcomeColumnError):
        keys.guard_outcomes(df)
    with pytest.raises(ValueError):
        keys.require_within(df, 20231231)
    assert keys.require_within(df, 20240101) is df


def test_cooccurrence_of_heavy_users(spark):
    """A user of more items than a block holds is counted, and exactly."""
    from collections import Counter

    from pitlane.operators import cf

    basket = {1: range(37), 2: range(30, 45), 3: [1], 4: [2, 36]}
    e = spark.createDataFrame([(u, i) for u, items in basket.items() for i in items], "u int, i int")
    want = Counter((i, j) for items in basket.values() for i in items for j in items if i != j)
    assert {(r.i, r.j): r.n for r in cf.cooccurrence(e, 5).collect()} == want
    long = spark.range(1_100).selectExpr("1 as u", "id as i")
    assert cf.cooccurrence(long).count() == 1_100 * 1_099


@pytest.mark.parametrize("share", [pit.SHARE, 10_000])
def test_prefix_of_a_hot_key(spark, share):
    """A key with half of all rows, null keys and times, ties: as by one ordered pass; no cell has more than a share of the rows."""
    rng = random.Random(7)
    minute = pit.CELL_MS
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None, f"k{i % 40}"]), rng.choice([None, *[rng.randrange(40 * minute)] * 30, 7 * minute]), rng.choice([0, 1, 1, None])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "row_id long, k string, time_ms long, y int").repartition(5)
    got = {r.row_id: (r.n, r.s) for r in pit.prefix_sums(df, ["k"], {"n": F.lit(1).cast("long"), "s": F.col("y").cast("long")}, share=share).collect()}
    seen, want = {}, {}
    for i, k, t, y in sorted(rows, key=lambda r: (-1 if r[2] is None else r[2], r[0])):
        n, s = seen.get(k, (0, 0))
        want[i] = (n, s)
        seen[k] = (n + 1, s + (y or 0))
    assert got == want
    cells = pit.in_cells(df, ["k"], F.floor(F.col("time_ms") / minute).cast("long"), share)
    sizes = {(r.k, r["_cell"]): r["count"] for r in cells.groupBy("k", "_cell").count().collect()}
    assert max(n for (k, _), n in sizes.items() if k == "hot") < 200 < sum(n for (k, _), n in sizes.items() if k == "hot")
    assert (len({k for k, c in sizes if c is not None}) == len(seen)) == (share == 10_000)


@pytest.mark.parametrize("block", [2, 1_000])
def test_histories_in_blocks(spark, block):
    rng = random.Random(8)
    history = {(u, i) for u in range(6) for i in range(40) if rng.random() < (0.9 if u == 0 else 0.1)}
    rows = [(n, rng.randrange(7), rng.randrange(40)) for n in range(120)]
    sims = {(i, j): rng.random() for i in range(40) for j in range(40) if i != j and rng.random() < 0.5}
    out = cf.history_scores(spark.createDataFrame(rows, "row_id int, user_id int, video_id int"), spark.createDataFrame(sorted(history), "u int, i int"), spark.createDataFrame([(i, j, s) for (i, j), s in sims.items()], "i int, j int, sim double"), block_items=block)
    got = {r.row_id: r for r in out.collect()}
    for n, u, j in rows:
        mine = [i for v, i in history if v == u]
        total = sum(sims.get((i, j), 0.0) for i in mine)
        assert (got[n].cf_sum, got[n].history_n) == (pytest.approx(total), len(mine)) and got[n].cf_mean == pytest.approx(total / len(mine) if mine else 0.0)


def test_plans_of_prefixes_grow_in_proportion(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), F.col("id").alias("time_ms"), *[(F.col("id") % i).alias(f"k{i}") for i in range(1, 9)], F.lit(1).alias("y"))

    def size(n):
        out = df
        for i in range(1, n + 1):
            out = pit.causal_prefix(out, [f"k{i}"], "y", F.lit(True), base=df).withColumnsRenamed({c: f"{c}{i}" for c in ("prior_n", "prior_labelled", "prior_pos")})
        return out._jdf.queryExecution().analyzed().toString().count("Range")

    assert size(8) - size(4) <= 1.5 * (size(4) - size(1)) * 4 / 3


def test_families_join_items_once(spark):
    """The prefixes of seven families read the stored log: none of them joins, and so broadcasts, the items anew."""
    from pitlane.plans import catalog

    from .conftest import SF

    read = catalog.QUERIES["pit07_causal_families"](spark, SF).inputFiles()
    assert read and not any("part.parquet" in f or "events.parquet" in f for f in read)
