"""Gradients, the distributed trainer, its objectives, and trees with a list objective, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlane.operators import boosting, nets, sgd


def lists_of(rng, sizes):
    lengths = np.array(sizes)
    n = int(lengths.sum())
    return rng.normal(size=n), (rng.random(n) < 0.4).astype(float), np.where(rng.random(n) < 0.15, 0.0, rng.random(n) + 0.5), lengths


def plain_loss(kind, s, y, w, lengths, k=5):
    """The losses pair by pair."""
    if kind == "bce":
        return sum(wi * (math.log1p(math.exp(si)) - yi * si) for si, yi, wi in zip(s, y, w, strict=True)) / sum(w)
    if kind == "primary":
        return (plain_loss("bpr_gauc", s, y, w, lengths, k) + plain_loss("lambda_ndcg", s, y, w, lengths, k)) / 2
    total, lists, positives, at = 0.0, 0, 0, 0
    for n in lengths:
        g = [(s[i], y[i]) for i in range(at, at + n) if w[i] > 0]
        at += n
        pos, neg = [i for i, x in enumerate(g) if x[1]], [i for i, x in enumerate(g) if not x[1]]
        if not pos or not neg:
            continue
        lists, positives = lists + 1, positives + len(pos)
        if kind == "listnet":
            z = math.log(sum(math.exp(x) for x, _ in g))
            total += sum(z - g[i][0] for i in pos) / len(pos)
            continue
        rank = {i: r for r, i in enumerate(sorted(range(len(g)), key=lambda i: -g[i][0]))}
        gain = lambda i: 1 / math.log2(rank[i] + 2) if rank[i] < k else 0.0  # noqa: E731, B023
        ideal = sum(1 / math.log2(i + 2) for i in range(min(k, len(pos))))
        for p in pos:
            for q in neg:
                weight = {"bpr": 1 / (len(pos) * len(neg)), "bpr_gauc": 1 / len(neg), "lambda_ndcg": abs(gain(p) - gain(q)) / ideal / (len(pos) * len(neg))}[kind]
                total += weight * math.log1p(math.exp(g[q][0] - g[p][0]))
    return total / (positives if kind == "bpr_gauc" else lists)


@pytest.mark.parametrize("kind", nets.OBJECTIVES)
def test_objectives_and_their_gradients(kind):
    rng = np.random.default_rng(3)
    s, y, w, lengths = lists_of(rng, [7, 1, 12, 3, 0, 9, 2, 6, 30])
    over = nets.totals(y, w, lengths)
    value, g = nets.objective(kind, s, y, w, lengths, over)
    assert value == pytest.approx(plain_loss(kind, s, y, w, lengths), rel=1e-9)
    for i in range(len(s)):
        up, down = s.copy(), s.copy()
        up[i] += 1e-6
        down[i] -= 1e-6  # ranks stay, so the weights of swaps are constants
        both = [nets.objective(kind, x, y, w, lengths, over)[0] for x in (up, down)]
        assert g[i] == pytest.approx((both[0] - both[1]) / 2e-6, abs=1e-7)
    half = int(lengths[:4].sum())
    parts = [nets.objective(kind, s[a], y[a], w[a], n, over) for a, n in ((slice(0, half), lengths[:4]), (slice(half, None), lengths[4:]))]
    assert sum(p[0] for p in parts) == pytest.approx(value) and np.concatenate([p[1] for p in parts]) == pytest.approx(g)


@pytest.mark.parametrize("net", [nets.FactorisationMachine(4), nets.TargetAttention(2, k=3, hidden=6)])
def test_gradients_of_nets(net):
    rng = np.random.default_rng(5)
    x = rng.integers(-1, 9, (12, 7))
    x[3, 3:] = -1  # no history
    x[4] = x[5]
    p = {n: v + 0.3 * rng.normal(size=v.shape) for n, v in net.start(np.arange(9), 1).items()}
    g = rng.normal(size=12)
    found = net.backward(p, x, net.forward(p, x)[1], g)
    assert set(found) == set(p)
    for name, (rows, values) in found.items():
        dense = np.zeros_like(p[name])
        if rows is None:
            dense += values.reshape(dense.shape)
        else:
            dense[rows] += values
        for at in rng.permutation(dense.size)[:40]:
            place = np.unravel_index(at, dense.shape)
            both = []
            for step in (1e-6, -1e-6):
                q = {**p, name: p[name].copy()}
                q[name][place] += step
                both.append((net.forward(q, x)[0] * g).sum())
            assert dense[place] == pytest.approx((both[0] - both[1]) / 2e-6, abs=2e-6), name


def log(spark, n=600, seed=1):
    """Rows whose label follows from the pair of user and item."""
    rng = random.Random(seed)
    liking = {(u, v): rng.random() for u in range(12) for v in range(15)}
    rows = []
    for i in range(n):
        u, v = rng.randrange(12), rng.randrange(15)
        rows.append((i, u, v, ["train", "train", "valid"][i % 3], int(rng.random() < liking[u, v] ** 2 * 1.6), rng.randint(0, 1), float(1 + i % 2)))
    return spark.createDataFrame(rows, "row_id long, user_id int, video_id int, split string, y int, z int, twice double").repartition(3)


def X():
    return F.array(sgd.code(0, F.col("user_id")), sgd.code(1, F.col("video_id")))


def stored(df, tmp_path, name):
    df.write.partitionBy("batch").parquet(str(tmp_path / name))
    return df.sparkSession.read.parquet(str(tmp_path / name))


@pytest.mark.parametrize(("loss", "lists", "fan_in"), [("bce", None, 64), ("primary", ["user_id"], 64), ("bce", None, 0)])
def test_a_step_equals_brute_force(spark, tmp_path, monkeypatch, loss, lists, fan_in):
    monkeypatch.setattr(sgd, "FAN_IN", fan_in)
    monkeypatch.setattr(sgd, "ROWS_AT_ONCE", 50)
    df = log(spark)
    rows = stored(sgd.rows_to_learn(df, X(), [F.col("y")], [F.col("twice")], 1, lists, longest=20), tmp_path, "rows")
    stack = sgd.Stack(nets.FactorisationMachine(4), [sgd.Member(seed=3, loss=loss)], rate=0.05, decay=0.01)
    over = stack.begin(rows)
    held = rows.collect()
    x = np.array([c for r in held for c in r.x]).reshape(-1, 2)
    y, w = (np.array([v for r in held for v in r[c]], float) for c in ("y", "w"))
    lengths = np.array([r.n for r in held])
    assert len(y) == 600 and (lists is None) == (max(lengths) == 1) and max(lengths) < 45
    slots = sgd.slots_of(stack.codes, x)
    p = {n: v.copy() for n, v in stack.models[0].params.items()}
    s, kept = stack.net.forward(p, slots)
    value, ds = nets.objective(loss, s, y, w, lengths, nets.totals(y, w, lengths))
    losses, got = stack.gradients(rows, {i: over[0, i] for i in range(1)})
    assert losses[0] == pytest.approx(value) == pytest.approx(plain_loss(loss, s, y, w, lengths))
    want = {n: np.zeros_like(v) for n, v in p.items()}
    for name, (at, v) in stack.net.backward(p, slots, kept, ds).items():
        want[name][slice(None) if at is None else at] += v.reshape(want[name].shape) if at is None else v
    for name in p:
        assert got[0][name] == pytest.approx(want[name], abs=1e-12)
    stack.models[0].move(got[0])
    for name in p:  # the first step of Adam: the sign of the gradient, times the rate
        g = want[name] + 0.01 * p[name]
        assert stack.models[0].params[name] == pytest.approx(p[name] - 0.05 * g / (np.abs(g) + 1e-8), abs=1e-9)


def fitted(spark, tmp_path, name, df, labels, weights, members, epochs=4, **more):
    rows = stored(sgd.rows_to_learn(df, X(), labels, weights, 2), tmp_path, name)
    return sgd.Stack(nets.FactorisationMachine(4), members, **more).fit(rows, 2, epochs)


def scores(stack, df):
    return {r.row_id: list(r.score) for r in stack.scores(df.withColumn("x", X()), ["row_id"]).collect()}


def test_weights_are_repetitions(spark, tmp_path):
    """A row of weight 2 equals the row twice; rows of weight 0 aren't there."""
    df = log(spark, 200)
    twice = df.unionByName(df.where("twice = 2"))
    a = fitted(spark, tmp_path, "a", df, [F.col("y")], [F.col("twice")], [sgd.Member()])
    b = fitted(spark, tmp_path, "b", twice, [F.col("y")], [F.lit(1.0)], [sgd.Member()])
    got, want = scores(a, df), scores(b, df)
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    c = fitted(spark, tmp_path, "c", df, [F.col("y")], [F.when(F.col("twice") == 2, 1.0).otherwise(0.0)], [sgd.Member()])
    d = fitted(spark, tmp_path, "d", df.where("twice = 2"), [F.col("y")], [F.lit(1.0)], [sgd.Member()])
    got, want = scores(c, df), scores(d, df)
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_a_stack_is_its_models(spark, tmp_path):
    """Targets, weights and seeds side by side give what each gives alone."""
    df = log(spark, 200)
    labels, weights = [F.col("y"), F.col("z")], [F.lit(1.0), F.col("twice")]
    members = [sgd.Member(0, 0, 0), sgd.Member(1, 1, 5), sgd.Member(1, 0, 2)]
    both = scores(fitted(spark, tmp_path, "all", df, labels, weights, members), df)
    for j, m in enumerate(members):
        alone = scores(fitted(spark, tmp_path, f"one{j}", df, [labels[m.label]], [weights[m.weight]], [sgd.Member(seed=m.seed)]), df)
        assert all(both[i][j] == pytest.approx(alone[i][0], abs=1e-9) for i in alone)


def test_early_stopping(spark, tmp_path):
    df = log(spark, 900)
    train, valid = df.where("split = 'train'"), df.where("split = 'valid'").withColumn("x", X())
    rows = stored(sgd.rows_to_learn(train, X(), [F.col("y")], [F.lit(1.0)], 2), tmp_path, "rows")
    stack = sgd.Stack(nets.FactorisationMachine(8), [sgd.Member(seed=i) for i in range(2)], rate=0.1)
    stack.fit(rows, 2, 40, lambda s: s.primaries(valid, "y"), patience=3)
    for curve, best in zip(stack.curves, stack.best, strict=True):
        assert len(curve) < 40 and best == 1 + curve.index(max(curve)) and len(curve) >= best + 3
        assert max(curve) > 0.55
    again = stack.primaries(valid, "y")  # the models are those of their best pass
    assert again == pytest.approx([max(c) for c in stack.curves], abs=1e-9)


def test_tables_of_a_stack_are_bounded():
    assert [sgd.bits_for(n) for n in (1, 2, 3, 35, 10**9)] == [20, 20, 19, 15, 1]
    assert all(n << sgd.bits_for(n) <= sgd.MOST_ROWS for n in range(2, 300))


def test_nothing_to_learn_from(spark):
    df = log(spark, 30)
    rows = sgd.rows_to_learn(df, X(), [F.col("y")], [F.lit(0.0)], 1)
    stack = sgd.Stack(nets.FactorisationMachine(4), [sgd.Member()]).fit(rows, 1, 2)
    assert set(map(tuple, scores(stack, df).values())) == {(0.0,)}


def test_lambdas_equal_brute_force():
    rng = np.random.default_rng(8)
    lengths = np.array([6, 1, 30, 0, 4, 11])
    n = int(lengths.sum())
    s, y = np.round(rng.normal(size=n), 1), (rng.random(n) < 0.4).astype(float)
    for truncation in (3, 15):
        g, h = boosting.lambdas(s, y, lengths, truncation)
        want_g, want_h, at = np.zeros(n), np.zeros(n), 0
        for m in lengths:
            rows = list(range(at, at + m))
            at += m
            rank = {i: r for r, i in enumerate(sorted(rows, key=lambda i: -s[i]))}
            pos = [i for i in rows if y[i]]
            ideal = sum(1 / math.log2(r + 2) for r in range(min(truncation, len(pos))))
            for i in pos:
                for j in (j for j in rows if not y[j]):
                    if min(rank[i], rank[j]) < truncation:
                        weight = abs(1 / math.log2(rank[i] + 2) - 1 / math.log2(rank[j] + 2)) / ideal
                        p = 1 / (1 + math.exp(s[i] - s[j]))
                        want_g[i] -= weight * p
                        want_g[j] += weight * p
                        want_h[i] += weight * p * (1 - p)
                        want_h[j] += weight * p * (1 - p)
        assert g == pytest.approx(want_g) and h == pytest.approx(want_h)


def lists_to_rank(spark, n=900):
    """The label follows x within a list and the list's own level z across lists."""
    rng = random.Random(2)
    rows = []
    for i in range(n):
        u = i % 45
        level = random.Random(u).random()
        x = rng.random()
        rows.append((i, u, 20240101 + i % 3, ["train", "train", "valid"][i // (n // 3)], int(0.35 * x + level + 0.25 * rng.random() > 0.85), x if i % 50 else None, level, rng.random()))
    return spark.createDataFrame(rows, "row_id long, user_id int, date int, split string, long_view int, x double, z double, noise double").repartition(3)


@pytest.mark.parametrize("objective", boosting.OBJECTIVES)
def test_a_tree_equals_brute_force(spark, objective):
    """The first splits of a tree are those of trying every feature and edge on all rows at once."""
    df = lists_to_rank(spark, 300)
    b = boosting.Boosted(["x", "z", "noise"], objective, rounds=1, depth=2, min_data_in_leaf=5, bins=8, lambda_l1=0.05)
    b.start(df)
    records = b.records(df, "long_view", ["user_id"])
    held = records.collect()
    x, y = np.array([v if v is not None else np.nan for r in held for v in r.x]).reshape(-1, 3), np.array([v for r in held for v in r.y])
    bins = boosting.binned(x.astype(float), b.edges)
    if objective == "lambdarank":
        g, h = boosting.lambdas(np.zeros(len(y)), y, np.array([r.n for r in held]))
    else:
        g, h = 0.5 - y, np.full(len(y), 0.25)
    b.fit(records)
    (tree,) = b.trees

    def best(of):
        score = lambda m: max(abs(g[m].sum()) - 0.05, 0) ** 2 / (h[m].sum() + 1.0 + 1e-12)
        tries = [(score(of & (bins[:, f] <= e)) + score(of & (bins[:, f] > e)) - score(of), f, e) for f in range(3) for e in range(7) if min((of & (bins[:, f] <= e)).sum(), (of & (bins[:, f] > e)).sum()) >= 5]
        return max(tries, key=lambda t: (round(t[0], 9), -t[1], -t[2]))

    everything = np.ones(len(y), bool)
    gain, f, e = best(everything)
    assert gain > 0 and (tree.feature[0], tree.split[0]) == (f, e)
    for child, of in ((1, bins[:, f] <= e), (2, bins[:, f] > e)):
        gain, cf, ce = best(of)
        assert (tree.feature[child] == -1) == (gain <= 1e-12) and (gain <= 1e-12 or (tree.feature[child], tree.split[child]) == (cf, ce))
        for leaf, part in ((2 * child + 1, of & (bins[:, cf] <= ce)), (2 * child + 2, of & (bins[:, cf] > ce))):
            total = g[part].sum()
            assert tree.value[leaf] == pytest.approx(-0.1 * np.sign(total) * max(abs(total) - 0.05, 0) / (h[part].sum() + 1.0), abs=1e-9)
    got = {r.row_id: r.score for r in b.scores(df, ["row_id"]).collect()}
    assert sorted(got.values()) == pytest.approx(sorted(tree.value[tree.nodes(bins)]), abs=1e-9)


@pytest.mark.parametrize("lists", [["user_id"], ["user_id", "date"]])
def test_lambdarank_ranks_lists(spark, lists):
    """Within lists it isn't worse than trees of the binary objective, by primary on validation rows."""
    df = lists_to_rank(spark).cache()
    found = {}
    for objective in boosting.OBJECTIVES:
        b = boosting.Boosted(["x", "z", "noise"], objective, rounds=6, depth=3, bins=16, min_data_in_leaf=10)
        train = df.where("split = 'train'")
        b.start(train)
        curve = b.fit(b.records(train, "long_view", lists)).shortened(df.where("split = 'valid'"), "long_view", 2)
        found[objective] = max(p for _, p in curve)
        assert [n for n, _ in curve] == [2, 4, 6] and len(b.trees) in (2, 4, 6)
    assert found["lambdarank"] >= found["binary"] - 0.01 and found["lambdarank"] > 0.68
    with pytest.raises(ValueError, match="none of"):
        boosting.Boosted(["x"], "other").records(df, "long_view", None)


@pytest.mark.parametrize(("losses", "lists"), [(("bce",), None), (("bce", "primary"), ["user_id"])])
def test_tables_in_parts_fit_the_same(spark, tmp_path, monkeypatch, losses, lists):
    """Where gradients would be too many for the driver, tables lie in parts: the same models, and only shared codes reach it."""
    df = log(spark, 900).withColumn("user_id", (F.col("user_id") + F.col("row_id") % 10 * 12).cast("int"))
    train, valid = df.where("split = 'train'"), df.where("split = 'valid'").withColumn("x", X())
    members = [sgd.Member(label, 0, seed, loss) for loss in losses for label, seed in ((0, 1), (1, 4))]
    rows = stored(sgd.rows_to_learn(train, X(), [F.col("y"), F.col("z")], [F.col("twice")], 2, lists), tmp_path, "rows")
    found = []
    for most in (sgd.DRIVER_BYTES, 0):
        monkeypatch.setattr(sgd, "DRIVER_BYTES", most)
        stack = sgd.Stack(nets.FactorisationMachine(4), members, rate=0.1).fit(rows, 2, 3, lambda s: s.primaries(valid, "y"), patience=1)
        new = df.withColumn("x", F.array(sgd.code(0, F.col("user_id") + 6), sgd.code(1, F.col("video_id") + 9)))  # some users and items are new
        strange = df.withColumn("x", F.array(sgd.code(0, F.col("user_id")), sgd.code(0, F.lit(3))))  # an item whose code is that of a user
        found.append((stack, scores(stack, df), *({r.row_id: list(r.score) for r in stack.scores(x, ["row_id"]).collect()} for x in (new, strange))))
    (plain, *want), (parted, *got) = found
    assert plain.parts is None and parted.parts is not None
    assert set(parted.codes) >= {r.c for r in df.select(sgd.code(1, F.col("video_id")).alias("c")).distinct().collect()} and len(parted.codes) < len(plain.codes)
    assert parted.best == plain.best and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(parted.curves, plain.curves, strict=True))
    for a, b in zip(got, want, strict=True):
        assert len(a) == len(b) == 900 and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in b)


def test_attention_in_parts_fits_the_same(spark, tmp_path, monkeypatch):
    """Histories name shared codes; a leading code of a large share of the rows is dealt by chance and shared."""
    df = log(spark, 300).withColumn("user_id", F.when(F.col("row_id") % 2 == 0, 1).otherwise(F.col("row_id").cast("int") % 40))
    x = F.concat(X(), F.array(sgd.code(2, F.col("video_id")), sgd.code(2, F.col("video_id") + 1), F.lit(-1)))
    rows = stored(sgd.rows_to_learn(df, x, [F.col("y")], [F.lit(1.0)], 2), tmp_path, "rows")
    found = []
    for most in (sgd.DRIVER_BYTES, 0):
        monkeypatch.setattr(sgd, "DRIVER_BYTES", most)
        stack = sgd.Stack(nets.TargetAttention(2, k=3, hidden=6), [sgd.Member(seed=i) for i in range(2)], rate=0.05).fit(rows, 2, 3)
        found.append({r.row_id: list(r.score) for r in stack.scores(df.withColumn("x", x), ["row_id"]).collect()})
    assert stack.parts.hot == [r.c for r in df.where("user_id = 1").select(sgd.code(0, F.col("user_id")).alias("c")).distinct().collect()]
    assert len(found[0]) == 300 and all(found[1][i] == pytest.approx(found[0][i], abs=1e-9) for i in found[0])


def test_gradients_are_made_once_a_tree(spark, tmp_path):
    """What is stored before a tree: each row's score by the trees so far, and the gradients of the whole list at it."""
    df = lists_to_rank(spark, 300)
    b = boosting.Boosted(["x", "z", "noise"], "lambdarank", rounds=2, depth=2, min_data_in_leaf=5, bins=8)
    b.start(df)
    rows = b.records(df, "long_view", ["user_id"])
    for i in range(3):
        rows = b.graded(rows, str(tmp_path / f"graded{i}"))
        seen = 0
        for batch in rows.toArrow().to_batches():
            for bins, y, s, g, h, lengths in boosting._graded_parts(batch, ("y", "s", "g", "h", "lengths")):
                seen += len(y)
                assert s == pytest.approx(b.raw(bins), abs=1e-12)
                assert (g, h) == tuple(pytest.approx(v, abs=1e-12) for v in boosting.lambdas(s, y, lengths))
        assert seen == 300 and len(b.trees) == i
        b.trees.append(b.grow(rows, np.random.default_rng(0)))


@pytest.mark.parametrize("longest", [boosting.LONGEST, 10])
def test_long_lists_are_whole(spark, tmp_path, monkeypatch, longest):
    """Sums of gradients are those of whole lists, however long: a pair isn't lost because its rows lie in two records."""
    monkeypatch.setattr(boosting, "LONGEST", longest)
    rng = random.Random(4)
    rows = [(i, 0 if i < 700 else 1 + i % 2 if i < 1300 else i % 40, int(rng.random() < 0.2), rng.random(), rng.random()) for i in range(1500)]
    df = spark.createDataFrame(rows, "row_id long, user_id int, long_view int, x double, z double").repartition(5)
    b = boosting.Boosted(["x", "z"], "lambdarank", rounds=3, depth=3, min_data_in_leaf=5, bins=8)
    b.start(df)
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    bins = boosting.binned(np.array([np.float32(r[3:]) for r in rows]).astype(float), b.edges)
    y, lengths = np.array([float(r[2]) for r in rows]), np.unique([r[1] for r in rows], return_counts=True)[1]
    held = b.records(df, "long_view", ["user_id"])
    for i in range(3):  # scores are all alike at first, and of few values later
        held = b.graded(held, str(tmp_path / f"graded{i}"))
        g, h = boosting.lambdas(b.raw(bins), y, lengths)
        (got,) = b.sums(held, boosting.Tree.of(2)).values()
        for f in range(2):
            for j, v in enumerate((g, h, np.ones(1500))):
                assert got[j, f] == pytest.approx(np.bincount(bins[:, f], v, 8), abs=1e-9)
        b.trees.append(b.grow(held, np.random.default_rng(0)))


@pytest.mark.parametrize(("losses", "lists", "most"), [(("bce",), None, 0), (("bce", "primary"), ["user_id"], 12_000)])
def test_parts_lend_each_other_what_the_driver_cannot_hold(spark, tmp_path, monkeypatch, losses, lists, most):
    """Items are held by the driver only as far as their gradients fit; the fit is the same."""
    df = log(spark, 900).withColumn("user_id", (F.col("user_id") + F.col("row_id") % 10 * 12).cast("int"))
    train, valid = df.where("split = 'train'"), df.where("split = 'valid'").withColumn("x", X())
    members = [sgd.Member(label, 0, seed, loss) for loss in losses for label, seed in ((0, 1), (1, 4))]
    rows = stored(sgd.rows_to_learn(train, X(), [F.col("y"), F.col("z")], [F.col("twice")], 2, lists), tmp_path, "rows")
    monkeypatch.setattr(sgd, "SHARED_BYTES", most)
    found = []
    for driver in (sgd.DRIVER_BYTES, 0):
        monkeypatch.setattr(sgd, "DRIVER_BYTES", driver)
        stack = sgd.Stack(nets.FactorisationMachine(4), members, rate=0.1).fit(rows, 2, 3, lambda s: s.primaries(valid, "y"), patience=1)
        new = df.withColumn("x", F.array(sgd.code(0, F.col("user_id") + 6), sgd.code(1, F.col("video_id") + 9)))
        found.append((stack, scores(stack, df), {r.row_id: list(r.score) for r in stack.scores(new, ["row_id"]).collect()}))
    (plain, *want), (parted, *got) = found
    assert len(parted.codes) == most // (len(members) * 6 * (8 * 4 + 8 + 8 + 8)) < 15 and parted.parts.needs is not None
    assert parted.best == plain.best and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(parted.curves, plain.curves, strict=True))
    for a, b in zip(got, want, strict=True):
        assert len(a) == len(b) == 900 and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in b)


def test_attention_over_lent_histories(spark, tmp_path, monkeypatch):
    df = log(spark, 300).withColumn("user_id", F.when(F.col("row_id") % 2 == 0, 1).otherwise(F.col("row_id").cast("int") % 40))
    x = F.concat(X(), F.array(sgd.code(2, F.col("video_id")), sgd.code(2, F.col("video_id") + 1), F.lit(-1)))
    rows = stored(sgd.rows_to_learn(df, x, [F.col("y")], [F.lit(1.0)], 2), tmp_path, "rows")
    monkeypatch.setattr(sgd, "SHARED_BYTES", 0)
    found = []
    for most in (sgd.DRIVER_BYTES, 0):
        monkeypatch.setattr(sgd, "DRIVER_BYTES", most)
        stack = sgd.Stack(nets.TargetAttention(2, k=3, hidden=6), [sgd.Member(seed=i) for i in range(2)], rate=0.05).fit(rows, 2, 3)
        found.append({r.row_id: list(r.score) for r in stack.scores(df.withColumn("x", x), ["row_id"]).collect()})
    assert list(stack.codes) == [c for c in stack.parts.hot] and len(found[0]) == 300
    assert all(found[1][i] == pytest.approx(found[0][i], abs=1e-9) for i in found[0])


def test_pairs_of_items_are_made_once(monkeypatch):
    """The hidden layer sees each distinct pair of a row's item and a past one once, whichever way sums are made, and scores and gradients are those of rows apart."""
    net, rng = nets.TargetAttention(2, k=3, hidden=6), np.random.default_rng(6)
    x = rng.integers(-1, 9, (200, 12))
    p = {n: v + 0.3 * rng.normal(size=v.shape) for n, v in net.start(np.arange(9), 1).items()}
    g, seen = rng.normal(size=200), []
    layer = nets.TargetAttention._layer

    def counted(self, p, x, some, *more):
        found = layer(self, p, x, some, *more)
        seen.append(len(found[1]))
        return found

    monkeypatch.setattr(nets.TargetAttention, "_layer", counted)
    for dense, pairs in ((256, 2048), (0, 7)):
        monkeypatch.setattr(nets, "MOST_DENSE", dense)
        monkeypatch.setattr(nets, "PAIRS_AT_ONCE", pairs)
        seen.clear()
        s, kept = net.forward(p, net.seen(x))
        assert sum(seen) == len({(a, b) for a, *past in x[:, 2:].tolist() for b in past if b >= 0}) <= 90
        want = {n: np.zeros_like(v) for n, v in p.items()}
        for i in range(200):
            one, of_one = net.forward(p, x[i : i + 1])
            assert one[0] == pytest.approx(s[i], abs=1e-12)
            for n, (at, v) in net.backward(p, x[i : i + 1], of_one, g[i : i + 1]).items():
                want[n][slice(None) if at is None else at] += v.reshape(want[n].shape) if at is None else v
        for n, (at, v) in net.backward(p, x, kept, g).items():
            got = np.zeros_like(p[n])
            got[slice(None) if at is None else at] += v.reshape(got.shape) if at is None else v
            assert got == pytest.approx(want[n], abs=1e-12)


def test_untouched_rows_take_no_room():
    """Rows of a table that no gradient has reached are as they started: they aren't stored, and come back."""
    net, members, codes = nets.TargetAttention(2, k=3, hidden=6), [sgd.Member(seed=5)], np.arange(10, 110, dtype=np.int32)
    p = {n: v for n, v in net.start(codes, 5).items() if n in net.tables}
    m = sgd.Adam(p, 0.1, first={n: np.zeros_like(v) for n, v in p.items()}, second={n: np.zeros_like(v) for n, v in p.items()})
    g = {n: np.zeros_like(v) for n, v in p.items()}
    g["I"][3], g["E"][40:] = 0.5, -0.25
    m.move(g)
    held = sgd._as_state(0, codes, {0: m})
    assert {r["name"]: len(r["sums"]) // 24 for r in held} == {"I": 1, "E": 60}
    got_codes, got = sgd._from_state(held, net, members)
    assert (got_codes == codes).all()
    for n in p:
        for a, b in ((got[0].params, m.params), (got[0].first, m.first), (got[0].second, m.second)):
            assert (a[n] == b[n]).all()
