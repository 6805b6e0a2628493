"""Operators on small fixtures: nulls, misses, hot keys, refusals, and formulas worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pitlane.operators import cf, fusion, keys, metrics, models, pit, selection
from pitlane.plans import catalog, catalog_ranking
from pitlane.plans import context as candidates
from pitlane.sources import files
from pitlane.sources.impressions import Fold
from pitlane.streaming import prefix

from .conftest import SF


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(1, None, 20240101, 20240102, 1), (2, None, 20240102, 20240102, 0), (3, "a", 20240101, 20240101, 1), (4, None, 20240103, 20240102, 1), (5, "a", 20240103, None, 1)], "row_id int, k string, date int, hz int, long_view int")
    assert rows_of(keys.factorised(df, ["k"]), "row_id", "key_id") == [(1, 0), (2, 0), (3, 1), (4, 0), (5, 1)]
    want = [(1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 1), (5, 0, 0)]
    for by_union in (False, True):
        assert rows_of(pit.frozen_prefix(df, ["k"], by_union=by_union), "row_id", "lab", "pos") == want
    assert rows_of(pit.frozen_prefixes(df, {"x": ["k"]}), "row_id", "x_lab", "x_pos") == want
    assert rows_of(pit.earlier_days(df, ["k"], {"n": F.lit(1)}), "row_id", "n") == [(1, 0), (2, 1), (3, 0), (4, 2), (5, 1)]


def test_numbering_by_cells(spark):
    rng = random.Random(1)
    tuples = sorted({(rng.randrange(60), rng.choice("abcdefgh")) for _ in range(3_000)})
    df = spark.createDataFrame(tuples, "a int, b string").repartition(5)
    assert [tuple(r) for r in keys.numbered(df, ["a", "b"], "n", cells=7).orderBy("n").collect()] == [(*t, i) for i, t in enumerate(tuples)]
    assert keys.numbered(df.limit(0), ["a", "b"], "n").count() == 0


def test_exact_quantiles(spark):
    rng = random.Random(2)
    values = [rng.choice([1.0, 2.5, 7.0, rng.random()]) for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    s = sorted(values)
    want = [s[math.floor(h)] + (h - math.floor(h)) * (s[math.ceil(h)] - s[math.floor(h)]) for h in ((len(s) - 1) * i / 10 for i in range(1, 10))]
    assert keys.quantile_edges(df, "x", 10) == pytest.approx(want, abs=0) and keys.quantile_edges(df.where("false"), "x", 4) == []


def test_unknown_categories_and_cold_items(spark):
    log = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "row_id int, video_id int")
    dim = spark.createDataFrame([(10, "a"), (11, None), (12, "c")], "video_id int, author_id string")
    assert rows_of(files.with_author(log, dim, "video_id", ["author_id"]), "row_id", "author_id") == [(1, "a"), (2, "UNK"), (3, "UNK")]
    train = spark.createDataFrame([("x", 1), ("y", 2), (None, 1)], "tag string, tab int")
    asked = spark.createDataFrame([(1, "x", 1), (2, "new", 2), (3, None, 9)], "row_id int, tag string, tab int")
    out, slots = keys.encoded(asked, train, ["tag", "tab"])
    assert rows_of(out, "row_id", "tag_id", "tab_id") == [(1, 0, 3), (2, 2, 4), (3, 2, 5)] and slots == 6


def test_plans_of_families_grow_in_proportion(spark):
    log = catalog.log(spark, SF)
    size = lambda n: pit.family_features(log, dict(list(pit.FAMILIES.items())[:n]))._jdf.queryExecution().analyzed().toString().count("Relation")
    one, four, eight = size(1), size(4), size(8)
    assert eight - four <= 1.5 * (four - one) and eight <= 8 * one


def test_context_has_no_outcomes(spark):
    c = candidates.Context.of(catalog.log(spark, SF).drop("hz", "split", "author_id", "tag", "video_type"), Fold("official"), *catalog.dimensions(spark, SF))
    assert not {"long_view", "is_click"} & set(c.rows.columns) and not hasattr(c, "log")
    assert c.part("valid").agg(F.min("date"), F.max("date")).first()[:] == (20240115, 20240121)
    with pytest.raises(ValueError, match="no feedback"):
        c.auxiliary_signal("duration_ms")
    with pytest.raises(ValueError, match="none of context, item, user"):
        c.expert_score("weather")
    bad = candidates.Candidate("bad", "f", lambda ctx: (candidates.popularity(ctx), {"n_estimators": 3}))
    assert "n_estimators can't be set" in candidates.run_candidate(c, bad)["detail"]


def test_parameters_are_clipped_or_refused():
    assert models.clipped_params({"learning_rate": 5.0, "num_leaves": 2.9, "lambda_l1": -1}) == {"learning_rate": 0.3, "num_leaves": 7, "lambda_l1": 0.0}
    for bad in ({"max_leaf_nodes": 3}, {"num_leaves": "x"}, {"num_leaves": float("nan")}, {"num_leaves": True}):
        with pytest.raises(ValueError):
            models.clipped_params(bad)
    assert models.tree_params({"num_leaves": 31, "bagging_fraction": 0.1}) == {"depth": 5, "subsamplingRate": 0.3}


def test_losses_by_hand(spark):
    rows = [(1, "u", 1, 0.3), (2, "u", 0, 0.5), (3, "u", 0, -0.2), (4, "u", 1, 0.1), (5, "v", 1, 0.7), (6, "w", 0, 0.2), (7, "w", 1, 0.2)]
    got = {r.loss: r.value for r in models.loss_values(spark.createDataFrame(rows, "row_id int, user_id string, y int, s double"), ["user_id"], "y", "s").collect()}
    soft = lambda x: math.log1p(math.exp(x))
    lists, gain = {g: [r for r in rows if r[1] == g] for g in "uw"}, lambda i: 1 / math.log2(i + 2) if i < 5 else 0
    bpr, gauc, net, ndcg, npos = [], 0.0, [], [], 0
    for g in lists.values():
        place = {r[0]: gain(i) for i, r in enumerate(sorted(g, key=lambda r: (-r[3], r[0])))}
        pairs = [(p, n) for p in g for n in g if p[2] and not n[2]]
        pos, neg = sum(r[2] for r in g), sum(1 - r[2] for r in g)
        bpr.append(sum(soft(n[3] - p[3]) for p, n in pairs) / len(pairs))
        gauc, npos = gauc + sum(soft(n[3] - p[3]) for p, n in pairs) / neg, npos + pos
        net.append(-sum(r[2] * (r[3] - math.log(sum(math.exp(x[3]) for x in g))) for r in g) / pos)
        ndcg.append(sum(soft(n[3] - p[3]) * abs(place[p[0]] - place[n[0]]) for p, n in pairs) / sum(gain(i) for i in range(pos)) / len(pairs))
    want = {"bce": sum(soft(r[3]) - r[2] * r[3] for r in rows) / 7, "bpr": sum(bpr) / 2, "bpr_gauc": gauc / npos, "listnet": sum(net) / 2, "lambda_ndcg": sum(ndcg) / 2}
    assert got == pytest.approx(want | {"primary": (want["bpr_gauc"] + want["lambda_ndcg"]) / 2})


def test_causal_cf_of_a_heavy_user(spark):
    rng = random.Random(4)
    log = [(i, rng.choice("aaab"), rng.randrange(12), rng.randrange(40), rng.randrange(2)) for i in range(160)]
    df = spark.createDataFrame(log, "row_id int, user_id string, video_id int, time_ms int, long_view int")
    sims = {(i, j): round(rng.random(), 3) for i in range(12) for j in range(12) if i != j and rng.random() < 0.6}
    table = spark.createDataFrame([(i, j, s) for (i, j), s in sims.items()], "i int, j int, sim double")
    want = []
    for r, u, j, t, _ in log:
        past = [x for x in log if x[1] == u and x[4] and (x[3], x[0]) < (t, r)]
        want.append((r, round(sum(sims.get((x[2], j), 0) for x in past), 6), len(past)))
    for block in (10, 1_000):
        out = cf.causal_scores(df, table, block_rows=block).withColumn("cf_sum", F.round("cf_sum", 6))
        assert rows_of(out, "row_id", "cf_sum", "cf_hist_n") == sorted(want, key=str)


def test_stream_of_several_batches(spark, tmp_path):
    rng = random.Random(6)
    log = [(i, rng.choice(["hot", "hot", "b", None]), rng.choice([0, 1, None]), i) for i in range(90)]
    for b in range(3):
        spark.createDataFrame(log[30 * b : 30 * b + 30], "row_id long, k string, y int, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, k string, y int, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        prefix.start_prefix(stream, "k", "y", "t", str(tmp_path / "out")).awaitTermination()
    want = [(i, sum(x[1] == k for x in log[:i]), sum(x[2] or 0 for x in log[:i] if x[1] == k)) for i, k, _, _ in log]
    assert rows_of(spark.read.parquet(str(tmp_path / "out/rows")), "row_id", "prior_n", "prior_pos") == sorted(want, key=str)
    # a batch that is run again counts nothing twice
    batch = spark.read.parquet(str(tmp_path / "in")).where("row_id >= 60")
    state = spark.read.parquet(str(tmp_path / "out/state/v1"))
    assert rows_of(prefix.next_state(batch, state), "k", "n", "pos") == rows_of(spark.read.parquet(str(tmp_path / "out/state/v2")), "k", "n", "pos")


def test_logs_as_csv(spark, tmp_path):
    for name, lines in (("b.csv", ["5,50,20240101,1,0,1.5,1", "6,,20240102,2,1,,0"]), ("a.csv", ["7,70,20240103,3,2,2.5,1"])):
        (tmp_path / name).write_text("user_id,video_id,date,time_ms,tab,duration_ms,long_view\n" + "\n".join(lines) + "\n")
    out = files.read_log(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")])
    assert rows_of(out, "row_id", "user_id", "video_id", "duration_ms") == [(0, 5, 50, 1.5), (1, 6, None, None), (2, 7, 70, 2.5)]


def test_logs_of_many_blocks(spark, tmp_path):
    """Files that are read in blocks, a folder of them, names with blanks; rows are numbered in the order of paths and lines."""
    head = "user_id,video_id,date,time_ms,tab,duration_ms,long_view\n"
    counts = {"z.csv": 400, "f/part 2.csv": 150, "f/part-1.csv": 3, "a b.csv": 1}
    (tmp_path / "f").mkdir()
    for n, (name, rows) in enumerate(counts.items()):
        (tmp_path / name).write_text(head + "".join(f"{n},{i},20240101,{i},0,1.0,1\n" for i in range(rows)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1k")
        out = files.read_log(spark, [str(tmp_path / p) for p in ("z.csv", "f", "a b.csv")])
        assert out.rdd.getNumPartitions() > 8
        got = [(r.user_id, r.video_id) for r in out.orderBy("row_id").collect()]
        ids = [r.row_id for r in out.select("row_id").orderBy("row_id").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(n, i) for n in (0, 1, 2, 3) for i in range(list(counts.values())[n])] and ids == list(range(554))
    with pytest.raises(ValueError, match="twice"):
        files.read_log(spark, [str(tmp_path / "z.csv")] * 2)


def test_json_over_many_lines(spark, tmp_path):
    cases = {"a": 'x {"y": {"n": 1}}\n"tokens": {\n "m}": {"in": 1,\n "s": "\\"{"}\n}\nrest }', "b": "nothing", "c": '"tokens": {"open": {', "d": '"tokens": 3'}
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
    got = {r.path[-1]: r.block for r in files.parse_blocks(spark, [str(tmp_path / n) for n in cases], "tokens").collect()}
    assert got == {"a": '{\n "m}": {"in": 1,\n "s": "\\"{"}\n}', "b": None, "c": None, "d": None}


def test_sealed_split_and_matrix(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "test", 1, 0.5), (2, 1, "test", 0, 0.1)], "row_id int, user_id int, split string, long_view int, score double")
    path = str(tmp_path / "audit")
    with pytest.raises(files.SealedSplit):
        files.audited_score(rows, "long_view", "score", "test", path, sealed=True)
    assert [files.audited_score(rows, "long_view", "score", "test", path).first().gauc for _ in range(2)] == [1.0, 1.0]
    assert rows_of(files.read_audit(spark, path), "split", "call") == [("test", 1), ("test", 2)]
    files.write_matrix(rows.select("row_id", "score"), str(tmp_path / "m"))
    assert files.read_matrix(spark, str(tmp_path / "m"), 2)[1] == ["score"]
    with pytest.raises(ValueError, match="expected 3"):
        files.read_matrix(spark, str(tmp_path / "m"), 3)


def test_real_experts_and_importances(spark):
    """Small trees on each family of a log whose label follows from the item; the telling feature is the most important one."""
    rng = random.Random(3)
    liked = {v: rng.random() for v in range(20)}
    rows = []
    for i in range(2_000):
        v = rng.randrange(20)
        rows.append((i, i % 40, v, f"a{v % 5}", i % 3, 20240101 + i % 28, rng.random() * 60, i % 24, int(rng.random() < liked[v]), rng.random()))
    df = spark.createDataFrame(rows, "row_id int, user_id int, video_id int, author_id string, tab int, date int, duration_ms double, hour int, long_view int, noise double")
    fold = Fold("official")
    df = fold.with_part(df).withColumn("hz", keys.window_horizon(F.col("date"), fold.schedule())).withColumn("dur_bucket", F.floor(F.col("duration_ms") / 25).cast("int"))
    primary = {}
    for name in models.EXPERTS:
        matrix, names = models.expert_matrix(df, name, 0.4)
        matrix = matrix.cache()
        scores = models.expert_scores(matrix, names, budget=3)
        assert scores.count() == 2_000 and scores.where("score is null or isnan(score)").count() == 0
        scored = matrix.where("split = 'valid'").join(scores, "row_id")
        primary[name] = metrics.evaluate(scored, "long_view", "score").first().primary
    assert primary["item"] > max(primary["user"], primary["context"]) + 0.02
    matrix, names = models.expert_matrix(df.where("split = 'train'"), "item", 0.4)
    top = models.importances(matrix.join(df.select("row_id", "noise"), "row_id"), [*names[:2], "noise"], top=3, iterations=3).collect()
    assert len(top) == 3 and sum(r.importance for r in top) == pytest.approx(1.0) and [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)
    told = df.withColumn("told", F.col("long_view") + 0.1 * F.col("noise"))
    assert models.importances(told, ["noise", "told", "tab"], top=1, iterations=2).first().feature == "told"


def test_decomposition_adds_up(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        a, b = rng.random(), rng.random()
        rows.append((i, i % 30, ["train", "train", "valid"][i % 3], 1, int(a + b + 0.2 * rng.random() > 1.1), a, b))
    df = spark.createDataFrame(rows, "row_id int, user_id int, split string, hz int, long_view int, a double, b double")
    x, y = models.decomposition(df, {"first": ["a"], "second": ["b"]}, budget=3).orderBy("place").collect()
    assert x.marginal is None and y.marginal == pytest.approx(y.cumulative - x.cumulative) and y.marginal > 0.02 and x.standalone > 0.5


def test_decomposition_reads_the_log_once(spark, monkeypatch):
    logs, scored = [], []
    prefixes, predict = catalog_ranking.pit.frozen_prefixes, models.predict
    monkeypatch.setattr(catalog_ranking.pit, "frozen_prefixes", lambda df, *a: logs.append(df) or prefixes(df, *a))
    monkeypatch.setattr(models, "predict", lambda model, rows, *a: scored.append(rows) or predict(model, rows, *a))
    assert catalog_ranking.dia06(spark, SF).count() == len(catalog_ranking._SOURCES) == len(scored)
    assert "get_json_object" not in logs[0]._jdf.queryExecution().optimizedPlan().toString()  # stored, as each source reads it
    assert all(rows.where("split <> 'valid'").isEmpty() for rows in scored)


def test_findings_and_better_members(spark):
    one = spark.createDataFrame([(0.51,), (0.53,)], "p double").select(selection.shuffle_finding(F.col("p")).alias("f"))
    assert [r.f for r in one.collect()] == ["OK", "BLOCK"]
    rows = [(i, i // 6, y, float(y), float(-y), 0.5 * y + (i % 3) / 3) for i, y in enumerate([1, 0, 0, 1, 0, 1] * 5)]
    df = spark.createDataFrame(rows, "row_id int, user_id int, long_view int, good double, bad double, middling double")
    assert fusion.better_members(df, {"good": 0.0, "bad": 0.0}, "middling", "long_view", ["user_id"]) == ["good"]


def plain_primary(rows, score):
    """GAUC and nDCG@5 by counting, over lists of (user, row, label, ...)."""
    lists = {}
    for r in rows:
        lists.setdefault(r[1], []).append((score(r), r[0], r[2]))
    won = weight = gain = 0.0
    for g in lists.values():
        pos, neg = [s for s, _, y in g if y], [s for s, _, y in g if not y]
        if pos and neg:
            won += sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(neg)
            weight += len(pos)
        if pos:
            top = sorted(g, key=lambda x: (-x[0], x[1]))[:5]
            gain += sum(y / math.log2(i + 2) for i, (_, _, y) in enumerate(top)) / sum(1 / math.log2(i + 2) for i in range(min(5, len(pos))))
    return ((won / weight if weight else 0.5) + gain / len(lists)) / 2


def test_weight_searches_equal_plain_ones(spark):
    rng = random.Random(14)
    rows = [(i, i % 9, int(rng.random() < 0.4), *(round(rng.random(), 2) for _ in range(3))) for i in range(90)]
    rows = [(*r[:3], round(0.4 * r[2] + 0.6 * r[3], 3), round(0.2 * r[2] + 0.8 * r[4], 3), r[5]) for r in rows]
    df = spark.createDataFrame(rows, "row_id int, user_id int, y int, a double, b double, c double")
    members = ["a", "b", "c"]
    value = lambda w: plain_primary(rows, lambda r: sum(r[3 + members.index(m)] * x for m, x in w.items()) / sum(w.values()))
    best = lambda tries: max(range(len(tries)), key=lambda i: (round(value(tries[i]), 12), -i))

    weights = dict.fromkeys(members, 1.0)
    trace = [value(weights)]
    for _ in range(2):
        start = trace[-1]
        for m in members:
            tries = [{**weights, m: max(0.0, weights[m] + s)} for s in (0.4, 0.2, 0.1, -0.1, -0.2)]
            i = best(tries)
            if value(tries[i]) > trace[-1] + 1e-6:
                weights = tries[i]
                trace.append(value(weights))
        if trace[-1] <= start + 1e-6:
            break
    got, path = fusion.coordinate_ascent(df, members, "y", ["user_id"], rounds=2)
    assert got == pytest.approx(weights) and path == pytest.approx(trace)

    singles = [{m: 1.0} for m in members]
    weights = singles[best(singles)]
    trace = [value(weights)]
    for _ in range(3):
        tries = [{**weights, m: weights.get(m, 0.0) + s} for m in members for s in (0.05, 0.1, 0.2)]
        i = best(tries)
        if value(tries[i]) <= trace[-1]:
            break
        weights = tries[i]
        trace.append(value(weights))
    got, path = fusion.greedy_forward(df, members, "y", ["user_id"], rounds=3)
    assert got == pytest.approx(weights) and path == pytest.approx(trace)


def test_shuffled_labels_and_a_leaky_pipeline(spark):
    rows = [(i, i % 20, int(i % 3 == 0)) for i in range(1_200)]
    out = selection.shuffled_labels(spark.createDataFrame(rows, "row_id int, user_id int, long_view int"), "long_view", 5)
    dealt = {r.row_id: r.shuffled for r in out.collect()}
    assert len(dealt) == 1_200 and sum(dealt.values()) == 400 and sum(dealt[i] == y for i, _, y in rows) < 900
    primary = plain_primary(rows, lambda r: r[2])
    one = spark.createDataFrame([(primary,)], "p double").select(selection.shuffle_finding(F.col("p")).alias("f"))
    assert one.first().f == "BLOCK"
