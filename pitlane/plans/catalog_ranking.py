"""Queries of metrics, diagnostics, collaborative filtering, fusion, selection, audits and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import count_below, day_index, hashed_unit, hashed_unit_sql
from ..operators import cf, diagnostics, fusion, keys, learners, metrics, models, pit, runs, selection, windows
from .catalog import BASE, DAY_LEDGER, OFFICIAL, POP, SCHEDULE, SUMMARY, day_ledger, groups_sql, log, popularity, query, r6, rounded_summary, stored
from .catalog_features import _COSINE, _TRAIN_EDGES, train_edges

W, P = f"WITH {BASE} ", f"WITH {POP} "
TEST = "SELECT * FROM pop WHERE split = 'test'"


def test_rows(spark, d):
    return OFFICIAL.rows(popularity(spark, d), "test")


def test_groups(spark, d, group=("user_id",)):
    return metrics.per_group(test_rows(spark, d), list(group), "long_view", "score")


@query("met01_auc", P + f", {groups_sql(TEST)} SELECT user_id, round(coalesce(auc, 0.5), 6) AS auc FROM per")
def met01(spark, d):
    return test_groups(spark, d).select("user_id", r6(F.coalesce("auc", F.lit(0.5)), "auc"))


@query("met02_ndcg", P + f", {groups_sql(TEST)} SELECT user_id, round(ndcg, 6) AS ndcg FROM per")
def met02(spark, d):
    return test_groups(spark, d).select("user_id", r6("ndcg", "ndcg"))


@query("met03_gauc", P + f", {groups_sql(TEST)} SELECT round(coalesce(sum(CASE WHEN valid THEN npos * auc END) / sum(CASE WHEN valid THEN npos END), 0.5), 6) AS gauc FROM per")
def met03(spark, d):
    return metrics.summary(test_groups(spark, d)).select(r6("gauc", "gauc"))


@query("met04_evaluate", P + f", {groups_sql(TEST)} SELECT {SUMMARY} FROM per")
def met04(spark, d):
    return rounded_summary(metrics.evaluate(test_rows(spark, d), "long_view", "score"))


@query("met04_by_user_day", P + f", {groups_sql(TEST, 'user_id, date')} SELECT {SUMMARY} FROM per")
def met04_day(spark, d):
    return rounded_summary(metrics.evaluate(test_rows(spark, d), "long_view", "score", ["user_id", "date"]))


@query("met05_per_group", P + f", {groups_sql(TEST, 'user_id, date')} SELECT user_id, date, size, npos, round(auc, 6) AS auc, round(ndcg, 6) AS ndcg, valid FROM per")
def met05(spark, d):
    return test_groups(spark, d, ("user_id", "date")).select("user_id", "date", "size", "npos", r6("auc", "auc"), r6("ndcg", "ndcg"), "valid")


@query("met06_random_baseline", P + f", {groups_sql(TEST.replace('*', 'user_id, row_id, long_view, ' + hashed_unit_sql('row_id', 17) + ' AS score'))} SELECT {SUMMARY} FROM per")
def met06(spark, d):
    return rounded_summary(metrics.evaluate(test_rows(spark, d).withColumn("random", hashed_unit(F.col("row_id"), 17)), "long_view", "random"))


@query("met07_oracles", P + f", {groups_sql(TEST.replace('*', 'user_id, row_id, long_view, CAST(long_view AS DOUBLE) AS score'))} SELECT {SUMMARY} FROM per")
def met07(spark, d):
    return rounded_summary(metrics.evaluate(test_rows(spark, d).withColumn("oracle", F.col("long_view").cast("double")), "long_view", "oracle"))


@query("met08_composition", P + f", {groups_sql(TEST, 'user_id, date')} SELECT CAST(count(*) AS BIGINT) AS groups, round(count(*) FILTER (WHERE npos = 0) / count(*), 6) AS all_neg, round(count(*) FILTER (WHERE npos = size) / count(*), 6) AS all_pos, round(count(*) FILTER (WHERE valid) / count(*), 6) AS discriminative FROM per")
def met08(spark, d):
    c = metrics.composition(test_groups(spark, d, ("user_id", "date")))
    return c.select("groups", *[r6(x, x) for x in ("all_neg", "all_pos", "discriminative")])


_SLICED = groups_sql(TEST, "user_id, date") + """, s AS (SELECT CAST(least(size, 12) AS BIGINT) AS bucket, count(*) AS users, avg(ndcg) AS ndcg_mean, avg(auc) AS auc_mean, sum(CASE WHEN valid THEN npos ELSE 0 END) AS w, avg(CASE WHEN npos > 0 THEN 1.0::DOUBLE ELSE 0 END) AS ceiling FROM per GROUP BY 1)"""


@query("dia01_headroom", P + f", {_SLICED} SELECT bucket, CAST(users AS BIGINT) AS users, round(ndcg_mean, 6) AS ndcg_mean, round(auc_mean, 6) AS auc_mean, round(w / sum(w) OVER (), 6) AS held, round(ceiling, 6) AS ceiling, round(users / sum(users) OVER () * (ceiling - ndcg_mean), 6) AS headroom FROM s")
def dia01(spark, d):
    out = diagnostics.headroom(test_groups(spark, d, ("user_id", "date")), F.least("size", F.lit(12)))
    return out.select("bucket", "users", *[r6(c, c) for c in ("ndcg_mean", "auc_mean", "held", "ceiling", "headroom")])


_INV = f"""t AS ({TEST}), n AS (SELECT user_id, sum(1 - long_view) AS neg FROM t GROUP BY 1), tot AS (SELECT sum(long_view) AS total FROM t),
  inv AS (SELECT b.tab, sum(CASE WHEN b.score > a.score THEN 1 WHEN b.score = a.score THEN 0.5 ELSE 0 END / CAST(n.neg * tot.total AS DOUBLE)) AS loss FROM t a JOIN t b ON a.user_id = b.user_id AND a.long_view = 1 AND b.long_view = 0 JOIN n ON n.user_id = b.user_id CROSS JOIN tot GROUP BY 1)"""


@query("dia02_inversions", P + f", {_INV} SELECT tab, round(loss, 6) AS loss FROM inv")
def dia02(spark, d):
    return diagnostics.inversions(test_rows(spark, d), ["user_id"], "long_view", "score", "tab").select("tab", r6("loss", "loss"))


@query("dia03_digest", P + f""", {groups_sql(TEST)}, s AS (SELECT CAST(least(size, 12) AS BIGINT) AS bucket, count(*) AS users, avg(ndcg) AS ndcg_mean, avg(CASE WHEN npos > 0 THEN 1.0::DOUBLE ELSE 0 END) AS ceiling FROM per GROUP BY 1),
  h AS (SELECT bucket, users / sum(users) OVER () * (ceiling - ndcg_mean) AS headroom FROM s ORDER BY headroom DESC, bucket LIMIT 4), {_INV}, l AS (SELECT tab, loss FROM inv ORDER BY loss DESC, tab LIMIT 4),
  m AS (SELECT coalesce(sum(CASE WHEN valid THEN npos * auc END) / sum(CASE WHEN valid THEN npos END), 0.5) AS gauc, avg(ndcg) AS ndcg FROM per)
  SELECT 'gauc' AS part, '' AS name, round(gauc, 4) AS value FROM m UNION ALL SELECT 'ndcg5', '', round(ndcg, 4) FROM m UNION ALL SELECT 'slice', CAST(bucket AS VARCHAR), round(headroom, 4) FROM h UNION ALL SELECT 'inversion', CAST(tab AS VARCHAR), round(loss, 4) FROM l""")
def dia03(spark, d):
    """The digest as rows: part (gauc, ndcg5, slice or inversion), name, value."""
    rows = test_rows(spark, d)
    groups = metrics.per_group(rows, ["user_id"], "long_view", "score")
    out = diagnostics.digest(metrics.summary(groups), diagnostics.headroom(groups, F.least("size", F.lit(12))), diagnostics.inversions(rows, ["user_id"], "long_view", "score", "tab"), "tab")
    row = lambda part, name, value: F.struct(F.lit(part).alias("part"), name.alias("name"), value.alias("value"))
    lists = [F.array(row("gauc", F.lit(""), F.col("gauc")), row("ndcg5", F.lit(""), F.col("ndcg"))), F.transform("slices", lambda x: row("slice", x["bucket"], x["headroom"])), F.transform("inversions", lambda x: row("inversion", x["value"], x["loss"]))]
    return out.select(F.inline(F.concat(*lists)))


@query("dia04_picked_slice", P + f", {_SLICED}, h AS (SELECT *, users / sum(users) OVER () * (ceiling - ndcg_mean) AS headroom FROM s ORDER BY headroom DESC, bucket LIMIT 4) SELECT round(min(ndcg_mean), 6) AS picked FROM h")
def dia04(spark, d):
    return diagnostics.picked_slice(diagnostics.headroom(test_groups(spark, d, ("user_id", "date")), F.least("size", F.lit(12))), "ndcg_mean", "min").select(r6("picked", "picked"))


# of each hour the rates of two splits as figures before and after, and a direction that was foretold
_MOVES = "r AS (SELECT hour, avg(long_view) FILTER (WHERE split = 'train') AS a, avg(long_view) FILTER (WHERE split = 'valid' AND hour <> 5) AS b, CASE hour % 3 WHEN 0 THEN 'increase' WHEN 1 THEN 'decrease' ELSE '' END AS direction FROM log GROUP BY 1)"


def moves(spark, d):
    y, split = F.col("long_view"), F.col("split")
    out = log(spark, d).groupBy("hour").agg(F.avg(F.when(split == "train", y)).alias("a"), F.avg(F.when((split == "valid") & (F.col("hour") != 5), y)).alias("b"))
    return out.withColumn("direction", F.when(F.col("hour") % 3 == 0, "increase").when(F.col("hour") % 3 == 1, "decrease").otherwise(""))


@query("dia05_predictions", W + f", {_MOVES} SELECT hour, direction, CASE WHEN b - a IS NULL THEN NULL WHEN direction = 'increase' THEN abs(b - a) >= 0.0001 AND b > a WHEN direction = 'decrease' THEN abs(b - a) >= 0.0001 AND b < a END AS holds FROM r")
def dia05(spark, d):
    return moves(spark, d).select("hour", "direction", diagnostics.prediction_holds(F.col("a"), F.col("b"), F.col("direction")).alias("holds"))


#: Sources in the order in which they are added, and the keys of their rates.
_SOURCES = {"context": ["tab"], "item": ["video_id"], "item_tab": ["video_id", "tab"], "user_dur": ["user_id", "dur_bucket"], "user_author": ["user_id", "author_id"], "user_item": ["user_id", "video_id"]}


@query("dia06_decomposition")
def dia06(spark, d):
    """Each source's frozen rate alone on the validation days, trees over it and all sources before it, and what it adds."""
    known = dict.fromkeys(["row_id", "user_id", "split", "hz", "date", "long_view", "duration_ms", *(k for by in _SOURCES.values() for k in by)])
    past = stored(log(spark, d).where("split in ('train', 'valid')").select(*known), "log")  # no horizon of these days sees a later one
    rows = pit.frozen_prefixes(past, _SOURCES)
    rows = rows.select("row_id", "user_id", "split", "hz", "long_view", F.log1p("duration_ms").alias("log_duration"), *pit.rate_columns(_SOURCES, 0.4))
    columns = {n: [f"{n}_rate"] for n in _SOURCES}
    columns["item"].append("log_duration")
    return models.decomposition(rows, columns)


# collaborative filtering


@query("cf01_cosine", W + _COSINE + " SELECT i, j, round(sim, 6) AS sim FROM sim")
def cf01(spark, d):
    return cf.cosine(train_edges(spark, d)).select("i", "j", r6("sim", "sim"))


@query(
    "cf02_causal_scores",
    W + _COSINE + """, p AS (SELECT user_id, video_id AS i, time_ms AS t, row_id AS r FROM log WHERE long_view = 1)
    SELECT l.row_id, round(coalesce(sum(sim.sim), 0), 6) AS cf_sum, CAST(count(p.r) AS BIGINT) AS cf_hist_n FROM log l LEFT JOIN p ON p.user_id = l.user_id AND (p.t < l.time_ms OR p.t = l.time_ms AND p.r < l.row_id) LEFT JOIN sim ON sim.i = p.i AND sim.j = l.video_id GROUP BY 1""",
)
def cf02(spark, d):
    return cf.causal_scores(log(spark, d), cf.cosine(train_edges(spark, d))).select("row_id", r6("cf_sum", "cf_sum"), "cf_hist_n")


@query(
    "cf03_frozen_scores",
    W + ", sch(lo, hi, h) AS (VALUES " + ", ".join(map(str, SCHEDULE)) + """), e AS (SELECT DISTINCT h, user_id AS u, video_id AS i FROM log JOIN sch ON date <= h WHERE long_view = 1), ok AS (SELECT h FROM e GROUP BY 1 HAVING count(*) >= 100),
    c AS (SELECT h, i, count(*) AS n FROM e GROUP BY ALL), x AS (SELECT a.h, a.i, b.i AS j, count(*) AS n FROM e a JOIN e b ON a.h = b.h AND a.u = b.u AND a.i <> b.i GROUP BY ALL),
    sim AS (SELECT x.h, x.i, x.j, x.n / sqrt(CAST(a.n * b.n AS DOUBLE)) AS s FROM x JOIN c a ON a.h = x.h AND a.i = x.i JOIN c b ON b.h = x.h AND b.i = x.j), hist AS (SELECT h, u, count(*) AS n FROM e GROUP BY ALL),
    t AS (SELECT DISTINCT hz AS h, user_id AS u, video_id AS j FROM log), sc AS (SELECT t.h, t.u, t.j, sum(sim.s) AS s FROM t JOIN e ON e.h = t.h AND e.u = t.u JOIN sim ON sim.h = t.h AND sim.i = e.i AND sim.j = t.j GROUP BY ALL),
    r AS (SELECT row_id, CASE WHEN ok.h IS NULL THEN 0 ELSE coalesce(sc.s, 0) END AS s, CASE WHEN ok.h IS NULL THEN 0 ELSE coalesce(hist.n, 0) END AS n FROM log LEFT JOIN ok ON ok.h = hz LEFT JOIN sc ON sc.h = hz AND sc.u = user_id AND sc.j = video_id LEFT JOIN hist ON hist.h = hz AND hist.u = user_id)
    SELECT row_id, round(s, 6) AS cf_sum, round(CASE WHEN n > 0 THEN s / n ELSE 0 END, 6) AS cf_mean, CAST(n AS BIGINT) AS history_n FROM r""",
)
def cf03(spark, d):
    out = cf.frozen_scores(log(spark, d), SCHEDULE)
    return out.select("row_id", r6("cf_sum", "cf_sum"), r6("cf_mean", "cf_mean"), "history_n")


_IDF = _TRAIN_EDGES + """, c AS (SELECT i, count(*) AS n, ln(1 + (SELECT count(DISTINCT u) FROM e) / greatest(count(*), 1)) AS f FROM e GROUP BY 1),
  x AS (SELECT a.i, b.i AS j, count(*) AS n FROM e a JOIN e b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2)"""


@query("cf04_idf_cosine", W + _IDF + " SELECT x.i, x.j, round(x.n / sqrt(CAST(a.n * b.n AS DOUBLE)) * sqrt(b.f / a.f), 6) AS sim FROM x JOIN c a ON a.i = x.i JOIN c b ON b.i = x.j")
def cf04(spark, d):
    return cf.idf_cosine(train_edges(spark, d)).select("i", "j", r6("sim", "sim"))


# fusion

_MEMBERS = P + """, m AS (SELECT *, 1 - (row_number() OVER (PARTITION BY user_id ORDER BY score DESC, row_id) - 1) / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1) AS a,
  1 - (row_number() OVER (PARTITION BY user_id ORDER BY duration_ms DESC, row_id) - 1) / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1) AS b,
  1 - (row_number() OVER (PARTITION BY user_id ORDER BY hour DESC, row_id) - 1) / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1) AS c FROM pop WHERE split = 'valid')"""


def members(spark, d):
    rows = OFFICIAL.rows(popularity(spark, d), "valid")
    return rows.withColumns({n: windows.percentile_rank(["user_id"], s, "row_id") for n, s in (("a", "score"), ("b", "duration_ms"), ("c", "hour"))})


@query("fus01_seed_average", _MEMBERS + " SELECT row_id, round((a + b + c) / 3, 9) AS fused FROM m")
def fus01(spark, d):
    rows = OFFICIAL.rows(popularity(spark, d), "valid")
    return fusion.seed_average(rows, ["user_id"], ["score", "duration_ms", "hour"]).select("row_id", F.round("fused", 9).alias("fused"))


@query("fus02_linear", _MEMBERS + " SELECT row_id, round((0.5 * a + 0.3 * b + 0.2 * c) / 1.0, 6) AS fused FROM m")
def fus02(spark, d):
    return members(spark, d).select("row_id", r6(fusion.linear({"a": 0.5, "b": 0.3, "c": 0.2}), "fused"))


@query("fus03_power", _MEMBERS + " SELECT row_id, round((power(least(greatest(a, 1e-6), 1), 0.75) * 2 + power(least(greatest(b, 1e-6), 1), 0.75)) / 3, 6) AS fused FROM m")
def fus03(spark, d):
    return members(spark, d).select("row_id", r6(fusion.power({"a": 2.0, "b": 1.0}, 0.75), "fused"))


@query("fus04_grid", _MEMBERS + f""", g AS (SELECT CAST(i AS DOUBLE) / 50 AS weight, m.user_id, m.row_id, m.long_view, (a * (CAST(i AS DOUBLE) / 50) + b * (1 - CAST(i AS DOUBLE) / 50)) / (CAST(i AS DOUBLE) / 50 + (1 - CAST(i AS DOUBLE) / 50)) AS score FROM m CROSS JOIN range(51) t(i)), {groups_sql("SELECT * FROM g", "weight, user_id")}
    SELECT round(weight, 6) AS weight, round((sum(CASE WHEN valid THEN npos * auc END) / sum(CASE WHEN valid THEN npos END) + avg(ndcg)) / 2, 3) AS primary_score FROM per GROUP BY 1""")
def fus04(spark, d):
    out = fusion.grid(_searched(spark, d), "a", "b", "long_view", ["user_id"])
    return out.select(r6("weight", "weight"), F.round("primary", 3).alias("primary_score"))


def _searched(spark, d):
    return stored(members(spark, d).select("user_id", "row_id", "long_view", "a", "b", "c"), "members")


@query("fus05_coordinate_ascent")
def fus05(spark, d):
    weights, trace = fusion.coordinate_ascent(_searched(spark, d), ["a", "b", "c"], "long_view", ["user_id"])
    return spark.createDataFrame([(m, float(w), trace[-1]) for m, w in weights.items()], "member string, weight double, value double")


@query("fus06_greedy_forward")
def fus06(spark, d):
    weights, trace = fusion.greedy_forward(_searched(spark, d), ["a", "b", "c"], "long_view", ["user_id"])
    return spark.createDataFrame([(m, float(w), trace[-1]) for m, w in weights.items()], "member string, weight double, value double")


_BETTER = ", ".join(f"{x}r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY {x}) + (count(*) OVER (PARTITION BY user_id, {x}) - 1) / CAST(2 AS DOUBLE) AS r, row_number() OVER (PARTITION BY user_id ORDER BY {x} DESC, row_id) AS i FROM m), {x}p AS ({{per}} FROM {x}r GROUP BY user_id), {x}v AS (SELECT (coalesce(sum(CASE WHEN valid THEN npos * auc END) / sum(CASE WHEN valid THEN npos END), 0.5) + avg(ndcg)) / 2 AS v FROM {x}p)" for x in "abc")
_BETTER = _BETTER.replace("{per}", groups_sql("SELECT 1").split("per AS (")[1].split("FROM ranked")[0])


@query("fus07_better_members", _MEMBERS + f", {_BETTER}, w AS (SELECT 1 AS wa, CASE WHEN (SELECT v FROM bv) > (SELECT v FROM av) THEN 1 ELSE 0 END AS wb, CASE WHEN (SELECT v FROM cv) > (SELECT v FROM av) - 0.05 THEN 1 ELSE 0 END AS wc) SELECT row_id, round((wa * a + wb * b + wc * c) / (wa + wb + wc), 9) AS fused FROM m CROSS JOIN w")
def fus07(spark, d):
    """The mean of popularity and of those members that come up to it, ``c`` being given 0.05."""
    rows = members(spark, d)
    better = fusion.better_members(rows, {"b": 0.0, "c": 0.05}, "a", "long_view", ["user_id"])
    return rows.select("row_id", F.round(fusion.linear(dict.fromkeys(["a", *better], 1.0)), 9).alias("fused"))


# selection

# hours as candidates, their rates of positives on three splits as scores
_STAB = W + ", c AS (SELECT hour AS candidate, split AS fold, round(avg(long_view), 6) AS valid FROM log WHERE split IS NOT NULL GROUP BY 1, 2), s AS (SELECT candidate, count(*) AS n, avg(valid) AS transfer, stddev_pop(valid) AS stability FROM c GROUP BY 1)"


def _scores(spark, d):
    rows = log(spark, d).where("split is not null").groupBy(F.col("hour").alias("candidate"), "split").agg(F.round(F.avg("long_view"), 6).alias("valid"))
    return selection.stability(rows)


@query("sel01_stability", _STAB + " SELECT candidate, CAST(n AS BIGINT) AS n, round(transfer, 6) AS transfer, round(stability, 6) AS stability FROM s")
def sel01(spark, d):
    return _scores(spark, d).select("candidate", "n", r6("transfer", "transfer"), r6("stability", "stability"))


_CURSE = "CASE WHEN n < 2 OR stability <= 0 THEN 0 ELSE stability * sqrt(2 * ln(CAST(n AS DOUBLE))) END"
_ROBUST = "transfer - stability - CASE WHEN n < 2 THEN 0 ELSE greatest(stability, 0.0008::DOUBLE) * sqrt(2 * ln(CAST(n AS DOUBLE))) END"


@query("sel02_winners_curse", _STAB + f" SELECT candidate, round({_CURSE}, 6) AS curse FROM s")
def sel02(spark, d):
    return _scores(spark, d).select("candidate", r6(selection.winners_curse(F.col("stability"), F.col("n")), "curse"))


@query("sel03_robust", _STAB + f" SELECT candidate, round({_ROBUST}, 6) AS robust FROM s")
def sel03(spark, d):
    return _scores(spark, d).select("candidate", r6(selection.robust_score(F.col("transfer"), F.col("stability"), F.col("n")), "robust"))


@query("sel04_selected", _STAB + f", r AS (SELECT candidate, transfer, round({_ROBUST}, 9) AS robust FROM s WHERE candidate % 5 <> 0) SELECT (SELECT candidate FROM r ORDER BY robust DESC, candidate LIMIT 1) AS chosen, round((SELECT max(robust) FROM r), 6) AS score, round((SELECT max(transfer) FROM r) - (SELECT transfer FROM r ORDER BY robust DESC, candidate LIMIT 1), 6) AS regret")
def sel04(spark, d):
    rows = _scores(spark, d).withColumn("robust", F.round(selection.robust_score(F.col("transfer"), F.col("stability"), F.col("n")), 9)).withColumn("blocked", F.col("candidate") % 5 == 0)
    return selection.selected(rows, "robust", "transfer").select("chosen", r6("score", "score"), r6("regret", "regret"))


@query("sel05_confirmed", W + f", {_MOVES} SELECT hour, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a - b < 0.035 AND greatest(a, b) < 0.36::DOUBLE + 0.05 END AS confirmed FROM r")
def sel05(spark, d):
    return moves(spark, d).select("hour", selection.confirmed(F.col("a"), F.col("b"), F.lit(0.36)).alias("confirmed"))


# audits


_CONSTANCY = f""", d AS (SELECT user_id, date, count(*) AS n, sum(long_view) AS p FROM log GROUP BY ALL),
  k AS (SELECT r.row_id, r.split, r.user_id, r.duration_ms, (coalesce(sum(d.p), 0) + 20 * 0.4::DOUBLE) / (coalesce(sum(d.n), 0) + 20) AS user_rate FROM log r LEFT JOIN d ON d.user_id = r.user_id AND d.date <= r.hz WHERE r.split <> 'train' GROUP BY ALL),
  p AS (SELECT row_id, split, user_id, duration_ms, user_rate, coalesce(sum(long_view) OVER (PARTITION BY user_id ORDER BY time_ms, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM log JOIN k USING (row_id, split, user_id, duration_ms)),
  dev AS (SELECT max(abs(user_rate - m1)) AS a, max(abs(duration_ms - m2)) AS b, max(abs(prefix - m3)) AS c FROM (SELECT *, avg(user_rate) OVER w AS m1, avg(duration_ms) OVER w AS m2, avg(prefix) OVER w AS m3 FROM p WINDOW w AS (PARTITION BY split, user_id))),
  found AS (SELECT unnest(['user_rate', 'duration_ms', 'user_prefix']) AS "column", unnest([CASE WHEN a > 1e-6 THEN 'BLOCK' ELSE 'OK' END, CASE WHEN b > 1e-6 THEN 'BLOCK' ELSE 'OK' END, CASE WHEN c > 1e-6 THEN 'BLOCK' ELSE 'OK' END]) AS finding FROM dev)"""


@query("aud01_user_constancy", W + _CONSTANCY + ' SELECT "column", finding FROM found')
def aud01(spark, d):
    """A frozen rate of the user is constant in a list; a duration isn't, nor is a prefix that has read the list."""
    rows = pit.frozen_prefixes(log(spark, d), {"user": ["user_id"]}).where("split <> 'train'").withColumn("user_rate", (F.col("user_pos") + 8.0) / (F.col("user_lab") + 20.0))
    rows = pit.causal_prefix(rows, ["user_id"], "long_view", F.lit(True)).withColumn("user_prefix", F.col("prior_pos").cast("double"))
    return selection.user_constancy(rows, ["split", "user_id"], ["user_rate", "duration_ms", "user_prefix"]).select("column", "finding")


@query("aud02_horizon", W + f"SELECT CAST(count(*) FILTER (WHERE hz > {OFFICIAL.horizon}) AS BIGINT) AS breaches, CASE WHEN count(*) FILTER (WHERE hz > {OFFICIAL.horizon}) > 0 THEN 'BLOCK' ELSE 'OK' END AS finding FROM log")
def aud02(spark, d):
    return selection.horizon_audit(log(spark, d), "hz", OFFICIAL.horizon)


_AGE = "(({0} // 10000 * 372 + ({0} % 10000) // 100 * 31 + {0} % 100))"


@query("aud03_staleness", W + f", m AS (SELECT abs(avg(CASE WHEN split = 'valid' THEN {_AGE.format('date')} - {_AGE.format('hz')} END) - avg(CASE WHEN split = 'test' THEN {_AGE.format('date')} - {_AGE.format('hz')} END)) AS x FROM log) SELECT round(x, 6) AS delta, CASE WHEN x > 3 THEN 'WARN' ELSE 'OK' END AS finding FROM m")
def aud03(spark, d):
    rows = log(spark, d).withColumn("staleness", day_index(F.col("date")) - day_index(F.col("hz")))
    return selection.staleness_parity(rows, "staleness").select(r6("delta", "delta"), "finding")


@query("aud04_label_shuffle")
def aud04(spark, d):
    """The factorisation machine refitted on shuffled training labels, scored on the true validation labels: above 0.52 it reads the answer."""
    fields = ["user_id", "video_id", "author_id", "tab", "dur_bucket"]
    rows = stored(selection.shuffled_labels(log(spark, d), "long_view", 11).select("row_id", "split", *fields, "long_view", "shuffled"), "shuffled")
    valid = rows.where("split = 'valid'")
    stack = learners.fitted_fm(rows.where("split = 'train'"), None, fields, "shuffled", epochs=10)
    out = metrics.evaluate(valid.join(learners.scored_by(stack, valid, fields), "row_id"), "long_view", "score")
    return rounded_summary(out).withColumn("finding", selection.shuffle_finding(F.col("primary_score")))


@query("aud05_gain_jump", W + f", {_MOVES} SELECT hour, CASE WHEN b - a > 0.02 THEN 'VERIFY' ELSE 'OK' END AS finding FROM r")
def aud05(spark, d):
    return moves(spark, d).select("hour", selection.jump_finding(F.col("b") - F.col("a")).alias("finding"))


@query(
    "aud06_combined",
    W + _CONSTANCY + f", every AS (SELECT finding FROM found UNION ALL SELECT CASE WHEN count(*) FILTER (WHERE hz > {OFFICIAL.horizon}) > 0 THEN 'BLOCK' ELSE 'OK' END FROM log UNION ALL SELECT 'WARN') SELECT bool_or(finding = 'BLOCK') AS veto, CAST(count(*) FILTER (WHERE finding = 'BLOCK') AS BIGINT) AS n_block, CAST(count(*) FILTER (WHERE finding = 'WARN') AS BIGINT) AS n_warn FROM every",
)
def aud06(spark, d):
    """Findings of three audits, the last of a log without a staleness column."""
    found = [aud01(spark, d).select(F.col("column").alias("rule"), "finding"), aud02(spark, d).select(F.lit("horizon").alias("rule"), "finding")]
    return selection.combined([*found, selection.staleness_parity(log(spark, d), "staleness").select(F.lit("staleness").alias("rule"), "finding")])


# runs

BASELINE = 0.385
_LED = f"WITH {BASE}, {DAY_LEDGER}, l AS (SELECT * FROM led)"
_STATE = _LED + f""", b AS (SELECT *, greatest({BASELINE}::DOUBLE, coalesce(max(v) OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best FROM l),
  i AS (SELECT *, coalesce(v > best + 0.002, false) AS improved FROM b),
  s AS (SELECT i.run, i.iteration, i.best, i.improved, i.seconds, (SELECT count(*) FROM i x WHERE x.run = i.run AND x.iteration <= i.iteration AND x.v IS NOT NULL AND NOT x.improved AND x.iteration > coalesce((SELECT max(y.iteration) FROM i y WHERE y.run = i.run AND y.iteration <= i.iteration AND y.improved), -1)) AS stall FROM i)"""


@query("run01_stall", _STATE + " SELECT run, iteration, round(best, 6) AS best, improved, CAST(stall AS BIGINT) AS stall FROM s")
def run01(spark, d):
    return runs.stall_state(day_ledger(spark, d), BASELINE).select("run", "iteration", r6("best", "best"), "improved", "stall")


@query("run02_convergence", _STATE + ", e AS (SELECT *, sum(seconds) OVER (PARTITION BY run ORDER BY iteration) AS elapsed FROM s) SELECT run, iteration, CASE WHEN stall >= 3 THEN 'stall' WHEN iteration >= 5 THEN 'iterations' WHEN elapsed >= 600 THEN 'wall_clock' END AS ends FROM e")
def run02(spark, d):
    rows = runs.stall_state(day_ledger(spark, d), BASELINE)
    elapsed = F.sum("seconds").over(windows.W.partitionBy("run").orderBy("iteration"))
    return rows.withColumn("elapsed", elapsed).select("run", "iteration", runs.convergence(F.col("stall"), F.col("iteration"), F.col("elapsed"), 3, 5, 600.0).alias("ends"))


@query("run03_summary", _LED + " SELECT run, CAST(count(*) AS BIGINT) AS n, CAST(count(v) AS BIGINT) AS n_scored, max(v) AS best_valid, CAST(min(CASE WHEN v = m THEN iteration END) AS INTEGER) AS best_iteration, sum(seconds) AS seconds FROM (SELECT *, max(v) OVER (PARTITION BY run) AS m FROM l) GROUP BY run")
def run03(spark, d):
    return runs.run_summary(day_ledger(spark, d))


@query("run04_mode", _LED + " SELECT run, iteration, CASE WHEN iteration < 6 * 0.6 THEN 'explore' ELSE 'consolidate' END AS mode FROM l")
def run04(spark, d):
    return day_ledger(spark, d).select("run", "iteration", runs.mode(F.col("iteration"), 6).alias("mode"))


@query("run05_accepted", W + f", {_MOVES} SELECT hour, coalesce(b - a > 0, false) AND coalesce(CASE WHEN hour % 4 = 3 THEN NULL ELSE abs(b - a) < 0.035 END, abs(b - a) < 0.02, false) AS accepted FROM r")
def run05(spark, d):
    delta = F.col("b") - F.col("a")
    confirmed = F.when(F.col("hour") % 4 != 3, F.abs(delta) < 0.035)
    return moves(spark, d).select("hour", runs.accepted(delta, confirmed, F.coalesce(F.abs(delta) < 0.02, F.lit(False))).alias("accepted"))


@query("agg12_track_record", _LED + f" SELECT family, CAST(count(*) AS BIGINT) AS n, CAST(count(v) AS BIGINT) AS n_scored, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate, round(sum(v - {BASELINE}), 6) AS gain, round(max(v - {BASELINE}), 6) AS best, round(avg(v - {BASELINE}), 6) AS mean_gain FROM l GROUP BY 1")
def agg12(spark, d):
    return runs.track_record(day_ledger(spark, d), BASELINE).select("family", "n", "n_scored", "hits", *[r6(c, c) for c in ("hit_rate", "gain", "best", "mean_gain")])


@query("mod05_losses", W + """, x AS (SELECT *, duration_ms / 100 AS s FROM log WHERE split = 'test'),
  g AS (SELECT *, sum(long_view) OVER w AS np, sum(1 - long_view) OVER w AS nn, max(s) OVER w AS m, row_number() OVER (PARTITION BY user_id, date ORDER BY s DESC, row_id) AS i FROM x WINDOW w AS (PARTITION BY user_id, date)),
  e AS (SELECT *, CASE WHEN i <= 5 THEN 1 / log2(i + 1) ELSE 0 END AS gain FROM g WHERE np > 0 AND nn > 0),
  p AS (SELECT a.user_id, a.date, a.np, a.nn, greatest(b.s - a.s, 0) + ln(1 + exp(-abs(b.s - a.s))) AS l, abs(a.gain - b.gain) AS w FROM e a JOIN e b ON a.user_id = b.user_id AND a.date = b.date AND a.long_view = 1 AND b.long_view = 0),
  per AS (SELECT user_id, date, any_value(np) AS np, any_value(nn) AS nn, sum(l) AS l, sum(l * w) AS lw FROM p GROUP BY 1, 2),
  net AS (SELECT user_id, date, (any_value(np) * ln(sum(exp(s - m))) - sum(long_view * (s - m))) / any_value(np) AS v FROM e GROUP BY 1, 2),
  v AS (SELECT (SELECT avg(greatest(s, 0) + ln(1 + exp(-abs(s))) - long_view * s) FROM x) AS bce, (SELECT avg(l / (np * nn)) FROM per) AS bpr, (SELECT sum(l / nn) / sum(np) FROM per) AS gauc, (SELECT avg(v) FROM net) AS net,
    (SELECT avg(lw / (np * nn) / list_sum(list_transform(range(1, CAST(least(np, 5) AS BIGINT) + 1), lambda j: 1 / log2(j + 1)))) FROM per) AS ndcg)
  SELECT unnest(['bce', 'bpr', 'bpr_gauc', 'listnet', 'lambda_ndcg', 'primary']) AS loss, round(unnest([bce, bpr, gauc, net, ndcg, (gauc + ndcg) / 2]), 6) AS value FROM v""")
def mod05(spark, d):
    rows = OFFICIAL.rows(log(spark, d), "test").withColumn("s", F.col("duration_ms") / 100)
    return models.loss_values(rows, ["user_id", "date"], "long_view", "s").select("loss", r6("value", "value"))


@query("mod04_recency_weight", W + ", a AS (SELECT row_id, CAST(datediff('day', CAST(strptime(CAST(date AS VARCHAR), '%Y%m%d') AS DATE), DATE '2024-01-14') AS DOUBLE) AS age FROM log WHERE split = 'train') SELECT row_id, round(exp(-age / 14) / (SELECT avg(exp(-age / 14)) FROM a), 6) AS weight FROM a")
def mod04w(spark, d):
    rows = OFFICIAL.rows(log(spark, d), "train").withColumn("age", F.datediff(F.to_date(F.lit("2024-01-14")), F.to_date(F.col("date").cast("string"), "yyyyMMdd")).cast("double"))
    mean = rows.agg(F.avg(F.exp(-F.col("age") / 14)).alias("m"))
    return rows.crossJoin(F.broadcast(mean)).select("row_id", r6(models.recency_weight(F.col("age"), 14.0, F.col("m")), "weight"))


_BINS = "[1, 3, 6, 10, 16, 24]"


@query(
    "mod08_history_weights",
    W + f""", h AS (SELECT r.row_id, r.split, CAST(count(x.row_id) AS BIGINT) AS n FROM log r LEFT JOIN log x ON x.user_id = r.user_id AND x.long_view = 1 AND x.date <= r.hz GROUP BY 1, 2),
  b AS (SELECT *, len(list_filter({_BINS}, lambda e: e <= n)) AS bin FROM h WHERE split IN ('train', 'test')), t AS (SELECT bin, count(*) AS t FROM b WHERE split = 'train' GROUP BY 1), v AS (SELECT bin, count(*) AS v FROM b WHERE split = 'test' GROUP BY 1),
  r AS (SELECT t.bin, t, least(greatest((coalesce(v, 0) / (SELECT sum(v) FROM v)) / (t / sum(t) OVER ()), 0), 8) AS r FROM t LEFT JOIN v USING (bin)), w AS (SELECT bin, r / (sum(r * t) OVER () / sum(t) OVER ()) AS w FROM r)
  SELECT row_id, n AS history_n, CASE WHEN n >= 10 THEN 1.0::DOUBLE ELSE 0.0 END AS late_only, round(w, 6) AS hist_match FROM b JOIN w USING (bin) WHERE split = 'train'""",
)
def mod08(spark, d):
    """Weights of training rows by the length of their history: late_only, and hist_match to the test rows."""
    rows = pit.frozen_prefix(log(spark, d), ["user_id"]).select("row_id", "split", F.col("pos").alias("history_n"))
    rows = rows.withColumn("bin", count_below([1, 3, 6, 10, 16, 24], F.col("history_n"), True))
    train = rows.where("split = 'train'")
    weights = models.history_match(train, rows.where("split = 'test'"), "bin", 0.0, 8.0)
    return train.join(F.broadcast(weights), "bin").select("row_id", "history_n", models.late_only(F.col("history_n")).alias("late_only"), r6("weight", "hist_match"))


@query("mod01_fm_logit", W + ", x AS (SELECT row_id, CAST(tab AS DOUBLE) AS a, CAST(hour AS DOUBLE) AS b, duration_ms AS c FROM log) SELECT row_id, round(0.1::DOUBLE + (0.2::DOUBLE * a + 0.3::DOUBLE * b) + (a * b + a * c + b * c), 5) AS logit FROM x")
def mod01(spark, d):
    rows = log(spark, d).select("row_id", F.col("tab").cast("double").alias("a"), F.col("hour").cast("double").alias("b"), F.col("duration_ms").alias("c"))
    vectors = [F.array(F.col(x)) for x in ("a", "b", "c")]
    return rows.select("row_id", F.round(models.fm_logit(F.lit(0.1), [0.2 * F.col("a"), 0.3 * F.col("b")], vectors, 1), 5).alias("logit"))
