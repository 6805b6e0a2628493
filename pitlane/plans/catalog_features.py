"""Queries of projections, joins, aggregates, windows and point-in-time aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, count_below, day_index, hashed_unit_sql
from ..operators import cf, diagnostics, keys, models, pit, quantiles, windows
from ..sources import files
from ..sources.impressions import impressions, table, users, videos
from .catalog import BASE, OFFICIAL, POP, SCHEDULE, log, popularity, query, r6, stored

W = f"WITH {BASE} "


@query("src01_log", W + "SELECT row_id, user_id, video_id, date, time_ms, tab, duration_ms, long_view, coalesce(author_id, 'UNK') AS author_id, split FROM log")
def src01(spark, d):
    rows = OFFICIAL.with_part(impressions(spark, d))
    return files.with_author(rows, videos(spark, d), "video_id", ["author_id"]).select("row_id", "user_id", "video_id", "date", "time_ms", "tab", "duration_ms", "long_view", "author_id", "split")


@query("src03_pruned_columns", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def src03(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("src05_unknown_category", W + "SELECT row_id, coalesce(v.author_id, 'UNK') AS author_id, coalesce(v.tag, 'UNK') AS tag FROM imp LEFT JOIN vid v USING (video_id)")
def src05(spark, d):
    return files.with_author(impressions(spark, d), videos(spark, d), "video_id", ["author_id", "tag"]).select("row_id", "author_id", "tag")


@query("prj01_split", W + "SELECT row_id, date FROM imp WHERE date BETWEEN 20240115 AND 20240121")
def prj01(spark, d):
    return OFFICIAL.rows(impressions(spark, d), "valid").select("row_id", "date")


@query("prj02_label", W + "SELECT row_id, long_view FROM imp")
def prj02(spark, d):
    return impressions(spark, d).select("row_id", "long_view")


@query("prj03_masked_label", W + f"SELECT row_id, CASE WHEN date <= {OFFICIAL.horizon} THEN long_view ELSE -1 END AS visible FROM imp")
def prj03(spark, d):
    return impressions(spark, d).select("row_id", keys.visible_label(F.col("long_view"), F.col("date"), OFFICIAL.horizon).alias("visible"))


@query("prj04_horizon_breaches", W + f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE date > {OFFICIAL.horizon}) AS BIGINT) AS n_breaches FROM imp")
def prj04(spark, d):
    return keys.horizon_breaches(impressions(spark, d), OFFICIAL.horizon)


@query("prj05_safe_columns", W + "SELECT row_id, user_id, video_id, date, time_ms, hour, tab, duration_ms FROM imp")
def prj05(spark, d):
    return keys.guard_outcomes(impressions(spark, d).drop("long_view", "is_click"))


@query("prj06_window_horizon", W + "SELECT row_id, hz FROM log")
def prj06(spark, d):
    return log(spark, d).select("row_id", "hz")


@query("prj07_composite_key", W + "SELECT row_id, CAST(dense_rank() OVER (ORDER BY user_id, video_id) - 1 AS BIGINT) AS key_id FROM imp")
def prj07(spark, d):
    return keys.factorised(impressions(spark, d), ["user_id", "video_id"]).select("row_id", "key_id")


@query("prj08_factorize", W + "SELECT row_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_ix FROM imp")
def prj08(spark, d):
    return keys.factorised(impressions(spark, d), ["user_id"], "user_ix").select("row_id", "user_ix")


_CODES = "SELECT {c} AS v, dense_rank() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM log WHERE split = 'train')"


@query(
    "prj09_encoded",
    W + f""", a AS ({_CODES.format(c="tag")}), b AS ({_CODES.format(c="author_id")}), c AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT CAST(tab AS VARCHAR) AS v FROM log WHERE split = 'train'))
    SELECT row_id, CAST(coalesce(a.code, (SELECT count(*) FROM a)) AS BIGINT) AS tag_id, CAST(coalesce(b.code, (SELECT count(*) FROM b)) + (SELECT count(*) FROM a) + 1 AS BIGINT) AS author_id_id,
           CAST(coalesce(c.code, (SELECT count(*) FROM c)) + (SELECT count(*) FROM a) + (SELECT count(*) FROM b) + 2 AS BIGINT) AS tab_id
    FROM log LEFT JOIN a ON tag = a.v LEFT JOIN b ON author_id = b.v LEFT JOIN c ON CAST(tab AS VARCHAR) = c.v""",
)
def prj09(spark, d):
    rows = log(spark, d)
    out, _ = keys.encoded(rows, rows.where("split = 'train'"), ["tag", "author_id", "tab"])
    return out.select("row_id", F.col("tag_id").cast("long"), F.col("author_id_id").cast("long"), F.col("tab_id").cast("long"))


_EDGES = "(SELECT quantile_cont(duration_ms, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM log WHERE split = 'train')"


@query("prj10_quantile_edges", W + f"SELECT CAST(i AS INTEGER) AS i, round({_EDGES}[i + 1], 6) AS edge FROM range(9) t(i)")
def prj10(spark, d):
    edges = keys.quantile_edges(OFFICIAL.rows(log(spark, d), "train"), "duration_ms", 10)
    return spark.createDataFrame(list(enumerate(edges)), "i int, edge double").select("i", r6("edge", "edge"))


@query("prj11_bucket_left", W + f", e AS (SELECT {_EDGES} AS q) SELECT row_id, CAST(len(list_filter(q, lambda x: x < duration_ms)) AS INTEGER) AS bucket FROM log CROSS JOIN e")
def prj11(spark, d):
    rows = log(spark, d)
    return keys.bucketed(rows, "duration_ms", keys.quantile_edges(OFFICIAL.rows(rows, "train"), "duration_ms", 10), "bucket").select("row_id", "bucket")


@query("prj12_digitize", W + "SELECT row_id, CAST(len(list_filter([1.0, 10.0, 50.0, 100.0], lambda x: x <= duration_ms)) AS INTEGER) AS open_right, CAST(len(list_filter([1.0, 10.0, 50.0, 100.0], lambda x: x < duration_ms)) AS INTEGER) AS closed_right FROM log")
def prj12(spark, d):
    edges = [1.0, 10.0, 50.0, 100.0]
    return log(spark, d).select("row_id", count_below(edges, F.col("duration_ms"), True).alias("open_right"), count_below(edges, F.col("duration_ms")).alias("closed_right"))


@query("prj13_rank_decile", W + "SELECT row_id, CAST(least(floor((row_number() OVER (ORDER BY duration_ms, row_id) - 1) * 10 / count(*) OVER ()), 9) AS INTEGER) AS decile FROM log")
def prj13(spark, d):
    return keys.rank_deciles(log(spark, d), "duration_ms", "row_id").select("row_id", "decile")


@query("prj14_clip_bucket", W + "SELECT user_id, CAST(least(greatest(count(*), 1), 12) AS BIGINT) AS size_bucket, CAST(least(greatest(sum(long_view), 0), 8) AS BIGINT) AS npos_bucket FROM log GROUP BY 1")
def prj14(spark, d):
    return log(spark, d).groupBy("user_id").agg(clip(F.count("*"), 1, 12).cast("long").alias("size_bucket"), clip(F.sum("long_view"), 0, 8).cast("long").alias("npos_bucket"))


@query("prj15_item_cold", W + ", s AS (SELECT DISTINCT video_id FROM log WHERE split = 'train') SELECT row_id, CASE WHEN s.video_id IS NULL THEN 1 ELSE 0 END AS item_cold FROM log LEFT JOIN s USING (video_id)")
def prj15(spark, d):
    rows = log(spark, d)
    seen = rows.where("split = 'train'").groupBy("video_id").agg(F.count("*").alias("n"))
    return rows.join(seen, "video_id", "left").select("row_id", (F.coalesce("n", F.lit(0)) == 0).cast("int").alias("item_cold"))


@query("prj16_group_keys", W + "SELECT row_id, user_id || '_' || date AS user_day, user_id || '_' || ((date - 20240101) // 7) AS user_week, user_id || '_' || hz AS user_window FROM log")
def prj16(spark, d):
    week = F.floor((F.col("date") - 20240101) / 7)
    return log(spark, d).select("row_id", F.concat_ws("_", "user_id", "date").alias("user_day"), F.concat_ws("_", "user_id", week).alias("user_week"), F.concat_ws("_", "user_id", "hz").alias("user_window"))


_DAY = "({0} // 10000 * 372 + ({0} % 10000) // 100 * 31 + {0} % 100)"


@query("prj17_item_age", W + f", f AS (SELECT video_id, min(date) AS first FROM log GROUP BY 1) SELECT row_id, CAST({_DAY.format('date')} - {_DAY.format('first')} AS BIGINT) AS age FROM log JOIN f USING (video_id)")
def prj17(spark, d):
    rows = log(spark, d)
    first = rows.groupBy("video_id").agg(F.min("date").alias("first"))
    return rows.join(first, "video_id").select("row_id", (day_index(F.col("date")) - day_index(F.col("first"))).cast("long").alias("age"))


@query("prj18_staleness", W + f"SELECT row_id, CAST({_DAY.format('date')} - {_DAY.format('hz')} AS BIGINT) AS staleness_days FROM log")
def prj18(spark, d):
    return log(spark, d).select("row_id", (day_index(F.col("date")) - day_index(F.col("hz"))).cast("long").alias("staleness_days"))


@query(
    "prj19_matrix_contract",
    W + """, m AS (SELECT CASE WHEN long_view = 1 THEN 'inf'::DOUBLE ELSE duration_ms END AS a, CASE WHEN tab = 2 THEN NULL ELSE duration_ms END AS b FROM log WHERE split <> 'train')
    SELECT unnest(['rows', 'finite:a', 'finite:b']) AS rule, CAST(unnest([count(*) - (SELECT count(*) FROM imp), count(*) FILTER (WHERE a IS NULL OR isnan(a) OR isinf(a)), count(*) FILTER (WHERE b IS NULL OR isnan(b) OR isinf(b))]) AS BIGINT) AS n FROM m""",
)
def prj19(spark, d):
    """A matrix of too few rows whose columns are infinite where the label is 1, and null in a tab."""
    rows = log(spark, d).where("split <> 'train'")
    matrix = rows.select(F.when(F.col("long_view") == 1, float("inf")).otherwise(F.col("duration_ms")).alias("a"), F.when(F.col("tab") != 2, F.col("duration_ms")).alias("b"))
    return keys.matrix_violations(matrix, ["a", "b"], table(spark, d, "events").count())


@query("prj20_bucket_right", W + f", e AS (SELECT list_sort(list_distinct({_EDGES})) AS q) SELECT row_id, CAST(least(greatest(len(list_filter(q, lambda x: x <= duration_ms)), 0), 9) AS INTEGER) AS bucket FROM log CROSS JOIN e")
def prj20(spark, d):
    rows = log(spark, d)
    edges = sorted(set(keys.quantile_edges(OFFICIAL.rows(rows, "train"), "duration_ms", 10)))
    return rows.select("row_id", clip(count_below(edges, F.col("duration_ms"), True), 0, 9).cast("int").alias("bucket"))


@query("prj21_fixed_width", W + "SELECT row_id, dur_bucket, CAST(dayofweek(CAST(strptime(CAST(date AS VARCHAR), '%Y%m%d') AS DATE)) + 1 AS INTEGER) AS weekday FROM log")
def prj21(spark, d):
    return log(spark, d).select("row_id", "dur_bucket", F.dayofweek(F.to_date(F.col("date").cast("string"), "yyyyMMdd")).alias("weekday"))


# joins


@query("jon01_dimensions", W + "SELECT row_id, coalesce(author_id, 'UNK') AS author_id, coalesce(tag, 'UNK') AS tag, coalesce(c_mktsegment, 'UNK') AS segment, CAST(coalesce(c_nationkey, -1) AS INTEGER) AS nation FROM log LEFT JOIN customer ON c_custkey = user_id")
def jon01(spark, d):
    rows = log(spark, d).join(users(spark, d), "user_id", "left")
    return rows.select("row_id", *[F.coalesce(c, F.lit("UNK")).alias(c) for c in ("author_id", "tag", "segment")], F.coalesce("nation", F.lit(-1)).cast("int").alias("nation"))


_FROZEN = """SELECT r.row_id, CAST(count(x.row_id) AS BIGINT) AS lab, CAST(coalesce(sum(x.long_view), 0) AS BIGINT) AS pos FROM log r LEFT JOIN log x ON {on} AND x.date <= r.hz GROUP BY 1"""
_SETS = """, daily AS (SELECT {k}, date, count(*) AS n, sum(long_view) AS p FROM log GROUP BY ALL)
  SELECT r.row_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS lab, CAST(coalesce(sum(p), 0) AS BIGINT) AS pos FROM log r LEFT JOIN daily x ON {on} AND x.date <= r.hz GROUP BY 1"""


@query("jon02_as_of", W + _SETS.format(k="video_id", on="x.video_id = r.video_id"))
def jon02(spark, d):
    return pit.frozen_prefix(log(spark, d), ["video_id"], by_union=True).select("row_id", "lab", "pos")


@query("jon03_range_join", W + ", s(lo, hi, horizon) AS (VALUES " + ", ".join(map(str, SCHEDULE[2:])) + ") SELECT row_id, CAST(coalesce(horizon, -1) AS INTEGER) AS horizon FROM imp LEFT JOIN s ON date BETWEEN lo AND hi")
def jon03(spark, d):
    s = spark.createDataFrame(SCHEDULE[2:], "lo int, hi int, horizon int")
    return keys.range_joined(impressions(spark, d), s).select("row_id", "horizon")


@query("jon04_label_pairs", W + "SELECT p.user_id, p.date, CAST(count(*) AS BIGINT) AS n_pairs, CAST(sum(CASE WHEN n.duration_ms > p.duration_ms THEN 1 ELSE 0 END) AS BIGINT) AS n_inverted FROM log p JOIN log n ON p.user_id = n.user_id AND p.date = n.date WHERE p.long_view = 1 AND n.long_view = 0 GROUP BY 1, 2")
def jon04(spark, d):
    return diagnostics.pair_counts(log(spark, d), ["user_id", "date"], "long_view", "duration_ms").where("n_pairs > 0")


_TRAIN_EDGES = ", e AS (SELECT DISTINCT user_id AS u, video_id AS i FROM log WHERE split = 'train' AND long_view = 1)"


def train_edges(spark, d) -> DataFrame:
    return cf.edges(log(spark, d).where("split = 'train' and long_view = 1"))


@query("jon05_cooccurrence", W + _TRAIN_EDGES + " SELECT a.i, b.i AS j, CAST(count(*) AS BIGINT) AS n FROM e a JOIN e b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2")
def jon05(spark, d):
    return cf.cooccurrence(train_edges(spark, d))


_COSINE = _TRAIN_EDGES + """, c AS (SELECT i, count(*) AS n FROM e GROUP BY 1),
  sim AS (SELECT x.i, x.j, x.n / sqrt(CAST(a.n * b.n AS DOUBLE)) AS sim FROM (SELECT a.i, b.i AS j, count(*) AS n FROM e a JOIN e b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2) x JOIN c a ON a.i = x.i JOIN c b ON b.i = x.j)"""


@query(
    "jon06_history_gather",
    W + _COSINE + """, h AS (SELECT u, count(*) AS n FROM e GROUP BY 1), t AS (SELECT DISTINCT user_id AS u, video_id AS j FROM log WHERE split = 'valid'),
    s AS (SELECT t.u, t.j, sum(sim) AS s FROM t JOIN e ON e.u = t.u JOIN sim ON sim.i = e.i AND sim.j = t.j GROUP BY 1, 2)
    SELECT row_id, round(coalesce(s.s, 0), 6) AS cf_sum, round(CASE WHEN h.n > 0 THEN coalesce(s.s, 0) / h.n ELSE 0 END, 6) AS cf_mean, CAST(coalesce(h.n, 0) AS BIGINT) AS history_n
    FROM log LEFT JOIN s ON s.u = user_id AND s.j = video_id LEFT JOIN h ON h.u = user_id WHERE split = 'valid'""",
)
def jon06(spark, d):
    e = train_edges(spark, d)
    out = cf.history_scores(OFFICIAL.rows(log(spark, d), "valid"), e, cf.cosine(e))
    return out.select("row_id", r6("cf_sum", "cf_sum"), r6("cf_mean", "cf_mean"), "history_n")


_VIOLATIONS = """, e AS (SELECT row_id, user_id, video_id FROM log WHERE split = 'test'),
  one AS (SELECT row_id, count(*) AS k, any_value(user_id) AS u, any_value(video_id) AS v, any_value(score) AS s FROM sub GROUP BY 1),
  j AS (SELECT one.row_id AS a, e.row_id AS b, k, (u IS DISTINCT FROM user_id OR v IS DISTINCT FROM video_id) AS off, try_cast(s AS DOUBLE) AS x FROM one FULL JOIN e ON one.row_id = e.row_id)
  SELECT unnest(['missing', 'extra', 'repeated', 'misaligned', 'not_finite']) AS rule, CAST(unnest([count(*) FILTER (WHERE a IS NULL), count(*) FILTER (WHERE b IS NULL), count(*) FILTER (WHERE k > 1),
    count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND off), count(*) FILTER (WHERE a IS NOT NULL AND (x IS NULL OR isnan(x) OR isinf(x)))]) AS BIGINT) AS n FROM j"""


@query("jon07_aligned", W + ", sub AS (SELECT row_id, user_id, CASE WHEN hour = 3 THEN video_id + 1 ELSE video_id END AS video_id, CAST(duration_ms AS VARCHAR) AS score FROM log WHERE split IN ('valid', 'test') AND tab < 3)" + _VIOLATIONS)
def jon07(spark, d):
    """A submission of other days too, without one tab's rows, whose items are off in one hour, against the test days."""
    rows = log(spark, d)
    sent = rows.where("split in ('valid', 'test') and tab < 3").withColumn("video_id", F.when(F.col("hour") == 3, F.col("video_id") + 1).otherwise(F.col("video_id")))
    return files.submission_violations(files.submission(sent, "duration_ms"), OFFICIAL.rows(rows, "test"))


@query("jon08_membership", W + ", k AS (SELECT DISTINCT user_id, video_id FROM log WHERE split = 'train') SELECT row_id, CAST(1 AS INTEGER) AS known FROM log SEMI JOIN k USING (user_id, video_id) WHERE split = 'test' UNION ALL SELECT row_id, 0 FROM log ANTI JOIN k USING (user_id, video_id) WHERE split = 'test'")
def jon08(spark, d):
    rows = log(spark, d)
    known, test = rows.where("split = 'train'").select("user_id", "video_id").distinct(), rows.where("split = 'test'")
    on = ["user_id", "video_id"]
    return test.join(known, on, "left_semi").select("row_id", F.lit(1).alias("known")).unionByName(test.join(known, on, "left_anti").select("row_id", F.lit(0).alias("known")))


# aggregates


@query("agg01_popularity", f"WITH {POP} SELECT row_id, round(score, 9) AS score FROM pop WHERE split IN ('valid', 'test')")
def agg01(spark, d):
    return popularity(spark, d).where("split in ('valid', 'test')").select("row_id", F.round("score", 9).alias("score"))


@query("agg02_prior", W + "SELECT round(avg(long_view), 9) AS prior FROM log WHERE split = 'train'")
def agg02(spark, d):
    return OFFICIAL.rows(log(spark, d), "train").agg(F.round(F.avg("long_view"), 9).alias("prior"))


@query("agg03_counts", W + "SELECT video_id, tab, CAST(count(*) AS BIGINT) AS n, CAST(sum(long_view) AS BIGINT) AS pos FROM log GROUP BY 1, 2")
def agg03(spark, d):
    return log(spark, d).groupBy("video_id", "tab").agg(F.count("*").alias("n"), F.sum("long_view").alias("pos"))


@query("agg04_mean_to_rows", W + "SELECT row_id, round(avg(duration_ms) OVER (PARTITION BY user_id), 6) AS mean_dur FROM log")
def agg04(spark, d):
    rows = log(spark, d)
    return rows.join(rows.groupBy("user_id").agg(F.avg("duration_ms").alias("m")), "user_id").select("row_id", r6("m", "mean_dur"))


@query("agg05_max_deviation", W + ", x AS (SELECT user_id, abs(duration_ms - avg(duration_ms) OVER (PARTITION BY user_id)) AS dev FROM log) SELECT user_id, round(max(dev), 6) AS max_dev FROM x GROUP BY 1")
def agg05(spark, d):
    return log(spark, d).select("user_id", F.abs(windows.deviation(["user_id"], "duration_ms")).alias("dev")).groupBy("user_id").agg(r6(F.max("dev"), "max_dev"))


@query("agg06_nan_mean", W + "SELECT tab, round(avg(CASE WHEN long_view = 1 THEN duration_ms END), 6) AS mean_pos FROM log GROUP BY 1")
def agg06(spark, d):
    nan = F.when(F.col("long_view") == 1, F.col("duration_ms")).otherwise(float("nan"))
    return log(spark, d).groupBy("tab").agg(r6(F.avg(F.when(~F.isnan(nan), nan)), "mean_pos"))


@query("agg07_percentiles", W + "SELECT tab, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.05), 6) AS p05, round(quantile_cont(duration_ms, 0.5) FILTER (WHERE long_view = 1), 6) AS median_pos, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1")
def agg07(spark, d):
    pos = F.when(F.col("long_view") == 1, F.col("duration_ms"))
    return log(spark, d).groupBy("tab").agg(r6(F.percentile("duration_ms", F.lit(0.95)), "p95"), r6(F.percentile("duration_ms", F.lit(0.05)), "p05"), r6(F.percentile(pos, F.lit(0.5)), "median_pos"), F.count("*").alias("n"))


@query("agg07_thresholds", W + """, t AS (SELECT hour, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (long_view = 0) AS n0, count(*) FILTER (long_view = 1) AS n1, quantile_cont(duration_ms, 0.5) AS m, quantile_cont(duration_ms, 0.95) FILTER (long_view = 0) AS low, quantile_cont(duration_ms, 0.05) FILTER (long_view = 1) AS high FROM log WHERE split = 'train' GROUP BY 1)
    SELECT hour, n, round(CASE WHEN n < 100 OR n0 < 20 OR n1 < 20 THEN m ELSE (low + high) / 2 END, 6) AS threshold FROM t""")
def agg07_thresholds(spark, d):
    """By hour of the training days, the duration that parts negatives from positives."""
    return quantiles.class_thresholds(OFFICIAL.rows(log(spark, d), "train"), "hour", "duration_ms", "long_view").select("hour", "n", r6("threshold", "threshold"))


@query("agg08_mean_std", W + "SELECT video_id, round(avg(duration_ms), 6) AS mean, round(stddev_pop(duration_ms), 6) AS std FROM log GROUP BY 1")
def agg08(spark, d):
    return log(spark, d).groupBy("video_id").agg(r6(F.avg("duration_ms"), "mean"), r6(F.stddev_pop("duration_ms"), "std"))


@query("agg09_median", W + "SELECT video_id, CAST(floor(quantile_cont(hour, 0.5)) AS INTEGER) AS median_hour FROM log GROUP BY 1")
def agg09(spark, d):
    return log(spark, d).groupBy("video_id").agg(F.floor(F.percentile("hour", F.lit(0.5))).cast("int").alias("median_hour"))


@query("agg10_distinct", W + "SELECT split, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users, CAST(count(DISTINCT video_id) AS BIGINT) AS n_items FROM log GROUP BY 1")
def agg10(spark, d):
    return log(spark, d).groupBy("split").agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("video_id").alias("n_items"))


_HORIZONS = sorted({h for _, _, h in SCHEDULE})


@query("agg10_sketches", W + f""", h AS (SELECT unnest({_HORIZONS}) AS horizon), x AS (SELECT tab, horizon, user_id FROM log JOIN h ON date <= horizon)
    SELECT tab, CAST(horizon AS INTEGER) AS horizon, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users, true AS users_close, true AS median_close FROM x GROUP BY 1, 2""")
def agg10_sketches(spark, d):
    """By tab and horizon of the schedule, from daily sketches: whether the number of users is within three standard errors, and the median's rank within three times its bound, beside the exact numbers."""
    rows = log(spark, d).select("tab", "date", "user_id", "duration_ms")
    horizons = spark.createDataFrame([(h,) for h in _HORIZONS], "horizon int")
    merged = quantiles.up_to(quantiles.daily_sketches(rows, ["tab"], "user_id", "duration_ms"), ["tab"], horizons, [0.5])
    past = rows.join(F.broadcast(horizons), F.col("date") <= F.col("horizon")).join(F.broadcast(merged.select("tab", "horizon", "n", "distinct", F.col("quantiles")[0].alias("median"))), ["tab", "horizon"])  # a row for each tab and horizon
    exact = past.groupBy("tab", "horizon", "n", "distinct").agg(F.countDistinct("user_id").alias("n_users"), F.avg((F.col("duration_ms") <= F.col("median")).cast("double")).alias("rank"))
    close = F.abs(F.col("distinct") - F.col("n_users")) <= 3 * quantiles.COUNT_ERROR * F.col("n_users") + 1
    return exact.select("tab", "horizon", "n", "n_users", close.alias("users_close"), (F.abs(F.col("rank") - 0.5) <= 3 * quantiles.QUANTILE_ERROR + 1 / F.col("n")).alias("median_close"))


@query(
    "agg11_histogram_ratio",
    W + """, t AS (SELECT dur_bucket, count(*) AS t FROM log WHERE split = 'train' GROUP BY 1), v AS (SELECT dur_bucket, count(*) AS v FROM log WHERE split = 'valid' GROUP BY 1),
    r AS (SELECT t.dur_bucket, t, least(greatest((coalesce(v, 0) / sum(coalesce(v, 0)) OVER ()) / (t / sum(t) OVER ()), 0.2), 5) AS r FROM t LEFT JOIN v USING (dur_bucket))
    SELECT dur_bucket, round(r / (sum(r * t) OVER () / sum(t) OVER ()), 6) AS weight FROM r""",
)
def agg11(spark, d):
    rows = log(spark, d)
    return models.history_match(OFFICIAL.rows(rows, "train"), OFFICIAL.rows(rows, "valid"), "dur_bucket").select("dur_bucket", r6("weight", "weight"))


@query("agg13_correlation", W + ", r AS (SELECT row_number() OVER (ORDER BY duration_ms, row_id) AS a, row_number() OVER (ORDER BY hour, row_id) AS b, duration_ms AS x, hour AS y FROM log) SELECT round(corr(x, y), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r")
def agg13(spark, d):
    rows = keys.global_rank(keys.global_rank(log(spark, d), "hour", "row_id", "b"), "duration_ms", "row_id", "a")
    return rows.agg(r6(F.corr("duration_ms", "hour"), "pearson"), r6(F.corr("a", "b"), "spearman"))


@query("agg14_split_counts", W + "SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(long_view) AS BIGINT) AS pos FROM log GROUP BY 1")
def agg14(spark, d):
    return log(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.sum("long_view").alias("pos"))


@query("agg15_slices", W + "SELECT tab, dur_bucket, CAST(count(*) AS BIGINT) AS n, CAST(sum(long_view) AS BIGINT) AS pos FROM log GROUP BY GROUPING SETS ((tab), (dur_bucket), ())")
def agg15(spark, d):
    return log(spark, d).groupingSets([["tab"], ["dur_bucket"], []], "tab", "dur_bucket").agg(F.count("*").alias("n"), F.sum("long_view").alias("pos"))


@query(
    "agg16_star",
    """SELECT r_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def agg16(spark, d):
    """The second star: facts first pre-aggregated by order, so that the join of the two large tables moves one row for each order."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    out = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.groupBy("r_name").agg(F.sum("k").alias("n"), F.round(F.sum("v"), 2).alias("revenue"))


# windows

P = f"WITH {POP} "


@query("win01_stable_rank", P + "SELECT row_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, row_id) AS BIGINT) AS place FROM pop")
def win01(spark, d):
    return popularity(spark, d).select("row_id", windows.stable_rank(["user_id"], "score", "row_id").alias("place"))


@query("win02_average_rank", P + "SELECT row_id, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / CAST(2 AS DOUBLE) AS avg_rank FROM pop")
def win02(spark, d):
    return popularity(spark, d).select("row_id", windows.average_rank(["user_id"], "score").alias("avg_rank"))


_PLACES = "SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, row_id) - 1 AS d, row_number() OVER (PARTITION BY user_id ORDER BY score, row_id) - 1 AS a, count(*) OVER (PARTITION BY user_id) AS n FROM pop"


@query("win03_percentile_a", P + f"SELECT row_id, round(1 - d / greatest(n - 1, 1), 9) AS p FROM ({_PLACES})")
def win03(spark, d):
    return popularity(spark, d).select("row_id", F.round(windows.percentile_rank(["user_id"], "score", "row_id", "A"), 9).alias("p"))


@query("win04_percentile_b", P + f"SELECT row_id, round((a + 1) / (n + 1), 9) AS p FROM ({_PLACES})")
def win04(spark, d):
    return popularity(spark, d).select("row_id", F.round(windows.percentile_rank(["user_id"], "score", "row_id", "B"), 9).alias("p"))


@query("win05_percentile_c", P + f"SELECT row_id, round(CASE WHEN n = 1 THEN 0.5 ELSE a / (n - 1) END, 9) AS p FROM ({_PLACES})")
def win05(spark, d):
    return popularity(spark, d).select("row_id", F.round(windows.percentile_rank(["user_id"], "score", "row_id", "C"), 9).alias("p"))


@query("win05b_percentile_d", P + f"SELECT row_id, round((a + 0.5::DOUBLE) / n, 9) AS p, CAST(n AS BIGINT) AS n FROM ({_PLACES})")
def win05b(spark, d):
    rows = popularity(spark, d).withColumn("p", F.round(windows.percentile_rank(["user_id"], "score", "row_id", "D"), 9))
    return rows.select("row_id", "p", F.count("*").over(windows.W.partitionBy("user_id")).alias("n"))


@query("win06_deviation", P + "SELECT row_id, round(score - avg(score) OVER (PARTITION BY split, user_id), 6) AS dev FROM pop")
def win06(spark, d):
    return popularity(spark, d).select("row_id", r6(windows.deviation(["split", "user_id"], "score"), "dev"))


@query("win07_zscore", W + ", x AS (SELECT row_id, duration_ms - avg(duration_ms) OVER w AS c, stddev_pop(duration_ms) OVER w AS s FROM log WINDOW w AS (PARTITION BY user_id)) SELECT row_id, round(c / (s + 1e-6), 4) AS z, round(CASE WHEN s <= 1e-8 THEN 0 ELSE c / s END, 4) AS z0 FROM x")
def win07(spark, d):
    return log(spark, d).select("row_id", F.round(windows.zscore(["user_id"], "duration_ms"), 4).alias("z"), F.round(windows.zscore(["user_id"], "duration_ms", None), 4).alias("z0"))


@query("win08_gap_to_max", P + "SELECT row_id, round(score - greatest(0, max(score) OVER (PARTITION BY user_id)), 9) AS gap FROM pop")
def win08(spark, d):
    return popularity(spark, d).select("row_id", F.round(windows.gap_to_max(["user_id"], "score"), 9).alias("gap"))


@query("win09_consensus", W + ", x AS (SELECT row_id, [CAST(hour AS DOUBLE), CAST(tab AS DOUBLE), duration_ms] AS a FROM log) SELECT row_id, round(list_avg(a), 6) AS rank_mean, round(list_stddev_pop(a), 6) AS rank_std, round(list_max(a) - list_min(a), 6) AS rank_spread FROM x")
def win09(spark, d):
    rows = log(spark, d).select("row_id", *[F.col(c).cast("double").alias(c) for c in ("hour", "tab", "duration_ms")])
    return rows.select("row_id", *[r6(c, n) for n, c in windows.consensus(["hour", "tab", "duration_ms"]).items()])


@query("win10_tail_history", W + ", x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time_ms DESC, row_id DESC) AS n FROM log WHERE split = 'train' AND long_view = 1) SELECT user_id, string_agg(CAST(video_id AS VARCHAR), ',' ORDER BY n DESC) AS history FROM x WHERE n <= 20 GROUP BY 1")
def win10(spark, d):
    rows = log(spark, d).where("split = 'train' and long_view = 1")
    return windows.tail_history(rows, ["user_id"], "video_id", ["time_ms", "row_id"], 20).select("user_id", F.array_join("history", ",").alias("history"))


@query("win11_top_k", P + "SELECT user_id, row_id FROM pop QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, row_id) <= 3")
def win11(spark, d):
    return windows.top_k(popularity(spark, d), ["user_id"], [F.desc("score"), F.col("row_id")], 3).select("user_id", "row_id")


@query("win12_duration_quantile", W + "SELECT row_id, round(CASE WHEN count(*) OVER (PARTITION BY dur_bucket) < 2 THEN 0 ELSE (row_number() OVER (PARTITION BY dur_bucket ORDER BY duration_ms, row_id) - 1) / (count(*) OVER (PARTITION BY dur_bucket) - 1) END, 9) AS target FROM log WHERE split = 'train'")
def win12(spark, d):
    return OFFICIAL.rows(log(spark, d), "train").select("row_id", F.round(windows.bucket_quantile_target("dur_bucket", "duration_ms", "row_id"), 9).alias("target"))


@query("win13_random_sample", W + f"SELECT user_id, row_id FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {hashed_unit_sql('row_id', 7)}, row_id) <= 10")
def win13(spark, d):
    return windows.random_sample(log(spark, d), ["user_id"], 10, 7).select("user_id", "row_id")


@query("win14_history_rank_weight", W + ", h AS (SELECT user_id, count(*) AS n FROM log WHERE split = 'train' GROUP BY 1), x AS (SELECT row_id, row_number() OVER (ORDER BY coalesce(n, 0), row_id) - 1 AS r, count(*) OVER () AS total FROM log LEFT JOIN h USING (user_id)) SELECT row_id, round(0.2 + 1.8 * r / greatest(total - 1, 1), 6) AS weight FROM x")
def win14(spark, d):
    rows = log(spark, d)
    sizes = OFFICIAL.rows(rows, "train").groupBy("user_id").agg(F.count("*").alias("n"))
    ranked = keys.global_rank(rows.join(sizes, "user_id", "left").withColumn("n", F.coalesce("n", F.lit(0))), "n", "row_id", "r")
    return ranked.select("row_id", r6(windows.history_rank_weight(F.col("r"), rows.count()), "weight"))


# point-in-time aggregates


@query("pit01_causal_prefix", W + f"SELECT row_id, CAST(count(*) OVER w AS BIGINT) AS prior_n, CAST(coalesce(sum(CASE WHEN date <= {OFFICIAL.horizon} THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS prior_labelled, CAST(coalesce(sum(CASE WHEN date <= {OFFICIAL.horizon} THEN long_view ELSE 0 END) OVER w, 0) AS BIGINT) AS prior_pos FROM log WINDOW w AS (PARTITION BY video_id ORDER BY time_ms, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def pit01(spark, d):
    return pit.causal_prefix(log(spark, d), ["video_id"], "long_view", F.col("date") <= OFFICIAL.horizon).select("row_id", "prior_n", "prior_labelled", "prior_pos")


@query("pit02_frozen_prefix", W + _FROZEN.format(on="x.user_id = r.user_id"))
def pit02(spark, d):
    return pit.frozen_prefix(log(spark, d), ["user_id"]).select("row_id", "lab", "pos")


@query("pit02_frozen_by_union", W + _FROZEN.format(on="x.user_id = r.user_id AND x.tab = r.tab"))
def pit02b(spark, d):
    return pit.frozen_prefix(log(spark, d), ["user_id", "tab"], by_union=True).select("row_id", "lab", "pos")


_DECAYED = f", daily AS (SELECT {{k}}, date, count(*) AS n, sum(long_view) AS p FROM log GROUP BY ALL) SELECT r.row_id, round(coalesce(sum(n * power(CAST(2 AS DOUBLE), -({_DAY.format('r.hz')} - {_DAY.format('x.date')}) / CAST(7 AS DOUBLE))), 0), 6) AS dlab, round(coalesce(sum(p * power(CAST(2 AS DOUBLE), -({_DAY.format('r.hz')} - {_DAY.format('x.date')}) / CAST(7 AS DOUBLE))), 0), 6) AS dpos FROM log r LEFT JOIN daily x ON x.{{k}} = r.{{k}} AND x.date <= r.hz GROUP BY 1"


@query("pit03_decayed", W + _DECAYED.format(k="video_id"))
def pit03(spark, d):
    return pit.frozen_prefix_decayed(log(spark, d), ["video_id"]).select("row_id", r6("dlab", "dlab"), r6("dpos", "dpos"))



def _daily_sql(n: str, cols: str) -> str:
    return f"d_{n} AS (SELECT {cols}, date, count(*) AS n, sum(long_view) AS p FROM log GROUP BY ALL)"


def _known_sql(n: str, cols: list[str]) -> str:
    on = " AND ".join(f"x.{c} = r.{c}" for c in cols)
    return f"k_{n} AS (SELECT r.row_id, CAST(coalesce(sum(x.n), 0) AS DOUBLE) AS lab, CAST(coalesce(sum(x.p), 0) AS DOUBLE) AS pos FROM log r LEFT JOIN d_{n} x ON {on} AND x.date <= r.hz GROUP BY 1)"


@query("pit04_smoothed_rate", W + f", {_daily_sql('i', 'video_id')}, {_known_sql('i', ['video_id'])} SELECT row_id, round((pos + 20 * 0.4::DOUBLE) / (lab + 20), 9) AS rate FROM k_i")
def pit04(spark, d):
    from ..functions.scalars import smoothed_rate

    return pit.frozen_prefix(log(spark, d), ["video_id"]).select("row_id", F.round(smoothed_rate(F.col("pos"), F.col("lab"), 0.4), 9).alias("rate"))


@query("pit05_hierarchical", W + f", {_daily_sql('a', 'author_id')}, {_known_sql('a', ['author_id'])}, {_daily_sql('i', 'video_id')}, {_known_sql('i', ['video_id'])} SELECT row_id, round((k_i.pos + 20 * ((k_a.pos + 20 * 0.4::DOUBLE) / (k_a.lab + 20))) / (k_i.lab + 20), 9) AS rate FROM k_i JOIN k_a USING (row_id)")
def pit05(spark, d):
    rows = pit.frozen_prefixes(log(spark, d), {"a": ["author_id"], "i": ["video_id"]})
    return rows.select("row_id", F.round(pit.hierarchical_rate(F.col("i_pos"), F.col("i_lab"), F.col("a_pos"), F.col("a_lab"), 0.4), 9).alias("rate"))


_FAM = ", ".join(f"{_daily_sql(n, ', '.join(k))}, {_known_sql(n, k)}" for n, k in pit.FAMILIES.items())


@query("pit06_families", W + f", {_FAM} SELECT row_id, " + ", ".join(f"round((k_{n}.pos + 20 * 0.4::DOUBLE) / (k_{n}.lab + 20), 9) AS {n}_rate, round(ln(1 + k_{n}.lab), 9) AS {n}_logn" for n in pit.FAMILIES) + " FROM log " + " ".join(f"JOIN k_{n} USING (row_id)" for n in pit.FAMILIES))
def pit06(spark, d):
    out = pit.family_features(log(spark, d), prior=0.4)
    return out.select("row_id", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("pit07_causal_families", W + "SELECT row_id, " + ", ".join(f"CAST(coalesce(sum(long_view) OVER ({p}), 0) AS BIGINT) AS {n}_pos, CAST(count(*) OVER ({p}) AS BIGINT) AS {n}_n" for n, k in list(pit.FAMILIES.items())[:7] for p in [f"PARTITION BY {', '.join(k)} ORDER BY time_ms, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"]) + " FROM log")
def pit07(spark, d):
    """The log is stored once: made anew for each family, its items are broadcast as many times, side by side."""
    names = list(pit.FAMILIES)[:7]
    used = dict.fromkeys(["row_id", "time_ms", "long_view", *(k for n in names for k in pit.FAMILIES[n])])
    rows = base = stored(log(spark, d).select(*used), "families")
    for n in names:
        rows = pit.causal_prefix(rows, pit.FAMILIES[n], "long_view", F.lit(True), base=base).withColumnsRenamed({"prior_pos": f"{n}_pos", "prior_n": f"{n}_n"}).drop("prior_labelled")
    return rows.select("row_id", *[c for n in names for c in (f"{n}_pos", f"{n}_n")])


@query("pit08_extra_keys", W + f", {_daily_sql('t', 'user_id, tag')}, {_known_sql('t', ['user_id', 'tag'])}, {_daily_sql('v', 'video_type, tab')}, {_known_sql('v', ['video_type', 'tab'])} SELECT row_id, CAST(k_t.lab AS BIGINT) AS tag_lab, CAST(k_t.pos AS BIGINT) AS tag_pos, CAST(k_v.lab AS BIGINT) AS type_lab, CAST(k_v.pos AS BIGINT) AS type_pos FROM k_t JOIN k_v USING (row_id)")
def pit08(spark, d):
    rows = pit.frozen_prefixes(log(spark, d), {"tag": ["user_id", "tag"], "type": ["video_type", "tab"]})
    return rows.select("row_id", "tag_lab", "tag_pos", "type_lab", "type_pos")


@query("pit09_other_target", W + ", daily AS (SELECT video_id, date, count(*) AS n, sum(is_click) AS p FROM log GROUP BY ALL) SELECT r.row_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS lab, CAST(coalesce(sum(p), 0) AS BIGINT) AS clicks FROM log r LEFT JOIN daily x ON x.video_id = r.video_id AND x.date <= r.hz GROUP BY 1")
def pit09(spark, d):
    return pit.frozen_prefix(log(spark, d), ["video_id"], "is_click", out=("lab", "clicks")).select("row_id", "lab", "clicks")


@query("pit10_nested_priors", W + f", {_daily_sql('t', 'tag')}, {_known_sql('t', ['tag'])}, {_daily_sql('u', 'user_id')}, {_known_sql('u', ['user_id'])}, {_daily_sql('x', 'user_id, tag')}, {_known_sql('x', ['user_id', 'tag'])}, r AS (SELECT row_id, (k_x.pos + 20 * ((k_t.pos + 20 * 0.4::DOUBLE) / (k_t.lab + 20))) / (k_x.lab + 20) AS rate, (k_u.pos + 20 * 0.4::DOUBLE) / (k_u.lab + 20) AS base FROM k_t JOIN k_u USING (row_id) JOIN k_x USING (row_id)) SELECT row_id, round(rate, 9) AS rate, round(rate - base, 9) AS above_base FROM r")
def pit10(spark, d):
    from ..functions.scalars import smoothed_rate

    rows = pit.frozen_prefixes(log(spark, d), {"t": ["tag"], "u": ["user_id"], "x": ["user_id", "tag"]})
    rate = pit.hierarchical_rate(F.col("x_pos"), F.col("x_lab"), F.col("t_pos"), F.col("t_lab"), 0.4)
    return rows.select("row_id", F.round(rate, 9).alias("rate"), F.round(rate - smoothed_rate(F.col("u_pos"), F.col("u_lab"), 0.4), 9).alias("above_base"))


@query("pit11_preferred_duration", W + "SELECT r.row_id, CAST(count(x.row_id) AS BIGINT) AS pref_n, round(avg(x.duration_ms), 9) AS pref_mean, round(stddev_pop(x.duration_ms), 3) AS pref_std FROM log r LEFT JOIN log x ON x.user_id = r.user_id AND x.date <= r.hz AND x.long_view = 1 GROUP BY 1")
def pit11(spark, d):
    return pit.preferred_value(log(spark, d), ["user_id"], "duration_ms").select("row_id", "pref_n", F.round("pref_mean", 9).alias("pref_mean"), F.round("pref_std", 3).alias("pref_std"))


@query("pit12_earlier_days", W + ", daily AS (SELECT video_id, date, count(*) AS n, sum(long_view) AS p FROM log GROUP BY ALL) SELECT r.row_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(p), 0) AS BIGINT) AS pos FROM log r LEFT JOIN daily x ON x.video_id = r.video_id AND x.date < r.date GROUP BY 1")
def pit12(spark, d):
    return pit.earlier_days(log(spark, d), ["video_id"], {"n": F.lit(1).cast("long"), "pos": F.col("long_view").cast("long")}).select("row_id", "n", "pos")
