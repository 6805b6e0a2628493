"""Queries of learners, sources and sinks, the candidate loop and the stream: checked by their rows and by tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import dot
from ..operators import keys, learners, metrics, models, pit, windows
from ..operators.nets import OBJECTIVES
from ..sources import files
from ..sources.impressions import FEEDBACK, Fold, table, users, videos
from ..streaming.prefix import start_prefix
from . import context as candidates
from .catalog import BASE, DAY_LEDGER, OFFICIAL, POP, SCHEDULE, SUMMARY, day_ledger, groups_sql, log, popularity, query, rounded_summary, scratch, stored
from .catalog_features import _VIOLATIONS

FIT_END = OFFICIAL.days("train")[1]
PRIOR = 0.4


def scored(spark, d, scores: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The metrics of each split; ``labels``: the log's rows where they are stored already."""
    rows = (log(spark, d) if labels is None else labels).select("row_id", "user_id", "split", "long_view")
    return rounded_summary(metrics.evaluate(rows.join(scores, "row_id"), "long_view", "score", by=["split"]), "split")


#: Fields of the factorisation machines.
FIELDS = ["user_id", "video_id", "author_id", "tab", "dur_bucket"]


def learning_rows(spark, d, feedback: bool = False) -> DataFrame:
    """The columns that learners of ids read, stored once for all windows."""
    more = [f"gave_{kind}" for kind in FEEDBACK] if feedback else []
    return stored(log(spark, d, feedback).select("row_id", "user_id", "video_id", "date", "time_ms", "split", "tab", "tag", "author_id", "dur_bucket", "long_view", "is_click", *more), "learning")


@query("mf01_als")
def mf01(spark, d):
    return scored(spark, d, models.als_scores(learning_rows(spark, d), SCHEDULE))


@query("mf02_dot", f"WITH {BASE} SELECT row_id, round(tab * hour + duration_ms * 2, 6) AS score FROM log")
def mf02(spark, d):
    return log(spark, d).select("row_id", F.round(dot(F.array(F.col("tab").cast("double"), "duration_ms"), F.array(F.col("hour").cast("double"), F.lit(2.0))), 6).alias("score"))


@query("mod01_fm_early_stopping")
def mod01_fit(spark, d):
    """The factorisation machine fitted on the training days until the validation primary stops growing, scored on all splits."""
    rows = learning_rows(spark, d)
    stack = learners.fitted_fm(rows.where("split = 'train'"), rows.where("split = 'valid'"), FIELDS)
    return scored(spark, d, learners.scored_by(stack, rows, FIELDS)).withColumns({"best_pass": F.lit(stack.best[0]), "passes": F.lit(len(stack.curves[0]))})


@query("mod02_windowed_fm")
def mod02(spark, d):
    return scored(spark, d, learners.windowed_fm(learning_rows(spark, d), SCHEDULE, FIELDS, ["long_view"], FIT_END).withColumnRenamed("long_view", "score"))


def by_name(scores: DataFrame, names: list[str], out: str) -> DataFrame:
    """row_id, ``out``, score: a row for each column of scores."""
    return scores.unpivot("row_id", names, out, "score")


def scored_apart(spark, d, scores: DataFrame, names: list[str], out: str, rows: DataFrame | None = None) -> DataFrame:
    """The metrics of each split and column of scores, by one evaluation; ``rows`` has the labels of what each column is for."""
    labels = rows if rows is not None else log(spark, d).select("row_id", "user_id", "split", "long_view")
    on = ["row_id", *([out] if out in labels.columns else [])]
    return rounded_summary(metrics.evaluate(labels.join(by_name(scores, names, out), on), "long_view", "score", by=[out, "split"]), out, "split")


@query("mod03_propensity")
def mod03(spark, d):
    """Machines for the five kinds of feedback side by side, each measured on its own feedback."""
    rows, names = learning_rows(spark, d, feedback=True), [f"gave_{kind}" for kind in FEEDBACK]
    scores = learners.windowed_fm(rows, SCHEDULE, FIELDS, names, FIT_END, epochs=6)
    truth = rows.unpivot(["row_id", "user_id", "split"], names, "target", "long_view")
    return scored_apart(spark, d, scores, names, "target", truth)


@query("mod04_refit")
def mod04(spark, d):
    """Machines with recency weights over three seeds; test rows by those of the training days alone (strict) or refitted with the validation days too (permissive)."""
    scores = learners.refit_scores(learning_rows(spark, d), FIELDS)
    return scored_apart(spark, d, scores, ["strict", "permissive"], "reading")


@query("mod05_trained_losses")
def mod05_trained(spark, d):
    """Machines of each objective over the lists of a user and day, fitted side by side, each until its validation primary stops growing."""
    rows = learning_rows(spark, d)
    stack = learners.fitted_fm(rows.where("split = 'train'"), rows.where("split = 'valid'"), FIELDS, losses=OBJECTIVES, lists=["user_id", "date"])
    out = stack.scores(rows.select("row_id", learners.slots(FIELDS, stack.bits).alias("x")), ["row_id"])
    return scored_apart(spark, d, out.select("row_id", *[F.col("score")[i].alias(x) for i, x in enumerate(OBJECTIVES)]), [*OBJECTIVES], "loss")


@query("mod07_target_attention")
def mod07_attention(spark, d):
    rows = learning_rows(spark, d)
    scores = learners.attention_scores(rows, SCHEDULE, FIELDS)
    return scored(spark, d, scores.withColumnRenamed("plain", "score"), rows)


@query("mod08_weighted_attention")
def mod08_attention(spark, d):
    """Target attention with training rows weighted by their histories in three ways."""
    modes = [m for m in learners.MODES if m != "plain"]
    rows = learning_rows(spark, d)
    scores = learners.attention_scores(rows, SCHEDULE, FIELDS, modes=tuple(modes), seeds=(0,))
    return scored_apart(spark, d, scores, modes, "mode", rows.select("row_id", "user_id", "split", "long_view"))


@query("mod07_sequences", f"WITH {BASE}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time_ms DESC, row_id DESC) AS n FROM log WHERE date <= {FIT_END}) SELECT user_id, CAST(count(*) AS BIGINT) AS slen, string_agg(CAST(video_id + 1 AS VARCHAR), ',' ORDER BY n DESC) AS seq FROM x WHERE n <= 32 GROUP BY 1")
def mod07(spark, d):
    rows = log(spark, d).where(F.col("date") <= FIT_END).withColumn("code", F.col("video_id") + 1)
    seq = windows.tail_history(rows, ["user_id"], "code", ["time_ms", "row_id"], 32, "seq")
    return seq.select("user_id", F.size("seq").cast("long").alias("slen"), F.array_join("seq", ",").alias("seq"))


FAMILIES = {n: pit.FAMILIES[n] for n in ("item", "user", "item_tab")}
FEATURES = [f"{n}_{x}" for n in FAMILIES for x in ("rate", "logn")]


def feature_rows(spark, d) -> DataFrame:
    """Frozen rates of three families and their deviations within (user, horizon), stored once."""
    rows = pit.frozen_prefixes(log(spark, d), FAMILIES).select("row_id", "user_id", "split", "hz", "date", "long_view", *pit.rate_columns(FAMILIES, PRIOR))
    return stored(rows.withColumns({f"{c}_dev": windows.deviation(["user_id", "hz"], c) for c in FEATURES}), "features")


@query("mod09_gbt")
def mod09(spark, d):
    """Trees on the training days' features and deviations, scored on all splits."""
    rows, names = feature_rows(spark, d), [*FEATURES, *(f"{c}_dev" for c in FEATURES)]
    return scored(spark, d, models.gbt_scores(names)(rows.where("split = 'train'"), rows))


@query("mod09_lambdarank")
def mod09_lambdarank(spark, d):
    """Trees with pair gradients within the lists of a user and day, as many as have the best validation primary."""
    names = [*FEATURES, *(f"{c}_dev" for c in FEATURES)]
    return scored(spark, d, models.boosted_scores(feature_rows(spark, d), names, "lambdarank", models.GROUPS["user_day"], learning_rate=0.1, depth=4))


@query("mod10_experts")
def mod10(spark, d):
    """Trees on each of three families of features apart, fitted on the training days, scored on all splits."""
    out = None
    for name in models.EXPERTS:
        rows, names = models.expert_matrix(log(spark, d), name, PRIOR)
        part = scored(spark, d, models.expert_scores(stored(rows, "expert"), names)).withColumn("expert", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_BOUNDS = ", ".join(f"('{k}', {float(lo)}::DOUBLE, {float(hi)}::DOUBLE, {str(isinstance(lo, int)).lower()})" for k, (lo, hi) in models.ALLOWED.items())


@query(
    "mod11_clipped_params",
    f"""WITH {BASE}, b(name, lo, hi, whole) AS (VALUES {_BOUNDS}), names AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS i FROM (SELECT name FROM b UNION ALL SELECT 'n_estimators')),
    g AS (SELECT name, round(avg(duration_ms), 4) - 40 AS v FROM log JOIN names ON i = hour % 11 GROUP BY 1),
    c AS (SELECT g.name, v, CASE WHEN lo IS NULL THEN NULL WHEN whole THEN trunc(least(greatest(v, lo), hi)) ELSE least(greatest(v, lo), hi) END AS x FROM g LEFT JOIN b USING (name))
    SELECT name, round(x, 4) AS value, CASE WHEN x IS NULL THEN 'UNKNOWN' WHEN x <> v THEN 'CLIPPED' ELSE 'OK' END AS finding FROM c""",
)
def mod11(spark, d):
    """Values made of the log's durations, proposed for each parameter and for one that can't be set."""
    names = F.array(*[F.lit(n) for n in sorted([*models.ALLOWED, "n_estimators"])])
    given = log(spark, d).groupBy(F.get(names, F.col("hour") % 11).alias("name")).agg((F.round(F.avg("duration_ms"), 4) - 40).alias("value"))
    return models.clipped_table(given).select("name", F.round("value", 4).alias("value"), "finding")


@query("mod12_importances")
def mod12(spark, d):
    return models.importances(feature_rows(spark, d).where("split = 'train'"), FEATURES, top=5)


# sources and sinks


@query("src02_cache", f"WITH {BASE} SELECT row_id, user_id, video_id FROM imp")
def src02(spark, d):
    return files.build_cache(log(spark, d), scratch(spark, "cache")).select("row_id", "user_id", "video_id")


@query("src04_guarded_signal", f"WITH {POP} SELECT row_id, round(score, 9) AS score FROM pop")
def src04(spark, d):
    path = scratch(spark, "signal")
    popularity(spark, d).select("row_id", "score").write.parquet(path)
    return files.read_signal(spark, path, table(spark, d, "events").count()).select("row_id", F.round("score", 9).alias("score"))


@query("src01_csv_log", f"WITH {BASE} SELECT CAST(row_number() OVER (ORDER BY split <> 'train', row_id) - 1 AS BIGINT) AS row_id, user_id, video_id, date, time_ms, tab, round(duration_ms, 6) AS duration_ms, long_view, split FROM log")
def src01_csv(spark, d):
    """The log as CSV files, those of the training days first, read back: rows are numbered by (file, line)."""
    rows, paths = log(spark, d), []
    for i, part in enumerate(("split = 'train'", "split <> 'train'")):
        path = scratch(spark, f"log{i}")
        rows.where(part).orderBy("row_id").select("user_id", "video_id", "date", "time_ms", "tab", "duration_ms", "long_view").write.csv(path, header=True)
        paths += files.parts(spark, path)
    return OFFICIAL.with_part(files.read_log(spark, paths)).withColumn("duration_ms", F.round("duration_ms", 6)).select("row_id", "user_id", "video_id", "date", "time_ms", "tab", "duration_ms", "long_view", "split")


def _ledger(spark, d) -> DataFrame:
    days = day_ledger(spark, d)
    detail = F.repeat(F.lit("d"), F.col("seconds").cast("int"))
    return days.select("run", "iteration", "family", F.when(F.col("hit"), "accept").otherwise("reject").alias("decision"), F.when(~F.isnan("valid"), F.col("valid")).alias("valid"), "seconds", detail.alias("detail"))


@query("src06_ledger_read", f"WITH {BASE}, {DAY_LEDGER} SELECT run, iteration, v AS valid, CAST(least(seconds, 800) AS BIGINT) AS detail_chars FROM led")
def src06(spark, d):
    path = scratch(spark, "ledger")
    files.append_ledger(_ledger(spark, d), path)
    return files.read_ledger(spark, path).select("run", "iteration", "valid", F.length("detail").cast("long").alias("detail_chars"))


@query("src07_status_lines", f"WITH {BASE}, {DAY_LEDGER} SELECT CASE WHEN hit THEN 'STOPPED' ELSE 'CONVERGED' END AS status, run || ' ' || iteration AS reason, v AS primary_score FROM led")
def src07(spark, d):
    """Lines of a console, one a day of the log: how a run ended and its score as JSON, among lines that say neither."""
    days = _ledger(spark, d)
    end = F.concat(F.when(F.col("decision") == "accept", "STOPPED: ").otherwise("CONVERGED: "), "run", F.lit(" "), "iteration", F.lit(" "), F.to_json(F.struct(F.col("valid").alias("primary"))))
    lines = days.select(F.explode(F.array(F.concat(F.lit("step "), "iteration"), end)).alias("value"))
    out = files.parse_status(lines)
    return out.select("status", "reason", F.col("primary").alias("primary_score"))


@query("src07_json_blocks", f"WITH {BASE}, {DAY_LEDGER} SELECT run, CAST(count(*) AS BIGINT) AS days, round(sum(v), 6) AS total FROM led GROUP BY 1")
def src07_blocks(spark, d):
    """A console log a run, in which a nested JSON object goes over many lines: a number for each of the run's days."""
    path = scratch(spark, "console")
    entry = F.concat(F.lit('    "day '), "iteration", F.lit('}": {"primary": '), F.coalesce(F.col("valid").cast("string"), F.lit("null")), F.lit("}"))
    whole = _ledger(spark, d).groupBy("run").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",\n").alias("e"))  # some days a run
    text = whole.select("run", F.concat(F.lit('begin {\n{"note": 1, "by_day":\n  {\n'), "e", F.lit("\n  }, \"after\": {}}\nend }")).alias("value"))
    text.repartition("run").write.partitionBy("run").text(path)
    found = files.parse_blocks(spark, [path], "by_day")
    days = F.from_json("block", "map<string,struct<primary:double>>")
    out = found.where("block is not null").select(F.regexp_extract("path", "run=([^/]+)/", 1).alias("run"), F.explode(days).alias("day", "x"))
    return out.groupBy("run").agg(F.count("*").alias("days"), F.round(F.sum("x.primary"), 6).alias("total"))


@query("snk01_submission", f"WITH {POP} SELECT row_id, user_id, video_id, printf('%.6g', score) AS score FROM pop WHERE split = 'test'")
def snk01(spark, d):
    path = scratch(spark, "submission")
    files.write_submission(OFFICIAL.rows(popularity(spark, d), "test"), "score", path)
    return spark.read.csv(path, header=True, schema="row_id long, user_id long, video_id int, score string")


_BROKEN = """, sub AS (SELECT row_id, CASE WHEN hour = 4 THEN -1 ELSE user_id END AS user_id, video_id, CASE WHEN hour = 5 THEN 'nan' WHEN hour = 6 THEN 'x' ELSE CAST(duration_ms AS VARCHAR) END AS score FROM log WHERE split = 'test' AND tab < 3
  UNION ALL SELECT row_id, user_id, video_id, CAST(duration_ms AS VARCHAR) FROM log WHERE split = 'test' AND hour = 7)"""


@query("snk02_validation", f"WITH {BASE}" + _BROKEN + _VIOLATIONS)
def snk02(spark, d):
    """A submission without one tab's rows, with one hour's rows twice, and with wrong users and scores in others."""
    rows = log(spark, d).where("split = 'test'")
    sent = files.submission(rows.where("tab < 3"), "duration_ms").join(rows.select("row_id", "hour"), "row_id")
    sent = sent.withColumn("user_id", F.when(F.col("hour") == 4, -1).otherwise(F.col("user_id")))
    sent = sent.withColumn("score", F.when(F.col("hour") == 5, "nan").when(F.col("hour") == 6, "x").otherwise(F.col("score"))).drop("hour")
    return files.submission_violations(sent.unionByName(files.submission(rows.where("hour = 7"), "duration_ms")), rows)


@query("snk03_ties", f"WITH {POP} SELECT CAST(sum(n - 1) AS BIGINT) AS ties FROM (SELECT count(*) AS n FROM pop WHERE split = 'test' GROUP BY user_id, score)")
def snk03(spark, d):
    return files.tie_count(OFFICIAL.rows(popularity(spark, d), "test"), "score")


@query("snk04_ledger_append", f"WITH {BASE}, {DAY_LEDGER} SELECT family, CAST(2 * count(*) AS BIGINT) AS n FROM led GROUP BY 1")
def snk04(spark, d):
    path, ledger = scratch(spark, "ledger"), _ledger(spark, d)
    for _ in range(2):
        files.append_ledger(ledger, path)
    return files.read_ledger(spark, path).groupBy("family").agg(F.count("*").alias("n"))


def _errors(spark, d) -> DataFrame:
    """A failure for each day without a score, whose detail has as many characters as the day has rows."""
    return _ledger(spark, d).where("valid is null").select("run", "iteration", F.lit("crash").alias("kind"), "detail", F.lit("left out").alias("recovery"))


@query("snk05_error_append", f"WITH {BASE}, {DAY_LEDGER} SELECT iteration, 'crash' AS kind, CAST(least(seconds, 800) AS BIGINT) AS detail_chars, 'left out' AS recovery, true AS timed FROM led WHERE v IS NULL")
def snk05(spark, d):
    path = scratch(spark, "errors")
    files.append_errors(_errors(spark, d), path)
    back = spark.read.schema("iteration int, kind string, detail string, recovery string, t string").json(path)
    return back.select("iteration", "kind", F.length("detail").cast("long").alias("detail_chars"), "recovery", F.col("t").rlike(r"^\d\d:\d\d:\d\d$").alias("timed"))


_AUDITED = ", ".join(f"{p}_r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / CAST(2 AS DOUBLE) AS r, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, row_id) AS i FROM pop WHERE split = '{p}'), {p}_g AS ({groups_sql('SELECT 1').split('per AS (')[1].split('FROM ranked')[0]} FROM {p}_r GROUP BY user_id), {p}_s AS (SELECT {SUMMARY} FROM {p}_g)" for p in ("valid", "test"))


@query("snk06_audited_metric", f"WITH {POP}, {_AUDITED} SELECT 'valid' AS split, CAST(unnest([1, 2]) AS BIGINT) AS call, unnest(['first', 'again']) AS reason, primary_score FROM valid_s UNION ALL SELECT 'test', 1, 'report', primary_score FROM test_s")
def snk06(spark, d):
    """The audit log after three scorings, and one that was refused as the split was sealed."""
    path, rows = scratch(spark, "audit"), stored(popularity(spark, d).select("row_id", "user_id", "split", "long_view", "score"), "scored")
    for split, reason in (("valid", "first"), ("valid", "again"), ("test", "report")):
        files.audited_score(rows, "long_view", "score", split, path, reason)
    try:
        files.audited_score(rows, "long_view", "score", "test", path, "refused", sealed=True)
    except files.SealedSplit:
        pass
    return files.read_audit(spark, path).select("split", "call", "reason", F.col("primary").alias("primary_score"))


@query(
    "snk07_run_report",
    f"""WITH {BASE}, {DAY_LEDGER},
    lines AS (SELECT run, -1 AS iteration, unnest([0, 1, 2, 3]) AS part, unnest(['# Days ' || run, '- Iterations: ' || count(*), '- Wall-clock: ' || CAST(sum(seconds) AS BIGINT) || ' s', printf('- Best primary: %.6f', max(v))]) AS line FROM led GROUP BY run
      UNION ALL SELECT run, iteration, unnest([0, 1, 2]), unnest([printf('## Iteration %d: ', iteration) || CASE WHEN hit THEN 'ACCEPT' ELSE 'REJECT' END, 'Family: ' || family, coalesce(printf('| primary | %.6f |', v), 'No validation score.')]) FROM led
      UNION ALL SELECT run, iteration, 101, 'Error crash: ' || CAST(CAST(seconds AS BIGINT) AS VARCHAR) || ' rows Recovery: left out' FROM led WHERE v IS NULL)
    SELECT run, CAST(iteration AS INTEGER) AS iteration, CAST(part AS INTEGER) AS part, line FROM lines""",
)
def snk07(spark, d):
    """A Markdown report of each split as a run over its days."""
    ledger = _ledger(spark, d)
    errors = ledger.where("valid is null").select("run", "iteration", F.lit("crash").alias("kind"), F.concat(F.col("seconds").cast("long").cast("string"), F.lit(" rows")).alias("detail"), F.lit("left out").alias("recovery"))
    return files.run_report(ledger, errors, "Days")


@query("snk08_matrix", f"WITH {POP} SELECT row_id, round(score, 9) AS score, duration_ms, 'score,duration_ms' AS names FROM pop")
def snk08(spark, d):
    """A matrix written and read back with the names of its columns in their order."""
    path = scratch(spark, "matrix")
    files.write_matrix(popularity(spark, d).select("row_id", "score", "duration_ms"), path)
    matrix, names = files.read_matrix(spark, path, table(spark, d, "events").count())
    return matrix.select("row_id", F.round("score", 9).alias("score"), "duration_ms", F.lit(",".join(names)).alias("names"))


# the candidate API, its loop, the stream


def _context(spark, d, *folds: Fold):
    """The context of the official fold, or those of some folds, over one stored log."""
    rows = stored(log(spark, d).drop("hz", "split", "author_id", "tag", "video_type"), "log")
    found = [candidates.Context.of(rows, fold, videos(spark, d), users(spark, d)) for fold in folds or (OFFICIAL,)]
    return found if folds else found[0]


@query("ctx01_candidate_loop")
def ctx01(spark, d):
    """A scripted loop over candidates, confirmed on a backtest: popularity, two that the label flows into under another name, two that aren't popularity."""
    leak = candidates.Candidate("leak", "causal", lambda ctx: ctx._log.select("row_id", (1 - F.col("long_view")).alias("watched_seconds")))
    noisy = candidates.Candidate("noisy leak", "causal", lambda ctx: ctx._log.select("row_id", (F.col("long_view") + F.hash("row_id") / 1e10).alias("watched_share")))
    proposals = [candidates.Candidate("item", "popularity", candidates.popularity), leak, noisy, candidates.Candidate("item x tab", "popularity", candidates.by_tab), candidates.Candidate("trees", "popularity", candidates.trees, "features")]
    context, backtest = _context(spark, d, OFFICIAL, Fold("backtest_a"))
    ledger = candidates.scripted_loop(context, proposals, 0.4, backtest=backtest)
    rows = [(e["iteration"], e["candidate"], e["family"], e["decision"], e["valid"], e["detail"]) for e in ledger]
    return spark.createDataFrame(rows, "iteration int, candidate string, family string, decision string, valid double, detail string")


@query("ctx02_visible_labels", f"WITH {BASE} SELECT row_id, CASE WHEN date <= {OFFICIAL.horizon} THEN long_view ELSE -1 END AS label FROM imp")
def ctx02(spark, d):
    return _context(spark, d).labels_visible().select("row_id", "label")


@query(
    "ctx03_field_specs",
    f"""WITH {BASE}, f AS (SELECT row_id, split, tag || ' ' || tab AS a, CAST(floor(hour / 4) AS VARCHAR) AS b FROM log),
    x AS (SELECT a AS v, row_number() OVER (ORDER BY a) - 1 AS code FROM (SELECT DISTINCT a FROM f WHERE split = 'train')), y AS (SELECT b AS v, row_number() OVER (ORDER BY b) - 1 AS code FROM (SELECT DISTINCT b FROM f WHERE split = 'train'))
    SELECT row_id, CAST(coalesce(x.code, (SELECT count(*) FROM x)) AS BIGINT) AS tag_tab_id, CAST(coalesce(y.code, (SELECT count(*) FROM y)) + (SELECT count(*) FROM x) + 1 AS BIGINT) AS time_id FROM f LEFT JOIN x ON a = x.v LEFT JOIN y ON b = y.v""",
)
def ctx03(spark, d):
    """Fields given as expressions, encoded with what the training days hold."""
    fields = [keys.FieldSpec("tag_tab", F.concat_ws(" ", "tag", "tab")), keys.FieldSpec("time", F.floor(F.col("hour") / 4).cast("string"))]
    out, _ = keys.encoded_fields(log(spark, d), F.col("split") == "train", fields)
    return out.select("row_id", F.col("tag_tab_id").cast("long"), F.col("time_id").cast("long"))


@query("str01_streaming_prefix", f"WITH {BASE} SELECT row_id, CAST(count(*) OVER w AS BIGINT) AS prior_n, CAST(coalesce(sum(long_view) OVER w, 0) AS BIGINT) AS prior_pos FROM imp WINDOW w AS (PARTITION BY video_id ORDER BY time_ms, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def str01(spark, d):
    """The prefix by a stream over the event files, run until all of them are read."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    rows = stream.select(F.col("event_id").alias("row_id"), F.get_json_object("props", "$.k").cast("int").alias("video_id"), F.col("event_type").isin("view", "purchase").cast("long").alias("long_view"), F.col("ts").cast("timestamp").alias("t"))
    path = scratch(spark, "stream")
    start_prefix(rows, "video_id", "long_view", "t", path).awaitTermination()
    return spark.read.schema("row_id long, prior_n long, prior_pos long").parquet(f"{path}/rows").drop("batch")
