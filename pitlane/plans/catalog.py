"""The registry: each operator as a query over the test tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import smoothed_rate
from ..operators import keys
from ..sources.impressions import Fold, impressions, users, videos
from ..sources.scratch import scratch, stored  # noqa: F401  for the catalogs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

OFFICIAL = Fold("official")
SCHEDULE = OFFICIAL.schedule()
DUR_WIDTH = 25


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def log(spark: SparkSession, d: str, feedback: bool = False) -> DataFrame:
    """The log with its items' attributes, the row's horizon hz, its split and a duration bucket."""
    rows = impressions(spark, d, feedback).join(videos(spark, d), "video_id", "left")
    rows = rows.withColumn("hz", keys.window_horizon(F.col("date"), SCHEDULE)).withColumn("dur_bucket", F.floor(F.col("duration_ms") / DUR_WIDTH).cast("int"))
    return OFFICIAL.with_part(rows)


def popularity(spark: SparkSession, d: str, alpha: float = 20.0) -> DataFrame:
    """The log with score: the item's smoothed rate among training rows; unseen items get the mean."""
    rows = log(spark, d)
    train = OFFICIAL.rows(rows, "train")
    items = train.groupBy("video_id").agg(F.count("*").alias("imp"), F.sum("long_view").alias("pos"))
    mean = train.agg(F.avg("long_view").alias("g"))
    out = rows.join(items, "video_id", "left").crossJoin(F.broadcast(mean))  # one row
    return out.withColumn("score", F.coalesce(smoothed_rate(F.col("pos"), F.col("imp"), F.col("g"), alpha), F.col("g")))


def day_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger made of the log: each split a run, each of its days an iteration whose score is its rate of positives, NaN on every seventh day."""
    days = log(spark, d).where("split is not null").groupBy(F.col("split").alias("run"), "date").agg(F.round(F.avg("long_view"), 6).alias("rate"), F.count("*").alias("n"))
    return days.select("run", (F.row_number().over(W.partitionBy("run").orderBy("date")) - 1).cast("int").alias("iteration"), F.concat(F.lit("family "), (F.col("date") % 3).cast("string")).alias("family"), F.when(F.col("date") % 7 == 0, float("nan")).otherwise(F.col("rate")).alias("valid"), F.col("n").cast("double").alias("seconds"), (F.col("date") % 2 == 1).alias("hit"))


DAY_LEDGER = """days AS (SELECT split AS run, date, round(avg(long_view), 6) AS rate, count(*) AS n FROM log WHERE split IS NOT NULL GROUP BY 1, 2),
led AS (SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY date) - 1 AS INTEGER) AS iteration, 'family ' || (date % 3) AS family, CASE WHEN date % 7 = 0 THEN NULL ELSE rate END AS v, CAST(n AS DOUBLE) AS seconds, date % 2 = 1 AS hit FROM days)"""


def r6(c, name: str):
    """Rounded to 6 digits, for sums whose order differs between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


_HZ = " ".join(f"WHEN date BETWEEN {lo} AND {hi} THEN {h}" for lo, hi, h in reversed(SCHEDULE))
_SPLIT = " ".join(f"WHEN date BETWEEN {lo} AND {hi} THEN '{p}'" for p in ("train", "valid", "test") for lo, hi in [OFFICIAL.days(p)])

BASE = f"""imp AS (
  SELECT event_id AS row_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS video_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date,
         CAST(epoch_ns(ts) // 1000000 AS BIGINT) AS time_ms, CAST(hour(ts) AS INTEGER) AS hour, CAST(hour(ts) // 6 AS INTEGER) AS tab, value AS duration_ms,
         CASE WHEN event_type IN ('view', 'purchase') THEN 1 ELSE 0 END AS long_view, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click
  FROM events),
vid AS (SELECT CAST(p_partkey AS INTEGER) AS video_id, p_brand AS author_id, p_type AS tag, p_size AS video_type FROM part),
log AS (
  SELECT imp.*, author_id, tag, video_type, CASE {_HZ} ELSE -1 END AS hz, CASE {_SPLIT} END AS split, CAST(floor(duration_ms / {DUR_WIDTH}) AS INTEGER) AS dur_bucket
  FROM imp LEFT JOIN vid USING (video_id))"""

POP = f"""{BASE},
items AS (SELECT video_id, count(*) AS imps, sum(long_view) AS pos FROM log WHERE split = 'train' GROUP BY 1),
mean AS (SELECT avg(long_view) AS g FROM log WHERE split = 'train'),
pop AS (SELECT log.*, coalesce((pos + CAST(20 AS DOUBLE) * g) / (imps + CAST(20 AS DOUBLE)), g) AS score FROM log LEFT JOIN items USING (video_id) CROSS JOIN mean)"""

_IDEAL = "[1.0::DOUBLE, 1.6309297535714573, 2.1309297535714573, 2.5616063116448506, 2.948459118879392]"


def groups_sql(rel: str, group: str = "user_id", score: str = "score") -> str:
    """CTEs ranked and per (group, size, npos, auc, ndcg, valid), by average ranks."""
    return f"""ranked AS (
  SELECT *, rank() OVER (PARTITION BY {group} ORDER BY {score}) + (count(*) OVER (PARTITION BY {group}, {score}) - 1) / CAST(2 AS DOUBLE) AS r,
         row_number() OVER (PARTITION BY {group} ORDER BY {score} DESC, row_id) AS i
  FROM ({rel})),
per AS (
  SELECT {group}, CAST(count(*) AS BIGINT) AS size, CAST(sum(long_view) AS BIGINT) AS npos, sum(long_view) > 0 AND sum(long_view) < count(*) AS valid,
         CASE WHEN sum(long_view) > 0 AND sum(long_view) < count(*) THEN (sum(CASE WHEN long_view = 1 THEN r ELSE 0 END) - sum(long_view) * (sum(long_view) + 1) / CAST(2 AS DOUBLE)) / (sum(long_view) * (count(*) - sum(long_view))) END AS auc,
         CASE WHEN sum(long_view) > 0 THEN sum(CASE WHEN long_view = 1 AND i <= 5 THEN 1 / log2(i + 1) ELSE 0 END) / ({_IDEAL})[CAST(least(sum(long_view), 5) AS BIGINT)] ELSE 0 END AS ndcg
  FROM ranked GROUP BY {group})"""


SUMMARY = """round(coalesce(sum(CASE WHEN valid THEN npos * auc END) / sum(CASE WHEN valid THEN npos END), 0.5), 6) AS gauc, round(coalesce(avg(ndcg), 0), 6) AS ndcg5,
  round((coalesce(sum(CASE WHEN valid THEN npos * auc END) / sum(CASE WHEN valid THEN npos END), 0.5) + coalesce(avg(ndcg), 0)) / 2, 6) AS primary_score, CAST(count(*) AS BIGINT) AS users, CAST(coalesce(sum(size), 0) AS BIGINT) AS rows_n"""


def rounded_summary(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, r6("gauc", "gauc"), r6("ndcg5", "ndcg5"), r6("primary", "primary_score"), "users", F.col("rows").alias("rows_n"))


def dimensions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return videos(spark, d), users(spark, d)


from . import catalog_features, catalog_models, catalog_ranking  # noqa: E402, F401  they register their queries
