"""The impression log, its dimensions, folds and window schedules.

The log is a view over ``events``: one row for each impression, ``row_id`` being its place. Feedback
columns are outcomes: labels to learn from, never features.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known before an impression is shown.
SAFE = ("row_id", "user_id", "video_id", "date", "time_ms", "hour", "tab", "duration_ms")
#: Known only afterwards.
OUTCOMES = ("long_view", "is_click")

#: Days of each fold's parts, both ends included.
FOLDS = {
    "official": {"train": (20240101, 20240114), "valid": (20240115, 20240121), "test": (20240122, 20240130)},
    "backtest_a": {"train": (20240101, 20240110), "valid": (20240111, 20240115), "test": (20240116, 20240121)},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Kinds of feedback, an event type each.
FEEDBACK = ("click", "error", "purchase", "signup", "view")


def impressions(spark: SparkSession, sf_dir: str, feedback: bool = False) -> DataFrame:
    """row_id, user_id, video_id, date (yyyymmdd), time_ms, hour, tab, duration_ms, and the outcomes long_view and is_click.

    feedback: also gave_<kind> of each of FEEDBACK, which are outcomes too.
    """
    ts = F.col("ts")
    millis = F.datediff(F.to_date(ts), F.lit(datetime.date(1970, 1, 1))).cast("long") * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.expr("extract(SECOND FROM ts)") * 1000)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("video_id"),
        F.date_format(ts, "yyyyMMdd").cast("int").alias("date"),
        millis.cast("long").alias("time_ms"),
        F.hour(ts).alias("hour"),
        F.floor(F.hour(ts) / 6).cast("int").alias("tab"),
        F.col("value").alias("duration_ms"),
        F.col("event_type").isin("view", "purchase").cast("int").alias("long_view"),
        (F.col("event_type") == "click").cast("int").alias("is_click"),
        *[(F.col("event_type") == kind).cast("int").alias(f"gave_{kind}") for kind in (FEEDBACK if feedback else ())],
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, author_id, tag, video_type; the first row of an id wins."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").cast("int").alias("video_id"), F.col("p_brand").alias("author_id"), F.col("p_type").alias("tag"), F.col("p_size").alias("video_type")).dropDuplicates(["video_id"])


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, segment, nation."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).dropDuplicates(["user_id"])


@dataclass(frozen=True)
class Fold:
    """Days of the three parts. Labels after ``horizon`` aren't to be seen."""

    name: str

    def days(self, part: str) -> tuple[int, int]:
        return FOLDS[self.name][part]

    @property
    def horizon(self) -> int:
        return self.days("valid")[1]

    def rows(self, log: DataFrame, part: str) -> DataFrame:
        return log.where(F.col("date").between(*self.days(part)))

    def with_part(self, log: DataFrame, out: str = "split") -> DataFrame:
        c = F.lit(None).cast("string")
        for part in ("test", "valid", "train"):
            c = F.when(F.col("date").between(*self.days(part)), part).otherwise(c)
        return log.withColumn(out, c)

    def schedule(self, chunks: int = 5) -> list[tuple[int, int, int]]:
        """(first day, last day, horizon): train cut into near-equal runs of days, each seeing labels up to the run before; then valid and test."""
        lo, hi = (datetime.datetime.strptime(str(d), "%Y%m%d").date() for d in self.days("train"))
        days = [int((lo + datetime.timedelta(i)).strftime("%Y%m%d")) for i in range((hi - lo).days + 1)]
        k = min(chunks, len(days))
        size, more = divmod(len(days), k)
        out, at, horizon = [], 0, days[0] - 1
        for i in range(k):
            run = days[at : at + size + (i < more)]
            out.append((run[0], run[-1], horizon))
            at, horizon = at + len(run), run[-1]
        return [*out, (*self.days("valid"), self.days("train")[1]), (*self.days("test"), self.days("valid")[1])]
