"""Distinct counts and quantiles: by daily sketches that merge up to any horizon, and exact thresholds between two classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a sketch's registers: a merged count has a standard error of 1.04 / 2 ** (bits / 2), 1.6 hundredths.
COUNT_BITS = 12
COUNT_ERROR = 1.04 / 2 ** (COUNT_BITS / 2)
#: Items of a quantile sketch: with a chance of 99 in 100 the rank of a quantile is off by less than 2.296 / k ** 0.9021, 0.55 hundredths.
QUANTILE_ITEMS = 800
QUANTILE_ERROR = 2.296 / QUANTILE_ITEMS**0.9021


def daily_sketches(df: DataFrame, keys: list[str], distinct: str, value: str, date: str = "date") -> DataFrame:
    """keys, date, n, _ids, _values: of each key and day its rows, a sketch of the distinct values of one column and one of the quantiles of another.

    Sketches are made where the rows lie and merged by key and day, so neither a hot key nor a column of
    many values gathers. Nulls and NaN are in neither sketch.
    """
    x = F.col(value).cast("double")
    ids = F.hll_sketch_agg(F.col(distinct).cast("string"), COUNT_BITS)
    return df.groupBy(*keys, date).agg(F.count("*").alias("n"), ids.alias("_ids"), F.kll_sketch_agg_double(F.when(~F.isnan(x), x), F.lit(QUANTILE_ITEMS)).alias("_values"))


def up_to(daily: DataFrame, keys: list[str], horizons: DataFrame, ranks: list[float], date: str = "date", horizon: str = "horizon") -> DataFrame:
    """keys, horizon, n, distinct, quantiles: the daily sketches up to each horizon, merged. ``horizons`` has one for each window of a schedule; a key without a day up to a horizon has no row."""
    met = daily.join(F.broadcast(horizons.select(horizon).distinct()), F.col(date) <= F.col(horizon))
    merged = met.groupBy(*keys, horizon).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("_ids")).alias("distinct"), F.kll_merge_agg_double("_values").alias("_values"))
    known = F.kll_sketch_get_n_double("_values") > 0
    return merged.select(*keys, horizon, "n", "distinct", F.when(known, F.array(*[F.kll_sketch_get_quantile_double("_values", F.lit(r)) for r in ranks])).alias("quantiles"))


def class_thresholds(df: DataFrame, bucket: str, x: str, label: str, least: int = 100, least_class: int = 20) -> DataFrame:
    """bucket, n, threshold: the value of ``x`` that parts negatives from positives in each bucket.

    Midway between the 95th percentile of the negatives and the 5th of the positives; the median of all in
    a bucket of fewer than ``least`` rows, or of fewer than ``least_class`` of either class. Percentiles
    are exact, with linear interpolation: values are counted by (bucket, class) first, so a task holds the
    distinct values of a bucket. A null value or label counts as none; a bucket of nulls alone has a null
    threshold.
    """
    v, y = F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double")), F.col(label)
    counts = df.where(v.isNotNull() & y.isNotNull()).groupBy(F.col(bucket).alias("_b"), v.alias("_x"), (y == 1).alias("_y")).agg(F.count("*").alias("_n"))
    of = lambda which, p: F.percentile(F.when(which, F.col("_x")), F.lit(p), F.col("_n"))
    n = lambda which: F.coalesce(F.sum(F.when(which, F.col("_n"))), F.lit(0))
    pos = F.col("_y")
    found = counts.groupBy("_b").agg(F.sum("_n").alias("n"), n(pos).alias("_n1"), n(~pos).alias("_n0"), of(F.lit(True), 0.5).alias("_median"), of(~pos, 0.95).alias("_low"), of(pos, 0.05).alias("_high"))
    few = (F.col("n") < least) | (F.col("_n0") < least_class) | (F.col("_n1") < least_class)
    kept = found.select(F.col("_b"), "n", F.when(few, F.col("_median")).otherwise((F.col("_low") + F.col("_high")) / 2).alias("threshold"))
    every = df.select(F.col(bucket).alias("_k")).distinct()
    return every.join(kept, F.col("_k").eqNullSafe(F.col("_b")), "left").select(F.col("_k").alias(bucket), F.coalesce("n", F.lit(0)).alias("n"), "threshold")
