"""Ranks and statistics within groups. Ties are always broken, or shared, on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hashed_unit


def stable_rank(group: list[str], score: str, tie: str, descending: bool = True) -> Column:
    """Place in the group from 1, ties by the row's place."""
    by = F.desc(score) if descending else F.asc(score)
    return F.row_number().over(W.partitionBy(*group).orderBy(by, tie)).cast("long")


def average_rank(group: list[str], score: str) -> Column:
    """Ascending rank, tied rows sharing the mean of their places."""
    first = F.rank().over(W.partitionBy(*group).orderBy(score))
    return first + (F.count("*").over(W.partitionBy(*group, score)) - 1) / F.lit(2.0)


def _size(group: list[str]) -> Column:
    return F.count("*").over(W.partitionBy(*group))


def percentile_rank(group: list[str], score: str, tie: str, form: str = "A") -> Column:
    """A: 1 - place/(n - 1) from the best, alone 1. B: (place + 1)/(n + 1) from the worst. C: place/(n - 1), alone 0.5. D: (place + 0.5)/n."""
    n = _size(group)
    if form == "A":
        return 1 - (stable_rank(group, score, tie) - 1) / F.greatest(n - 1, F.lit(1))
    place = stable_rank(group, score, tie, descending=False) - 1
    if form == "B":
        return (place + 1) / (n + 1)
    if form == "C":
        return F.when(n == 1, 0.5).otherwise(place / (n - 1))
    return (place + 0.5) / n


def deviation(group: list[str], x: str) -> Column:
    return F.col(x) - F.avg(x).over(W.partitionBy(*group))


def zscore(group: list[str], x: str, epsilon: float | None = 1e-6) -> Column:
    """Against the population deviation plus epsilon; without epsilon 0 where the deviation is at most 1e-8."""
    w = W.partitionBy(*group)
    std = F.stddev_pop(x).over(w)
    centred = F.col(x) - F.avg(x).over(w)
    return centred / (std + epsilon) if epsilon is not None else F.when(std <= 1e-8, 0.0).otherwise(centred / std)


def gap_to_max(group: list[str], x: str) -> Column:
    """Against the group's maximum, or 0 if that is below 0."""
    return F.col(x) - F.greatest(F.lit(0.0), F.max(x).over(W.partitionBy(*group)))


def consensus(ranks: list[str]) -> dict[str, Column]:
    """Mean, population deviation and spread of a row's ranks."""
    a = F.array(*ranks)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / len(ranks)
    variance = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / len(ranks)
    return {"rank_mean": mean, "rank_std": F.sqrt(variance), "rank_spread": F.array_max(a) - F.array_min(a)}


def tail_history(df: DataFrame, group: list[str], item: str, order: list[str], n: int, out: str = "history") -> DataFrame:
    """For each group its last ``n`` items in order. Only ``n`` rows of a group reach the gather."""
    latest = F.row_number().over(W.partitionBy(*group).orderBy(*[F.desc(c) for c in order]))
    kept = df.withColumn("_n", latest).where(F.col("_n") <= n)
    return kept.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), F.col(item).alias("i")))), lambda s: s.i).alias(out))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def bucket_quantile_target(bucket: str, x: str, tie: str) -> Column:
    """Ascending place / (n - 1) within the bucket, 0 for a bucket of one."""
    w = W.partitionBy(bucket)
    n = F.count("*").over(w)
    return F.when(n < 2, 0.0).otherwise((F.row_number().over(w.orderBy(x, tie)) - 1) / (n - 1))


def random_sample(df: DataFrame, group: list[str], n: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """At most ``n`` rows of each group, drawn by a hash of their id: the same rows at every run."""
    return top_k(df, group, [hashed_unit(F.col(row_id), seed), F.col(row_id)], n)


def history_rank_weight(rank: Column, total: Column | int) -> Column:
    """0.2 + 1.8 * rank / (n - 1), the rank being that of the history's length among all rows."""
    n = total if isinstance(total, Column) else F.lit(total)
    return 0.2 + 1.8 * rank / F.greatest(n - 1, F.lit(1))
