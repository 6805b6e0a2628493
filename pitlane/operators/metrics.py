"""Ranking metrics by group, with exact treatment of ties.

AUC counts positives above negatives, ties half, from counts by (group, score), so rows of one score
are pre-aggregated before anything is ordered. nDCG ranks ties by the row's place; only the first k rows of a
group are wanted, and Spark limits groups before it shuffles them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _dcg(gains: int) -> float:
    import math

    return sum(1 / math.log2(i + 2) for i in range(gains))


def per_group(df: DataFrame, group: list[str], label: str, score: str, tie: str = "row_id", k: int = 5) -> DataFrame:
    """group, size, npos, auc (null unless both labels occur), ndcg (0 without a positive), valid."""
    g = [F.col(c) for c in group]
    counts = df.groupBy(*g, F.col(score).alias("_s")).agg(F.sum(label).cast("long").alias("_p"), F.sum(1 - F.col(label)).cast("long").alias("_n"))
    below = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = counts.withColumn("_u", F.col("_p") * (below + F.col("_n") / F.lit(2.0)))
    auc = won.groupBy(*group).agg(F.sum(F.col("_p") + F.col("_n")).alias("size"), F.sum("_p").alias("npos"), F.sum("_u").alias("_u"))
    auc = auc.withColumn("valid", (F.col("npos") > 0) & (F.col("npos") < F.col("size")))
    auc = auc.withColumn("auc", F.when(F.col("valid"), F.col("_u") / (F.col("npos") * (F.col("size") - F.col("npos")))))
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(score), tie))
    gains = df.select(*group, label, score, tie).withColumn("_i", place).where(F.col("_i") <= k).groupBy(*group).agg(F.sum(F.when(F.col(label) == 1, 1 / F.log2(F.col("_i") + 1)).otherwise(0.0)).alias("_dcg"))
    ideal = F.element_at(F.array(*[F.lit(_dcg(i)) for i in range(1, k + 1)]), F.least(F.greatest(F.col("npos"), F.lit(1)), F.lit(k)).cast("int"))
    out = auc.join(gains, group)
    return out.withColumn("ndcg", F.when(F.col("npos") > 0, F.col("_dcg") / ideal).otherwise(0.0)).select(*group, "size", "npos", "auc", "ndcg", "valid")


def summary(groups: DataFrame, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """gauc, ndcg<k>, primary, users, rows of per_group(): AUC by positives over valid groups (0.5 without any), nDCG over all (0 without any)."""
    weight = F.sum(F.when(F.col("valid"), F.col("npos")))
    gauc = F.coalesce(F.sum(F.when(F.col("valid"), F.col("npos") * F.col("auc"))) / weight, F.lit(0.5))
    ndcg = F.coalesce(F.avg("ndcg"), F.lit(0.0))
    aggs = [gauc.alias("gauc"), ndcg.alias(f"ndcg{k}"), ((gauc + ndcg) / 2).alias("primary"), F.count("*").alias("users"), F.coalesce(F.sum("size"), F.lit(0)).alias("rows")]
    return groups.groupBy(*by).agg(*aggs) if by else groups.agg(*aggs)


def evaluate(df: DataFrame, label: str, score: str, group: list[str] | None = None, tie: str = "row_id", k: int = 5, by: list[str] | None = None) -> DataFrame:
    """summary(per_group()) of the scored rows, apart for each value of ``by``."""
    return summary(per_group(df, [*(by or []), *(group or ["user_id"])], label, score, tie, k), k, by)


def composition(groups: DataFrame) -> DataFrame:
    """Shares of groups without a positive, of positives alone, and with both."""
    n = F.count("*")
    return groups.agg(n.alias("groups"), (F.count_if(F.col("npos") == 0) / n).alias("all_neg"), (F.count_if(F.col("npos") == F.col("size")) / n).alias("all_pos"), (F.count_if("valid") / n).alias("discriminative"))
