"""Choosing among candidates whose scores transfer or not, and auditing what they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stability(scores: DataFrame, by: str = "candidate", value: str = "valid") -> DataFrame:
    """candidate, n, transfer (mean over folds), stability (population deviation)."""
    return scores.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("transfer"), F.stddev_pop(value).alias("stability"))


def winners_curse(sigma: Column, n: Column) -> Column:
    """Expected excess of the best of n noisy scores: sigma * sqrt(2 ln n)."""
    return F.when((n < 2) | (sigma <= 0), 0.0).otherwise(sigma * F.sqrt(2 * F.log(n.cast("double"))))


def robust_score(transfer: Column, spread: Column, n: Column, penalty: float = 1.0, floor: float = 0.0008) -> Column:
    """transfer - penalty * spread - the curse at the spread, which is at least ``floor``."""
    return transfer - penalty * spread - winners_curse(F.greatest(spread, F.lit(floor)), n)


def selected(candidates: DataFrame, score: str, truth: str, blocked: str = "blocked") -> DataFrame:
    """chosen, score, regret: the best candidate that isn't blocked, and how much the best truth exceeds its own."""
    free = candidates.where(~F.col(blocked))
    return free.agg(F.max_by("candidate", F.struct(F.col(score), (-F.col("candidate")).alias("c"))).alias("chosen"), F.max(score).alias("score"), (F.max(truth) - F.max_by(truth, F.struct(F.col(score), (-F.col("candidate")).alias("c")))).alias("regret"))


def confirmed(valid: Column, test: Column, ceiling: Column, gap: float = 0.035, slack: float = 0.05) -> Column:
    """Whether a backtest confirms: valid exceeds test by less than ``gap`` and neither is above what is attainable; null if any is unknown."""
    return F.when(valid.isNotNull() & test.isNotNull() & ceiling.isNotNull(), (valid - test < gap) & (F.greatest(valid, test) < ceiling + slack))


def user_constancy(df: DataFrame, group: list[str], columns: list[str], least: float = 1e-6) -> DataFrame:
    """column, max_dev, finding: BLOCK for a user-level column that differs within a list."""
    by = W.partitionBy(*group)
    dev = df.select(*[F.abs(F.col(c) - F.avg(c).over(by)).alias(c) for c in columns])
    worst = dev.agg(*[F.max(c).alias(c) for c in columns])
    rows = worst.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("max_dev")) for c in columns])).alias("x")).select("x.*")
    return rows.withColumn("finding", F.when(F.col("max_dev") > least, "BLOCK").otherwise("OK"))


def horizon_audit(df: DataFrame, hz: str, limit: int) -> DataFrame:
    return df.agg(F.count_if(F.col(hz) > limit).alias("breaches")).withColumn("finding", F.when(F.col("breaches") > 0, "BLOCK").otherwise("OK"))


def staleness_parity(df: DataFrame, column: str | None, a: str = "valid", b: str = "test", most: float = 3.0) -> DataFrame:
    """delta, finding: WARN if the column is missing or its means on two splits differ by more than ``most``."""
    if column is None or column not in df.columns:
        return df.sparkSession.createDataFrame([(None, "WARN")], "delta double, finding string")
    means = df.agg(F.avg(F.when(F.col("split") == a, F.col(column))).alias("x"), F.avg(F.when(F.col("split") == b, F.col(column))).alias("y"))
    return means.select(F.abs(F.col("x") - F.col("y")).alias("delta")).withColumn("finding", F.when(F.col("delta") > most, "WARN").otherwise("OK"))


def shuffled_labels(df: DataFrame, label: str, seed: int, parts: int = 64) -> DataFrame:
    """``df`` with its labels dealt anew by a hash: rows and labels are ordered apart within parts, and matched by place."""
    part = F.pmod(F.xxhash64("row_id", F.lit(seed + 2)), F.lit(parts))
    rows = df.withColumn("_part", part)
    place = F.row_number().over(W.partitionBy("_part").orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id"))
    other = F.row_number().over(W.partitionBy("_part").orderBy(F.xxhash64("row_id", F.lit(seed + 1)), "row_id"))
    labels = rows.select("_part", F.col(label).alias("shuffled"), other.alias("_place"))
    return rows.withColumn("_place", place).join(labels, ["_part", "_place"]).drop("_part", "_place")


def shuffle_finding(primary: Column, floor: float = 0.52) -> Column:
    """BLOCK for a pipeline whose primary stays above ``floor`` though its training labels are shuffled."""
    return F.when(primary > floor, "BLOCK").otherwise("OK")


def jump_finding(delta: Column, most: float = 0.02) -> Column:
    return F.when(delta > most, "VERIFY").otherwise("OK")


def combined(findings: list[DataFrame]) -> DataFrame:
    """veto, n_block, n_warn over findings (rule, finding)."""
    out = findings[0].select("rule", "finding")
    for f in findings[1:]:
        out = out.unionByName(f.select("rule", "finding"))
    return out.agg(F.coalesce(F.bool_or(F.col("finding") == "BLOCK"), F.lit(False)).alias("veto"), F.count_if(F.col("finding") == "BLOCK").alias("n_block"), F.count_if(F.col("finding") == "WARN").alias("n_warn"))
