"""Analytics of a run: a ledger of iterations with their validation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def stall_state(ledger: DataFrame, baseline: float, epsilon: float = 0.002) -> DataFrame:
    """``ledger`` (run, iteration, valid) with best (before the row), improved, and stall: scored rows without improvement since the last one.

    A null or NaN score is a crash, which neither counts nor resets.
    """
    in_run = W.partitionBy("run").orderBy("iteration")
    v = F.when(F.isnan("valid"), None).otherwise(F.col("valid"))
    rows = ledger.withColumn("_v", v)
    best = F.greatest(F.lit(baseline), F.max("_v").over(in_run.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("best", best).withColumn("improved", F.coalesce(F.col("_v") > F.col("best") + epsilon, F.lit(False)))
    since = rows.withColumn("_era", F.sum(F.col("improved").cast("int")).over(in_run))
    counted = (F.col("_v").isNotNull() & ~F.col("improved")).cast("int")
    return since.withColumn("stall", F.sum(counted).over(W.partitionBy("run", "_era").orderBy("iteration")).cast("long")).drop("_v", "_era")


def convergence(stall: Column, iteration: Column, seconds: Column, patience: int = 3, iterations: int = 10, wall: float = 3600.0) -> Column:
    """Why a run ends, the first reason that holds: stall, iterations, wall_clock; null while it goes on."""
    return F.when(stall >= patience, "stall").when(iteration >= iterations, "iterations").when(seconds >= wall, "wall_clock")


def run_summary(ledger: DataFrame) -> DataFrame:
    """run, n, n_scored, best_valid, best_iteration (the earliest of the best), seconds."""
    ok = F.col("valid").isNotNull() & ~F.isnan("valid")
    return ledger.groupBy("run").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_scored"), F.max(F.when(ok, F.col("valid"))).alias("best_valid"), F.max_by("iteration", F.when(ok, F.struct("valid", (-F.col("iteration")).alias("i")))).alias("best_iteration"), F.sum("seconds").alias("seconds"))


def mode(iteration: Column, budget: int, share: float = 0.6) -> Column:
    """explore in the first ``share`` of the budget, consolidate after it."""
    return F.when(iteration < budget * share, "explore").otherwise("consolidate")


def accepted(delta: Column, confirmed: Column, plausible: Column) -> Column:
    """A gain that a backtest confirms; one that it can't judge, if it is plausible."""
    return F.coalesce(delta > 0, F.lit(False)) & F.coalesce(confirmed, plausible)


def track_record(ledger: DataFrame, baseline: float) -> DataFrame:
    """family, n, n_scored, hits, hit_rate, gain, best, mean_gain; crashes have no gain."""
    gain = F.when(F.isnan("valid"), None).otherwise(F.col("valid") - baseline)
    return ledger.withColumn("_g", gain).groupBy("family").agg(F.count("*").alias("n"), F.count("_g").alias("n_scored"), F.count_if("hit").alias("hits"), (F.count_if("hit") / F.count("*")).alias("hit_rate"), F.sum("_g").alias("gain"), F.max("_g").alias("best"), F.avg("_g").alias("mean_gain"))
