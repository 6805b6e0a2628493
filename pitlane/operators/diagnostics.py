"""Where a ranking loses: slices, inversions, digests and predictions about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def headroom(groups: DataFrame, bucket: str | Column, oracle_ndcg: str = "ceiling", k: int = 5) -> DataFrame:
    """bucket, users, ndcg_mean, auc_mean, held, ceiling, headroom by slice of per_group().

    held: the slice's share of GAUC's weight. ceiling: mean nDCG of a perfect order (1 with a positive,
    else 0). headroom: users' share times (ceiling - ndcg_mean).
    """
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    rows = groups.withColumn("bucket", b).withColumn("_best", (F.col("npos") > 0).cast("double"))
    weight = F.when(F.col("valid"), F.col("npos")).otherwise(0)
    out = rows.groupBy("bucket").agg(F.count("*").alias("users"), F.avg("ndcg").alias("ndcg_mean"), F.avg("auc").alias("auc_mean"), F.sum(weight).alias("_w"), F.avg("_best").alias(oracle_ndcg))
    whole = W.partitionBy()  # over slices, of which there are few
    return out.select("bucket", "users", "ndcg_mean", "auc_mean", (F.col("_w") / F.sum("_w").over(whole)).alias("held"), oracle_ndcg, (F.col("users") / F.sum("users").over(whole) * (F.col(oracle_ndcg) - F.col("ndcg_mean"))).alias("headroom"))


def inversions(df: DataFrame, group: list[str], label: str, score: str, attribute: str) -> DataFrame:
    """attribute, loss: pairs of a list in which a negative is above a positive (1) or tied with it (1/2), by the negative's attribute.

    A pair weighs 1 / (negatives of the list * all positives). No pair is made: each negative counts
    the positives below it and beside it in one ordered pass.
    """
    by = W.partitionBy(*group)
    below = F.coalesce(F.sum(label).over(by.orderBy(score).rangeBetween(W.unboundedPreceding, W.currentRow)), F.lit(0))
    beside = F.sum(label).over(W.partitionBy(*group, score))
    rows = df.select(*group, label, score, attribute).withColumns({"_upto": below, "_beside": beside, "_neg": F.sum(1 - F.col(label)).over(by)})
    total = df.agg(F.sum(label).alias("_total"))
    negatives = rows.where(F.col(label) == 0).crossJoin(F.broadcast(total))  # one row
    loss = (F.col("_upto") - F.col("_beside") / 2) / (F.col("_neg") * F.col("_total"))
    return negatives.groupBy(attribute).agg(F.sum(loss).alias("loss"))


def pair_counts(df: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    """group, n_pairs (positive, negative), n_inverted (the negative's score is greater). No pair is made: rows are counted by score first, and each score adds the positives below it."""
    counts = df.groupBy(*group, score).agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_n"))
    below = F.coalesce(F.sum("_p").over(W.partitionBy(*group).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = counts.withColumn("_below", below).groupBy(*group).agg((F.sum("_p") * F.sum("_n")).cast("long").alias("n_pairs"), F.sum(F.col("_n") * F.col("_below")).cast("long").alias("n_inverted"))
    return out


def pairs(df: DataFrame, group: list[str], label: str, columns: list[str]) -> DataFrame:
    """All pairs of a positive and a negative of one list, with the columns of both as p_ and n_. For short lists."""
    pos = df.where(F.col(label) == 1).select(*group, *[F.col(c).alias(f"p_{c}") for c in columns])
    neg = df.where(F.col(label) == 0).select(*group, *[F.col(c).alias(f"n_{c}") for c in columns])
    return pos.join(neg, group)


def digest(metrics: DataFrame, slices: DataFrame, losses: DataFrame, attribute: str, top: int = 4) -> DataFrame:
    """One row: gauc and ndcg rounded to 4 digits, the ``top`` slices by headroom, the ``top`` attribute values by loss."""
    worst = slices.orderBy(F.desc("headroom"), "bucket").limit(top).agg(F.collect_list(F.struct(F.round("headroom", 4).alias("headroom"), F.col("bucket").cast("string").alias("bucket"))).alias("s"))
    lost = losses.orderBy(F.desc("loss"), attribute).limit(top).agg(F.collect_list(F.struct(F.round("loss", 4).alias("loss"), F.col(attribute).cast("string").alias("value"))).alias("l"))
    one = metrics.select(F.round("gauc", 4).alias("gauc"), F.round("ndcg5", 4).alias("ndcg"))
    joined = one.crossJoin(worst).crossJoin(lost)  # one row each
    return joined.select("gauc", "ndcg", F.reverse(F.array_sort("s")).alias("slices"), F.reverse(F.array_sort("l")).alias("inversions"))


def prediction_holds(before: Column, after: Column, direction: Column, least: float = 1e-4) -> Column:
    """True or false, null where the diagnostic is unknown or the direction is none of increase and decrease; no move is false."""
    delta = after - before
    moved = F.abs(delta) >= least
    return F.when(delta.isNull(), F.lit(None).cast("boolean")).when(direction == "increase", moved & (delta > 0)).when(direction == "decrease", moved & (delta < 0))


def picked_slice(slices: DataFrame, value: str, mode: str, reported: int = 4) -> DataFrame:
    """picked: minimum, maximum or mean of a slice figure among the ``reported`` slices of most headroom."""
    f = {"min": F.min, "max": F.max}.get(mode, F.avg)
    return slices.orderBy(F.desc("headroom"), "bucket").limit(reported).agg(f(value).alias("picked"))
