"""Item-item collaborative filtering over sparse edges, never a dense item matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pit import prefix_sums


def edges(df: DataFrame, user: str = "user_id", item: str = "video_id") -> DataFrame:
    """Distinct (user, item)."""
    return df.select(F.col(user).alias("u"), F.col(item).alias("i")).distinct()


def cooccurrence(e: DataFrame, block_items: int = 1_000) -> DataFrame:
    """i, j, n for i != j: users of both.

    The items of a user of more than ``block_items`` are dealt into blocks of about as many; each pair
    of the user's blocks is a key of its own, so that one user's pairs are made by many tasks. The rows
    of a user of one block aren't copied.
    """
    heavy = e.groupBy("u").count().where(F.col("count") > block_items).select("u", F.ceil(F.col("count") / block_items).cast("int").alias("_blocks"))
    blocks = F.coalesce("_blocks", F.lit(1))
    rows = e.join(heavy, "u", "left").select("u", "i", F.pmod(F.xxhash64("i"), blocks).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    left = rows.withColumnsRenamed({"_own": "_a", "_other": "_b"})
    right = rows.withColumnsRenamed({"i": "j", "_own": "_b", "_other": "_a"})
    return left.join(right, ["u", "_a", "_b"]).where("i <> j").groupBy("i", "j").agg(F.count("*").alias("n"))


def item_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("i").agg(F.count("*").alias("users"))


def cosine(e: DataFrame) -> DataFrame:
    """i, j, sim: n / sqrt(users of i * users of j)."""
    c = item_counts(e)
    out = cooccurrence(e).join(c.withColumnRenamed("users", "_ni"), "i").join(c.select(F.col("i").alias("j"), F.col("users").alias("_nj")), "j")
    return out.select("i", "j", (F.col("n") / F.greatest(F.sqrt(F.col("_ni") * F.col("_nj")), F.lit(1e-6))).alias("sim"))


def idf_cosine(e: DataFrame) -> DataFrame:
    """i, j, sim: the cosine times sqrt(idf of j / idf of i), idf being log1p(all users / users of the item)."""
    users = e.agg(F.countDistinct("u").alias("_U"))
    c = item_counts(e).crossJoin(F.broadcast(users)).select("i", "users", F.log1p(F.col("_U") / F.greatest("users", F.lit(1))).alias("idf"))  # one row
    out = cooccurrence(e).join(c.select("i", F.col("users").alias("_ni"), F.col("idf").alias("_fi")), "i").join(c.select(F.col("i").alias("j"), F.col("users").alias("_nj"), F.col("idf").alias("_fj")), "j")
    return out.select("i", "j", (F.col("n") * F.col("_fj") / F.sqrt(F.col("_ni") * F.col("_fi")) / F.sqrt(F.col("_nj") * F.col("_fj"))).alias("sim"))


def met_in_blocks(targets: DataFrame, history: DataFrame, block_items: int = 1_000) -> DataFrame:
    """u, j, i: each target (u, j) with each item (u, i) of its user's history.

    A user of more than ``block_items`` targets or items has them dealt into blocks of about as many;
    each pair of a block of targets and one of items is a key of its own, so that one user's pairs are
    made by many tasks. Rows of other users aren't copied.
    """
    blocks = lambda df, name: df.groupBy("u").agg(F.ceil(F.count("*") / block_items).cast("int").alias(name))
    heavy = blocks(targets, "_ta").join(blocks(history, "_tb"), "u").where("_ta > 1 or _tb > 1")
    a, b = F.coalesce("_ta", F.lit(1)), F.coalesce("_tb", F.lit(1))
    left = targets.join(heavy, "u", "left").select("u", "j", F.pmod(F.xxhash64("j"), a).cast("int").alias("_a"), F.explode(F.sequence(F.lit(0), b - 1)).alias("_b"))
    right = history.join(heavy, "u", "left").select("u", "i", F.pmod(F.xxhash64("i"), b).cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), a - 1)).alias("_a"))
    return left.join(right, ["u", "_a", "_b"]).select("u", "j", "i")


def history_scores(rows: DataFrame, history: DataFrame, sims: DataFrame, user: str = "user_id", item: str = "video_id", row_id: str = "row_id", block_items: int = 1_000) -> DataFrame:
    """row_id, cf_sum, cf_mean, history_n: similarities between a row's item and its user's history (u, i); 0 without one."""
    sizes = history.groupBy("u").agg(F.count("*").alias("history_n"))
    targets = rows.select(F.col(user).alias("u"), F.col(item).alias("j")).distinct()
    scored = met_in_blocks(targets, history, block_items).join(sims, ["i", "j"]).groupBy("u", "j").agg(F.sum("sim").alias("cf_sum"))
    out = rows.select(row_id, F.col(user).alias("u"), F.col(item).alias("j")).join(scored, ["u", "j"], "left").join(sizes, "u", "left")
    total, n = F.coalesce("cf_sum", F.lit(0.0)), F.coalesce("history_n", F.lit(0))
    return out.select(row_id, total.alias("cf_sum"), F.when(n > 0, total / n).otherwise(0.0).alias("cf_mean"), n.cast("long").alias("history_n"))


def frozen_scores(df: DataFrame, schedule: list[tuple[int, int, int]], label: str = "long_view", least: int = 100, similarity=cosine) -> DataFrame:
    """history_scores() of each window's rows, from positives up to its horizon; zeros where a window has fewer than ``least``."""
    out = None
    for lo, hi, horizon in schedule:
        rows = df.where(F.col("date").between(lo, hi))
        known = edges(df.where((F.col("date") <= horizon) & (F.col(label) == 1)))
        if known.count() < least:
            part = rows.select("row_id", F.lit(0.0).alias("cf_sum"), F.lit(0.0).alias("cf_mean"), F.lit(0).cast("long").alias("history_n"))
        else:
            part = history_scores(rows, known, similarity(known))
        out = part if out is None else out.unionByName(part)
    return out


def causal_scores(df: DataFrame, sims: DataFrame, label: str = "long_view", user: str = "user_id", item: str = "video_id", block_rows: int = 2_000) -> DataFrame:
    """row_id, cf_sum, cf_hist_n: similarities to the user's positives strictly earlier in (time, row).

    The history's length is a running count in cells of time. A row meets its user's past item by item; the past and
    the rows of a user of more than ``block_rows`` are dealt into blocks of about as many, each pair
    of which is a key of its own.
    """
    rows = df.select(F.col("row_id").alias("_r"), F.col("time_ms").alias("_t"), F.col(user).alias("u"), F.col(item).alias("j"), F.col(label).alias("_y"))
    sizes = rows.groupBy("u").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    heavy = sizes.where("_blocks > 1")
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = rows.join(heavy, "u", "left").withColumn("_own", F.pmod(F.xxhash64("_r"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    past = dealt.where("_y = 1").select("u", F.col("j").alias("i"), F.col("_t").alias("_pt"), F.col("_r").alias("_pr"), F.col("_own").alias("_b"), F.col("_other").alias("_a"))
    asked = dealt.withColumnsRenamed({"_own": "_a", "_other": "_b"}).drop("_y")
    earlier: Column = (F.col("_pt") < F.col("_t")) | (F.col("_pt") == F.col("_t")) & (F.col("_pr") < F.col("_r"))
    met = asked.join(past, ["u", "_a", "_b"]).where(earlier).groupBy("_r", "i", "j").agg(F.count("*").alias("_k")).join(sims, ["i", "j"])
    sums = met.groupBy("_r").agg(F.sum(F.col("_k") * F.col("sim")).alias("cf_sum"))
    known = prefix_sums(rows, ["u"], {"cf_hist_n": F.col("_y").cast("long")}, ("_t", "_r")).select("_r", "cf_hist_n")
    return known.join(sums, "_r", "left").select(F.col("_r").alias("row_id"), F.coalesce("cf_sum", F.lit(0.0)).alias("cf_sum"), "cf_hist_n")
