"""Learners over ids: factorisation machines by window, by recency and for several targets, and target attention over histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import calendar_date, count_below
from ..sources.scratch import stored
from . import models, windows
from .keys import join_on
from .nets import FactorisationMachine, TargetAttention
from .sgd import BITS, Member, Stack, bits_for, code, rows_to_learn

Schedule = list[tuple[int, int, int]]

#: Parts of a pass, of which each moves the models once.
BATCHES = 8
#: The place of items among the fields, in rows and in histories.
ITEM = 1_000
#: Bounds of the lengths of histories whose shares are compared.
HISTORY_BINS = [1, 3, 6, 10, 16, 24]
MODES = ("plain", "late_only", "recency", "hist_match")


def slots(fields: list[str], bits: int = BITS) -> Column:
    """The codes of a row's fields."""
    return F.array(*[code(i, F.col(c), bits) for i, c in enumerate(fields)])


def window_of(date: Column, schedule: Schedule) -> Column:
    """The number of the last window that holds the date; null without one."""
    out = F.lit(None).cast("int")
    for i, (lo, hi, _) in enumerate(schedule):
        out = F.when(date.between(lo, hi), i).otherwise(out)
    return out


def _dealt(rows: DataFrame, name: str, by: list[str] | None = None, key: str | None = None) -> DataFrame:
    """``rows`` stored so that every pass over them has work for all cores; dealt by the hash of a key, which saves the sort of dealing in turn."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return stored(rows.repartition(tasks, *([key] if key else [])), name, by)


def _learned(stack: Stack, rows: DataFrame, batches: int, epochs: int, **more) -> Stack:
    return stack.fit(_dealt(rows, "rows", ["batch"]), batches, epochs, **more)


def windowed_fm(df: DataFrame, schedule: Schedule, fields: list[str], targets: list[str], fit_end: int, least: int = 200, k: int = 16, epochs: int = 8, rate: float = 0.03, seed: int = 0, batches: int = BATCHES) -> DataFrame:
    """row_id and a score for each target: each window's rows by machines fitted on what is dated up to min(horizon, fit_end).

    All windows and targets are fitted side by side: a row counts for the windows that may see it. A
    window with fewer than ``least`` rows to learn from scores 0, one whose labels are all alike their
    mean. A null label counts as 0. Rows in no window are left out.
    """
    ends, date = [min(horizon, fit_end) for _, _, horizon in schedule], F.col("date")
    labels = [F.coalesce(F.col(t).cast("double"), F.lit(0.0)) for t in targets]
    seen = df.agg(*[a for i, end in enumerate(ends) for a in (F.count_if(date <= end).alias(f"n{i}"), *[F.avg(F.when(date <= end, y)).alias(f"m{i}_{j}") for j, y in enumerate(labels)])]).first()
    bits = bits_for(len(ends) * len(targets))
    rows = rows_to_learn(df, slots(fields, bits), labels, [(date <= end).cast("int") for end in ends], batches)
    stack = Stack(FactorisationMachine(k), [Member(j, i, seed) for i in range(len(ends)) for j in range(len(targets))], rate=rate, bits=bits)
    _learned(stack, rows, batches, epochs)
    asked = df.select("row_id", slots(fields, bits).alias("x"), window_of(date, schedule).alias("_w")).where("_w is not null")
    out = stack.scores(asked, ["row_id", "_w"], "_w", len(targets))
    columns = []
    for j, target in enumerate(targets):
        score = F.col("score")[j]
        for i in range(len(ends)):
            mean = seen[f"m{i}_{j}"]
            if seen[f"n{i}"] < least or mean in (0.0, 1.0):
                score = F.when(F.col("_w") == i, 0.0 if seen[f"n{i}"] < least else float(mean)).otherwise(score)
        columns.append(score.alias(target))
    return out.select("row_id", *columns)


def fitted_fm(train: DataFrame, valid: DataFrame | None, fields: list[str], label: str = "long_view", weights: list[Column] | None = None, seeds: tuple[int, ...] = (0,), losses: tuple[str, ...] = ("bce",), lists: list[str] | None = None, k: int = 16, epochs: int = 40, patience: int = 4, rate: float = 0.03, batches: int = BATCHES) -> Stack:
    """Machines for each loss, weight and seed, in this order, fitted side by side.

    With validation rows each stops after ``patience`` passes without a better primary on them and is
    that of its best one. losses: some of nets.OBJECTIVES; all but bce are over ``lists`` of rows.
    """
    weights = weights or [F.lit(1.0)]
    bits = bits_for(len(losses) * len(weights) * len(seeds))
    rows = rows_to_learn(train, slots(fields, bits), [F.coalesce(F.col(label), F.lit(0))], weights, batches, lists)
    stack = Stack(FactorisationMachine(k), [Member(0, i, s, loss) for loss in losses for i in range(len(weights)) for s in seeds], rate=rate, bits=bits)
    if valid is None:
        return _learned(stack, rows, batches, epochs)
    asked = _dealt(valid.select("row_id", "user_id", label, slots(fields, bits).alias("x")), "valid")
    return _learned(stack, rows, batches, epochs, valid=lambda s: s.primaries(asked, label), patience=patience)


def scored_by(stack: Stack, df: DataFrame, fields: list[str]) -> DataFrame:
    """row_id, score: the mean over the stack's models."""
    out = stack.scores(df.select("row_id", slots(fields, stack.bits).alias("x")), ["row_id"])
    return out.select("row_id", _mean(F.col("score")).alias("score"))


def _mean(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)


def refit_scores(df: DataFrame, fields: list[str], label: str = "long_view", seeds: tuple[int, ...] = (0, 1, 2), tau: float = 14.0, permissive: bool = True, **more) -> DataFrame:
    """row_id, strict, permissive: scores of all rows of ``df`` (with split train, valid, test), the mean over seeds.

    Machines are fitted on training rows, of the weight exp(-days to the last one / tau), and stop by the
    validation rows. strict: these score all rows. permissive: test rows are scored by machines
    refitted on training and validation rows, with as many passes as the median of the first ones' best;
    without ``permissive`` this column is null.
    """
    day = F.datediff(calendar_date(F.col("date")), F.lit("1970-01-01").cast("date"))
    last = df.where("split = 'train'").agg(F.max(day)).first()[0] or 0
    weight = F.exp(F.least(day - last, F.lit(0)) / tau)
    train, valid = df.where("split = 'train'"), df.where("split = 'valid'")
    first = fitted_fm(train, valid, fields, label, [weight], seeds, **more)
    out = scored_by(first, df, fields).withColumnRenamed("score", "strict")
    if not permissive:
        return out.withColumn("permissive", F.lit(None).cast("double"))
    passes = sorted(first.best)[len(seeds) // 2]
    again = fitted_fm(df.where("split in ('train', 'valid')"), None, fields, label, [weight], seeds, **{**more, "epochs": max(passes, 1)})
    late = scored_by(again, df.where("split = 'test'"), fields).withColumnRenamed("score", "late")
    return out.join(late, "row_id", "left").select("row_id", "strict", F.coalesce("late", "strict").alias("permissive"))


def histories(df: DataFrame, schedule: Schedule, label: str = "long_view", length: int = 32, bits: int = BITS) -> DataFrame:
    """user_id, _w, history: codes of a user's last ``length`` positives up to each window's horizon, the oldest first. Only so many rows of a user and window are gathered."""
    past = df.where(F.col(label) == 1)
    seen = F.filter(F.array(*[F.struct(F.lit(i).alias("w"), F.lit(h).alias("h")) for i, (_, _, h) in enumerate(schedule)]), lambda x: F.col("date") <= x["h"])
    rows = past.select("user_id", code(ITEM, F.col("video_id"), bits).alias("code"), "time_ms", "row_id", F.explode(seen).alias("x")).withColumn("_w", F.col("x.w"))
    return windows.tail_history(rows, ["user_id", "_w"], "code", ["time_ms", "row_id"], length)


def history_weights(rows: DataFrame, train: Column, valid: Column, length: str = "history_n") -> DataFrame:
    """``rows`` with a weight for each of MODES, 0 outside of the training rows.

    late_only: 1 with at least 10 items of history. recency: from 0.2 to 2 by the length's rank among
    training rows. hist_match: the share of the length's bin among validation rows over that among
    training rows. The tables of lengths and bins have at most as many rows as a history is long.
    """
    sizes = rows.where(train).groupBy(length).agg(F.count("*").alias("_c")).orderBy(length).collect()
    total, below, place = sum(r["_c"] for r in sizes), 0, {}
    for r in sizes:
        place[r[length]] = (below + (r["_c"] - 1) / 2) / max(total - 1, 1)
        below += r["_c"]
    binned = rows.withColumn("_bin", count_below(HISTORY_BINS, F.col(length), True))
    match = {r["_bin"]: r.weight for r in models.history_match(binned.where(train), binned.where(valid), "_bin", 0.0, 8.0).collect()}
    by_value = lambda table, key: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(0.0)) if table else F.lit(0.0)
    weights = {"plain": F.lit(1.0), "late_only": models.late_only(F.col(length)), "recency": 0.2 + 1.8 * by_value(place, F.col(length)), "hist_match": by_value(match, F.col("_bin"))}
    return binned.withColumns({m: F.when(train, w).otherwise(0.0) for m, w in weights.items()}).drop("_bin")


def attention_scores(df: DataFrame, schedule: Schedule, fields: list[str], label: str = "long_view", modes: tuple[str, ...] = ("plain",), seeds: tuple[int, ...] = (0, 1), length: int = 32, k: int = 32, hidden: int = 64, epochs: int = 6, patience: int = 2, rate: float = 0.01, batches: int = BATCHES) -> DataFrame:
    """row_id and for each mode a score, the mean over seeds: target attention over histories up to the row's window's horizon.

    Networks are fitted on the rows of split train, one for each mode of weighting (see
    history_weights()) and seed, side by side; each stops by the rows of split valid. A row in no window
    has no history, as has a user without a positive.
    """
    for m in modes:
        if m not in MODES:
            raise ValueError(f"{m} is none of {', '.join(MODES)}")
    rows = df.withColumn("_w", window_of(F.col("date"), schedule))
    bits = bits_for(4 * len(modes) * len(seeds))  # two tables of twice the machines' width
    rows = join_on(rows, histories(df, schedule, label, length, bits), ["user_id", "_w"], "left")
    past = F.coalesce("history", F.array().cast("array<int>"))
    x = F.concat(slots(fields, bits), F.array(code(ITEM, F.col("video_id"), bits)), past, F.array_repeat(F.lit(-1), length - F.size(past)))
    rows = rows.select("row_id", "user_id", "split", F.coalesce(F.col(label), F.lit(0)).alias(label), x.alias("x"), F.size(past).alias("history_n"))
    rows = _dealt(rows, "histories", key="row_id")
    weighted = history_weights(rows, F.col("split") == "train", F.col("split") == "valid").where("split = 'train'")
    learn = rows_to_learn(weighted, F.col("x"), [F.col(label)], [F.col(m) for m in modes], batches)
    stack = Stack(TargetAttention(len(fields), k, hidden), [Member(0, i, s) for i in range(len(modes)) for s in seeds], rate=rate, decay=0.0, bits=bits)
    valid = rows.where("split = 'valid'")
    _learned(stack, learn, batches, epochs, valid=lambda s: s.primaries(valid, label), patience=patience)
    n = len(seeds)
    scores = stack.scores(rows, ["row_id"]).select("row_id", *[_mean(F.slice("score", i * n + 1, n)).alias(m) for i, m in enumerate(modes)])
    return stored(scores, "scores")  # metrics read them twice
