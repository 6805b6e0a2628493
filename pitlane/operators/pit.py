"""Point-in-time aggregates: what was known of a key before a moment.

``causal_prefix`` looks at strictly earlier events of the key; it is unsafe for scoring a list as a
set, for a row's list-mates' labels show. ``frozen_prefix`` looks at all rows of the key up to the row's
horizon, in two plans: a join with the few distinct horizons, and a union with a running sum for any
number of them. Both aggregate by key and day first, so a hot key is as many rows as it has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import day_index, smoothed_rate
from .keys import join_on


#: A key with more than one so many-th of a task's share of the rows is ordered in cells of time.
SHARE = 4
CELL_MS = 60_000


def _hot_keys(df: DataFrame, keys: list[str], share: int) -> DataFrame:
    """keys, _hot: of which there are at most ``share`` for each shuffle partition."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("_n") * (share * tasks) > F.col("_all")).select(*keys, F.lit(True).alias("_hot"))  # one row


def _in_cells(df: DataFrame, hot: DataFrame, keys: list[str], at: Column) -> DataFrame:
    return join_on(df, F.broadcast(hot), keys, "left").withColumn("_cell", F.when(F.col("_hot"), F.coalesce(at, F.lit(-(1 << 62))))).drop("_hot")


def in_cells(df: DataFrame, keys: list[str], at: Column, share: int = SHARE) -> DataFrame:
    """``df`` with _cell: ``at`` for rows of hot keys, whose rows of one cell are ordered together; null for others."""
    return _in_cells(df, _hot_keys(df, keys, share), keys, at)


def prefix_sums(df: DataFrame, keys: list[str], values: dict[str, Column], order: tuple[str, str] = ("time_ms", "row_id"), at: Column | None = None, share: int = SHARE, base: DataFrame | None = None) -> DataFrame:
    """``df`` with, for each name, the sum of its value over the key's strictly earlier rows, by (time, row); 0 without any.

    In two levels: a hot key's rows are ordered within cells of time, by as many tasks, and the sums of
    the cells before are added. So no task gets all rows of a key. ``at``: the cell of a row, which must
    not fall as the order rises; by default the minute. ``base``: the same rows with a shorter plan, of
    which hot keys and cells are made; for several prefixes one after the other, whose plan would double
    with each.
    """
    at = F.floor(F.col(order[0]) / CELL_MS).cast("long") if at is None else at
    base = df if base is None else base
    hot = _hot_keys(base, keys, share)
    named = {f"_v_{n}": v for n, v in values.items()}
    rows, short = (_in_cells(x.withColumns(named), hot, keys, at) for x in (df, base))
    within = W.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = short.where("_cell is not null").groupBy(*keys, "_cell").agg(*[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in values])
    offsets = cells.select(*keys, "_cell", *[F.sum(f"_c_{n}").over(before).alias(f"_o_{n}") for n in values])
    inside = rows.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(within) for n in values}).drop(*[f"_v_{n}" for n in values])
    zero = F.lit(0)
    out = join_on(inside, offsets, [*keys, "_cell"], "left").withColumns({n: F.coalesce(f"_i_{n}", zero) + F.coalesce(f"_o_{n}", zero) for n in values})
    return out.select(*df.columns, *values)


def causal_prefix(df: DataFrame, keys: list[str], label: str, labelled: Column, order: tuple[str, str] = ("time_ms", "row_id"), base: DataFrame | None = None) -> DataFrame:
    """``df`` with prior_n, prior_labelled, prior_pos over strictly earlier rows of the key, by (time, row)."""
    known = labelled.cast("long")
    return prefix_sums(df, keys, {"prior_n": F.lit(1).cast("long"), "prior_labelled": known, "prior_pos": F.when(labelled, F.col(label)).otherwise(0).cast("long")}, order, base=base)


def _daily(df: DataFrame, keys: list[str], values: dict[str, Column], date: str) -> DataFrame:
    return df.groupBy(*keys, date).agg(*[F.sum(v).alias(n) for n, v in values.items()])


def frozen_sums(df: DataFrame, keys: list[str], values: dict[str, Column], horizon: str = "hz", date: str = "date") -> DataFrame:
    """``df`` with, for each name, the sum of its value over the key's rows dated up to the row's horizon; 0 without any.

    Plan by join: daily sums meet the distinct horizons, of which a schedule has few. A null key is a
    key like any other; a row without a horizon knows nothing.
    """
    return _with_known(df, _known(df, keys, values, horizon, date), keys, values, horizon)


def _known(df: DataFrame, keys: list[str], values: dict[str, Column], horizon: str, date: str) -> DataFrame:
    horizons = F.broadcast(df.select(horizon).distinct())  # a row for each window of the schedule
    daily = _daily(df, keys, values, date)
    return daily.join(horizons, F.col(date) <= F.col(horizon)).groupBy(*keys, horizon).agg(*[F.sum(n).alias(n) for n in values])


def _with_known(df: DataFrame, known: DataFrame, keys: list[str], values: dict[str, Column], horizon: str) -> DataFrame:
    return join_on(df, known, [*keys, horizon], "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in values})


def frozen_sums_by_union(df: DataFrame, keys: list[str], values: dict[str, Column], horizon: str = "hz", date: str = "date") -> DataFrame:
    """The same, for any number of horizons: daily sums and probes (key, horizon) in one order, and a running sum. Days sort before probes."""
    daily = _daily(df, keys, values, date).select(*keys, F.col(date).alias("_d"), F.lit(0).alias("_probe"), *values)
    probes = df.select(*keys, horizon).distinct().select(*keys, F.col(horizon).alias("_d"), F.lit(1).alias("_probe"), *[F.lit(None).alias(n) for n in values])
    running = W.partitionBy(*keys).orderBy("_d", "_probe").rowsBetween(W.unboundedPreceding, 0)
    both = daily.unionByName(probes).withColumns({n: F.sum(n).over(running) for n in values}).where("_probe = 1")
    return _with_known(df, both.withColumnRenamed("_d", horizon).drop("_probe"), keys, values, horizon)


def frozen_prefix(df: DataFrame, keys: list[str], label: str = "long_view", labelled: Column | None = None, horizon: str = "hz", by_union: bool = False, out: tuple[str, str] = ("lab", "pos")) -> DataFrame:
    """``df`` with the labelled rows and positives of the key dated up to the row's horizon."""
    known = F.lit(True) if labelled is None else labelled
    values = {out[0]: known.cast("long"), out[1]: F.when(known, F.col(label)).otherwise(0).cast("long")}
    return (frozen_sums_by_union if by_union else frozen_sums)(df, keys, values, horizon)


def frozen_prefixes(df: DataFrame, families: dict[str, list[str]], label: str = "long_view", horizon: str = "hz", date: str = "date") -> DataFrame:
    """``df`` with <family>_lab and <family>_pos of each family of keys: frozen_prefix() of many, all made from ``df`` itself.

    The plan grows by one aggregate and one join for each family.
    """
    out = df
    for name, by in families.items():
        values = {f"{name}_lab": F.lit(1).cast("long"), f"{name}_pos": F.col(label).cast("long")}
        out = _with_known(out, _known(df, by, values, horizon, date), by, values, horizon)
    return out


def frozen_prefix_decayed(df: DataFrame, keys: list[str], label: str = "long_view", half_life: float = 7.0, horizon: str = "hz", date: str = "date", out: tuple[str, str] = ("dlab", "dpos")) -> DataFrame:
    """frozen_prefix with each day weighing 2 ** -(days from it to the horizon / half_life).

    Days weigh 2 ** (day / half_life) in one sum each, which the horizon's own power scales back.
    """
    base = day_index(F.lit(df.agg(F.min(date)).first()[0] or 0))
    weight = F.pow(F.lit(2.0), (day_index(F.col(date)) - base) / half_life)
    rows = frozen_sums(df, keys, {out[0]: weight, out[1]: weight * F.col(label)}, horizon, date)
    back = F.pow(F.lit(2.0), -(day_index(F.col(horizon)) - base) / half_life)
    return rows.withColumns({n: F.col(n) * back for n in out})


def hierarchical_rate(positives: Column, labelled: Column, parent_pos: Column, parent_lab: Column, prior: Column | float, alpha: float = 20.0) -> Column:
    """The key's rate shrunk to its parent's, which is shrunk to the prior."""
    return smoothed_rate(positives, labelled, smoothed_rate(parent_pos, parent_lab, prior, alpha), alpha)


#: The families of keys.
FAMILIES = {
    "item": ["video_id"],
    "author": ["author_id"],
    "user": ["user_id"],
    "user_author": ["user_id", "author_id"],
    "user_item": ["user_id", "video_id"],
    "user_tab": ["user_id", "tab"],
    "user_dur": ["user_id", "dur_bucket"],
    "item_tab": ["video_id", "tab"],
}


def family_features(df: DataFrame, families: dict[str, list[str]] | None = None, prior: float = 0.0, horizon: str = "hz", label: str = "long_view") -> DataFrame:
    """row_id, and <family>_rate and <family>_logn of each family, frozen at the row's horizon."""
    families = FAMILIES if families is None else families
    used = dict.fromkeys(["row_id", "date", horizon, label, *(k for by in families.values() for k in by)])
    rows = frozen_prefixes(df.select(*used), families, label, horizon)
    return rows.select("row_id", *rate_columns(families, prior))


def rate_columns(families, prior: float, alpha: float = 20.0) -> list[Column]:
    """<family>_rate and <family>_logn of frozen_prefixes()."""
    return [c for n in families for c in (smoothed_rate(F.col(f"{n}_pos"), F.col(f"{n}_lab"), prior, alpha).alias(f"{n}_rate"), F.log1p(F.col(f"{n}_lab")).alias(f"{n}_logn"))]


def earlier_days(df: DataFrame, keys: list[str], values: dict[str, Column], date: str = "date") -> DataFrame:
    """``df`` with sums over the key's rows of strictly earlier days."""
    day = F.datediff(F.to_date(F.col(date).cast("string"), "yyyyMMdd"), F.to_date(F.lit("1970-01-01")))
    daily = _daily(df, keys, values, date).withColumn("_day", day)
    before = W.partitionBy(*keys).orderBy("_day").rangeBetween(W.unboundedPreceding, -1)
    known = daily.select(*keys, date, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in values])
    return join_on(df, known, [*keys, date])


def preferred_value(df: DataFrame, keys: list[str], x: str, label: str = "long_view", horizon: str = "hz") -> DataFrame:
    """``df`` with pref_n, pref_mean, pref_std of ``x`` over the key's positives up to the horizon; null without one."""
    y = F.col(label)
    rows = frozen_sums(df, keys, {"pref_n": y.cast("long"), "_s1": F.col(x) * y, "_s2": F.col(x) * F.col(x) * y}, horizon)
    n = F.when(F.col("pref_n") > 0, F.col("pref_n"))
    mean = F.col("_s1") / n
    return rows.withColumns({"pref_mean": mean, "pref_std": F.when(n.isNotNull(), F.sqrt(F.greatest(F.col("_s2") / n - mean * mean, F.lit(0.0))))}).drop("_s1", "_s2")
