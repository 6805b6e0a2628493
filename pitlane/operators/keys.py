"""Filters, labels, horizons, ids and buckets of the log."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clip, count_below
from ..sources.impressions import OUTCOMES
from ..sources.scratch import stored


def visible_label(label: Column, date: Column, horizon: int | Column) -> Column:
    """The label up to the horizon, -1 after it."""
    return F.when(date <= horizon, label).otherwise(-1).cast("int")


def horizon_breaches(df: DataFrame, horizon: int, date: str = "date") -> DataFrame:
    """n_rows, n_breaches: rows dated after the horizon."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(date) > horizon).alias("n_breaches"))


def require_within(df: DataFrame, horizon: int, date: str = "date") -> DataFrame:
    """``df``, or an error if any of its rows is dated after the horizon."""
    n = horizon_breaches(df, horizon, date).first().n_breaches
    if n:
        raise ValueError(f"{n} rows are dated after the horizon {horizon}")
    return df


class OutcomeColumnError(ValueError):
    pass


def guard_outcomes(df: DataFrame, outcomes: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """``df``, or an error if it has an outcome column."""
    found = [c for c in df.columns if c in outcomes]
    if found:
        raise OutcomeColumnError(f"outcome columns can't be features: {', '.join(found)}")
    return df


@dataclass(frozen=True)
class FieldSpec:
    """A categorical field: its name, and an expression of its values over a row."""

    name: str
    value: Column


def encoded_fields(df: DataFrame, in_train: Column, fields: list[FieldSpec]) -> tuple[DataFrame, int]:
    """encoded() of fields given as expressions: ``df`` with <name>_id of each, and the number of slots."""
    rows = df.withColumns({f.name: f.value for f in fields})
    return encoded(rows, rows.where(in_train), [f.name for f in fields])


def window_horizon(date: Column, schedule: list[tuple[int, int, int]]) -> Column:
    """The horizon of the last window of the schedule that holds the date; -1 where none does."""
    out = F.lit(-1)
    for lo, hi, horizon in schedule:
        out = F.when(date.between(lo, hi), horizon).otherwise(out)
    return out.cast("int")


def range_joined(df: DataFrame, schedule: DataFrame, date: str = "date") -> DataFrame:
    """``df`` with the horizon of the schedule row (lo, hi, horizon) whose days hold the date; -1 without one. Windows must not overlap."""
    s = F.broadcast(schedule)  # a schedule has a row for each of a few windows
    return df.join(s, df[date].between(s.lo, s.hi), "left").withColumn("horizon", F.coalesce("horizon", F.lit(-1))).drop("lo", "hi")


def join_on(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with ``other`` on keys of which null equals null."""
    named = other.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in other.columns if c not in on])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return df.join(named, same, how).drop(*[f"_on_{c}" for c in on])


def numbered(distinct: DataFrame, keys: list[str], out: str, cells: int = 64) -> DataFrame:
    """Distinct key tuples with their place in order, from 0; nulls come first.

    Edges come from a sample by hash of about 1,000 keys; keys are numbered inside a cell between two
    edges, and the sizes of the cells before it are added. So no single task sorts all keys.
    """
    every = max(1, distinct.count() // 1_000)
    sample = distinct.where(F.pmod(F.xxhash64(*keys), F.lit(every)) == 0).select(*keys).orderBy(*keys).collect()
    edges = sample[:: max(1, len(sample) // cells)]
    kinds = [distinct.schema[k].dataType for k in keys]
    bounds = F.array(*[F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, e, kinds, strict=True)]) for e in edges]) if edges else None
    cell = F.size(F.filter(bounds, lambda e: e <= F.struct(*keys))) if edges else F.lit(0)
    rows = distinct.withColumn("_cell", cell)
    placed = rows.withColumn("_place", F.row_number().over(W.partitionBy("_cell").orderBy(*keys)))
    return _after_cells(placed, rows).withColumn(out, F.col("_place").cast("long") - 1 + F.col("_before")).drop("_cell", "_place", "_before")


def _after_cells(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """``placed`` with _before: the rows of all cells before the row's own."""
    sizes = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # over the cells alone
    return placed.join(F.broadcast(before), "_cell")


def factorised(df: DataFrame, keys: list[str], out: str = "key_id") -> DataFrame:
    """``df`` with dense ids, from 0, of the distinct key tuples in their order; a null is a value, the first one."""
    return join_on(df, numbered(df.select(*keys).distinct(), keys, out), keys)


#: A vocabulary of more values joins by a shuffle.
BROADCAST_VALUES = 200_000


def vocabularies(train: DataFrame, columns: list[str]) -> DataFrame:
    """place, value, code: the sorted distinct values of the training rows but null, of each column and numbered from 0 over all of them in the columns' order."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)]))
    values = train.select(pairs.alias("x")).select("x.*").where("value is not null").distinct()
    return numbered(stored(values, "values"), ["place", "value"], "code")


def encoded(df: DataFrame, train: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """``df`` with <column>_id: codes fitted on ``train``, each column after the ones before it, its last slot for unseen values; and the number of slots.

    The values of all columns are gathered in one pass and numbered together.
    """
    codes = stored(vocabularies(train, columns), "codes")
    sizes = {r.place: r["count"] for r in codes.groupBy("place").count().collect()}  # a row a column
    offset = 0
    for i, c in enumerate(columns):
        size = sizes.get(i, 0)
        named = codes.where(F.col("place") == i).select(F.col("value").alias(f"_{c}"), (F.col("code") + i).alias(f"{c}_id"))  # an unseen slot for each column before
        named = F.broadcast(named) if size <= BROADCAST_VALUES else named
        df = df.join(named, df[c].cast("string") == named[f"_{c}"], "left").drop(f"_{c}").withColumn(f"{c}_id", F.coalesce(f"{c}_id", F.lit(offset + size)))
        offset += size + 1
    return df, offset


def quantile_edges(train: DataFrame, column: str, n: int) -> list[float]:
    """The n - 1 inner quantiles, exact, with linear interpolation; nulls and NaN don't count, and without any value there are none.

    Values are counted first and numbered by cells, so neither one task nor one hash map gets them all.
    """
    x = F.col(column).cast("double")
    counts = train.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x)).groupBy("x").agg(F.count("*").alias("n"))
    placed = _cells_of(counts, "x", 64)
    upto = F.sum("n").over(W.partitionBy("_cell").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    sizes = placed.select("_cell", "n").groupBy("_cell").agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # over the cells alone
    total = sizes.agg(F.sum("_n")).first()[0]
    if not total:
        return []
    places = [(total - 1) * i / n for i in range(1, n)]
    wanted = F.array(*[F.lit(p).cast("long") for p in sorted({q for h in places for q in (math.floor(h), math.ceil(h))})])
    known = placed.withColumn("_upto", upto).join(F.broadcast(sizes.drop("_n")), "_cell").withColumn("_upto", F.col("_upto") + F.col("_before"))
    held = known.select("x", F.filter(wanted, lambda w: (w < F.col("_upto")) & (w >= F.col("_upto") - F.col("n"))).alias("w")).where(F.size("w") > 0)
    at = {w: r.x for r in held.collect() for w in r.w}  # two values for each of n - 1 places at most
    return [at[math.floor(h)] + (h - math.floor(h)) * (at[math.ceil(h)] - at[math.floor(h)]) for h in places]


def bucketed(df: DataFrame, column: str, edges: list[float], out: str, inclusive: bool = False) -> DataFrame:
    return df.withColumn(out, count_below(edges, F.col(column), inclusive))


def global_rank(df: DataFrame, key: str, tie: str, out: str = "rank", cells: int = 64) -> DataFrame:
    """``df`` with the place of each row, from 0, by (key, tie).

    The key's range is cut at approximate quantiles; rows are ranked inside a cell, and the sizes of the
    cells before it are added. So no single task sorts all rows. Null keys come first.
    """
    rows = _cells_of(df, key, cells)
    placed = rows.withColumn("_place", F.row_number().over(W.partitionBy("_cell").orderBy(key, tie)))
    return _after_cells(placed, rows).withColumn(out, F.col("_place") - 1 + F.col("_before")).drop("_cell", "_place", "_before")


def _cells_of(df: DataFrame, key: str, cells: int) -> DataFrame:
    """``df`` with _cell: between which approximate quantiles of a numeric key the row lies; -1 for null."""
    edges = sorted(set(df.agg(F.percentile_approx(F.col(key).cast("double"), [i / cells for i in range(1, cells)], 10_000).alias("q")).first().q or []))
    return df.withColumn("_cell", F.when(F.col(key).isNull(), -1).otherwise(count_below(edges, F.col(key).cast("double"), True) if edges else F.lit(0)))


def rank_deciles(df: DataFrame, key: str, tie: str, out: str = "decile", n: int = 10) -> DataFrame:
    """``df`` with min(floor(rank * n / rows), n - 1), ties by position."""
    total = df.count()
    return global_rank(df, key, tie, "_rank").withColumn(out, clip(F.floor(F.col("_rank") * n / F.lit(max(total, 1))), 0, n - 1).cast("int")).drop("_rank")


def matrix_violations(df: DataFrame, columns: list[str], expected_rows: int) -> DataFrame:
    """rule, n: rows missing or too many, and values of the matrix that are null, NaN or infinite."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns]
    one = df.agg((F.count("*") - expected_rows).alias("rows"), *bad)
    return one.select(F.explode(F.array(*[F.struct(F.lit(f"finite:{c}" if c != "rows" else c).alias("rule"), F.col(c).cast("long").alias("n")) for c in ("rows", *columns)])).alias("x")).select("x.rule", "x.n")
