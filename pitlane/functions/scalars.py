"""Column functions: buckets, rates, pseudo-calendar arithmetic, numerically safe maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_index(date: Column) -> Column:
    """Pseudo-calendar day number of a yyyymmdd integer: every year has 372 days and every month 31.

    Differences within a month are exact; the step from a 30-day month's end counts two.
    """
    d = date.cast("int")
    return F.expr("0") + F.floor(d / 10000) * 372 + F.floor((d % 10000) / 100) * 31 + d % 100


def calendar_date(date: Column) -> Column:
    """DATE of a yyyymmdd integer, for exact differences."""
    return F.to_date(date.cast("string"), "yyyyMMdd")


def count_below(edges: list[float] | Column, x: Column, inclusive: bool = False) -> Column:
    """How many edges lie below ``x`` (or at it): the bucket of a left-sided (right-sided) binary search."""
    array = edges if isinstance(edges, Column) else F.array(*[F.lit(float(e)) for e in edges])
    return F.size(F.filter(array, lambda e: (e <= x) if inclusive else (e < x)))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column, bound: float = 30.0) -> Column:
    return F.lit(1.0) / (1 + F.exp(-clip(x, -bound, bound)))


def smoothed_rate(positives: Column, labelled: Column, prior: Column | float, alpha: float = 20.0) -> Column:
    """(positives + alpha * prior) / (labelled + alpha)."""
    p = prior if isinstance(prior, Column) else F.lit(float(prior))
    return (positives + F.lit(alpha) * p) / (labelled + F.lit(alpha))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashed_unit(x: Column, seed: int) -> Column:
    """A number from 0 to 1 made of a whole number by multiplications and shifts modulo 2**31, which any SQL can repeat."""
    m = 1 << 31
    h = (F.pmod(x.cast("long"), F.lit(m)) * 1_103_515_245 + (seed * 12_345 + 1)) % m
    h = (h.bitwiseXOR(F.shiftright(h, 15)) * 1_566_083_941) % m
    return h.bitwiseXOR(F.shiftright(h, 13)) / float(m)


def hashed_unit_sql(x: str, seed: int) -> str:
    """hashed_unit() in DuckDB's SQL."""
    m = 1 << 31
    h = f"((({x}) % {m} * 1103515245 + {seed * 12_345 + 1}) % {m})"
    h = f"((xor({h}, {h} >> 15) * 1566083941) % {m})"
    return f"(xor({h}, {h} >> 13) / {m}::DOUBLE)"
