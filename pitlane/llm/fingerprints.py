"""Document fingerprints: a threshold-scaled sketch of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, and at least the smallest
hash there is. So the sketch of two texts' shingles together is that of their sketches together
(``merged``), and what two sketches share, divided by the size of one of them, estimates how much of
that text the other contains, however unequal the two are. A sketch of the least hash alone, above the
threshold, shares nothing with a sketch of hashes below it, whatever the texts share; pairs with such a
sketch are settled on all hashes of both texts (``near``).

All of it is DataFrame expressions. The texts are shuffled once, to find each one's successor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES

SHINGLE = 5
#: One hash in SCALE is kept.
SCALE = 8
#: Rows that a bucket of neighbouring ids is to hold; buckets are at most BUCKETS, so that their heads (96 bytes each in a hash table) can be broadcast.
BUCKET_ROWS, BUCKETS, CELLS = 512, BROADCAST_BYTES // 96, 64
#: Bytes of carried columns that a task of the ordering shuffle is to read.
TASK_BYTES = 64 << 20


def _below(scale: int) -> Column:
    return F.lit(-(2**63) + 2**64 // scale)


def bounded(hashes: Column, scale: int = SCALE) -> Column:
    """The sketch of an array of hashes: sorted, distinct, below the threshold; the least one if none is; empty if there is none."""
    kept = F.filter(hashes, lambda h: h < _below(scale))
    return F.array_sort(F.array_distinct(F.when((F.size(kept) > 0) | (F.size(hashes) == 0), kept).otherwise(F.array(F.array_min(hashes)))))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of all shingles that two sketches stand for."""
    return bounded(F.concat(a, b), scale)


def hashed(df: DataFrame, text: str, out: str, k: int = SHINGLE) -> DataFrame:
    """``df`` with the shingle hashes of a text column: words are runs of other than ASCII white space, lower-cased; fewer than ``k`` are one shingle."""
    words = f"{out}__words"
    df = df.withColumn(words, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn(words, F.transform(words, lambda w: F.xxhash64(w)))
    many = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    few = F.transform(F.array(F.array_join(F.transform(words, lambda h: h.cast("string")), " ")), lambda s: F.xxhash64(s))
    return df.withColumn(out, F.when(F.size(words) >= k, many).when(F.size(words) > 0, few).otherwise(F.array().cast("array<bigint>"))).drop(words)


def sketched(df: DataFrame, text: str, out: str, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch of a text column's hashed() shingles."""
    hashes = f"{out}__hashes"
    return hashed(df, text, hashes, k).withColumn(out, bounded(F.col(hashes), scale)).drop(hashes)


def is_fallback(sketch: Column, scale: int = SCALE) -> Column:
    """Whether a sketch is the least hash alone, as none is below the threshold."""
    return (F.size(sketch) > 0) & (F.element_at(sketch, F.when(F.size(sketch) > 0, 1)) >= _below(scale))


def near(df: DataFrame, a: tuple[str, str], others: dict[str, tuple[str, str]], k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``df`` with the containment() of ``a`` and each of ``others``, given as (text, sketch); of all hashes where one sketch of the two is a fallback. Only such rows' texts are hashed again."""
    asks = {n: is_fallback(F.col(a[1]), scale) | is_fallback(F.col(sketch), scale) for n, (_, sketch) in others.items()}
    any_asks = F.greatest(*asks.values(), F.lit(False))
    texts = {"_a": F.when(any_asks, F.col(a[0])), **{f"_o_{n}": F.when(asks[n], F.col(text)) for n, (text, _) in others.items()}}
    df = df.withColumns({f"{c}_text": x for c, x in texts.items()})
    for c in texts:
        df = hashed(df, f"{c}_text", f"{c}_all", k).withColumn(f"{c}_all", F.array_distinct(f"{c}_all"))
    exact = {n: containment(F.array_sort("_a_all"), F.array_sort(f"_o_{n}_all")) for n in others}
    df = df.withColumns({n: F.when(asks[n], exact[n]).otherwise(containment(F.col(a[1]), F.col(sketch))) for n, (_, sketch) in others.items()})
    return df.drop(*[f"{c}_{x}" for c in texts for x in ("text", "all")])


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the larger one holds: 1 for equal sketches, 0 if just one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(a == b, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least).cast("double")


def as_text(sketch: Column) -> Column:
    """16 hex digits for each hash, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(df: DataFrame, key: str, carried: list[str], order: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with next_<c> for each carried column: of the row after it by ascending ``key``, of the first row after the last.

    Ties of the key are ordered by ``order``, null keys come first. Ids are cut into cells at their
    quantiles and cells into buckets of equal width, so that a bucket holds about BUCKET_ROWS rows
    wherever ids are dense; the head of the bucket after it is added to each bucket, and a window
    over the bucket does the rest. So rows are shuffled once, into tasks of about TASK_BYTES. A single
    row is its own successor. ``prepare`` adds columns to carry, to each row once, before that. Rows
    of one id are ordered by one task, which spills what it can't hold.
    """
    points = [i / CELLS for i in range(CELLS + 1)]
    stats = df.agg(F.count("*").alias("n"), F.percentile_approx(F.col(key), points, 10_000).alias("q"), sum((F.sum(F.octet_length(c)) for c in order), F.lit(0)).alias("bytes")).first()
    edges = sorted({int(x) for x in stats.q or [0]})
    lows = edges[:-1] or edges
    per = max(1, -(-min(BUCKETS, -(-stats.n // BUCKET_ROWS)) // len(lows)))
    widths = [max(1, -(-(hi - lo) // per)) for lo, hi in zip(lows, [*edges[1:], edges[-1] + 1], strict=False)]
    cell = F.greatest(F.lit(1), F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in lows]), lambda x: x <= F.col(key))))
    low, width = F.element_at(F.array(*[F.lit(x).cast("long") for x in lows]), cell), F.element_at(F.array(*[F.lit(x).cast("long") for x in widths]), cell)
    sub = F.coalesce(F.floor((F.col(key) - low).cast("double") / width.cast("double")).cast("long"), F.lit(-(2**62)))
    placed = {"_cell": cell, "_sub": sub}

    heads = df.select(key).withColumns(placed).groupBy("_cell", "_sub").agg(F.min(key).alias("head"))
    ends = heads.groupBy("_cell").agg(F.max("_sub").alias("last"))
    around = W.orderBy("_cell")  # over CELLS rows at most
    last = F.max(F.struct("_cell", "last")).over(W.partitionBy())
    before = F.coalesce(F.lag(F.struct("_cell", "last")).over(around), last)
    ends = ends.select("_cell", before.alias("before"))
    own = F.lag("_sub").over(W.partitionBy("_cell").orderBy("_sub"))
    heads = heads.withColumn("own", own).join(F.broadcast(ends), "_cell")
    heads = heads.select("head", F.when(F.col("own").isNull(), F.col("before._cell")).otherwise(F.col("_cell")).alias("_cell"), F.coalesce("own", "before.last").alias("_sub"))

    rows = df.withColumns(placed).withColumn("_ghost", F.lit(0))
    ghosts = df.join(F.broadcast(heads), df[key].eqNullSafe(heads["head"]))  # at most BUCKETS + CELLS heads
    ghosts = ghosts.groupBy("_cell", "_sub").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("x")).select("x.*", "_cell", "_sub").withColumn("_ghost", F.lit(1))
    both = rows.unionByName(ghosts)
    both = prepare(both) if prepare else both
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(stats.bytes or 0) // TASK_BYTES))
    by = W.partitionBy("_cell", "_sub").orderBy("_ghost", key, *order)
    out = both.repartition(parts, "_cell", "_sub").withColumn("_next", F.lead(F.struct(*carried)).over(by)).where("_ghost = 0")
    return out.withColumns({f"next_{c}": F.col(f"_next.{c}") for c in carried}).drop("_cell", "_sub", "_ghost", "_next")


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited, sketch, edited_sketch, next_sketch, near_edited, near_next: a row for each row of ``docs``.

    edited: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by ascending doc_id, the first after the last. A null text counts as empty, whose sketch
    is empty. Repeated rows stay; rows that share a doc_id follow each other by their text, null ids
    come first. One row alone follows itself. Only ``doc_id`` and ``text`` are read, so other
    columns' names can't clash.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, "id", ["text", "sketch"], ["text"], lambda d: sketched(d, "text", "sketch", k, scale))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    rows = sketched(rows, "edited", "edited_sketch", k, scale)
    rows = near(rows, ("text", "sketch"), {"near_edited": ("edited", "edited_sketch"), "near_next": ("next_text", "next_sketch")}, k, scale)
    return rows.select(F.col("id").alias(doc_id), "n_chars", "edited", "sketch", "edited_sketch", "next_sketch", "near_edited", "near_next")
