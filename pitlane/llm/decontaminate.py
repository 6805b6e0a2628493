"""Benchmark decontamination by a prefix-filtered join of word shingles.

A window is ``window`` consecutive words of a benchmark item (or a shorter item as a whole). Its
shingles are its runs of SHINGLE words; a window of fewer words is one shingle. To hold a window, a
document must hold all of its shingles side by side, so its rarest shingle is a necessary prefix.

Steps:
1. One pass over the texts keeps, of the documents that hold any shingle of the benchmark, which
   ones and where. Texts of the same words are one row from here on.
2. Shingles are ordered by rarity (the number of these rows that hold them); each window is filed
   under its rarest. A window with a shingle that no document holds is gone.
3. Occurrences join the windows by that prefix. Its place bounds where the window starts and ends,
   which must lie inside the text, and the shingles that stand there must be those of the window, at
   consecutive places: 64-bit hashes of five words each, all of which must agree.
4. Spans that overlap become one, by text; a second pass over the documents counts words and joins
   the spans by a digest of the text.

Documents are shuffled only if step 4's spans don't fit a broadcast. What the first pass holds are 8
bytes for each shingle of the benchmark, at most ``filter_shingles`` of them; a larger benchmark is
taken in several passes, whose occurrences add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ROW_OVERHEAD, cut
from .shingles import WORDS, chunks, mixed, shingle_hashes

SHINGLE = 5
FILTER_SHINGLES = BROADCAST_BYTES // 8
_OCCURRENCES = "d binary, n int, k int, pos array<int>, tok array<long>"


def _tokens(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, different for each k."""
    return mixed(shingle_hashes(words, k) + np.uint64(k))


def _windows(bench: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """w (the window's shingles in order), len (its words), k (words of a shingle), items (sorted ids of the items that have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lens, ws = [], [], []
            words, counts = (list(x) for x in zip(*(WORDS.words(*c) for c in chunks(b.column("t"))), strict=True)) if b.num_rows else ([], [])
            for item, own in zip(b.column("item").to_pylist(), (x for ws_, cs in zip(words, counts, strict=True) for x in np.split(ws_, np.cumsum(cs)[:-1])), strict=True):
                if not len(own):
                    continue
                size = min(window, len(own))
                tokens = _tokens(own, k := min(SHINGLE, size)).view(np.int64)
                for w in {tuple(tokens[p : p + size - k + 1].tolist()) for p in range(len(own) - size + 1)}:
                    ids.append(item)
                    lens.append(size)
                    ws.append(list(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lens, pa.int32()), pa.array(ws, pa.list_(pa.int64()))], names=["item", "len", "w"])

    items = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).cast("binary").alias("t"))
    found = items.mapInArrow(run, "item string, len int, w array<long>").groupBy("w", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.withColumn("k", F.least(F.col("len"), F.lit(SHINGLE))).withColumn("id", F.monotonically_increasing_id())


def _occurrences(texts: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """d (digest of the text), n (its words), k, pos, tok: of texts (t) with any wanted shingle of k words, where which ones begin."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = []
        for k, held in shared.value.items():
            coarse = np.zeros(1 << 20, bool)
            coarse[held >> np.uint64(44)] = True
            filters.append((k, held, coarse))
        for b in batches:
            out = [[] for _ in range(5)]
            for data, bounds in chunks(b.column("t")):
                words, counts = WORDS.words(data, bounds)
                ends = np.cumsum(counts)
                for k, held, coarse in filters:
                    tokens = _tokens(words, k)
                    at = np.flatnonzero(coarse[tokens >> np.uint64(44)])
                    at = at[held[np.minimum(np.searchsorted(held, tokens[at]), len(held) - 1)] == tokens[at]]
                    owner = np.searchsorted(ends, at, "right")
                    inside = at + k <= ends[owner]
                    at, owner = at[inside], owner[inside]
                    cuts = np.flatnonzero(np.diff(owner)) + 1
                    for own in np.split(at, cuts) if len(at) else []:
                        i = int(np.searchsorted(ends, own[0], "right"))
                        for column, x in zip(out, (xxhash.xxh3_128_digest(data[bounds[i] : bounds[i + 1]].tobytes()), int(counts[i]), k, (own - (ends[i] - counts[i])).astype(np.int32), tokens[own].view(np.int64)), strict=True):
                            column.append(x)
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["d", "n", "k", "pos", "tok"])

    return texts.select("t").mapInArrow(run, _OCCURRENCES)


def _all_occurrences(texts: DataFrame, windows: DataFrame, filter_shingles: int) -> DataFrame | None:
    """_occurrences() of all shingles of the windows, each text once; None if there are no shingles."""
    tokens = cut(windows.select("k", F.explode("w").alias("tok")).distinct())
    passes = -(-tokens.count() // filter_shingles)
    out = None
    for i in range(passes):
        mine = tokens.where(F.pmod(F.xxhash64("tok"), F.lit(passes)) == i).toArrow()  # filter_shingles rows or about as many
        k, tok = mine.column("k").to_numpy(), mine.column("tok").to_numpy().view(np.uint64)
        found = _occurrences(texts, {int(x): np.sort(tok[k == x]) for x in np.unique(k)})
        out = found if out is None else out.unionByName(found)
    if out is None:
        return None
    if passes > 1:  # a text's shingles of several passes, in order again
        pairs = out.groupBy("d", "n", "k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("pos", "tok"))))).alias("x"))
        out = pairs.select("d", "n", "k", F.col("x.pos").alias("pos"), F.col("x.tok").alias("tok"))
    return cut(out.dropDuplicates(["d", "k"]))


def _prefixes(windows: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Windows all of whose shingles occur, with the rarest one: prefix, and off, its place in the window."""
    rarity = occurrences.select(F.explode(F.array_distinct("tok")).alias("tok")).groupBy("tok").agg(F.count("*").alias("rows"))
    parts = windows.select("id", F.posexplode("w").alias("off", "tok")).join(rarity, "tok", "left")
    rarest = parts.groupBy("id").agg(F.min(F.struct("rows", "off", "tok")).alias("p"), F.count_if(F.col("rows").isNull()).alias("absent")).where("absent = 0")
    return windows.join(rarest, "id").select("w", "len", "k", "items", F.col("p.tok").alias("prefix"), F.col("p.off").alias("off"))


def _row_bytes(c: Column | str) -> Column:
    """About what an array of strings, or of pairs of ints, takes."""
    return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + 24 + F.length(x))


def _matches(occurrences: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """d, start, stop, items: of each window of the benchmark that a text holds."""
    around = max(0, window - SHINGLE)
    low = lambda i: F.greatest(i - around, F.lit(0))
    places = F.transform(F.sequence(F.lit(0), F.size("pos") - 1), lambda i: F.struct(F.get("tok", i).alias("prefix"), F.get("pos", i).alias("at"), (i - low(i)).alias("i"), F.slice("pos", low(i) + 1, F.lit(2 * around + 1)).alias("poss"), F.slice("tok", low(i) + 1, F.lit(2 * around + 1)).alias("toks")))
    index = cut(_prefixes(windows, occurrences))
    size = index.agg(F.coalesce(F.sum(8 * F.size("w") + _row_bytes("items") + 48 + ROW_OVERHEAD), F.lit(0)).alias("b")).first().b
    met = occurrences.select("d", "n", "k", F.explode(places).alias("o")).select("d", "n", "k", "o.*").join(F.broadcast(index) if size <= BROADCAST_BYTES else index, ["k", "prefix"])
    start, first, many = F.col("at") - F.col("off"), F.col("i") - F.col("off"), F.size("w")
    met = met.where((start >= 0) & (start + F.col("len") <= F.col("n")) & (first >= 0))
    met = met.where((F.get("poss", first) == start) & (F.get("poss", first + many - 1) == start + many - 1) & (F.slice("toks", first + 1, many) == F.col("w")))
    return met.select("d", start.alias("start"), (start + F.col("len")).alias("stop"), "items")


def _united(matches: DataFrame) -> DataFrame:
    """d, hits (disjoint spans of words, in order), items: of each text with a match."""
    by = W.partitionBy("d").orderBy("start")
    before = F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = matches.groupBy("d", "start").agg(F.max("stop").alias("stop"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    rows = rows.withColumn("_new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(by))
    spans = rows.groupBy("d", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return spans.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def find_windows(docs: DataFrame, bench: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, filter_shingles: int = FILTER_SHINGLES) -> DataFrame:
    """Columns ``keep``, and n_words (long), hits (array of struct start, stop over words), items (array of string, sorted).

    Words are runs of letters a-z, digits and code points from U+0080, after A-Z are lower-cased.

    A null or empty text, or one without a word, has 0 words, no hits and no items; so has every
    document if the benchmark is empty. An item without a word is no window; an item of fewer words
    than ``window`` is one window as a whole. Repeated rows of documents stay and are judged each,
    null ids too; repeated items count once by their id, a null id as the empty string. Windows of
    equal rarity are filed under their first shingle. Columns outside ``keep`` are dropped, so their
    names can't clash.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t")
    kept = text in keep and docs.schema[text].dataType.simpleString() == "string"  # then texts go to Python once
    source, at = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *([] if kept else [t])), keep.index(text) if kept else len(keep)
    windows = cut(_windows(bench, item_id, item_text, window))
    occurrences = _all_occurrences(docs.select(t), windows, filter_shingles)
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests = [], []
            for data, bounds in chunks(b.column(at).cast(pa.binary())):
                counts += WORDS.counts(data, bounds).tolist()
                digests += [xxhash.xxh3_128_digest(data[i:j].tobytes()) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(digests, pa.binary())], names=[*names, "n_words", "d"])

    kinds = "".join(f"{n} {source.schema[n].dataType.simpleString()}, " for n in names)
    rows = source.mapInArrow(run, f"{kinds}n_words long, d binary")
    hits, items = F.array().cast("array<struct<start:int,stop:int>>"), F.array().cast("array<string>")
    if occurrences is None:
        rows = rows.withColumns({"hits": hits, "items": items})
    else:
        found = cut(_united(_matches(occurrences, windows, window)))
        size = found.agg(F.coalesce(F.sum(32 * F.size("hits") + _row_bytes("items") + 64 + ROW_OVERHEAD), F.lit(0)).alias("b")).first().b
        rows = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "d", "left").withColumns({"hits": F.coalesce("hits", hits), "items": F.coalesce("items", items)})
    return rows.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "n_words", "hits", "items")


def verdicts(found: DataFrame, keep: list[str]) -> DataFrame:
    """Of find_windows(): n_words, n_hit, n_items, items and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + (x.stop - x.start).cast("long"))
    return found.select(*keep, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items").withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
