"""How the sources of a language differ in their use of terms, by wide vectors of term counts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small, stored

#: Terms are runs of letters: A-Z count as a-z, and all of ASCII but letters separates.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LETTERS = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Bytes of text that are counted at once, unless one text is longer; terms or counts that a task holds; rows of a batch that it hands on.
CHUNK_BYTES, MOST_HELD, OUT_ROWS = 4 << 20, 1_000_000, 100_000
#: Shares are counted in parts of this.
PARTS = 1_000_000_000
#: Bytes of one source in the vectors of a language, for the size of a broadcast.
SOURCE_BYTES = 64


class _Counts:
    """Counts of terms by language and source, of some documents."""

    def __init__(self):
        self.codes: dict[bytes, int] = defaultdict(count().__next__)
        self.groups: dict[tuple[str, str], int] = defaultdict(count().__next__)
        self.held = np.zeros((3, 0), np.int64)

    def add(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        words = [t.translate(LETTERS).split() for t in texts]
        lengths = list(map(len, words))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(words)), np.int64, sum(lengths))
        group = np.fromiter(map(self.groups.__getitem__, zip(langs, sources, strict=True)), np.int64, len(texts))
        of_doc, n = np.unique(np.repeat(np.arange(len(texts)) << 32, lengths) | codes, return_counts=True)
        keys = group[of_doc >> 32] << 32 | (of_doc & 0xFFFFFFFF)
        self.held = self._summed(np.concatenate([self.held, np.stack([keys, n, np.ones_like(n)])], 1))

    @staticmethod
    def _summed(rows: np.ndarray) -> np.ndarray:
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        starts = np.flatnonzero(np.diff(rows[0], prepend=-1))
        return np.concatenate([rows[:1, starts], np.add.reduceat(rows[1:], starts, 1)]) if len(starts) else rows

    def batches(self) -> Iterator[pa.RecordBatch]:
        terms = pa.array(list(self.codes), pa.binary()).cast(pa.string())
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        for at in range(0, self.held.shape[1], OUT_ROWS):
            keys, n, docs = self.held[:, at : at + OUT_ROWS]
            group, code = pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(code), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_BYTES, "right")))
            counts.add(*[c.slice(start, stop - start).to_pylist() for c in batch.columns])
            start = stop
            if max(len(counts.codes), counts.held.shape[1]) > MOST_HELD:
                yield from counts.batches()
                counts = _Counts()
    yield from counts.batches()


def term_counts(texts: DataFrame) -> DataFrame:
    """lang, term, entries (source, n), docs: of each term of a language its count in each source that has it, and how many documents have it.

    ``texts`` has lang, source, text without nulls. A task sums its counts before the one shuffle, so a
    hot source or term is a row of each task.
    """
    held = texts.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    by_source = held.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("entries"), F.sum("docs").alias("docs"))


def wide_vectors(texts: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, sources, totals, n_terms; lang, term, counts): the sources of each language and the vectors of its kept terms.

    counts and totals (sums of counts over the kept terms) stand in the order of sources. A language
    without a kept term has totals of 0.
    """
    sources = cut(texts.groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("sources")))
    most = sources.agg(F.max(F.size("sources"))).first()[0] or 0
    kept = term_counts(texts).where(F.col("docs") >= least_docs)
    dense = F.transform("sources", lambda s: F.coalesce(F.element_at(F.map_from_entries("entries"), s), F.lit(0).cast("long")))
    vectors, _ = stored(kept.join(small(sources, most * SOURCE_BYTES), "lang").select("lang", "term", dense.alias("counts")))
    sums = vectors.select("lang", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"), F.count("*").alias("n_terms"))
    totals = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("totals"), F.max("n_terms").alias("n_terms"))
    zeros = F.transform("sources", lambda _: F.lit(0).cast("long"))
    frame = sources.join(totals, "lang", "left").select("lang", "sources", F.coalesce("totals", zeros).alias("totals"), F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"))
    return cut(frame), vectors


def _share(count: str, total: str, prior: int) -> str:
    """SQL of 1 + floor(PARTS * (count + prior) / (total + prior * n_terms)) as a long; the product needs more than 64 bits."""
    return f"1L + CAST(({PARTS}BD * CAST({count} + {prior}L AS DECIMAL(19,0))) DIV CAST({total} + {prior}L * n_terms AS DECIMAL(19,0)) AS BIGINT)"


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, prior: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms it stands out.

    A language keeps the terms that at least ``least_docs`` of its documents have. A source's share
    of a term is 1 + floor(PARTS * (count + prior) / (N + prior * V)), N being its count of kept terms
    and V their number. Part ``pair`` has a row for each other source of the language: the sum of the
    absolute differences of their shares. Part ``term`` has the ``top`` terms that the source has more
    of than the whole language, by the difference of their shares.

    Each kept term is one row with an array of counts in the order of the language's sources. JVM
    functions turn it into the differences of all pairs of sources, which are summed where they
    arise, so no term, source or language gathers in one task.

    A null text, language or source counts as the empty string. A source without terms has a row for
    each other source, of the value that its zero counts give (0 without kept terms); one alone in its
    language has none. Repeated rows count each. Ties are ranked by the bytes of the item. An empty
    table gives an empty table. Other columns are not read.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    frame, vectors = wide_vectors(texts, least_docs)
    most = frame.agg(F.max(F.size("sources"))).first()[0] or 0
    held = vectors.join(small(frame, 2 * most * SOURCE_BYTES), "lang").withColumns({
        "p": F.expr(f"transform(counts, (c, i) -> {_share('c', 'totals[i]', prior)})"),
        "n": F.expr("aggregate(counts, 0L, (s, c) -> s + c)"), "total": F.expr("aggregate(totals, 0L, (s, c) -> s + c)"),
    })

    differences = "flatten(transform(sequence(0, size(p) - 2), i -> transform(sequence(i + 1, size(p) - 1), j -> struct(i AS i, j AS j, abs(p[i] - p[j]) AS f))))"
    sums = held.where("size(p) > 1").select("lang", F.inline(F.expr(differences))).groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))
    ones = frame.select("lang", "sources", F.posexplode("sources").alias("a", "source"))
    twos = ones.select("lang", "a", "source", F.posexplode("sources").alias("b", "item")).where("a <> b").withColumns({"i": F.least("a", "b"), "j": F.greatest("a", "b")})
    pairs = twos.join(sums, ["lang", "i", "j"], "left").select("lang", "source", "item", F.coalesce("f", F.lit(0).cast("long")).alias("value"))

    terms = held.select("lang", "sources", "term", "counts", F.expr(_share("n", "total", prior)).alias("q"), F.posexplode("p").alias("at", "share"))
    terms = terms.where("counts[at] > 0 AND share > q").select("lang", F.expr("sources[at]").alias("source"), F.col("term").alias("item"), (F.col("share") - F.col("q")).alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for df, part in ((pairs, "pair"), (terms, "term"))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
