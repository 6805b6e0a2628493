"""Language identification by words first, then ever shorter character n-grams.

A word that the model knows adds its log frequency in each language. An unseen word adds the mean log
frequency of its character n-grams of the greatest length, from ``LONGEST`` down, at which the model
knows any of them. The language of the highest sum is predicted; the score is the share of that
language when the mean log frequencies per word are turned into shares (a softmax).

What is learned: all words and n-grams of at most about ``SAMPLE_DOCS`` documents of each language,
drawn by a hash of the document id (a bounded sample of labelled rows). So the model's size depends on
the sample alone, and it can be broadcast. Texts are judged where they lie, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

SAMPLE_DOCS = 4_000
LONGEST = 5
SMOOTHING = 0.5
CACHE_ENTRIES = 300_000
UNKNOWN = "und"

_RUN = re.compile(r"[^\W\d_]+")


def runs_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and of numbers that are no digits, such as fractions."""
    return _RUN.findall((text or "").lower())


def is_word(run: str) -> bool:
    """Whether a run has a letter; others say nothing of a language."""
    return any(map(str.isalpha, run))


def held_out(doc_id: Column) -> Column:
    """Whether the remainder of crc32 of the id's text by 3 is 1; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass(frozen=True)
class Level:
    """Words, or n-grams of one length: the place of each, and there a row of log frequencies."""

    place: dict[str, int]
    logs: np.ndarray


@dataclass(frozen=True)
class Model:
    """Languages in order, and a level for words (0) and for n-grams of 1 to LONGEST characters."""

    langs: list[str]
    levels: list[Level]


def fit(docs: DataFrame, doc_id: str, text: str, lang: str, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of rows with a language and a text. Repeated rows count each; an empty table gives a model without languages."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    sample = rows.join(small(sizes, 64), "lang").where(chance * F.col("n") < sample_docs).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in runs_of(text))
        yield pa.RecordBatch.from_pylist([{"lang": lang, "item": w, "c": n} for (lang, w), n in seen.items() if is_word(w)], schema=pa.schema([("lang", pa.string()), ("item", pa.string()), ("c", pa.int64())]))

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, word, count in zip(*(b.column(c).to_pylist() for c in ("lang", "item", "c")), strict=True):
                seen[lang, 0, word] += count
                for n in range(1, LONGEST + 1):
                    for g in grams_of(word, n):
                        seen[lang, n, g] += count
            columns = list(zip(*((*k, c) for k, c in seen.items()), strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["lang", "n", "item", "c"])

    words = sample.mapInArrow(counted, "lang string, item string, c long").groupBy("lang", "item").agg(F.sum("c").alias("c"))
    kept = words.mapInArrow(shorter, "lang string, n int, item string, c long").groupBy("lang", "n", "item").agg(F.sum("c").alias("c")).toArrow()
    langs = sorted(set(kept.column("lang").unique().to_pylist()))
    return Model(langs, [_level(kept.filter(pc.equal(kept.column("n"), n)), langs) for n in range(LONGEST + 1)])


def _level(rows: pa.Table, langs: list[str]) -> Level:
    items = rows.column("item").unique()
    at, lang = (pc.index_in(rows.column(c), pa.array(v, pa.string())).to_numpy() for c, v in (("item", items), ("lang", langs)))
    table = np.zeros((len(items), len(langs)))
    np.add.at(table, (at, lang), rows.column("c").to_numpy())
    logs = np.log(table + SMOOTHING) - np.log(table.sum(axis=0) + SMOOTHING * (len(items) + 1))
    return Level({w: i for i, w in enumerate(items.to_pylist())}, logs.astype(np.float32))


class Scorer(dict):
    """run -> row of ``table``: log frequencies by language, and a 1 for a word; rows are made as runs are met."""

    def __init__(self, model: Model):
        super().__init__()
        self.langs, self.levels = model.langs, model.levels
        self.table = np.zeros((CACHE_ENTRIES + 1, len(self.langs) + 1))

    def _scored(self, word: str) -> np.ndarray:
        words = self.levels[0]
        if (row := words.place.get(word)) is not None:
            return words.logs[row]
        for n in range(LONGEST, 0, -1):
            place = self.levels[n].place
            known = [place[g] for g in grams_of(word, n) if g in place]
            if known:
                return self.levels[n].logs[known].sum(axis=0, dtype=float) / len(known)
        return np.zeros(len(self.langs))

    def __missing__(self, run: str) -> int:
        row = len(self)
        self.table[row] = [*self._scored(run), 1] if is_word(run) else 0
        self[run] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        runs = runs_of(text)
        total = np.zeros(len(self.langs) + 1)
        for i in range(0, len(runs), 100_000):
            part = runs[i : i + 100_000]
            if len(self) + len(part) > CACHE_ENTRIES:
                self.clear()
            total += self.table[list(map(self.__getitem__, part))].sum(axis=0)
        total, words = total[:-1], total[-1]
        if not words or not self.langs:
            return UNKNOWN, 0.0
        best = int(total.argmax())
        shares = np.exp((total - total[best]) / words)
        return self.langs[best], float(1 / shares.sum())


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, and lang_pred, score, for each row.

    A text that is null or without a letter gets "und" and 0; so does every text if the model has no
    language. Equal sums go to the first language by name. Repeated rows stay, each with the same
    result. An empty table gives an empty one. Columns outside ``keep`` are dropped, so their names
    can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.predict(t.as_py()) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*names, "lang_pred", "score"])

    kinds = "".join(f"{n} {source.schema[n].dataType.simpleString()}, " for n in names)
    out = source.mapInArrow(run, f"{kinds}lang_pred string, score double")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "lang_pred", "score")
