"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold[k] - w.x): all grades share the weights w, and the thresholds are
ordered because each is the one before it plus an exponential. x has a 1 for each distinct hash of a
word, of a word's beginning, of a run of punctuation, and of how often words repeat. The model gives
the expected grade and the tail probability P(grade >= ``keep_from``), by which documents are selected.

It is fitted on at most about ``SAMPLE_ROWS`` rated documents, drawn by a hash of their ids. Their
hashes are checkpointed once; the loss and its gradient are a Spark job that sums by partition, of
which the driver adds up ``FIT_PARTITIONS`` vectors and takes a step of L-BFGS. Texts are scored where
they lie.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small

SAMPLE_ROWS = 20_000
FIT_PARTITIONS = 8
BITS = 18
STEPS, HISTORY, DECAY = 30, 8, 1e-4
#: Lengths of the beginnings of longer words that count besides the words.
BEGINNINGS = (4, 5)
CACHE_ENTRIES = 100_000

_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")


def _hashed(feature: bytes) -> int:
    return zlib.crc32(feature) >> (32 - BITS)


class Tokens(dict):
    """token -> hashes of its features, remembered for a bounded number of tokens."""

    def __missing__(self, token: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        begun = {b"^" + token[:n].decode(errors="ignore").encode() for n in BEGINNINGS if len(token) > n}
        self[token] = h = tuple(map(_hashed, [token, *begun]))
        return h

    def of(self, text: str | None) -> list[int]:
        """Distinct hashes of the features of the text, A-Z lower-cased."""
        tokens = _TOKEN.findall((text or "").encode().lower())
        distinct = set(tokens)
        out = {h for t in distinct for h in self[t]}
        out.add(_hashed(b"#%d" % int(2 * math.log2(len(tokens) / len(distinct))) if tokens else b"#"))
        return sorted(out)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each score and each grade but the last."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def judged(self, score: np.ndarray, keep_from: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and P(grade >= keep_from)."""
        below = self.below(score)
        return (1 - below).sum(axis=1), 1 - below[:, keep_from - 1]


def _loss(model: Model, xs: list[np.ndarray], ys: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed negative log likelihood, and its gradients by the weights and by the thresholds."""
    flat = np.concatenate(xs) if xs else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    score = np.bincount(owner, model.weights[flat], minlength=len(xs))
    below = np.column_stack([np.zeros(len(xs)), model.below(score), np.ones(len(xs))])
    rows = np.arange(len(xs))
    high, low = below[rows, ys + 1], below[rows, ys]
    p = np.maximum(high - low, 1e-12)
    up, down = high * (1 - high) / p, low * (1 - low) / p
    by_threshold = np.zeros(below.shape[1])
    np.add.at(by_threshold, ys + 1, -up)
    np.add.at(by_threshold, ys, down)
    return -np.log(p).sum(), np.bincount(flat, (up - down)[owner], minlength=1 << BITS), by_threshold[1:-1]


def _thresholds(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate((gaps[:1], np.exp(gaps[1:]))))


def _direction(g: np.ndarray, moves: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """The quasi-Newton step for a gradient, from the latest moves and turns of the gradient (two-loop recursion)."""
    if not moves:
        return g / np.linalg.norm(g)
    q, shares = g.copy(), []
    for s, y in zip(reversed(moves), reversed(turns), strict=True):
        shares.append((s @ q) / (s @ y))
        q -= shares[-1] * y
    q *= (moves[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
    for s, y, share in zip(moves, turns, reversed(shares), strict=True):
        q += s * (share - (y @ q) / (s @ y))
    return q


def fit(docs: DataFrame, rated: DataFrame, grades: int, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", sample_rows: int = SAMPLE_ROWS, steps: int = STEPS) -> Model:
    """The model of ratings 0 to ``grades`` - 1 in ``rated`` (doc_id, grade).

    Rows with a null id or grade are left out, as are ratings of no document and documents without a
    rating; a document rated twice counts twice. Without any rated text the model rejects nothing:
    it expects the top grade.
    """
    named = rated.select(F.col(doc_id).alias("id"), F.col(grade).cast("int").alias("y")).where("id is not null and y is not null")
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    chosen = cut(named.where(chance * named.count() < sample_rows))
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).join(small(chosen, 32), "id").select("t", "y")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([known.of(t.as_py()) for t in b.column("t")], pa.list_(pa.int32())), b.column("y")], names=["x", "y"])

    sample = cut(source.mapInArrow(tokens, "x array<int>, y int").repartition(FIT_PARTITIONS))
    n = sample.count()
    if not n:
        return Model(np.zeros(1 << BITS), np.arange(grades - 1) - 50.0)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        weights, gaps = v[: 1 << BITS], v[1 << BITS :]
        value, by_weight, by_threshold = _summed(sample, Model(weights, _thresholds(gaps)))
        later = np.cumsum(by_threshold[::-1])[::-1]
        by_gap = np.concatenate((later[:1], later[1:] * np.exp(gaps[1:])))
        return value / n + DECAY / 2 * (weights @ weights), np.concatenate((by_weight / n + DECAY * weights, by_gap / n))

    v = np.concatenate((np.zeros(1 << BITS), [-2.0], np.zeros(grades - 2)))
    value, g = loss(v)
    moves, turns = [], []
    for _ in range(steps):
        if np.linalg.norm(g) < 1e-6:
            break
        q, reach = _direction(g, moves, turns), 1.0
        while (new := loss(v - reach * q))[0] > value - 1e-4 * reach * (q @ g) and reach > 1e-3:
            reach /= 2
        if (turn := new[1] - g) @ q < 0:
            moves, turns = [*moves, -reach * q][-HISTORY:], [*turns, turn][-HISTORY:]
        v, (value, g) = v - reach * q, new
    return Model(v[: 1 << BITS], _thresholds(v[1 << BITS :]))


def _summed(sample: DataFrame, model: Model) -> tuple[float, np.ndarray, np.ndarray]:
    shared = sample.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        value, by_weight, by_threshold = 0.0, np.zeros(1 << BITS), np.zeros(len(model.thresholds))
        for b in batches:
            x = b.column("x")
            flat, offsets = x.values.to_numpy(), x.offsets.to_numpy()
            some = _loss(model, [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)], b.column("y").to_numpy())
            value, by_weight, by_threshold = value + some[0], by_weight + some[1], by_threshold + some[2]
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([by_weight.astype(np.float32).tobytes()]), pa.array([by_threshold.tobytes()])], names=["v", "w", "t"])

    parts = sample.mapInArrow(partial, "v double, w binary, t binary").collect()
    shared.destroy()
    return sum(p.v for p in parts), sum(np.frombuffer(p.w, np.float32).astype(float) for p in parts), sum(np.frombuffer(p.t, float) for p in parts)


def judge(docs: DataFrame, model: Model, keep: list[str], text: str = "text", keep_from: int = 1) -> DataFrame:
    """Columns ``keep``, and expected_grade, tail_probability (of a grade of at least ``keep_from``), for each row.

    A null or empty text has no token, so that the thresholds alone decide. Repeated rows stay.
    Columns outside ``keep`` are dropped, so their names can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    names = [f"k{i}" for i in range(len(keep))]
    kept = text in keep and docs.schema[text].dataType.simpleString() == "string"  # then texts go to Python once
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], *([] if kept else [F.col(text).cast("string").alias("t")]))
    at = keep.index(text) if kept else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Model(*shared.value), Tokens()
        for b in batches:
            score = np.array([model.weights[known.of(t.as_py())].sum(dtype=float) for t in b.column(at)], float)
            expected, tail = model.judged(score, keep_from)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(expected), pa.array(tail)], names=[*names, "expected_grade", "tail_probability"])

    kinds = "".join(f"{n} {source.schema[n].dataType.simpleString()}, " for n in names)
    out = source.mapInArrow(run, f"{kinds}expected_grade double, tail_probability double")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "expected_grade", "tail_probability")
