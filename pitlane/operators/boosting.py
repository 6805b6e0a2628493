"""Boosted trees with an objective of their own over rows or lists: histograms of gradients are a Spark aggregate, splits are found from them.

Before each tree, rows are scored by the one before it and their gradients stored with their bins. Each
level of the tree is then one pass over these: gradients are summed by (node, feature, bin) in the task
and then over tasks. The driver gets as many sums as a level has nodes, times features, times bins.

Short lists lie in a record each. Long ones are cut into many, and their rows ranked by a sort of all of
them; each row then meets the first ones of its list, the only ones that it makes pairs with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from . import metrics
from .nets import LISTS_AT_ONCE, padded, sigmoid
from .sgd import _flat, _parts, rows_to_learn

OBJECTIVES = ("binary", "lambdarank")
#: Fixed value: pairs count if one of them is among so many first.
TRUNCATION = 15
#: Lists of more rows lie in several records.
LONGEST = 256
#: Records of long lists that are opened at once.
RECORDS_AT_ONCE = 64


def lambdas(s: np.ndarray, y: np.ndarray, lengths: np.ndarray, truncation: int = TRUNCATION) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives by score of the pair losses of each list, a pair weighted by what swapping it now changes in nDCG.

    Lists with one label have none. Rank ties go by the row's place.
    """
    g, h, ends = np.zeros(len(s)), np.zeros(len(s)), np.cumsum(lengths)
    for at in range(0, len(lengths), LISTS_AT_ONCE):
        some = lengths[at : at + LISTS_AT_ONCE]
        rows = slice(int(ends[at] - lengths[at]), int(ends[at + len(some) - 1]))
        inside = np.arange(int(some.max(initial=0))) < some[:, None]
        ss, pos = padded(s[rows], some), (padded(y[rows], some) > 0.5) & inside
        neg = inside & ~pos
        rank = np.argsort(np.argsort(np.where(inside, -ss, np.inf), 1, kind="stable"), 1, kind="stable")
        gain, first = 1 / np.log2(rank + 2.0), rank < truncation
        n_pos = np.minimum(pos.sum(1), truncation)
        ideal = np.cumsum(1 / np.log2(np.arange(truncation) + 2.0))[np.maximum(n_pos, 1) - 1]
        weight = (pos[:, :, None] & neg[:, None, :] & (first[:, :, None] | first[:, None, :])) * np.abs(gain[:, :, None] - gain[:, None, :]) / ideal[:, None, None]
        p = sigmoid(ss[:, None, :] - ss[:, :, None])
        pull, bend = weight * p, weight * p * (1 - p)
        g[rows] = (pull.sum(1) - pull.sum(2))[inside]
        h[rows] = (bend.sum(1) + bend.sum(2))[inside]
    return g, h


@dataclass
class Tree:
    """Nodes of a level-wise tree: node i has the children 2i + 1 and 2i + 2. A feature of -1 ends the way; bins up to ``split`` go left."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row's way ends."""
        at = np.zeros(len(bins), np.int64)
        while True:
            f = self.feature[at]
            going = np.flatnonzero(f >= 0)
            if not len(going):
                return at
            now = at[going]
            at[going] = 2 * now + 1 + (bins[going, f[going]] > self.split[now])


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of edges below each value; an unknown value lies in the first bin."""
    return np.stack([np.where(np.isnan(c), 0, np.searchsorted(e, c, "left")) for c, e in zip(x.T, edges, strict=True)], 1) if x.shape[1] else np.zeros((len(x), 0), np.int64)


def first_pairs(rank: np.ndarray, s: np.ndarray, y: np.ndarray, positives: np.ndarray, first_s: np.ndarray, first_y: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of rows, and derivatives of the pairs that each row makes with the first ones of its list: what lambdas() sums, a row of them for each row.

    rank: places by score, from 0. positives: of the whole list. first_s, first_y: of the ``lengths`` first rows of each row's list.
    """
    top, pos = np.arange(first_s.shape[1]), (y > 0.5)[:, None]
    met = (top < lengths[:, None]) & ((first_y > 0.5) != pos)
    ideal = np.cumsum(1 / np.log2(np.arange(TRUNCATION) + 2.0))[np.clip(positives, 1, TRUNCATION) - 1]
    weight = met * np.abs(1 / np.log2(rank + 2.0)[:, None] - 1 / np.log2(top + 2.0)) / ideal[:, None]
    p = sigmoid(np.where(pos, first_s - s[:, None], s[:, None] - first_s))
    return np.where(pos[:, 0], -1.0, 1.0), weight * p, weight * p * (1 - p)


_GRADED = (("lengths", "<i4"), ("bins", "<u2"), ("y", "<f8"), ("s", "<f8"), ("g", "<f8"), ("h", "<f8"))
#: The same with what tells a long list's rows; null for short ones.
_STORED = (*_GRADED, ("list", "<i8"), ("places", "<i8"))
_KINDS = ", ".join(f"{c} binary" for c, _ in _STORED)


def _record(*values: np.ndarray) -> list[bytes]:
    return [v.astype(t).tobytes() for v, (_, t) in zip(values, _STORED, strict=False)]


def _records(out: list[list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] if c < len(r) else None for r in out], pa.binary()) for c in range(len(_STORED))], names=[c for c, _ in _STORED])


def _binary(values: np.ndarray) -> pa.Array:
    """A binary for each row of a matrix."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] * values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])


def _numpy(batch: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]


def _graded_parts(batch: pa.RecordBatch, columns: tuple[str, ...] = ("y", "s", "lengths")) -> Iterator[tuple[np.ndarray, ...]]:
    """bins and these columns of each record of Boosted.graded()."""
    kinds = dict(_STORED)
    for r in batch.select([*dict.fromkeys(("lengths", "bins", *columns))]).to_pylist():
        n = int(np.frombuffer(r["lengths"], kinds["lengths"]).sum())
        yield np.frombuffer(r["bins"], kinds["bins"]).reshape(n, -1).astype(np.int64), *(np.frombuffer(r[c], kinds[c]) for c in columns)


@dataclass
class Boosted:
    """Trees, and the edges of each feature's bins. ``learning_rate`` is in the trees' values."""

    features: list[str]
    objective: str = "binary"
    rounds: int = 20
    depth: int = 5
    learning_rate: float = 0.1
    min_data_in_leaf: int = 20
    lambda_l1: float = 0.0
    lambda_l2: float = 1.0
    min_gain_to_split: float = 0.0
    feature_fraction: float = 1.0
    bins: int = 32
    seed: int = 0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)
    #: Whether there are long lists.
    long: bool = False

    def x(self) -> Column:
        return F.array(*[F.col(c).cast("float") for c in self.features])

    def records(self, df: DataFrame, label: str, lists: list[str] | None) -> DataFrame:
        """Rows to learn from, in lists where the objective is over lists."""
        if self.objective not in OBJECTIVES:
            raise ValueError(f"{self.objective} is none of {', '.join(OBJECTIVES)}")
        return rows_to_learn(df, self.x(), [F.coalesce(F.col(label), F.lit(0))], [F.lit(1.0)], 1, lists if self.objective == "lambdarank" else None, longest=LONGEST, named=True)

    def start(self, df: DataFrame) -> None:
        """Edges at the quantiles of each feature, to half a hundredth of the rows."""
        probabilities = [(i + 1) / self.bins for i in range(self.bins - 1)]
        known = df.select(*[F.col(c).cast("double").alias(c) for c in self.features])
        self.edges = [np.unique(np.array(q, np.float32).astype(np.float64)) for q in known.approxQuantile(self.features, probabilities, 0.005)]
        self.trees = []

    def raw(self, bins: np.ndarray, trees: list[Tree] | None = None) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees if trees is None else trees:
            out += t.value[t.nodes(bins)]
        return out

    def graded(self, rows: DataFrame, path: str) -> DataFrame:
        """Rows of records(), scored by no tree, or what this gave before, scored by one tree more: with gradients, stored as records of many rows."""
        edges, objective, last, read = self.edges, self.objective, self.trees[-1] if self.trees else None, rows.sparkSession.read
        if not last:
            self.long = "list" in rows.columns and not rows.where("list is not null").isEmpty()

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for bins, y, s, lengths in _graded_parts(batch) if last else ((binned(x, edges), y[:, 0], np.zeros(len(x)), n) for x, y, _, n in _parts(batch, 1, 1)):
                    if last:
                        s = s + last.value[last.nodes(bins)]
                    if objective == "lambdarank":
                        g, h = lambdas(s, y, lengths)
                    else:
                        p = sigmoid(s)
                        g, h = p - y, p * (1 - p)
                    out.append(_record(lengths, bins, y, s, g, h))
                yield _records(out)

        whole = rows.where("list is null") if self.long else rows
        (whole if last else whole.select("n", "x", "y", "w")).mapInArrow(packed, _KINDS).write.mode("overwrite").parquet(f"{path}/whole")
        if not self.long:
            return read.schema(_KINDS).parquet(f"{path}/whole")
        self._graded_long(rows.where("list is not null"), path)
        return read.schema(_KINDS).parquet(f"{path}/whole", f"{path}/long")

    def _ranked(self, rows: DataFrame, path: str) -> DataFrame:
        """list, task, at, place, bins, y, s of the rows of long lists, scored and stored in the order of (list, score): at is the place among those of the list in the task."""
        edges, last = self.edges, self.trees[-1] if self.trees else None

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, RECORDS_AT_ONCE):
                    some = batch.slice(at, RECORDS_AT_ONCE)
                    if last:
                        found = [(b, y, s + last.value[last.nodes(b)], of, r) for b, y, s, of, r in _graded_parts(some, ("y", "s", "list", "places"))]
                    else:
                        of, n = _numpy(some, "list", "n")
                        x, y, r = (_flat(some.column(c)) for c in ("x", "y", "places"))
                        found = [(binned(x.reshape(len(r), -1), edges), y, np.zeros(len(r)), np.repeat(of, n), r)]
                    for b, y, s, of, r in found:
                        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(r), _binary(b.astype("<u2")), pa.array(y.astype(float)), pa.array(s)], names=["list", "place", "bins", "y", "s"])

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, held = None, 0  # the list that the last batch ended in, and its rows so far
            for batch in batches:
                of = batch.column("list").to_numpy()
                if len(of):
                    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                    at = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
                    if of[0] == before:
                        at[: starts[1] if len(starts) > 1 else len(of)] += held
                    before, held = of[-1], at[-1] + 1
                    yield batch.append_column("at", pa.array(at))

        columns = "list long, place long, bins binary, y double, s double"
        ordered = rows.mapInArrow(opened, columns).orderBy("list", F.desc("s"), "place").withColumn("task", F.spark_partition_id())
        kinds = f"{columns}, task int, at long"
        ordered.mapInArrow(placed, kinds).write.mode("overwrite").parquet(f"{path}/ranked")
        return rows.sparkSession.read.schema(kinds).parquet(f"{path}/ranked")

    def _graded_long(self, rows: DataFrame, path: str) -> None:
        """graded() of long lists. No task gets a list whole: what a list's rows must know goes to each task that ranked some of them."""
        read, rows = rows.sparkSession.read, self._ranked(rows, path)
        of_list, parts = W.partitionBy("list"), rows.groupBy("list", "task").agg(F.count("*").alias("n"), F.count_if(F.col("y") > 0.5).alias("pos"))
        earlier = F.sum("n").over(of_list.orderBy("task").rowsBetween(W.unboundedPreceding, -1))  # over the tasks alone
        parts = parts.select("list", "task", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("pos").over(of_list).alias("positives"))
        firsts = rows.where(F.col("at") < TRUNCATION).join(parts, ["list", "task"]).withColumn("rank", F.col("at") + F.col("before")).where(F.col("rank") < TRUNCATION)
        firsts = firsts.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("rank", "s", "y"))).alias("f"))  # so many of a list
        known = parts.join(firsts, "list").select("list", "task", "before", "positives", F.col("f.s").alias("first_s"), F.col("f.y").alias("first_y"))

        def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                of, rank, s, y, positives = _numpy(batch, "list", "rank", "s", "y", "positives")
                lengths = np.diff(batch.column("first_s").offsets.to_numpy())
                sign, g, h = first_pairs(rank, s, y, positives, padded(_flat(batch.column("first_s")), lengths), padded(_flat(batch.column("first_y")), lengths), lengths)
                out = [batch.column(c) for c in ("list", "rank", "place", "bins", "y", "s")]
                yield pa.RecordBatch.from_arrays([*out, pa.array(sign * g.sum(1)), pa.array(h.sum(1)), pa.array(["row"] * len(of))], names=names)
                later = rank >= TRUNCATION  # first ones meet each other as rows already
                lists, at = np.unique(of[later], return_inverse=True)
                sums = np.zeros((2, len(lists), g.shape[1]))
                np.add.at(sums[0], at, -sign[later, None] * g[later])
                np.add.at(sums[1], at, h[later])
                n = sums[0].size
                none = [pa.nulls(n, k) for k in (pa.int64(), pa.binary(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lists, g.shape[1])), pa.array(np.tile(np.arange(g.shape[1]), len(lists))), *none, pa.array(sums[0].ravel()), pa.array(sums[1].ravel()), pa.array(["first"] * n)], names=names)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), "<u2")
                    y, s, g, h, of, r = _numpy(batch, "y", "s", "g", "h", "list", "place")
                    yield _records([_record(np.array([len(y)]), bins, y, s, g, h, of, r)])

        kinds = "list long, rank long, place long, bins binary, y double, s double, g double, h double, kind string"
        names = [k.split()[0] for k in kinds.split(", ")]
        rows = rows.join(known, ["list", "task"]).withColumn("rank", F.col("at") + F.col("before"))
        rows.mapInArrow(paired, kinds).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/paired")
        found = read.schema(kinds).parquet(f"{path}/paired")
        more = found.where("kind = 'first'").groupBy("list", "rank").agg(F.sum("g").alias("_g"), F.sum("h").alias("_h"))
        rows = found.where("kind = 'row'").join(more, ["list", "rank"], "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0.0)) for c in "gh"})
        rows.select("list", "place", "bins", "y", "s", "g", "h").mapInArrow(packed, _KINDS).write.mode("overwrite").parquet(f"{path}/long")

    def sums(self, rows: DataFrame, tree: Tree) -> dict[int, np.ndarray]:
        """For each node that rows of graded() end in: g, h and n of each feature and bin."""
        width, n_features = self.bins, len(self.features)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes = len(tree.feature)
            total = np.zeros((3, n_features, nodes * width))
            for batch in batches:
                for bins, g, h in _graded_parts(batch, ("g", "h")):
                    at = tree.nodes(bins) * width
                    for f in range(n_features):
                        for i, v in enumerate((g, h, None)):
                            total[i, f] += np.bincount(at + bins[:, f], v, nodes * width)
            f, b = np.nonzero(total[2])
            columns = [b // width, f, b % width, *(total[i, f, b] for i in range(3))]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c), k) for c, k in zip(columns, kinds, strict=True)], names=["node", "feature", "bin", "g", "h", "n"])

        parts = rows.select("lengths", "bins", "g", "h").mapInArrow(partial, "node int, feature int, bin int, g double, h double, n double")
        found = parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
        node, feature, b = (found.column(c).to_numpy() for c in ("node", "feature", "bin"))
        out = {int(i): np.zeros((3, n_features, width)) for i in np.unique(node)}
        for i, total in out.items():
            of = node == i
            for j, c in enumerate(("g", "h", "n")):
                total[j, feature[of], b[of]] = found.column(c).to_numpy()[of]
        return out

    def _weight(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return -np.sign(g) * np.maximum(np.abs(g) - self.lambda_l1, 0) / (h + self.lambda_l2 + 1e-12)

    def _score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(g) - self.lambda_l1, 0) ** 2 / (h + self.lambda_l2 + 1e-12)

    def best_split(self, total: np.ndarray, allowed: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray] | None:
        """feature, bin, and (g, h, n) of either side, of the largest gain above min_gain_to_split; of equal ones the first. None without one that leaves enough rows on both sides."""
        left = total.cumsum(2)[:, :, :-1]
        whole = total.sum(2, keepdims=True)
        right = whole - left
        gain = self._score(*left[:2]) + self._score(*right[:2]) - self._score(*whole[:2])
        gain[~allowed] = -np.inf
        gain[(left[2] < self.min_data_in_leaf) | (right[2] < self.min_data_in_leaf)] = -np.inf
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[f, b] > max(self.min_gain_to_split, 1e-12):
            return None
        return int(f), int(b), left[:, f, b], right[:, f, b]

    def grow(self, rows: DataFrame, rng: np.random.Generator) -> Tree:
        n = len(self.features)
        allowed = np.isin(np.arange(n), rng.permutation(n)[: max(1, round(n * self.feature_fraction))])
        tree, open_nodes = Tree.of(self.depth), [0]
        for level in range(self.depth):
            totals = self.sums(rows, tree)
            if level == 0 and 0 in totals:
                tree.value[0] = self.learning_rate * self._weight(*totals[0][:2, 0].sum(1))
            following = []
            for node in open_nodes:
                found = self.best_split(totals[node], allowed) if node in totals else None
                if found:
                    tree.feature[node], tree.split[node] = found[:2]
                    for child, side in zip((2 * node + 1, 2 * node + 2), found[2:], strict=True):
                        tree.value[child] = self.learning_rate * self._weight(*side[:2])
                        following.append(child)
            open_nodes = following
            if not following:
                break
        return tree

    def fit(self, rows: DataFrame) -> Boosted:
        """Adds the trees one by one; ``rows`` (of records()) are read once, what graded() makes of them, in two folders in turn, once for each level of a tree."""
        rng = np.random.default_rng(self.seed)
        folders = [scratch(rows.sparkSession, "graded") for _ in range(2)]
        for i in range(self.rounds):
            rows = self.graded(rows, folders[i % 2])
            self.trees.append(self.grow(rows, rng))
        return self

    def scores(self, df: DataFrame, keep: list[str], stages: list[int] | None = None) -> DataFrame:
        """Columns ``keep`` and score: the sum of all trees, or an array of the sums of the first so many of them."""
        edges, trees, raw = self.edges, self.trees, self.raw
        source = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], self.x().alias("x"))
        ends = stages or [len(trees)]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if n:
                    bins, out, before = binned(_flat(batch.column("x")).astype(np.float64).reshape(n, -1), edges), np.zeros((n, len(ends))), 0
                    for j, end in enumerate(ends):
                        out[:, j] = (out[:, j - 1] if j else 0.0) + raw(bins, trees[before:end])
                        before = end
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(ends), pa.int32()), pa.array(out.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], listed], names=[*batch.schema.names[: len(keep)], "score"])

        kinds = ", ".join([*[f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))], "score array<double>"])
        out = source.mapInArrow(scored, kinds)
        return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score" if stages else F.col("score")[0].alias("score"))

    def shortened(self, valid: DataFrame, label: str, every: int = 5, group: str = "user_id") -> list[tuple[int, float]]:
        """Keeps as many trees as have the best primary on ``valid``, of each ``every`` and all; gives what was tried. One evaluation."""
        stages = sorted({*range(every, len(self.trees) + 1, every), len(self.trees)})
        rows = self.scores(valid, ["row_id", group, label], stages).select("row_id", group, label, F.posexplode("score").alias("stage", "score"))
        got = {r.stage: r.primary for r in metrics.evaluate(rows, label, "score", [group], by=["stage"]).collect()}
        curve = [(n, got.get(i, 0.0)) for i, n in enumerate(stages)]
        self.trees = self.trees[: max(curve, key=lambda c: (c[1], -c[0]))[0]]
        return curve
