"""Exact Lloyd clustering of integer vectors, by bounds and balls around the current centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Components of vectors are below this after scaling, so that every squared distance of up to 64 of them is a long.
LARGEST = 1 << 27
#: Below this, sums of 64 squares are exact in 64-bit floats.
EXACT = 1 << 22
#: Bounds are widened by this share, far above what rounding adds.
SLACK = 1e-12


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to centroids, a column for each centroid."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT and x.shape[1] <= 64:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, one in enumerate(c):
        gap = x.astype(np.int64) - one
        out[:, j] = (gap * gap).sum(1)
    return out


class Exponion:
    """Nearest centroids of vectors that have bounds from the round before.

    For a vector of centroid a at a distance of u at most, the nearest and the second nearest centroid
    lie within 2 * u + (the distance from a to the next centroid) of a. So of a's list of centroids by
    distance only the beginning is scanned, its end included, so that ties are seen; of equal
    distances the smaller number wins.
    """

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        k = len(now)
        between = np.sqrt(squared(now, now).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.gaps = np.take_along_axis(between, self.order, 1)
        others = between + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.next = others.min(1) if k > 1 else np.full(k, np.inf)
        self.scanned = 0
        if before is not None:
            moved = now.astype(np.float64) - before
            self.moved = np.sqrt((moved * moved).sum(1)) * (1 + SLACK)
            rest = np.where(np.eye(k, dtype=bool), 0, self.moved)
            self.most = rest.max(1) if k > 1 else np.zeros(k)

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper and lower bound of each vector, by all centroids."""
        return self._nearest(x, np.arange(len(self.now)))

    def _nearest(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = squared(x, self.now[among])
        self.scanned += d.size
        best = d.argmin(1)
        upper = np.sqrt(d[np.arange(len(x)), best].astype(np.float64)) * (1 + SLACK)
        lower = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * (1 - SLACK) if len(among) > 1 else np.full(len(x), np.inf)
        return among[best], upper, lower

    def again(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster and bounds after the centroids moved."""
        cluster, upper, lower = cluster.copy(), (upper + self.moved[cluster]) * (1 + SLACK), (lower - self.most[cluster]) * (1 - SLACK)
        lower = np.maximum(lower, 0)
        safe = np.maximum(lower, self.next[cluster] / 2 * (1 - SLACK))
        left = np.flatnonzero(upper >= safe)
        if not len(left):
            return cluster, upper, lower
        gap = x[left].astype(np.int64) - self.now[cluster[left]]
        self.scanned += len(left)
        upper[left] = np.sqrt((gap * gap).sum(1).astype(np.float64)) * (1 + SLACK)
        left = left[upper[left] >= safe[left]]
        radius = (2 * upper[left] + self.next[cluster[left]]) * (1 + SLACK)
        at = cluster[left]
        for a in np.unique(at):
            of = at == a
            count = np.searchsorted(self.gaps[a], radius[of], "right")
            for m in np.unique(count):
                chosen = left[of][count == m]
                cluster[chosen], upper[chosen], lower[chosen] = self._nearest(x[chosen], np.sort(self.order[a, :m]))
        return cluster, upper, lower


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Stored vectors, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width)


def _start(kept: DataFrame, k: int, seed: str, width: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids; repeated ids by their components."""
    whole = F.transform("e", lambda x: F.floor(x.cast("double") * F.col("scale")).cast("long"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(hashed.alias("h"), whole.alias("v")).orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, width)


def _moved(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Each centroid's mean, rounded down; where it is until now if it has no vector. Tasks hand on their sums, of which the driver gets one for each component."""
    k, width = now.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, at = _matrix(batch.column("v"), width), batch.column("cluster").to_numpy()
            count += np.bincount(at, minlength=k)
            for a in np.unique(at):
                total[a] += x[at == a].sum(0, dtype=np.int64)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = state.select("v", "cluster").mapInArrow(sums, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = now.copy()
    for r in each.collect():
        out[r.cluster, r["at"]] = r.x // r.n
    return out


def cluster(df: DataFrame, keep: list[str], vec_id: str = "vec_id", embedding: str = "embedding", width: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1") -> DataFrame:
    """Columns ``keep``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: a row for each vector of ``width`` components.

    Components become floor(scale * x). The centroids start as the ``k`` vectors whose
    ``<seed>:<vec_id>`` has the smallest SHA-256. Each round assigns every vector to the nearest
    centroid (of equally near ones that of the smaller number) and moves each centroid to its vectors'
    mean, rounded down; at last vectors are assigned once more. All of it is exact.

    Vectors are stored with their cluster and bounds, an upper one of the distance to their centroid and
    a lower one to any other, and read once a round; the round before is deleted when the next one is
    written. Nothing is shuffled but a sum for each centroid and task. The driver holds k * width sums
    and k * k distances.

    Left out are null vectors, those of another width, with a null or non-finite component, or with one
    of LARGEST or more after scaling, whose distances no long can hold. A null id counts as empty for
    the start; repeated ids are vectors of their own. With fewer than ``k`` vectors each starts a
    centroid. An empty table gives an empty table. Columns outside ``keep`` are not returned.
    """
    if not 1 <= width <= 64:
        raise ValueError("squared distances are longs for up to 64 components")
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST / scale - 1))
    kept = df.where((F.size(embedding) == width) & F.coalesce(finite, F.lit(False)))
    named = kept.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(vec_id).alias("id"), F.col(embedding).alias("e"), F.lit(scale).alias("scale"))
    now, spark = _start(named, k, seed, width), df.sparkSession
    kinds = ", ".join(f"k{i} {named.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))) + ", " * bool(keep)
    schema = f"{kinds}v binary, cluster int, upper double, lower double"
    n_keys = len(keep)

    def rebuilt(batch: pa.RecordBatch, v: pa.Array, found: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:n_keys], v, pa.array(found[0], pa.int32()), pa.array(found[1]), pa.array(found[2])], names=[*batch.schema.names[:n_keys], "v", "cluster", "upper", "lower"])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Exponion(now)
        for batch in batches:
            if batch.num_rows:
                x = np.floor(batch.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype("<i4").reshape(-1, width)
                yield rebuilt(batch, pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()), search.all(x))

    def moved_on(now: np.ndarray, before: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Exponion(now, before)
            for batch in batches:
                if batch.num_rows:
                    bounds = [batch.column(c).to_numpy() for c in ("cluster", "upper", "lower")]
                    yield rebuilt(batch, batch.column("v"), search.again(_matrix(batch.column("v"), width), *bounds))

        return run

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.column("cluster")
                gap = _matrix(batch.column("v"), width).astype(np.int64) - now[at.to_numpy()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], at, pa.array((gap * gap).sum(1))], names=[*batch.schema.names[:n_keys], "cluster", "distance"])

    if not len(now):
        empty = ", cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], named.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]).limit(0).schema).selectExpr("*", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in empty[2:].split(", ")])
    state, path = stored(named.drop("id", "scale").mapInArrow(begun, schema))
    for _ in range(rounds):
        before, now, old = now, _moved(state, now), path
        state, path = stored(state.mapInArrow(moved_on(now, before), schema))
        forget(spark, old)
    out = state.drop("upper", "lower").mapInArrow(measured, f"{kinds}cluster int, distance long")
    sums = out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # a row for each centroid
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    of_cluster = spark.createDataFrame([(r.cluster, r.s, hashes[r.cluster]) for r in sums], "cluster int, cluster_inertia long, centroid_sha256 string")
    joined = out.join(F.broadcast(of_cluster), "cluster")
    return joined.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "cluster", "distance", "cluster_inertia", F.lit(sum(r.s for r in sums)).cast("long").alias("inertia"), "centroid_sha256")
