"""MinHash near-duplicate detection with tensored banding.

Each document's distinct word shingles give ``COLLECTIONS`` small collections of ``ROWS`` minhashes.
A table key joins the collections i and j of one document, so all 120 pairs of 16 collections serve
as tables of eight minhashes each, though just 64 minhashes were computed (about a square root of
those of 120 independent tables). Two documents of similarity 0.85 agree on a table unless they agree
on at most one collection, which happens to 1.4 in 10,000 such pairs (of 0.80: to 26 in 10,000).

Steps:
1. One pass over the texts gives every document's set size, a 128-bit digest of the set (the node:
   documents of equal sets are one node from here on) and the collections.
2. Collections that no other node shares can't be half of a shared key. Of the rest every pair of a
   node's collections makes a table key.
3. Along the keys: each key's least node is its centre, which meets the key's other nodes. Exact
   intersections of whole sets confirm links, and what they connect becomes one group.
4. Keys whose nodes are of one group are done. In each other key, the nodes outside its largest group
   meet all of the key's nodes. Keys of the same nodes are one. So no pair that shares a key and isn't
   connected yet is left out.
5. Components of all links are the classes.

Whoever meets is dealt in tasks of at most about ``BLOCK`` sets held in memory, past which up to
``STREAM`` others stream; a task returns a spanning forest of its links. A key of n nodes costs n rows
of sets in step 3, and n for each ``BLOCK`` nodes outside its largest group in step 4.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, small
from .components import components
from .shingles import mixed, sets_of

COLLECTIONS, ROWS = 16, 4
BLOCK, STREAM = 256, 512
#: Distinct shingles that are minhashed at once.
MINHASH_CHUNK = 4096

_rng = np.random.default_rng(85)
_A = _rng.integers(1, 2**63, COLLECTIONS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, COLLECTIONS * ROWS, dtype=np.uint64)
_SALT = _rng.integers(1, 2**63, COLLECTIONS, dtype=np.uint64)


def collections_of(s: np.ndarray) -> np.ndarray:
    """One 64-bit number for each collection of minhashes of the set."""
    least = np.full(COLLECTIONS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), MINHASH_CHUNK):
        np.minimum(least, (_A[:, None] * s[None, i : i + MINHASH_CHUNK] + _B[:, None]).min(axis=1), out=least)
    out = _SALT.copy()
    for column in mixed(least).reshape(COLLECTIONS, ROWS).T:
        out = mixed(out * np.uint64(31) + column)
    return out


def _signatures(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """id, n, node (null for an empty set), c (array of long)."""
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, nodes, cs = [], [], []
            for s in sets_of(b.column("t"), k):
                n.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                cs.append(collections_of(s).view(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(cs, pa.list_(pa.int64()))], names=["id", "n", "node", "c"])

    return source.mapInArrow(run, "id long, n long, node binary, c array<long>")


def _table_keys(nodes: DataFrame) -> DataFrame:
    """node, key: the table keys of nodes (node, c) that another node may have too."""
    single = cut(nodes.select("node", F.explode("c").alias("c")))
    shared = single.groupBy("c").agg(F.count("*").alias("_n")).where("_n > 1")
    halves = join_counted(single, shared, "c", single.count()).groupBy("node").agg(F.array_sort(F.collect_list("c")).alias("c")).where(F.size("c") > 1)
    pairs = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.xxhash64(x, y))))
    return halves.select("node", F.explode(pairs).alias("key"))


def _forest(nodes: list[bytes], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that connect what is linked between the nodes of side 0, which come first, and those of side 1."""
    size = np.array([len(s) for s in sets], np.int64)
    cut_at = sides.count(0)
    left, right = slice(0, cut_at), slice(cut_at, None)
    tokens, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    common = np.flatnonzero(seen > 1)
    rank = np.full(len(tokens), -1, np.int64)
    rank[common] = np.arange(len(common))
    at = rank[place]
    owner, at = owner[at >= 0], at[at >= 0]
    both = np.zeros((cut_at, len(sets) - cut_at), np.float64)
    by = np.argsort(at, kind="stable")
    owner, at = owner[by], at[by]
    for lo in range(0, len(common), 8192):
        a, b = np.searchsorted(at, (lo, lo + 8192))
        held = np.zeros((len(sets), min(8192, len(common) - lo)), np.float32)
        held[owner[a:b], at[a:b] - lo] = 1
        both += held[left] @ held[right].T
    linked = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in np.argwhere(linked).tolist():
        j += cut_at
        if nodes[i] != nodes[j] and (x := find(i)) != (y := find(j)):
            root[max(x, y)] = min(x, y)
            out.append((nodes[i], nodes[j]))
    return out


def _sets(docs: DataFrame, members: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """node, s: the set of each node of members (id, node), id being a document of it."""
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [s.tobytes() for s in sets_of(b.column("t"), k)]
            # a document id that stands for several texts makes rows of which only the node's own counts
            keep = pa.array([xxhash.xxh3_128_digest(s) == n for s, n in zip(made, b.column("node").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(made, pa.binary())], names=["node", "s"]).filter(keep)

    return source.join(small(members, 48), "id").mapInArrow(run, "node binary, s binary").dropDuplicates(["node"])


def _met(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect all nodes linked across the two sides of any group of dealt (group, block, salt, side, node)."""
    rows = sets.join(small(cut(dealt), 56), "node").repartition("group", "block", "salt").sortWithinPartitions("group", "block", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            nodes, found = [[*a, *b] for a, b in zip(*sides, strict=True)], []
            if sides[0][0] and sides[1][0]:
                found = _forest(nodes[0], [0] * len(sides[0][0]) + [1] * len(sides[1][0]), nodes[1], percent)
            sides[1] = ([], [])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])

        at, sides = None, [([], []), ([], [])]
        for b in batches:
            for row in chain.from_iterable(zip(*(b.slice(i, 64).column(c).to_pylist() for c in ("group", "block", "salt", "side", "node", "s")), strict=True) for i in range(0, b.num_rows, 64)):
                if row[:3] != at:
                    if at is not None:
                        yield done()
                    at, sides[0] = row[:3], ([], [])
                held, other = sides[row[3]]
                held.append(row[4])
                other.append(np.frombuffer(row[5], np.uint64))
                if len(sides[1][0]) >= BLOCK:
                    yield done()
        if at is not None:
            yield done()

    return rows.mapInArrow(run, "a binary, b binary")


def _by_hash(column: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(column), parts).cast("int")


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _stars_of(keys: DataFrame, n: int) -> DataFrame:
    """Deals each key's least node, its centre, and the key's other nodes; a node meets a centre once."""
    centres = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("_n"))
    pairs = join_counted(keys, centres.where("_n > 1"), "key", n).where("node <> centre").select("node", "centre").distinct()
    group = F.xxhash64("centre").alias("group")  # centres of one hash share a group, whose nodes meet both
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("salts"), F.count("*").alias("_n"))
    first = sizes.select(group, F.lit(0).alias("block"), _numbers(F.col("salts")).alias("salt"), F.lit(0).alias("side"), F.col("centre").alias("node"))
    rest = join_counted(pairs, sizes, "centre", n).select(group, F.lit(0).alias("block"), _by_hash("node", F.col("salts")).alias("salt"), F.lit(1).alias("side"), "node")
    return first.unionByName(rest)


def _rest_of(keys: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Deals, in keys of nodes of several groups (node, root), the nodes outside the largest group, and all of the key's nodes."""
    rows = cut(keys.join(groups, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root")))
    code = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)]
    parts = rows.groupBy("key", "root").agg(F.count("*").alias("n"), *code)
    whole = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("groups"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(2)])
    mixed_ = whole.where("groups > 1").groupBy("n", "h0", "h1").agg(F.min(F.struct("key", "most")).alias("x"))  # of keys of the same nodes one
    outside = F.col("n") - F.col("x.most.n")
    mixed_ = cut(mixed_.select("x.key", F.col("x.most.root").alias("largest"), F.ceil(outside / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / STREAM).cast("int").alias("salts"), F.col("n").alias("_n")))
    met = cut(join_counted(rows, mixed_, "key", n))
    left = met.where("root <> largest").select(F.col("key").alias("group"), _by_hash("node", F.col("blocks")).alias("block"), _numbers(F.col("salts")).alias("salt"), F.lit(0).alias("side"), "node")
    right = met.select(F.col("key").alias("group"), _numbers(F.col("blocks")).alias("block"), _by_hash("node", F.col("salts")).alias("salt"), F.lit(1).alias("side"), "node")
    return left.unionByName(right)


def _roots(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """node, root: of each node (node, id, c) that is linked to another one, the least node of its class."""
    keys = cut(_table_keys(nodes.where("id is not null").select("node", "c")))
    n = keys.count()
    members = cut(nodes.select("id", "node").join(keys.select("node").distinct(), "node"))
    sets = cut(_sets(docs, members, doc_id, text, k))
    groups = cut(components(cut(_met(_stars_of(keys, n), sets, percent)), "a", "b"))
    more = _met(_rest_of(keys, groups, n), sets, percent)
    for side in ("a", "b"):
        own = groups.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        more = more.join(own, side, "left").withColumn(side, F.coalesce(f"{side}_root", side)).drop(f"{side}_root")
    merged = components(cut(more), "a", "b").select(F.col("node").alias("root"), F.col("root").alias("least"))
    singles = merged.join(groups.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("least").alias("root"))
    return groups.join(merged, "root", "left").select("node", F.coalesce("least", "root").alias("root")).unionByName(singles)


def _classed(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Checkpointed: id, n, node (null for an empty set) of each row of docs; and node, root of each node, the same root for one class."""
    signed = cut(_signatures(docs, doc_id, text, k))
    nodes = cut(signed.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("c").alias("c")))
    roots = _roots(docs, nodes, doc_id, text, k, percent)
    return signed.select("id", "n", "node"), cut(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``.

    n_shingles: size of the set of distinct shingles of ``k`` words. component_id: the least doc_id
    among documents reachable over links, its own included; two documents are linked if their
    intersection is at least ``percent`` hundredths of their union. kept: doc_id is component_id.

    A text that is null, empty or without words has an empty set and no links. Fewer than ``k`` words
    are one shingle. Repeated rows stay, each with the same result; rows that share a doc_id are
    judged by their own texts. A null doc_id never stands for others: its component_id is the least
    id of its class, or null, and it is not kept unless it is alone. An empty table gives an empty one. Only ``doc_id``
    and ``text`` are read, so other columns' names can't clash.
    """
    signed, roots = _classed(docs, doc_id, text, k, percent)
    owners = signed.where("node is not null").groupBy("node").agg(F.min("id").alias("id")).join(roots, "node")
    least = owners.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("_n"))
    owners = join_counted(owners.select("node", "root"), least, "root", signed.count()).select("node", "component_id")
    found = signed.where("node is not null").join(owners, "node", "left")
    out = found.unionByName(signed.where("node is null").withColumn("component_id", F.lit(None).cast("long")))  # texts without words don't meet
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 85) -> DataFrame:
    """Rows of ``docs``, with all its columns: of each class of near copies one.

    That of the least doc_id stays, any id before a null one; of several texts of that id the one
    whose set has the least digest; of rows alike in id and set any one. Rows without words are in no
    class and stay. Only rows whose id repeats or is null are looked at by their text once more; all
    others go by their id alone.
    """
    signed, roots = _classed(docs, doc_id, text, k, percent)
    rows = signed.where("node is not null").groupBy("id", "node").agg(F.count("*").alias("n")).join(roots, "node")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("first"), F.count("*").alias("_n"))
    rows = cut(join_counted(rows, first, "root", signed.count()).select("id", "node", "n", ((F.col("node") == F.col("first.node")) & F.col("id").eqNullSafe(F.col("first.id"))).alias("stays")))
    repeated = cut(signed.groupBy("id").count().where("count > 1 or id is null").select("id"))
    lost = cut(rows.where("not stays").select("id").join(small(repeated, 16), "id", "left_anti"))
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, columns, strict=True)], F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").cast("binary").alias("_t"))
    in_repeated = plain["_id"].eqNullSafe(repeated["id"])
    again = plain.join(small(repeated, 16), in_repeated, "left_semi")
    others = plain.join(small(repeated, 16), in_repeated, "left_anti").join(small(lost, 16), F.col("_id") == lost["id"], "left_anti")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets_of(b.column("_t"), k)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(nodes, pa.binary())], names=[*b.schema.names[:-1], "_node"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in again.schema if f.name != "_t")
    judged = again.mapInArrow(digests, f"{kinds}, _node binary")
    stays = rows.where("stays").select("id", "node")
    one = judged.join(stays, judged["_id"].eqNullSafe(stays["id"]) & (judged["_node"] == stays["node"]), "left_semi").dropDuplicates(["_id", "_node"])
    out = others.select(*columns).unionByName(one.select(*columns)).unionByName(judged.where("_node is null").select(*columns))
    return out.toDF(*docs.columns)
