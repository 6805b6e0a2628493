"""Edge cases and brute force of divergence, packing and clustering."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlane.llm import centroids, divergence, oracles, packing, queries, wordids

from ..compare import connect, same
from ..conftest import SF

AZ = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows, least, prior, top):
    """Rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(divergence.TERM, t.translate(AZ)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(w, r[2]) for w, r in zip(words, rows, strict=True) if r[1] == lang]
        docs = Counter(t for w, _ in mine for t in set(w))
        kept = [t for t, n in docs.items() if n >= least]
        counts = defaultdict(Counter)
        for w, s in mine:
            counts[s].update(t for t in w if docs[t] >= least)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + prior) // (sum(c.values()) + prior * len(kept)) for t in kept}  # noqa: E731, B023
        p = {s: share(c) for s, c in counts.items()}
        q = share(whole)
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, n) for n, (v, i) in enumerate(found, 1) if part == "pair" or n <= top]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    texts = ["The cat, the CAT; dog", "Ünï ünï Ünï a1b2c3", None, "", "... 42", "dog dog " * 500, "日本 語 cat dog", "zz cat", "zz cat", "Straße straße cat"]
    rows = [(texts[i % 10], ["en", None, "de", "x"][i // 7 % 4], ["web", "books", None, f"s{i % 5}"][i % 4]) for i in range(120)]
    rows += [(None, "empty", "a"), ("", "empty", "b"), ("only", "alone", "a")] + [("the dog", "one", f"s{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3).withColumns({c: F.lit(0) for c in ("term", "n", "p", "item", "sources", "at")})
    for least, prior, top in ((2, 5, 3), (1, 1, 50), (10**6, 5, 50)):
        got = sorted(tuple(r) for r in divergence.audit(df, least_docs=least, prior=prior, top=top).collect())
        assert got == plain_audit(rows, least, prior, top)
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_of_other_columns_and_the_query(spark):
    df = spark.createDataFrame([("a b", 1, True), ("a a", 1, False), ("b", 2, False)], "body string, kind int, good boolean")
    got = sorted(tuple(r) for r in divergence.audit(df, "body", "kind", "good", least_docs=1, top=1).collect())
    assert got == plain_audit([("a b", "1", "true"), ("a a", "1", "false"), ("b", "2", "false")], 1, 5, 1)
    same(queries.op11_source_divergence(spark, SF), connect(SF), oracles.SQL["op11_source_divergence"])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.packed_vocabulary_path())
    t.encode_special_tokens = True
    return t


ODD = [None, "", " \t\n", "One", "don't don 't", "é e ́x", "a\x1cb\x85c d e", "ΑΣ ΑΣ. Σ", "<|endoftext|> a<|startoftext|>b", "x" * 20_000, "中文 字 🙂 İ ﬁ ①", "word " * 9_000, "12 345"]


def test_words_are_encoded_as_whole_texts(library):
    encoder = wordids.WordEncoder(queries.packed_vocabulary_path())
    rng = np.random.default_rng(1)
    alphabet = [*"abcXYZ  \n\t.,'\"09éÉßΣσ中́  \x1c\r\v\f|<>", "'s", "'LL", "<|endoftext|>"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3_000)]
    texts += [" ".join("".join(rng.choice([*"etaoinshrdlu", "th", "ing", "é", "ÿ", "÷", "É"], rng.integers(1, 16))) for _ in range(40)) for _ in range(300)]
    assert encoder.merges
    got = encoder.encode_all([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, docs, library, size, end=(2,)):
    """Pieces lie gapless in their sequences and their documents, and give each document's ids back."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
        assert r.length > 0 and len(r.ids) == 4 * r.length
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    want = defaultdict(list)
    for key, text in docs:
        want[key].append([*library.encode(text or "", add_special_tokens=False).ids, *end])
    for key, lists in want.items():
        if len(lists) == 1:
            mine = sorted(pieces[key], key=lambda r: r.start)
            assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
            assert np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist() == lists[0]
            assert {r.doc_tokens for r in mine} <= {len(lists[0])}
        else:  # repeated ids: as many ids in all
            assert sum(r.length for r in pieces[key]) == sum(map(len, lists))
    assert set(pieces) == {k for k, x in want.items() if sum(map(len, x))}
    return padding, len(sequences)


@pytest.mark.parametrize(("size", "most_open", "fan_in", "parts"), [(4096, 32, 64, 1), (64, 4, 2, 7), (48, 1, 3, 5), (1, 2, 2, 2)])
def test_packing_loses_nothing(spark, library, size, most_open, fan_in, parts):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (5, "again"), (5, "again")] + [(100 + i, "w " * (i * 7 % 90)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).withColumns({c: F.lit(0) for c in ("t", "k0", "ids", "task", "open", "offset")})
    rows = packing.pack(df, ["doc_id"], queries.packed_vocabulary_path, size=size, most_open=most_open, fan_in=fan_in).collect()
    padding, sequences = check_packing(rows, docs, library, size)
    total = sum(r.length for r in rows)
    assert padding == 0 and sequences <= total // size + size.bit_length() + 1


def test_packing_best_fit_and_edges(spark, library):
    b = packing.BestFit(10, 2)
    piece = lambda n: packing.Piece((), 0, b"\0\0\0\0" * n, n)
    assert [list(b.place(piece(n))) for n in (6, 7)] == [[], []]
    assert list(b.place(piece(3)))[0].gap == 0 and [w.gap for w in b.open] == [4]  # 3 fills the seven, not the six
    assert list(b.place(piece(8))) == [] and [w.gap for w in b.open] == [4, 2]
    full = list(b.place(piece(5)))  # no room: two ids fill the fullest, three go to the other
    assert [len(p) for p in full[0].pieces] == [8, 2] and [w.gap for w in b.open] == [1]
    assert [[len(p) for p in w.pieces] for w in b.rest()] == [[6, 2], [1]]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, ["doc_id"], queries.packed_vocabulary_path).collect() == []
    none = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    rows = packing.pack(none, ["doc_id"], queries.packed_vocabulary_path, end_id=None).collect()
    assert [(r.doc_id, r.length) for r in rows] == [(2, 2)]


def test_packing_query(spark, library):
    out = queries.op12_packing(spark, SF)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = out.collect()
    for r in rows[::9]:
        ids = [*library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def plain_lloyd(vectors, k, rounds, scale=64):
    """Rows of (id, components)."""
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in start[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        groups = [[v for (_, v), a in zip(kept, at, strict=True) if a == j] for j in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else o for g, o in zip(groups, c, strict=True)]
    at = [nearest(v) for _, v in kept]
    d = [far(v, c[a]) for (_, v), a in zip(kept, at, strict=True)]
    inertia = [sum(x for x, a in zip(d, at, strict=True) if a == j) for j in range(len(c))]
    return sorted(((str(i), a, x, inertia[a], sum(d), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d, strict=True)), key=str)


@pytest.mark.parametrize(("k", "rounds", "spread"), [(5, 3, 1.0), (16, 6, 0.05), (1, 2, 1.0), (40, 2, 1.0), (3, 0, 300_000.0), (4, 3, 60_000.0)])
def test_clusters_equal_brute_force(spark, k, rounds, spread):
    rng = np.random.default_rng(k)
    rows = [(i, (spread * rng.integers(-3, 4, 4)).tolist() if i % 3 else (spread * rng.normal(size=4)).tolist()) for i in range(150)]
    rows += [(7, [0.0] * 4), (7, [spread] * 4), (None, [0.25] * 4), (200, None), (201, [1.0] * 3), (202, [1.0, None, 1.0, 1.0]), (203, [1.0, float("nan"), 0.0, 0.0]), (204, [float("inf")] * 4), (205, []), (206, [-0.0, 1e-9, -1e-9, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({c: F.lit(0) for c in ("v", "cluster", "distance", "k0", "e", "id", "scale", "upper")})
    out = centroids.cluster(df, ["vec_id"], width=4, k=k, rounds=rounds)
    got = sorted(((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect()), key=str)
    assert got == plain_lloyd([(i, v) for i, v in rows if v is not None and len(v) == 4], k, rounds)


def test_cluster_edges_and_query(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = centroids.cluster(empty, ["vec_id"])
    assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    one = spark.createDataFrame([(1, [0.5] * 64), (2, [1e30] * 64)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in centroids.cluster(one, ["vec_id"]).collect()] == [(1, 0, 0, 0)]
    same(queries.op13_centroids(spark, SF), connect(SF), oracles.SQL["op13_centroids"])


def test_balls_spare_distances_and_keep_ties():
    rng = np.random.default_rng(4)
    at = rng.integers(0, 12, 3_000)
    x = (100 * rng.normal(size=(12, 16)))[at].astype(np.int64) + rng.integers(-3, 4, (3_000, 16))
    before = x[[np.flatnonzero(at == j)[0] for j in range(12)]]
    found = centroids.Exponion(before).all(x)
    now = before + rng.integers(-1, 2, before.shape)
    search = centroids.Exponion(now, before)
    cluster, upper, lower = search.again(x, *found)
    d = centroids.squared(x, now)
    assert (cluster == d.argmin(1)).all() and search.scanned < len(x) * 3
    second = np.sqrt(np.partition(d, 1, axis=1)[:, 1])
    assert (upper >= np.sqrt(d.min(1))).all() and (lower <= second).all()
    # two centroids at one place, and vectors midway between two: the smaller number wins
    line = np.array([[0, 0], [10, 0], [10, 0], [20, 0]])
    points = np.array([[5, 0], [15, 0], [10, 0], [10, 7]])
    found = centroids.Exponion(line + [1, 0]).all(points)
    assert centroids.Exponion(line, line + [1, 0]).again(points, *found)[0].tolist() == [0, 1, 1, 1]
