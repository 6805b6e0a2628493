"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs whose concatenation is a piece: a heap for a
long part, and for short ones a row of a table, many of which are worked off side by side. The
pair of the highest score is merged first, the leftmost among equals; a merge puts the two new
neighbouring pairs on the agenda. Entries whose symbols have changed since are skipped. What is left
that is no piece becomes byte pieces.

Texts are cut before each run of U+2581 (the vocabulary's mark for a space) and around line feeds
where no piece spans such a place, and a long cut once more between any two characters that stand
together in no piece, so that merges stay inside a part. What repeats comes from a cache of bounded size, which
drops what was used longest ago. Each Arrow batch is encoded by the sentencepiece library as well, and the
column ``agrees`` tells whether the ids are the same.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Cuts that a Python worker remembers in each of two generations: a full younger one replaces the older.
CACHE_ENTRIES = 200_000
#: Longer cuts aren't remembered.
CACHED_CHARS = 64
#: Parts whose agendas are worked off side by side.
AGENDAS = 2048
#: The rank of a pair of symbols that makes no piece.
NO_RANK = np.iinfo(np.int32).max
#: Code points that go through one call of the library at most, unless one text is longer.
CHUNK_CHARS = 1_000_000


class MergeVocabulary:
    """Scores and ids of a merge-type (BPE) SentencePiece model, and the agenda over them."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.ids: dict[str, int] = {}
        self.cost: dict[str, float] = {}
        self.bytes = [sp.unk_id()] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.cost[piece] = -sp.get_score(i)
        self.eos = sp.eos_id()
        self._check()
        inside = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        line = any("\n" in p for p in self.ids)
        self.cuts = re.compile(r"(?s).+" if inside else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if line else rf"\n+|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.together = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._pairs()
        self.keys = np.array([*sorted(self.pair), np.iinfo(np.int64).max])
        self.ranks, self.news = np.array([*map(self.pair.get, self.keys[:-1].tolist()), (NO_RANK, 0)], np.int32).T.copy()
        self.id_array = np.array([*self.id_of, -1], np.int32)  # the last one is that of symbol -1
        self.number_of = np.full(sys.maxunicode + 1, -1, np.int32)
        for c, x in self.number.items():
            if len(c) == 1:
                self.number_of[ord(c)] = x
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _check(self) -> None:
        """An error for a model of other rules than these: no normalisation, a space before each text, all white space kept, no symbols of the user's own."""
        sp = self.library
        own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and sp.get_score(i) == 0]
        odd = "Ａﬁ①é  e\u0301\t x "
        if sp.decode(sp.encode(odd)) != odd or sp.encode("x", out_type=str)[0][:1] != SPACE or len(own) > 1:
            raise ValueError("this model normalises texts, adds no space before them or has symbols of its own, which the agenda doesn't know")

    def _pairs(self) -> None:
        """Numbers for symbols (pieces, and characters that are none), and for each pair of them that makes a piece its rank and number."""
        chars = {c for p in self.ids for c in p} - self.ids.keys()
        self.number = {p: i for i, p in enumerate([*self.ids, *chars])}
        self.id_of = [*self.ids.values()] + [-1] * len(chars)
        ranks = {c: r for r, c in enumerate(sorted(set(self.cost.values())))}
        self.pair: dict[int, tuple[int, int]] = {}
        for p in self.ids:
            for i in range(1, len(p)):
                left, right = self.number.get(p[:i]), self.number.get(p[i:])
                if left is not None and right is not None:
                    self.pair[left << 20 | right] = ranks[self.cost[p]], self.number[p]

    def merged(self, text: str) -> bytes:
        """Ids of one part (each of four bytes), by the agenda: of entries rank * length + place, the least comes first."""
        n, pair, number = len(text), self.pair.get, self.number.get
        part = [number(c, -1) for c in text]
        if n > 1:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            agenda = [found[0] * n + i for i in range(n - 1) if (found := pair(part[i] << 20 | part[i + 1]))]
            heapify(agenda)
            while agenda:
                rank, i = divmod(heappop(agenda), n)
                left = part[i]
                if left is None or (j := after[i]) >= n or not (found := pair(left << 20 | part[j])) or found[0] != rank:
                    continue  # a symbol of this entry has been merged since
                part[i], part[j] = new, _ = found[1], None
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if found := pair(new << 20 | part[k]):
                        heappush(agenda, found[0] * n + i)
                if (h := before[i]) >= 0 and (found := pair(part[h] << 20 | new)):
                    heappush(agenda, found[0] * n + h)
        out: list[int] = []
        for i, x in enumerate(part):
            if x is not None:
                if x >= 0 and (piece := self.id_of[x]) >= 0:
                    out.append(piece)
                else:
                    out.extend(self.bytes[b] for b in text[i].encode())
        return np.array(out, np.int32).tobytes()

    def merged_together(self, parts: list[str]) -> list[bytes]:
        """Ids of many short parts: an agenda for each, of which every round takes the first entry.

        An agenda is a row of ranks, one at each symbol's place; its least entry, the leftmost among
        equals, is merged in all rows at once.
        """
        out = [b""] * len(parts)
        order = np.argsort(list(map(len, parts)), kind="stable").tolist()
        for lo in range(0, len(order), AGENDAS):
            at = order[lo : lo + AGENDAS]
            for i, ids in zip(at, self._block([parts[i] for i in at]), strict=True):
                out[i] = ids
        return out

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (NO_RANK of one that makes no piece), and the number of its piece."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), self.news[at]

    def _block(self, parts: list[str]) -> list[bytes]:
        lengths = np.array([len(p) for p in parts])
        n = int(lengths.max())
        inside = np.arange(n) < lengths[:, None]
        part = np.full((len(parts), n + 1), -1, np.int32)
        part[:, :n][inside] = self.number_of[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        strange = (part[:, :n] < 0) & inside
        ranks, news = self._found(part[:, :-1], part[:, 1:])
        after = np.tile(np.arange(1, n + 2, dtype=np.int32), (len(parts), 1))
        before = after - 2
        alive = inside.copy()
        rows = np.arange(len(parts))
        while True:
            i = ranks[rows].argmin(1)
            going = ranks[rows, i] < NO_RANK
            rows, i = rows[going], i[going]
            if not len(rows):
                break
            j = after[rows, i]
            k = after[rows, j]
            part[rows, i] = new = news[rows, i]
            alive[rows, j], ranks[rows, j] = False, NO_RANK
            after[rows, i], before[rows, np.minimum(k, n)] = k, i
            ranks[rows, i], news[rows, i] = self._found(new, part[rows, np.minimum(k, n)])
            h = before[rows, i]
            r, x, i = rows[h >= 0], new[h >= 0], h[h >= 0]
            ranks[r, i], news[r, i] = self._found(part[r, i], x)
        ids = np.where(alive, self.id_array[part[:, :n]], np.int32(0))
        odd = (strange | (ids < 0)).any(axis=1)
        flat, ends = ids[alive].tobytes(), (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [self.merged(p) if o else flat[lo:hi] for p, o, lo, hi in zip(parts, odd.tolist(), [0, *ends], ends, strict=False)]

    def _shorter(self, cut: str) -> list[str]:
        """A long cut's parts, between characters that stand together in no piece."""
        bounds = [0, *(i for i in range(1, len(cut)) if cut[i - 1 : i + 1] not in self.together), len(cut)]
        return [cut[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _learn(self, wanted: set[str]) -> None:
        """Puts the ids of all wanted parts into the younger generation."""
        wanted.difference_update(self.young)
        self.young.update((c, self.old[c]) for c in wanted & self.old.keys())
        wanted.difference_update(self.young)
        short = [c for c in wanted if len(c) <= CACHED_CHARS]
        self.young.update(zip(short, self.merged_together(short), strict=True))
        self.young.update((c, self.merged(c)) for c in wanted if len(c) > CACHED_CHARS)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text (each of four bytes), without an end id. A space is put before a text that isn't empty."""
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        cuts = [self.cuts.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        wanted = set(chain.from_iterable(cuts))
        long = {c: self._shorter(c) for c in wanted if len(c) > CACHED_CHARS}
        self._learn(wanted.difference(long).union(*long.values()))
        forgotten = set(long).union(p for parts in long.values() for p in parts if len(p) > CACHED_CHARS)
        for c, parts in long.items():
            self.young[c] = b"".join([self.young[p] for p in parts])
        out = [b"".join(map(self.young.__getitem__, c)) for c in cuts]
        for c in forgotten:
            del self.young[c]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text, as encode_all finds them."""
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()


_LOADED: dict[str, MergeVocabulary] = {}


def _loaded(model: str | Callable[[], str]) -> MergeVocabulary:
    path = model if isinstance(model, str) else model()
    if path not in _LOADED:
        _LOADED[path] = MergeVocabulary(path)
    return _LOADED[path]


def encode_decode(df: DataFrame, keep: list[str], model: str | Callable[[], str], text: str = "text", end_id: bool = True, check: bool = True) -> DataFrame:
    """Columns ``keep``, and ids (array of int), decoded (string), agrees (boolean).

    model: the vocabulary's path on each executor, or a function that gives it there.
    check: also encode by the library; ``agrees`` is null otherwise.

    A null text counts as empty: with ``end_id`` its only id is the end id, and it decodes to the
    empty string. Repeated rows stay. An empty table gives an empty table. Columns outside ``keep``
    are dropped, so their names can't clash.
    """
    kept = text in keep and df.schema[text].dataType.simpleString() == "string"  # then texts go to Python once
    source = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *([] if kept else [F.col(text).cast("string").alias("t")]))
    place = keep.index(text) if kept else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(model)
        tail = np.array([vocabulary.eos] if end_id else [], np.int32).tobytes()
        for whole in batches:
            start = 0
            lengths = [n or 0 for n in pc.utf8_length(whole.column(place)).to_pylist()] if whole.num_rows else []
            while start < whole.num_rows:
                stop, chars = start, 0
                while stop < whole.num_rows and (stop == start or chars + lengths[stop] <= CHUNK_CHARS):
                    chars += lengths[stop]
                    stop += 1
                batch = whole.slice(start, stop - start)
                start = stop
                texts = [t or "" for t in batch.column(place).to_pylist()]
                made = [x + tail for x in vocabulary.encode_all(texts)]
                ends = np.cumsum([0, *map(len, made)]) // 4
                flat = np.frombuffer(b"".join(made), np.int32)
                ids = [x.tolist() for x in np.split(flat, ends[1:-1])]
                agrees = [a == b for a, b in zip(ids, vocabulary.library.encode(texts, add_eos=end_id, num_threads=1), strict=True)] if check else [None] * len(ids)
                decoded = vocabulary.library.decode(ids, num_threads=1)
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], listed, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], names=[*batch.schema.names[: len(keep)], "ids", "decoded", "agrees"])

    kinds = ", ".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    out = source.mapInArrow(run, f"{kinds}{', ' * bool(keep)}ids array<int>, decoded string, agrees boolean")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", "decoded", "agrees")
