"""Ids of whole texts by a vocabulary that encodes each word for itself."""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Callable

import numpy as np

#: Words of up to so many bytes are remembered, so many of them in each of two generations.
CACHED_BYTES, CACHE_ENTRIES = 48, 200_000
#: Words of one call of the library, and the word between them, which has an id of its own.
TOGETHER, BETWEEN = 64, "\x01"
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ID_BYTES = 4
STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A run of lower-case letters of ASCII and Latin-1, which no normalisation changes, and stops; longer ones are left to the library.
SIMPLE = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]){1,32})([%s]*)" % re.escape(STOPS.encode()))
#: A capital of Latin-1.
CAPITAL = re.compile(rb"\xc3([\x80-\x96\x98-\x9e])")
#: Words of one length that are merged at once.
AT_ONCE = 4096
NO_RANK = 1 << 30


def _letter_of_byte() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from 256 on in turn."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Merges:
    """Merges of a byte-level vocabulary, for many words of one run of letters side by side."""

    def __init__(self, model: dict):
        vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = _letter_of_byte()
        self.inner, self.last = (np.array([vocabulary.get(c + suffix, -1) for c in letters], np.int32) for suffix in ("", end))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs])
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.news = np.array([vocabulary[a + b] for a, b in pairs], np.int32)[order]

    def _found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and what it becomes; NO_RANK for one that isn't merged."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(known, self.ranks[at], np.int32(NO_RANK)), self.news[at]

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. In each round every word makes its merge of least rank, the first of equal ones."""
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        out = [b""] * len(words)
        for n, members in by_length.items():
            for at in range(0, len(members), AT_ONCE):
                some = members[at : at + AT_ONCE]
                flat, counts = self._merged(np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(-1, n))
                ends = (ID_BYTES * np.cumsum(counts)).tolist()
                for m, a, b in zip(some, [0, *ends], ends, strict=False):
                    out[m] = flat[a:b]
        return out

    def _merged(self, data: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids of words of one length, one after the other, and how many each has."""
        size, n = data.shape
        place = np.arange(n + 1)
        parts = np.full((size, n + 1), -1, np.int32)
        parts[:, :n] = self.inner[data]
        parts[:, n - 1] = self.last[data[:, -1]]
        ranks, news = self._found(parts[:, :-1], parts[:, 1:])
        counts, going = np.full(size, n), np.arange(size)
        while len(going):
            i = ranks[going].argmin(1)
            some = ranks[going, i] < NO_RANK
            going, i = going[some], i[some]
            if not len(going):
                break
            new, rows = news[going, i], np.arange(len(going))
            moved = np.minimum(place + (place > i[:, None]), n)
            p = np.take_along_axis(parts[going], moved, 1)
            p[rows, i] = new
            r, w = (np.take_along_axis(x[going], np.minimum(moved[:, :-1], n - 1), 1) for x in (ranks, news))
            r[:, -1] = NO_RANK
            r[rows, i], w[rows, i] = self._found(new, p[rows, i + 1])
            left = np.flatnonzero(i > 0)
            r[left, i[left] - 1], w[left, i[left] - 1] = self._found(p[left, i[left] - 1], new[left])
            parts[going], ranks[going], news[going] = p, r, w
            counts[going] -= 1
        return parts[place < counts[:, None]].astype("<u4").tobytes(), counts


class WordEncoder:
    """Ids of texts by a vocabulary that never joins what white space parts.

    Such a vocabulary gives a text the ids of its words one after the other, so each distinct word
    is encoded once, many in one call. Words are cut at ASCII white space alone; any other is left to
    the library. If the vocabulary is of lower case, A-Z are lowered first, which makes fewer words
    distinct. If it is byte-level and parts letters from the stops after them, new words of letters and
    stops are merged side by side in NumPy, all others are encoded by the library. Strings of special
    tokens are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        one = lambda text: self._ids([text])[0].tolist()
        if one("a b. 1") != [*one("a"), *one("b."), *one("1")]:
            raise ValueError("the vocabulary encodes white space, so texts can't be encoded by words")
        self.lowers = one("AbZ") == one("abz")
        self.between = one(BETWEEN)
        self.merges = self._merges() if self.lowers else None

    def _merges(self) -> Merges | None:
        """Merges for simple words, if they give the library's ids; else they are left to the library as well."""
        model = json.loads(self.library.to_str())["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            return None
        rng = np.random.default_rng(0)
        letters = [*"etaoinshrdlucmfgypwbvkjxqz", *map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0x100)])]
        words = ["".join(letters[int(len(letters) * rng.random() ** 2)] for _ in range(n)) for n in rng.integers(1, 20, 1_000)]
        merges, texts = Merges(model), [*words, *[a + b for a, b in zip(words, STOPS * 40, strict=False)]]
        ids = dict(zip(texts, (x.tobytes() for x in self._ids(texts)), strict=True))
        stops = dict(zip(STOPS, (x.tobytes() for x in self._ids([*STOPS])), strict=True))
        same = merges.of_words([w.encode() for w in words]) == [ids[w] for w in words]
        return merges if same and all(ids[a + b] == ids[a] + stops[b] for a, b in zip(words, STOPS * 40, strict=False)) else None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: simple ones by Merges, TOGETHER of the others in one text, parted by a word that stands for nothing else."""
        out: dict[bytes, bytes] = {}
        simple, runs, stops = [], [], []
        for w in words if self.merges else []:
            m = SIMPLE.fullmatch(w) or SIMPLE.fullmatch(CAPITAL.sub(lambda c: bytes([0xC3, c[1][0] + 32]), w))
            if m:
                simple.append(w)
                runs.append(m[1])
                stops.append(m[2])
        if simple:
            one, other = list(set(runs)), list(set(stops))
            ids, after = dict(zip(one, self.merges.of_words(one), strict=True)), dict(zip(other, (x.tobytes() for x in self._ids([b.decode() for b in other])), strict=True))
            out.update(zip(simple, map(bytes.__add__, map(ids.__getitem__, runs), map(after.__getitem__, stops)), strict=True))
        mark = f" {BETWEEN} ".encode()
        plain = [w for w in words if w not in out and BETWEEN.encode() not in w] if len(self.between) == 1 else []
        groups = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        for group, ids in zip(groups, self._ids([mark.join(g).decode() for g in groups]), strict=True):
            at = np.flatnonzero(ids == self.between[0]).tolist()
            if len(at) == len(group) - 1:
                whole = ids.tobytes()
                out.update((w, whole[ID_BYTES * a : ID_BYTES * b]) for w, a, b in zip(group, [0, *(i + 1 for i in at)], [*at, len(ids)], strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, (x.tobytes() for x in self._ids([w.decode() for w in rest])), strict=True))
        return [out[w] for w in words]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8), each of four bytes with the lowest first."""
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        split = [(t.translate(LOWERED) if self.lowers else t).split() for t in texts]
        wanted = set().union(*split)
        wanted.difference_update(self.young)
        self.young.update((w, self.old[w]) for w in wanted & self.old.keys())
        wanted.difference_update(self.young)
        new = list(wanted)
        self.young.update(zip(new, self._of_words(new), strict=True))
        out = [b"".join(map(self.young.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHED_BYTES:
                del self.young[w]
        return out


_LOADED: dict[str, WordEncoder] = {}


def loaded(tokenizer: str | Callable[[], str]) -> WordEncoder:
    """The encoder of a vocabulary, made once in a process."""
    path = tokenizer if isinstance(tokenizer, str) else tokenizer()
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


