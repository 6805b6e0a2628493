"""Sets of hashed word shingles, made for a whole Arrow buffer at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are hashed at once, unless one text is longer.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_rng = np.random.default_rng(20240229)
#: The lowest n bytes of eight.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def _bytes(chosen) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chosen)] = True
    return out


#: Bytes between words: ASCII white space; or all of ASCII but letters and digits.
SPACES = _bytes([32, *range(9, 14)])
NO_WORD = _bytes(b for b in range(128) if not chr(b).isalnum())
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Hashes:
    """Word hashes of 64 bits; A-Z count as a-z.

    Each eight bytes of a word are mixed into its hash in turn, many words side by side; XXH3 hashes
    the long ones. Neither is linear in the bytes, so no words hash alike by their making.
    """

    def __init__(self, between: np.ndarray):
        self.between = between

    def _places(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end. A word can't go on from one text to the next."""
        n = len(data)
        space = self.between[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        word = ~space
        starts = np.flatnonzero(word & (edge[:n] | np.concatenate(([True], space[:-1]))))
        return starts, np.flatnonzero(word & (edge[1:] | np.concatenate((space[1:], [True])))) + 1

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """How many words each text has."""
        return np.diff(np.searchsorted(self._places(data, bounds)[0], bounds)) if len(data) else np.zeros(len(bounds) - 1, np.int64)

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and how many words each text has. Texts are data[bounds[i]:bounds[i+1]]."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
        starts, ends = self._places(data, bounds)
        return self._hashed(_LOWER[data], starts, ends - starts), np.diff(np.searchsorted(starts, bounds))

    @staticmethod
    def _hashed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        out = mixed(lengths.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
        long = lengths > LONG_WORD
        at, left, rows = starts, lengths, None
        if long.any():
            whole = data.tobytes()
            for i in np.flatnonzero(long).tolist():
                out[i] = xxhash.xxh3_64_intdigest(whole[starts[i] : starts[i] + lengths[i]])
            rows = np.flatnonzero(~long)
            at, left = starts[rows], lengths[rows]
        while len(at):
            part = eights[at] & _BYTES[np.minimum(left, 8)]
            if rows is None:
                out = mixed(out ^ part)
            else:
                out[rows] = mixed(out[rows] ^ part)
            more = left > 8
            rows = np.flatnonzero(more) if rows is None else rows[more]
            at, left = at[more] + 8, left[more] - 8
        return out


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of neighbouring texts (an array of binary, null being empty), CHUNK_BYTES at once or one longer text, and the bounds of each."""
    start, rows = 0, len(texts)
    lengths = np.array([x or 0 for x in pc.binary_length(texts).to_pylist()], np.int64)
    while start < rows:
        stop = max(start + 1, start + int(np.searchsorted(np.cumsum(lengths[start:]), CHUNK_BYTES, "right")))
        data = np.frombuffer(b"".join(x.as_py() or b"" for x in texts.slice(start, stop - start)), np.uint8)
        yield data, np.concatenate(([0], np.cumsum(lengths[start:stop])))
        start = stop


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, before mixed()."""
    m = max(0, len(words) - k + 1)
    full = np.zeros(m, np.uint64)
    for i in range(k):
        full += words[i : i + m] * _PLACE[i]
    return full


_HASHES = _Hashes(SPACES)


def sets_of(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Of each text (an array of binary) the sorted distinct hashes of its shingles of ``k`` words.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Fewer than ``k`` words
    make one shingle, none (or null) an empty set.
    """
    for data, bounds in chunks(texts):
        words, counts = _HASHES.words(data, bounds)
        full = mixed(shingle_hashes(words, k))
        at = 0
        for c in counts.tolist():
            if c >= k:
                yield np.unique(full[at : at + c - k + 1])
            elif c:
                yield mixed(shingle_hashes(words[at : at + c], c) + _U(c))
            else:
                yield np.zeros(0, np.uint64)
            at += c


WORDS = _Hashes(NO_WORD)
