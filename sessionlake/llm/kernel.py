"""Vectorised word kernel: finds and hashes the words of UTF-8 texts straight from Arrow buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. A-Z are folded to a-z before
hashing. The hash is 64 bits: a polynomial over a random byte table, then a finaliser; two different
words of a corpus collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]

_powers: dict[str, np.ndarray] = {}


#: Bytes that are hashed at once: a longer text comes in pieces that end between words, and a longer word in pieces too.
LONG_BYTES = 2 * CHUNK_BYTES


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to LONG_BYTES, modulo 2**64."""
    if not _powers or len(_powers["up"]) <= LONG_BYTES:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(LONG_BYTES + 1, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about CHUNK_BYTES that end between words; longer where a word is."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + CHUNK_BYTES, n)
        while b < n:
            blank = np.flatnonzero(IS_SPACE[data[b : b + 65_536]])
            if len(blank):
                b += int(blank[0])
                break
            b = min(b + 65_536, n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _long_hash(word: np.ndarray) -> int:
    """The hash of one word of any length: sums of its pieces, each times the power that its place has."""
    _, down = _power_tables()
    total, place = 0, 1
    for a in range(0, len(word), CHUNK_BYTES):
        part = word[a : a + CHUNK_BYTES]
        total += int((_BYTE[part] * down[: len(part)]).sum(dtype=np.uint64)) * place
        place = place * pow(_INVERSE, CHUNK_BYTES, 1 << 64) % (1 << 64)
    return int(mix(np.array([total % (1 << 64)], np.uint64))[0])


class Words:
    """The words of some texts: where each begins and ends (bytes), its hash, and each row's first word."""

    __slots__ = ("end", "first", "hash", "row0", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row0: int = 0):
        self.row0 = row0
        if len(data) <= LONG_BYTES:
            self.start, self.end, self.hash = self._found(data, offsets)
        else:  # one long text
            found = []
            for a, b in pieces(data):
                start, end, h = self._found(data[a:b], np.array([0, b - a]))
                found.append((start + a, end + a, h))
            self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*found, strict=True))
        self.first = np.searchsorted(self.start, offsets)

    @classmethod
    def _found(cls, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        inside = ~IS_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, cls.hashes(data, start, end)

    @staticmethod
    def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of words that begin and end there, in the order of the text."""
        up, down = _power_tables()

        def near(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * down[: len(part)], out=total[1:])
            return mix((total[end] - total[start]) * up[start])

        if len(data) <= LONG_BYTES:
            return near(data, start, end)
        out, k = np.zeros(len(start), np.uint64), 0
        while k < len(start):
            base = int(start[k])
            j = int(np.searchsorted(end, base + LONG_BYTES, "right"))
            if j > k:
                out[k:j] = near(data[base : int(end[j - 1])], start[k:j] - base, end[k:j] - base)
            else:
                out[k] = _long_hash(data[base : int(end[k])])
            k = max(j, k + 1)
        return out

    @property
    def rows(self) -> int:
        return len(self.first) - 1


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows with about CHUNK_BYTES in all; a longer text comes alone."""
    data, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        after = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, after, data[offsets[row] : offsets[after]], offsets[row : after + 1] - offsets[row]
        row = after


def words(column: pa.Array | pa.ChunkedArray) -> Iterator[Words]:
    for row, _, data, offsets in chunks(column):
        yield Words(data, offsets, row)


_STEPS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each of the first len - n + 1 words, over row ends too."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for a in range(0, len(out), CHUNK_BYTES):
        b = min(a + CHUNK_BYTES, len(out))
        total = hashes[a:b] * _STEPS[0]
        for k in range(1, n):
            total += hashes[a + k : b + k] * _STEPS[k]
        out[a:b] = mix(total + np.uint64(n))
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; the array is sorted in place."""
    values.sort()
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def shingle_sets(column: pa.Array | pa.ChunkedArray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its n-word shingles); fewer words are one shingle, none are an empty set.

    A long text takes some 5 bytes for each of its bytes beside itself: its words' hashes and its shingles'.
    """
    for row0, _, data, offsets in chunks(column):
        if len(data) > LONG_BYTES:
            hashes = np.concatenate([Words._found(data[a:b], np.array([0, b - a]))[2] for a, b in pieces(data)])
            first = np.array([0, len(hashes)])
        else:
            w = Words(data, offsets)
            hashes, first = w.hash, w.first
        every = grams(hashes, n)
        short = hashes[: len(hashes) if len(hashes) < n or len(first) > 2 else 0].copy()
        del hashes
        for row in range(len(first) - 1):
            a, b = first[row], first[row + 1]
            if b - a >= n:
                yield row0 + row, _distinct(every[a : b - n + 1])
            elif b > a:
                yield row0 + row, grams(short[a:b], int(b - a))
            else:
                yield row0 + row, every[:0]
