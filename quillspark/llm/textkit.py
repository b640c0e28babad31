"""Word and window hashing over Arrow string columns with numpy.

Texts are handled as UTF-8 bytes. Every word class used here is decided by ASCII bytes
alone (a byte of 0x80 or more is always a word byte), so byte positions and code points
agree. Memory follows the slice of rows in hand, see :func:`slices`. Hashes are for finding
candidates and drawing samples; what must be equal is told by :meth:`Words.distinct` and
:func:`window_numbers`, which compare bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_SEED = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD1B54A32D192ED03 | 1)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Pieces of more bytes are hashed one by one.
_LONG = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words split at ASCII white space: [^\x20\x09-\x0D]
SPACED = ~_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words of digits, letters and whatever is not ASCII.
ALNUM = ~_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def pieces_of(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large binary array without nulls, and n + 1 offsets."""
    _, offsets, data = names.buffers()
    at = np.frombuffer(offsets, np.int64)[names.offset : names.offset + len(names) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and len(names) else np.zeros(0, np.uint8)), at


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, cut so that ``column`` holds about ``most`` bytes in each slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces buf[start[i]:end[i]]: eight bytes at a time go through the
    finaliser, pieces of more than _LONG bytes through BLAKE2b."""
    size = np.asarray(end - start, np.int64)
    out = mix(size.astype(np.uint64) + _SEED)
    lanes = _lanes(buf)
    at = np.flatnonzero(size <= _LONG)
    place, left = start[at], size[at]
    while len(at):
        out[at] = mix(out[at] ^ (lanes[place] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        at, place, left = at[more], place[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))


def same_bytes(one: np.ndarray, start: np.ndarray, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether one[start[i]:start[i] + size[i]] is other[at[i]:at[i] + size[i]]."""
    x, y = _lanes(one), _lanes(other)
    out = np.ones(len(start), bool)
    open_, left = np.arange(len(start)), np.asarray(size, np.int64)
    start, at = np.asarray(start, np.int64), np.asarray(at, np.int64)
    while len(open_):
        equal = (x[start] ^ y[at]) & _MASKS[np.minimum(left, 8)] == 0
        out[open_[~equal]] = False
        more = equal & (left > 8)
        open_, start, at, left = open_[more], start[more] + 8, at[more] + 8, left[more] - 8
    return out


def binaries(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """``data`` cut into pieces of these sizes."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Words:
    """Words of a column: ``start``, ``end`` (byte positions in ``buf``), ``hash`` (64 bits
    each) and ``first`` (n + 1 positions, those of row i are first[i]:first[i + 1])."""

    def __init__(self, column: pa.Array, table: np.ndarray, lower: bool = True, hashed: bool = True):
        buf, self.offsets = strings(column)
        self.buf = _LOWER[buf] if lower else buf
        self.inside = inside = table[self.buf]
        n = len(inside)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(len(self.offsets), np.int64)
            return
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        left = inside.copy()
        left[1:] &= ~inside[:-1] | edge[1:n]
        right = inside.copy()
        right[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(left)
        self.end = np.flatnonzero(right) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = hashes(self.buf, self.start, self.end) if hashed else None

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def encoded(self) -> pa.DictionaryArray:
        """The words as numbers of distinct words; bytes are compared."""
        return binaries(self.buf[self.inside], self.end - self.start).dictionary_encode()

    def distinct(self) -> tuple[np.ndarray, pa.Array]:
        """The number of each word among the distinct words, and these."""
        found = self.encoded()
        return found.indices.to_numpy(), found.dictionary

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with a blank after each, and where each word begins (and the end)."""
        at = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start + 1, out=at[1:])
        out = np.full(at[-1], 0x20, np.uint8)
        own = np.ones(at[-1], bool)
        own[at[1:] - 1] = False
        out[own] = self.buf[self.inside]
        return out, at

    def digests(self) -> list[bytes | None]:
        """For each row 128 bits of a digest of its sequence of words, None without words."""
        data, at = self.joined()
        ends = at[self.first].tolist()
        return [hashlib.blake2b(data[a : b - 1].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(ends, ends[1:])]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive values (ordered); len - n + 1 of them, or none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k, p in enumerate(powers(_Q, n)):
        out += hashes[k : k + len(out)] * p
    return mix(out + np.uint64(n))


def shingle_hashes(words: Words, n: int) -> list[np.ndarray]:
    """For each row the hashes of its ``n``-word shingles, repeats included; of fewer words, but
    not none, the whole sequence is one shingle."""
    every = windows(words.hash, n)
    bounds = words.first.tolist()
    return [every[a : b - n + 1] if b - a >= n else windows(words.hash[a:b], b - a) if b > a else every[:0] for a, b in zip(bounds, bounds[1:])]


def window_numbers(code: np.ndarray, first: np.ndarray, n: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """``n``-word windows of rows of word numbers (below ``kinds``; row i has first[i]:first[i + 1]):
    a number for each, equal for equal windows only, and the n + 1 places where a row's begin. A
    row of fewer than ``n`` words, but not none, is one window."""
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(count, out=bounds[1:])
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], count)
    last = np.repeat(first[1:], count)
    key, room = np.zeros(len(at), np.int64), 1
    for k in range(n):
        if room > (1 << 62) // (kinds + 1):
            names, key = np.unique(key, return_inverse=True)
            room = len(names)
        # Beyond a short row's end stands the number ``kinds``.
        own = code[np.minimum(at, len(code) - 1)] if len(at) else code[:0]
        key = key * (kinds + 1) + np.where(at < last, own, kinds)
        room *= kinds + 1
        at = at + 1
    return key, bounds


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """For each row its distinct ``n``-word shingles as sorted numbers (see
    :func:`window_numbers`), to be compared among these rows only."""
    code, names = words.distinct()
    key, bounds = window_numbers(code, words.first, n, len(names))
    return [np.unique(key[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
