"""Static range asymmetric numeral system over token ids, with numpy.

One frequency table, scaled to 2^SCALE, is shared by all blocks. Inside a block LANES coder
states take the ids in turn (id t goes to lane t mod LANES) and share one stream of 32-bit
words. Every CHECKPOINT steps the states and the place in the stream are kept, so decoding
may begin at any of them; blocks are independent of each other. Each block has a CRC-32 of
its ids (as little-endian 32-bit integers).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 18
LANES = 1024
CHECKPOINT = 128
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<QIII")


class Table:
    """``counts[id]`` scaled so that each id that occurs has a share of at least one."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        if not counts.any():
            counts = np.ones(1, np.int64)
        used = np.flatnonzero(counts)
        size = 1 << SCALE
        if len(used) > size:
            raise ValueError(f"{len(used)} distinct ids do not fit a table of {size}")
        spare = size - len(used)
        exact = counts[used] * (spare / counts[used].sum())
        share = np.floor(exact).astype(np.int64)
        order = np.lexsort((used, share - exact))
        share[order[: spare - share.sum()]] += 1
        self.freq = np.zeros(len(counts), np.uint64)
        self.freq[used] = share + 1
        self.start = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(counts), dtype=np.uint32), self.freq.astype(np.int64))
        self.pad = int(used[0])

    def to_bytes(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes())

    @staticmethod
    def from_bytes(data: bytes) -> Table:
        out = Table.__new__(Table)
        out.freq = np.frombuffer(zlib.decompress(data), "<u4").astype(np.uint64)
        out.start = np.cumsum(out.freq) - out.freq
        out.symbol = np.repeat(np.arange(len(out.freq), dtype=np.uint32), out.freq.astype(np.int64))
        out.pad = int(np.flatnonzero(out.freq)[0])
        return out


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block. Every id must have a share in ``table``."""
    steps = -(-len(ids) // LANES)
    grid = np.full(steps * LANES, table.pad, np.int64)
    grid[: len(ids)] = ids
    freq, start = table.freq[grid].reshape(steps, LANES), table.start[grid].reshape(steps, LANES)
    if len(ids) and not freq.all():
        raise ValueError("an id has no share in the frequency table")
    x = np.full(LANES, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    behind = 0
    bound = np.uint64(63 - SCALE)
    for s in range(steps - 1, -1, -1):
        f = freq[s]
        full = x >= (f << bound)
        out = x[full].astype(np.uint32)
        words.append(out)
        behind += len(out)
        x[full] >>= np.uint64(32)
        q = x // f
        x += start[s]
        x += q * ((np.uint64(1) << np.uint64(SCALE)) - f)
        if s % CHECKPOINT == 0:
            marks.append((behind, x.copy()))
    marks.reverse()
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    head = _HEAD.pack(len(ids), len(marks), len(stream), zlib.crc32(np.asarray(ids).astype("<u4").tobytes()))
    places = np.array([len(stream) - k for k, _ in marks], "<u4").tobytes()
    return head + places + b"".join(state.astype("<u8").tobytes() for _, state in marks) + stream.astype("<u4").tobytes()


def length(block: bytes) -> int:
    """Number of ids in a block."""
    return _HEAD.unpack_from(block)[0]


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a block; with ``first`` and ``last``, those between two checkpoints only. The
    whole block is held against its checksum."""
    n, marks, length, crc = _HEAD.unpack_from(block)
    last = marks if last is None else min(last, marks)
    if first >= last:
        return np.zeros(0, np.uint32)
    at = _HEAD.size
    places = np.frombuffer(block, "<u4", marks, at)
    states = np.frombuffer(block, "<u8", marks * LANES, at + 4 * marks).reshape(marks, LANES)
    stream = np.frombuffer(block, "<u4", length, at + 4 * marks + 8 * marks * LANES).astype(np.uint64)
    x, here = states[first].astype(np.uint64), int(places[first])
    begin, steps = first * CHECKPOINT, min(last * CHECKPOINT, -(-n // LANES))
    out = np.empty((steps - begin, LANES), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for s in range(steps - begin):
        slot = x & mask
        symbol = table.symbol[slot]
        out[s] = symbol
        x = table.freq[symbol] * (x >> np.uint64(SCALE)) + slot - table.start[symbol]
        short = np.flatnonzero(x < _LOW)
        x[short] = (x[short] << np.uint64(32)) | stream[here : here + len(short)]
        here += len(short)
    ids = out.ravel()[: n - begin * LANES]
    if first == 0 and last == marks and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("block checksum does not match its ids")
    return ids
