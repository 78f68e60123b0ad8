"""Static range asymmetric numeral system over token ids, many interleaved states at a time.

A file holds one frequency table and blocks that decode without each other. In a block, state l of LANES codes the
ids at places l, l + LANES, ...; every SEGMENT steps a checkpoint keeps the states and the place in the word stream, and
each segment has a checksum, so that parts of a block decode in parallel and damage is found where it lies.

Layout, little-endian: header; sorted ids and their frequencies; per block a header, and per segment its first
word, its checksum and its states; then the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LRA1"
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 2048
SEGMENT = 256
BLOCK = 1 << 20
_HEAD, _BLOCK = struct.Struct("<4sBIII"), struct.Struct("<IIII")


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 1 << SCALE_BITS, at least 1 for each id that occurs."""
    total = 1 << SCALE_BITS
    if len(counts) > total:
        raise ValueError("more distinct ids than the table's scale")
    freq = np.maximum(1, (counts.astype(np.float64) * (total / counts.sum())).astype(np.int64))
    over = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    for i in order:
        if over <= 0:
            break
        cut = min(over, int(freq[i]) - 1)
        freq[i] -= cut
        over -= cut
    return freq


class Table:
    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def _encode_block(places: np.ndarray, table: Table) -> bytes:
    n = len(places)
    lanes = max(1, min(LANES, -(-n // SEGMENT)))
    steps = -(-n // lanes)
    freq, first = table.freq[places], table.first[places]
    shift, word = np.uint64(SCALE_BITS), np.uint64(32)
    most = np.uint64((1 << 31 >> SCALE_BITS) << 32)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    kept: dict[int, tuple[np.ndarray, int]] = {}
    count = 0
    for t in range(steps - 1, -1, -1):
        f, c = freq[t * lanes : (t + 1) * lanes], first[t * lanes : (t + 1) * lanes]
        x = state[: len(f)]
        full = x >= most * f
        if full.any():
            out = x[full]
            words.append((out & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            count += len(out)
            x = np.where(full, x >> word, x)
        q = x // f
        state[: len(f)] = (q << shift) + (x - q * f) + c
        if t % SEGMENT == 0:
            kept[t] = (state.copy(), count)
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    parts = [_BLOCK.pack(n, lanes, len(kept), len(stream))]
    raw = table.ids[places].astype("<u4")
    for t in sorted(kept):
        own = raw[t * lanes : (t + SEGMENT) * lanes]
        parts.append(struct.pack("<II", count - kept[t][1], zlib.crc32(own.tobytes())) + kept[t][0].astype("<u8").tobytes())
    return b"".join([*parts, stream.astype("<u4").tobytes()])


def encode_file(ids: np.ndarray) -> bytes:
    """A file of all ids."""
    found, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
    table = Table(found, normalised(counts) if len(found) else np.zeros(0, np.int64))
    blocks = [_encode_block(places[i : i + BLOCK], table) for i in range(0, len(ids), BLOCK)]
    listed = np.stack([table.ids, table.freq.astype(np.uint32)]).astype("<u4")
    listed[0, 1:] = np.diff(table.ids)
    packed = zlib.compress(listed.tobytes(), 1)
    sizes = np.array([len(b) for b in blocks], "<u4").tobytes()
    return b"".join([_HEAD.pack(MAGIC, SCALE_BITS, len(found), len(packed), len(blocks)), packed, sizes, *blocks])


def _decode_segment(block: memoryview, index: int, table: Table) -> np.ndarray:
    """The ids of one segment of a block, from its checkpoint."""
    n, lanes, segments, n_words = _BLOCK.unpack_from(block)
    step = 8 + 8 * lanes
    at = _BLOCK.size + index * step
    word_at, crc = struct.unpack_from("<II", block, at)
    state = np.frombuffer(block, "<u8", lanes, at + 8).astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, _BLOCK.size + segments * step)
    first, last = index * SEGMENT * lanes, min(n, (index + 1) * SEGMENT * lanes)
    out = np.empty(last - first, np.uint32)
    mask, shift, word = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    for i in range(0, last - first, lanes):
        x = state[: min(lanes, last - first - i)]
        low = x & mask
        sym = table.slots[low]
        out[i : i + len(x)] = sym
        x = table.freq[sym] * (x >> shift) + low - table.first[sym]
        short = np.flatnonzero(x < LOW)
        if len(short):
            x[short] = (x[short] << word) | words[word_at : word_at + len(short)]
            word_at += len(short)
        state[: len(x)] = x
    ids = table.ids[out]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError(f"segment {index} is damaged")
    return ids


class File:
    """Reads a file; segments() lists what can be decoded on its own."""

    def __init__(self, data: bytes):
        magic, bits, n, packed, blocks = _HEAD.unpack_from(data)
        if magic != MAGIC or bits != SCALE_BITS:
            raise ValueError("not a token file")
        at = _HEAD.size
        listed = np.frombuffer(zlib.decompress(data[at : at + packed]), "<u4").reshape(2, n)
        self.table = Table(np.cumsum(listed[0], dtype=np.uint32), listed[1])
        at += packed
        sizes = np.frombuffer(data, "<u4", blocks, at).astype(np.int64)
        ends = at + 4 * blocks + np.cumsum(sizes)
        view = memoryview(data)
        self.blocks = [view[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]

    def segments(self) -> list[tuple[int, int]]:
        return [(b, i) for b, block in enumerate(self.blocks) for i in range(_BLOCK.unpack_from(block)[2])]

    def decode(self, segments: list[tuple[int, int]] | None = None) -> np.ndarray:
        parts = [_decode_segment(self.blocks[b], i, self.table) for b, i in (self.segments() if segments is None else segments)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
