"""Splitting many texts into the pieces that BPE never merges across, with whole-array operations on UTF-8 bytes.

Both tokenizers cut a text by a regular expression over letters, digits, white space and the rest. For texts of ASCII
and Latin letters the cuts follow from the class of each byte, its neighbours and the apostrophe rule; texts with
anything else take the tokenizer library. Pieces are looked up, and compared, in a bounded table that a
Python worker keeps between batches; pieces not in it are encoded one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACE, LETTER, DIGIT, OTHER, ODD = range(5)

_CLASS = np.full(256, ODD, np.uint8)
_CLASS[:128] = OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[0x1C:0x20] = ODD
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[0xC3:0xCA] = LETTER  # leads of U+00C0 to U+024F, letters but for two signs
_CLASS[0x80:0xC0] = LETTER  # continuation bytes

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

#: Bytes of text that are handled at once; a longer text is a chunk of its own, up to LONG.
CHUNK = 2 << 20
#: Longer texts take the library, whose memory doesn't grow with such arrays.
LONG = 16 << 20


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, (1 << 20) + (1 << 16))
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array and n+1 offsets; nulls are empty."""
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """(first, last) of runs of texts with about size bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_classes(data: np.ndarray) -> np.ndarray:
    found = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    found[lead[(data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)]] = ODD
    return found


def odd_texts(classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts the class rule can't cut."""
    seen = np.concatenate([[0], np.cumsum(classes == ODD)])
    return seen[offsets[1:]] > seen[offsets[:-1]]


def _contractions(data: np.ndarray, start: np.ndarray, classes: np.ndarray, ends: np.ndarray) -> None:
    """Cut 's 't 're 've 'm 'll 'd where a lone apostrophe begins a piece. ends: of its text, for each apostrophe."""
    n = len(data)
    quotes = np.flatnonzero((data == 39) & start)
    for q, end in zip(quotes.tolist(), ends[quotes].tolist() if len(quotes) else []):
        if q + 1 >= end or classes[q + 1] != LETTER:
            continue
        a, b = data[q + 1], data[q + 2] if q + 2 < end else 0
        k = 1 if a in b"stmd" else 2 if (a, b) in ((114, 101), (118, 101), (108, 108)) else 0
        if k:
            start[q + 1] = False
            if q + 1 + k < n and q + 1 + k < end and classes[q + 1 + k] == LETTER:
                start[q + 1 + k] = True


def _text_ends(offsets: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(offsets[1:], np.diff(offsets))


def cut_spaced(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of pieces where one blank may lead a piece and white space is kept."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(classes[1:], classes[:-1], out=start[1:])
    start |= first[:n]
    before = np.flatnonzero((classes[:-1] == SPACE) & (classes[1:] != SPACE) & ~first[1:n])
    start[before] = True
    start[before + 1] = data[before] != 32
    if (data == 39).any():
        _contractions(data, start, classes, _text_ends(offsets, n))
    return np.flatnonzero(start)


def cut_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces where white space is dropped and each digit stands alone."""
    n = len(data)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(classes[1:], classes[:-1], out=start[1:])
    start[offsets[:-1][offsets[:-1] < n]] = True
    start |= classes == DIGIT
    if (data == 39).any():
        _contractions(data, start, classes, _text_ends(offsets, n))
    at = np.flatnonzero(start)
    end = np.append(at[1:], n)
    held = classes[at] != SPACE
    return at[held], end[held]


def _shuffled(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def two_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight and the next eight bytes of each data[start:end] as numbers, zeros beyond its end."""
    padded = np.append(data, np.zeros(16, np.uint8))
    at = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    size = end - start
    return at[start] & _FIRST[np.minimum(size, 8)], at[start + 8 * (size > 8)] & _FIRST[np.clip(size - 8, 0, 8)]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: of up to 16 bytes by a mixing function, of longer ones by BLAKE2, so that no rule of their letters makes two of them equal."""
    a, b = two_words(data, start, end)
    found = _shuffled(_shuffled(a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + b * np.uint64(0xD6E8FEB86659FD93) + (end - start).astype(np.uint64))
    long = np.flatnonzero(end - start > 16)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        found[long] = [int.from_bytes(hashlib.blake2b(raw[i:j], digest_size=8).digest(), "little") for i, j in zip(start[long].tolist(), end[long].tolist())]
    return found


class PieceTable:
    """Ids of pieces. A piece of up to 16 bytes is compared whole, as two numbers and its length; longer ones are keys of a dictionary.

    At most `room` pieces of either kind are held; beyond that, pieces are encoded each time.
    """

    PROBES = 6

    def __init__(self, encode, dtype, bits: int = 20):
        self.encode, self.mask = encode, np.uint64((1 << bits) - 1)
        self.room, self.held = int(0.6 * (1 << bits)), 0
        self.first, self.second = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.size = np.zeros(1 << bits, np.uint8)  # 0: an empty slot
        self.at = np.zeros(1 << bits, np.int32)
        self.n = np.zeros(1 << bits, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool, self.used = np.zeros(1 << 20, dtype), 0

    def _find(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, home: np.ndarray) -> np.ndarray:
        slot = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for probe in range(self.PROBES):
            at = ((home[left] + np.uint64(probe)) & self.mask).astype(np.int64)
            here = self.size[at]
            hit = (here == size[left]) & (self.first[at] == a[left]) & (self.second[at] == b[left])
            slot[left[hit]] = at[hit]
            left = left[~hit & (here != 0)]
            if not len(left):
                break
        return slot

    def _add(self, ids) -> tuple[int, int]:
        n = len(ids)
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + n] = ids
        self.used += n
        return self.used - n, n

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and count of ids of each piece data[start:end]; no piece is empty."""
        if self.used > 1 << 24:  # what isn't in the table is dropped from the pool by starting anew
            self.size[:] = 0
            self.long.clear()
            self.held = self.used = 0
        raw = memoryview(np.ascontiguousarray(data))
        at, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        short = end - start <= 16
        for k in np.flatnonzero(~short).tolist():
            piece = bytes(raw[start[k] : end[k]])
            spot = self.long.get(piece)
            if spot is None:
                spot = self._add(self.encode(piece))
                if len(piece) <= 4096 and len(self.long) < self.room // 8:
                    self.long[piece] = spot
            at[k], n[k] = spot
        which = np.flatnonzero(short)
        if len(which):
            s, e = start[which], end[which]
            a, b = two_words(data, s, e)
            size = (e - s).astype(np.uint8)
            home = _shuffled(a * np.uint64(0x9E3779B97F4A7C15) + _shuffled(b + size))
            slot = self._find(a, b, size, home)
            missing = np.flatnonzero(slot < 0)
            if len(missing):
                own = np.empty(len(missing), [("a", np.uint64), ("b", np.uint64), ("size", np.uint8)])
                own["a"], own["b"], own["size"] = a[missing], b[missing], size[missing]
                order = np.lexsort((own["size"], own["b"], own["a"]))
                new = np.append(True, own[order][1:] != own[order][:-1])
                number = np.empty(len(missing), np.int64)
                number[order] = np.cumsum(new) - 1
                spots = []
                for k in missing[order[new]].tolist():
                    spot = self._add(self.encode(bytes(raw[s[k] : e[k]])))
                    spots.append(spot)
                    if self.held < self.room:
                        for probe in range(self.PROBES):
                            free = (int(home[k]) + probe) & int(self.mask)
                            if not self.size[free]:
                                self.first[free], self.second[free], self.size[free] = a[k], b[k], size[k]
                                self.at[free], self.n[free] = spot
                                self.held += 1
                                break
                spot = np.array(spots, np.int64).reshape(-1, 2)[number]
                at[which[missing]], n[which[missing]] = spot[:, 0], spot[:, 1]
            known = np.flatnonzero(slot >= 0)
            at[which[known]], n[which[known]] = self.at[slot[known]], self.n[slot[known]]
        return at, n

    def gather(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of all pieces, one after the other."""
        total = int(n.sum())
        if not total:
            return self.pool[:0]
        ends = np.cumsum(n)
        return self.pool[np.repeat(at - (ends - n), n) + np.arange(total)]
