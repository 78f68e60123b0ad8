"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of a collection of strings.

Round j inserts one symbol of each string, that before its last j symbols: the place of each new suffix follows from the
place of the suffix one shorter by a rank in the transform, and one front-to-back pass merges the new symbols and common
prefixes into the two sequences. Common prefixes are held up to a cap. The sequences are the files of the external-memory
method; a caller bounds the collection, so they are held in memory and rewritten in order, one after the other.

repeated() takes eight bytes as one symbol and each string once for every phase of the eight, so that a collection of
short strings takes an eighth of the rounds; a substring then is the head of a suffix of the phase in which it starts.
"""

from __future__ import annotations

import numpy as np


def _merged(old: np.ndarray, at: np.ndarray, new: np.ndarray, kept: np.ndarray) -> np.ndarray:
    out = np.empty(len(old) + len(new), old.dtype)
    out[at] = new
    out[kept] = old
    return out


def build(symbol_at, size: np.ndarray, start_sign: int, dtype, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of all suffixes in order; ends of strings differ and sort by string, before all symbols.

    symbol_at(strings, j) gives the symbols that stand before the last j ones of strings that are longer than j. Row r's
    common prefix is that with row r - 1, at most cap (below 255). start_sign, above all symbols, stands for "no symbol before".
    """
    m = len(size)
    before = lambda who, j: _or_sign(symbol_at, who, j, size, start_sign, dtype)
    who = np.arange(m)
    row = np.arange(m)  # of the suffix that was inserted last, for each string still in work
    bwt = before(who, 0)
    lcp = np.zeros(m, np.uint8)
    for j in range(1, int(size.max(initial=0)) + 1):
        alive = size[who] >= j
        who, row = who[alive], row[alive]
        order = np.argsort(bwt, kind="stable")
        place_of = np.empty(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        symbol, rank = bwt[row], place_of[row]
        prev, nxt = order[np.maximum(rank - 1, 0)], order[np.minimum(rank + 1, len(order) - 1)]
        has_prev = (rank > 0) & (bwt[prev] == symbol)
        has_next = (rank + 1 < len(order)) & (bwt[nxt] == symbol)
        padded = np.append(lcp, np.uint8(0))
        own_lcp = np.where(has_prev, np.minimum(_range_min(padded, prev + 1, row + 1, has_prev) + 1, cap), 0).astype(np.uint8)
        next_lcp = np.minimum(_range_min(padded, row + 1, nxt + 1, has_next) + 1, cap).astype(np.uint8)
        place = m + rank
        kept = np.ones(len(bwt) + len(row), bool)
        kept[place] = False
        bwt = _merged(bwt, place, before(who, j), kept)
        lcp = _merged(lcp, place, own_lcp, kept)
        lcp[place[has_next] + 1] = next_lcp[has_next]
        row = place
    return bwt, lcp


def _or_sign(symbol_at, who, j, size, sign, dtype):
    out = np.full(len(who), sign, dtype)
    longer = size[who] > j
    out[longer] = symbol_at(who[longer], j)
    return out


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Least of values[first:last] where wanted, else 0. values ends with an element beyond all ranges."""
    out = np.zeros(len(first), np.int64)
    at = np.flatnonzero(wanted)
    if len(at):
        at = at[np.argsort(first[at], kind="stable")]
        pairs = np.empty(2 * len(at), np.int64)
        pairs[::2], pairs[1::2] = first[at], last[at]
        out[at] = np.minimum.reduceat(values, pairs)[::2]
    return out


def repeated(strings: list[bytes], length: int = 200) -> list[np.ndarray]:
    """For each string, which of its substrings of that length, by their start, occur at another place in the collection."""
    width = next(w for w in (8, 5, 4, 3, 2, 1) if length % w == 0)
    data = np.frombuffer(b"".join(strings), np.uint8)
    n = np.array([len(s) for s in strings], np.int64)
    base = np.cumsum(n) - n
    flags = np.zeros(len(data), bool)
    if len(data) >= length:
        groups = np.zeros(len(data) - width + 1, np.uint64)
        for k in range(width):
            groups = (groups << np.uint64(8)) | data[k : len(groups) + k]
        found, ranks = np.unique(groups, return_inverse=True)
        dtype = np.uint8 if len(found) < 255 else np.uint16 if len(found) < 65535 else np.uint32
        ranks = ranks.astype(dtype)
        phase = np.tile(np.arange(width), len(strings))
        first = np.repeat(base, width) + phase
        size = np.maximum(0, (np.repeat(n, width) - phase) // width)
        cap = length // width
        bwt, lcp = build(lambda who, j: ranks[first[who] + width * (size[who] - 1 - j)], size, len(found), dtype, cap)
        shared = lcp >= cap
        shared[:-1] |= shared[1:]
        order = np.argsort(bwt, kind="stable")
        step = np.empty(len(bwt), np.int64)
        step[order] = len(size) + np.arange(len(order))
        who = row = np.arange(len(size))
        for j in range(1, int(size.max(initial=0)) + 1):  # back from each string's end, by the transform
            alive = size[who] >= j
            who, row = who[alive], step[row[alive]]
            if j >= cap:
                flags[first[who] + width * (size[who] - j)] = shared[row]
    return [flags[b : b + max(0, k - length + 1)] for b, k in zip(base.tolist(), n.tolist())]
