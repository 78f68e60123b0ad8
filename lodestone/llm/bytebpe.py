"""The byte-level BPE vocabulary over whole Arrow batches: ids as the tokenizers library gives them."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from lodestone.llm.pieces import CHUNK, LONG, PieceTable, byte_classes, chunks, cut_spaced, flat_bytes, odd_texts

#: Id after the last token of every document.
END_ID = 2


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        model = json.load(open(path))["model"]
        signs = byte_signs()
        of = {bytes(signs[c] for c in token): i for token, i in model["vocab"].items()}
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.dtype = np.uint16 if max(of.values()) < 1 << 16 else np.uint32
        # Pieces are merged by a compiled library where ids are in the order of merges, as its ranks are.
        ordered = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and all(bytes([b]) in of for b in range(256))
        if ordered:
            import tiktoken

            core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=of, special_tokens={})._core_bpe
            self.encode_piece = lambda b: [of[b]] if b in of else core.encode_single_piece(b)
        else:
            self.encode_piece = lambda b: self.library.encode(b.decode(), add_special_tokens=False).ids
        self.table = PieceTable(self.encode_piece, self.dtype)

    def one(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, self.dtype)

    def encode(self, column):
        """Yields (first, offsets, ids): texts from the first on, their ids with END_ID after each, and n+1 offsets."""
        data, offsets = flat_bytes(column)
        for i, j in chunks(offsets, CHUNK):
            yield i, *self._chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def _chunk(self, data: np.ndarray, offsets: np.ndarray):
        m = len(offsets) - 1
        if len(data) == 0:
            return np.arange(m + 1), np.full(m, END_ID, self.dtype)
        if len(data) > LONG:
            parts = [np.append(self.one(data[a:b].tobytes()), self.dtype(END_ID)) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.concatenate(parts)
        classes = byte_classes(data)
        odd = odd_texts(classes, offsets)
        start = cut_spaced(data, offsets, classes)
        end = np.append(start[1:], len(data))
        whole = data.tobytes()
        owner = np.searchsorted(offsets, start, "right") - 1
        if odd.any():  # an odd text is one piece here, replaced below
            held = ~odd[owner]
            start, end, owner = start[held], end[held], owner[held]
        at, n = self.table.lookup(data, start, end)
        extra_at, extra_n = np.full(m, -1, np.int64), np.ones(m, np.int64)
        tail_at, _ = self.table._add([END_ID])
        extra_at[:] = tail_at
        for k in np.flatnonzero(odd):
            extra_at[k], extra_n[k] = self.table._add(np.append(self.one(whole[offsets[k] : offsets[k + 1]]), END_ID))
        where = np.searchsorted(owner, np.arange(m), "right")
        ids = self.table.gather(np.insert(at, where, extra_at), np.insert(n, where, extra_n))
        counts = np.bincount(owner, weights=n, minlength=m).astype(np.int64) + extra_n
        return np.concatenate([[0], np.cumsum(counts)]), ids


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One per worker process, with its table of pieces."""
    return ByteBpe(path)
