"""Exact BPE with word ends by a backtracking encoder, and decoding by an offset table.

A piece is covered from the left by longest vocabulary matches, found by one Aho-Corasick pass. A token may follow
another only if BPE would never merge across the seam; the table of such pairs is filled as pairs come up. Where no token
fits, the last one gives way to its next shorter prefix in the vocabulary, and an end once left is never tried again, so
the work is linear in the piece. The result is the one that applying merges by rank gives, as the tests show.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bytebpe import byte_signs
from lodestone.llm.common import mapped
from lodestone.llm.pieces import LONG, PieceTable, byte_classes, chunks, cut_words, flat_bytes, odd_texts

CHUNK = 1 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
WORD_END = "</w>"


class Backtracker:
    """Tokens are strings over 512 signs: a byte, or 256 more for the last byte of a piece."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        import ahocorasick

        signs = byte_signs()
        as_text = {}
        for token, i in vocab.items():
            ended = token.endswith(WORD_END)
            raw = [signs[c] for c in (token.removesuffix(WORD_END) if ended else token)]
            as_text[i] = "".join(map(chr, raw[:-1])) + chr(raw[-1] + 256 * ended)
        self.of = {s: i for i, s in as_text.items()}
        # rank: order of creation, base tokens first; split: the two parts a token was merged from
        self.rank = {i: -1 for i in as_text}
        self.split = {i: (i, i) for i in as_text}
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            i = vocab[a + b]
            pair = (vocab[a], vocab[b])
            self.merged.setdefault(pair, i)
            if self.rank[i] < 0:
                self.rank[i], self.split[i] = r, pair
        self.shorter: dict[int, int] = {}
        for s, i in self.of.items():
            for k in range(len(s) - 1, 0, -1):
                if (j := self.of.get(s[:k])) is not None:
                    self.shorter[i] = j
                    break
        self.length = {i: len(s) for i, s in as_text.items()}
        self.matcher = ahocorasick.Automaton()
        for s, i in self.of.items():
            self.matcher.add_word(s, (len(s), i))
        self.matcher.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}

    def _may_follow(self, left: int, right: int) -> bool:
        """Undo the later merge on either side of the seam until nothing is left; a merge across it that BPE would have done by then speaks against the pair."""
        rank, split, merged = self.rank, self.split, self.merged
        limit = 1 << 60
        while True:
            across = merged.get((left, right))
            if across is not None and rank[across] < limit:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # of two equal ranks the left one is merged first, so the right one is undone first
                limit, left = a, split[left][1]
            else:
                limit, right = b + 1, split[right][0]

    def encode(self, piece: bytes) -> list[int]:
        text = piece[:-1].decode("latin-1") + chr(256 + piece[-1])
        whole = self.of.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest = [-1] * n
        for end, (k, i) in self.matcher.iter(text):
            longest[end - k + 1] = i  # a later end is a longer match
        free = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        length, shorter, table = self.length, self.shorter, self.compatible
        while at < n:
            end = at + length[token]
            fits = free[end]
            if fits and out:
                pair = (out[-1], token)
                fits = table.get(pair)
                if fits is None:
                    if len(table) > 2_000_000:
                        table.clear()
                    fits = table[pair] = self._may_follow(*pair)
            if fits:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif token in shorter:
                token = shorter[token]
            else:
                free[at] = 0
                token = out.pop()
                at -= length[token]
        return out


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        spec = json.load(open(path))
        model = spec["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.backtracker = Backtracker(model["vocab"], merges)
        self.signs = byte_signs()
        names = dict((i, t) for t, i in model["vocab"].items()) | {x["id"]: x["content"] for x in spec["added_tokens"]}
        texts = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.letters = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        self.table = PieceTable(self.backtracker.encode, np.uint16 if len(texts) <= 1 << 16 else np.uint32)

    def one(self, text: str) -> list[int]:
        """A text of any letters: the library's rules for folding and cutting, our encoder for the pieces."""
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [i for piece, _ in cut for i in self.backtracker.encode(bytes(self.signs[c] for c in piece))]

    def encode(self, column):
        """Yields (first, offsets, ids) for runs of texts."""
        data, offsets = flat_bytes(column)
        for i, j in chunks(offsets, CHUNK):
            yield i, *self._chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def _chunk(self, data: np.ndarray, offsets: np.ndarray):
        m = len(offsets) - 1
        kind = self.table.pool.dtype
        if len(data) == 0 or len(data) > LONG:
            parts = [np.array(self.one(data[a:b].tobytes().decode()), kind) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64), np.concatenate(parts)
        classes = byte_classes(data)
        odd = odd_texts(classes, offsets)
        odd |= np.bincount(np.searchsorted(offsets, np.flatnonzero(self._unsure(data)), "right") - 1, minlength=m)[:m] > 0
        lowered = self._lowered(data)
        start, end = cut_words(lowered, offsets, classes)
        owner = np.searchsorted(offsets, start, "right") - 1
        if odd.any():
            held = ~odd[owner]
            start, end, owner = start[held], end[held], owner[held]
        at, n = self.table.lookup(lowered, start, end)
        counts = np.bincount(owner, weights=n, minlength=m).astype(np.int64)
        if odd.any():
            raw = data.tobytes()
            where, spots = [], []
            for k in np.flatnonzero(odd).tolist():
                spots.append(self.table._add(self.one(raw[offsets[k] : offsets[k + 1]].decode())))
                where.append(np.searchsorted(owner, k))
                counts[k] = spots[-1][1]
            at, n = np.insert(at, where, [x[0] for x in spots]), np.insert(n, where, [x[1] for x in spots])
        return np.concatenate([[0], np.cumsum(counts)]), self.table.gather(at, n)

    @staticmethod
    def _unsure(data: np.ndarray) -> np.ndarray:
        """Letters whose small form isn't one that is a step of 32 away: U+0100 and later take the library's rules."""
        return (data >= 0xC4) & (data < 0xCA)

    @staticmethod
    def _lowered(data: np.ndarray) -> np.ndarray:
        out = data.copy()
        out[(data >= 65) & (data <= 90)] += 32
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        big = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E)]
        out[big] += 32
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with a blank between them."""
        a, n = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1] - self.offsets[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ids) else 0
        return self.letters[np.repeat(a - (ends - n), n) + np.arange(total)][:-1].tobytes()


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _coder(vocabulary: str):
    def run(batches):
        import pyarrow as pa

        bpe = word_bpe(vocabulary)
        for batch in batches:
            docs = batch.column(0)
            for i, offsets, ids in bpe.encode(batch.column(1)):
                wide = ids.astype("<u4")
                tokens = bpe.offsets[ids.astype(np.int64) + 1] - bpe.offsets[ids]
                letters = np.concatenate([[0], np.cumsum(tokens)])[offsets]
                text = memoryview(bpe.decode(ids) + b" ") if len(ids) else memoryview(b"")
                out = []
                for k in range(len(offsets) - 1):
                    a, b = offsets[k], offsets[k + 1]
                    decoded = text[letters[k] : letters[k + 1] - 1] if b > a else b""
                    out.append((int(b - a), hashlib.sha256(wide[a:b]).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                n, own, back = zip(*out)
                yield pa.RecordBatch.from_arrays([docs.slice(i, len(n)), pa.array(n, pa.int64()), pa.array(own), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def coded(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of its whole text; a null text is empty and has no ids.

    Rows that repeat others give repeated rows, null ids stay null, no rows give none; other columns play no part.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return mapped(rows, _coder(vocabulary), SCHEMA)
