"""Toxicity of documents whose words may be disguised.

A noisy channel turns words into digits and signs for letters, letters set apart, and letters repeated. Tokens that may
be disguised become a lattice of letters; the Viterbi path under the channel's costs and a character model of the whole corpus is the restored word. Restored words
take the place of the disguised ones in the text that is scored: a logistic regression on hashed words and beginnings of words,
learnt from labelled documents, TRAIN_ROWS and TRAIN_BYTES at most.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.chars import SIGNS, letter_model
from lodestone.llm.common import fold_column, mapped, settled
from lodestone.llm.pieces import chunks, flat_bytes
from lodestone.llm.repeats import _digests, _mixed, _sums

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Labelled documents that the regression is fitted on at most, bytes of their texts, and bits of the feature table.
TRAIN_ROWS, TRAIN_BYTES, BITS = 4000, 128 << 20, 20
MASK = (1 << BITS) - 1
#: Bytes of a word's beginning that are a feature.
BEGINNINGS = (4, 5, 6, 7)
#: Features in use at most, how many standard errors their log odds lie from none, and the pull of weights to zero.
CHOSEN, SURE, PULL = 3000, 3.0, 1.0

#: Letters that a sign may stand for, with the channel's cost.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "2": "z", "6": "gb", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SUBSTITUTED, DROPPED_SIGN, KEPT_DOUBLE, DROPPED_REPEAT, SPLIT = 1.0, 0.5, 0.7, 0.3, 1.0
GAPS = " \t\r\n\xa0.,;:/\\-_*~'"

#: Letters of any script, what may stand for one, and what may set letters apart.
_LETTER, _SIGN, _GAP = r"[^\W\d_]", "@$!|+(€£¡", r"[\s.,;:/\\\-_*~']"
_SPACED = rf"(?<![^\W_])(?:[^\W_]|[@$!])(?:{_GAP}++(?:[^\W_]|[@$!])(?![^\W_])){{2,}}"
_LEET = rf"(?<![\w{_SIGN}])(?=[\d_{_SIGN}]*{_LETTER}){_LETTER}*+[0-9{_SIGN}][\w{_SIGN}]*"
_GAPPED = rf"(?<!{_LETTER}){_LETTER}++(?:[*._~\-,/]++{_LETTER}++)+"
_REPEATED = rf"(?<!{_LETTER}){_LETTER}*?({_LETTER})(?i:\1){_LETTER}*"
SUSPECT = re.compile("|".join(f"(?:{x})" for x in (_SPACED, _LEET, _GAPPED, _REPEATED)))
_GAPS, _DOUBLE = re.compile(f"{_GAP}+"), re.compile(rf"([\w{_SIGN}])(?i:\1)")
ALL_KEPT = 1e6
#: Signs of a token whose lattice is held at once.
WIDEST = 1024


def restore(token: str, model: np.ndarray, dropped: float = DROPPED_REPEAT) -> str:
    """The likeliest letters behind a token: a Viterbi pass over its lattice, states being the last three letters and the last sign read.

    A gap holds nothing or is the end of a word, as the model has it. Letters beyond a-z stand for themselves. dropped is the cost of a repeat that doesn't count.
    """
    states: dict[tuple[int, str], tuple[float, tuple | None, str]] = {(0, ""): (0.0, None, "")}
    trail: list[dict] = []
    for c in token.lower():
        new: dict[tuple[int, str], tuple[float, tuple, str]] = {}

        def step(state, cost, letter, last):
            context = state[0]
            if letter == " ":
                cost -= float(model[context, 0])
                context = 0
            elif "a" <= letter <= "z":
                cost -= float(model[context, ord(letter) - 96])
                context = (context * SIGNS + ord(letter) - 96) % SIGNS**3
            elif letter:
                context = context * SIGNS**2 % SIGNS**3  # two bytes or more that are no letters to the model
            to = (context, last)
            if to not in new or cost < new[to][0]:
                new[to] = (cost, state, letter)

        for state, (cost, _, _) in states.items():
            if c not in LEET and c not in GAPS and c.isalpha():
                if state[1] == c:  # a repeat counts or it doesn't
                    step(state, cost + dropped, "", c)
                    step(state, cost + KEPT_DOUBLE, c, c)
                else:
                    step(state, cost, c, c)
            else:
                for x in LEET.get(c, ""):
                    if state[1] == c:
                        step(state, cost + dropped, "", c)
                        step(state, cost + KEPT_DOUBLE, x, c)
                    else:
                        step(state, cost + SUBSTITUTED, x, c)
                if c in GAPS:
                    step(state, cost, "", state[1])
                    if state[0]:
                        step(state, cost + SPLIT, " ", "")
                elif c not in LEET or c in _SIGN and dropped < ALL_KEPT:  # it may be mere punctuation
                    step(state, cost + DROPPED_SIGN * (1 + 4 * (c in LEET)), "", state[1])
        trail.append(new)
        states = new
    if not states:
        return ""
    end = min(states, key=lambda s: states[s][0] - float(model[s[0], 0]))
    letters = []
    for column in reversed(trail):
        _, before, letter = column[end]
        letters.append(letter)
        end = before
    return "".join(reversed(letters)).strip()


def collapsed(token: str, model: np.ndarray) -> str:
    """As restore(), for a token of letters alone: each run of one letter counts once or more often."""
    states = {0: (0.0, "")}
    for c, run in groupby(token.lower()):
        r, n = sum(1 for _ in run), ord(c) - 96 if "a" <= c <= "z" else 0
        new: dict[int, tuple[float, str]] = {}
        for context, (cost, word) in states.items():
            for k in range(1, min(r, 6) + 1):
                if n:
                    cost -= float(model[context, n])
                    context = (context * SIGNS + n) % SIGNS**3
                else:
                    context = context * SIGNS**2 % SIGNS**3
                cost += KEPT_DOUBLE * (k > 1)
                # from the fourth on every further letter costs the same, so few or all of them are best
                more = r - 6 if k == 6 else 0
                step = KEPT_DOUBLE - (float(model[context, n]) if n else 0.0)
                for total, kept in ((cost + DROPPED_REPEAT * (r - k), k), (cost + more * step, r))[: 1 + (more > 0)]:
                    if context not in new or total < new[context][0]:
                        new[context] = (total, word + c * kept)
        states = new
    return min(((cost - float(model[context, 0]), word) for context, (cost, word) in states.items()), default=(0.0, ""))[1]


class Restorer:
    """Reads texts token by token and remembers what it has seen, as most tokens come again and again."""

    #: A letter or sign by itself, which may be one of a word whose letters are set apart.
    ALONE = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!])(?![^\W_])")
    PLAIN, DISGUISED, APART = range(3)
    MOST = 150_000

    def __init__(self, model: np.ndarray):
        self.model, self.known, self.kinds = model, {}, {}

    def _readings(self, token: str) -> str:
        """What a suspect token may say: its restoration, and the token itself where that is a reading too."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > self.MOST:
                self.known.clear()
            if token.isalpha():
                readings = {collapsed(token, self.model): None, token.lower(): None}
            else:
                readings = {self._restored(token): None}
                if _DOUBLE.search(token):  # the model always likes fewer letters better, so the word with all of them is told too
                    readings[self._restored(token, ALL_KEPT)] = None
            self.known[token] = found = " ".join(readings)
        return found

    def _restored(self, token: str, dropped: float = DROPPED_REPEAT) -> str:
        """A token of more than WIDEST signs is restored in parts, as the lattice is held whole."""
        return "".join(restore(token[i : i + WIDEST], self.model, dropped) for i in range(0, len(token), WIDEST))

    def _kind(self, token: str) -> int:
        if len(self.kinds) > self.MOST:
            self.kinds.clear()
        kind = self.APART if self.ALONE.search(token) else self.DISGUISED if SUSPECT.search(token) else self.PLAIN
        if len(token) <= 64:
            self.kinds[token] = kind
        return kind

    def words(self, text: str) -> list[str]:
        """Readings of suspect tokens that don't stand in the text as they are."""
        out = []
        for m in SUSPECT.finditer(text):
            plain = _GAPS.sub(" ", m[0].lower()).strip(f" {_SIGN}")
            readings = self._readings(m[0]).split(" ") if " " not in plain else [self._readings(m[0])]
            if left := " ".join(w for w in readings if w != plain):
                out.append(left)
        return out

    def restored(self, text: str) -> str:
        """The text, one blank between words, with readings in the place of suspect tokens."""
        tokens = text.split()
        kinds = [self.kinds.get(t) for t in tokens]
        if None in kinds:
            kinds = [self._kind(t) if k is None else k for t, k in zip(tokens, kinds)]
        odd = [i for i, k in enumerate(kinds) if k]
        if not odd:
            return text
        out, at = [], 0
        for i in odd:
            if i < at:
                continue
            out += tokens[at:i]
            at = i + 1
            if kinds[i] == self.APART:  # with its neighbours, as letters may be set apart by blanks
                while at < len(tokens) and kinds[at] == self.APART:
                    at += 1
            out.append(SUSPECT.sub(lambda m: self._readings(m[0]), " ".join(tokens[i:at])))
        return " ".join(out + tokens[at:])


_WORD = np.zeros(256, bool)
_WORD[97:123] = _WORD[48:58] = _WORD[128:] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of each text, and n+1 offsets: its words and beginnings of words, and whether they come once, twice, four or eight times."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    data[lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E)]] += 32
    word = _WORD[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    sums, owner = _sums(data, 0), (np.searchsorted(offsets, a, "right") - 1) << BITS
    shift = np.uint64(64 - BITS)
    parts = [owner | (_digests(sums, a, b) >> shift).astype(np.int64)]
    for k in BEGINNINGS:
        long = b - a > k
        parts.append(owner[long] | (_mixed(_digests(sums, a[long], a[long] + k)) >> shift).astype(np.int64))
    every = np.sort(np.concatenate(parts))
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    times = np.diff(np.append(first, len(every)))
    once = every[first]
    levels = [once]
    for n in (2, 4, 8):
        many = once[times >= n]
        levels.append((many >> BITS << BITS) | (_mixed((many & MASK).astype(np.uint64) + np.uint64(n << 32)) >> shift).astype(np.int64))
    both = np.sort(np.concatenate(levels))
    both = both[np.append(True, both[1:] != both[:-1])]
    return both & MASK, np.searchsorted(both >> BITS, np.arange(len(texts) + 1))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on the features that tell the labels apart best; the last one is the constant."""
    weights = np.zeros((1 << BITS) + 1)
    y = labels.astype(np.float64)
    if not 0 < y.sum() < len(y):
        return weights
    with_, all_ = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r, label in zip(rows, y):  # a row's features are distinct
        all_[r] += 1
        if label:
            with_[r] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    c1, c0 = with_ + 0.5, all_ - with_ + 0.5
    odds = np.log(c1 / (n1 - with_ + 0.5)) - np.log(c0 / (n0 - (all_ - with_) + 0.5))
    sure = np.abs(odds) / np.sqrt(1 / c1 + 1 / (n1 - with_ + 0.5) + 1 / c0 + 1 / (n0 - (all_ - with_) + 0.5))
    best = np.argsort(-sure, kind="stable")[:CHOSEN]
    best = best[(sure[best] >= SURE) & (all_[best] > 2)]
    number = np.full(1 << BITS, -1, np.int32)
    number[best] = np.arange(len(best))
    kept = [c[c >= 0] for c in (number[r] for r in rows)]
    col, row = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(c) for c in kept])
    w, b = np.zeros(len(best)), np.log(n1 / n0)
    balance = np.where(y == 1, len(y) / n1, len(y) / n0) / 2
    memory_w, memory_b = np.full(len(best), 1e-8), 1e-8
    for _ in range(400):
        z = np.bincount(row, weights=w[col], minlength=len(y)) + b
        g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.bincount(col, weights=g[row], minlength=len(best)) + PULL * w
        memory_w += gw * gw
        memory_b += g.sum() ** 2
        w -= 0.2 * gw / np.sqrt(memory_w)
        b -= 0.2 * g.sum() / np.sqrt(memory_b)
    weights[best], weights[-1] = w, b
    return weights


def calibrated(rows: list[np.ndarray], labels: np.ndarray, share: float) -> np.ndarray:
    """Weights fitted on all rows, then scaled and shifted by what four fits that each leave out a quarter say of that quarter, at the labels' true share."""
    if not 0 < labels.sum() < len(labels):
        return fit(rows, labels)
    order = np.random.default_rng(6).permutation(len(rows))
    z = np.zeros(len(rows))
    for q in range(4):
        rest, held = order[np.arange(len(order)) % 4 != q], order[q::4]
        own = fit([rows[i] for i in rest], labels[rest])
        z[held] = [own[rows[i]].sum() + own[-1] for i in held]
    y = labels
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    line = np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(50):  # Newton's steps, with a pull towards the slope 1 that keeps separable rows finite
        q = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        gradient = x.T @ (weight * (q - y)) + 0.05 * (line - [1, 0])
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        line = line - step * min(1, 2 / np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    weights = fit(rows, labels) * line[0]
    weights[-1] += line[1]
    return weights


def score(weights: np.ndarray, found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(weights[found])])
    z = sums[offsets[1:]] - sums[offsets[:-1]] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _texts(column, restorer: Restorer):
    """Yields (first, restored texts in UTF-8)."""
    _, offsets = flat_bytes(column)
    for i, j in chunks(offsets, 1 << 19):
        own = column.slice(i, j - i).to_pylist()
        yield i, [restorer.restored(t).encode() for t in own]


@lru_cache(maxsize=2)
def _restorer(raw: bytes) -> Restorer:
    return Restorer(np.frombuffer(raw, np.float32).reshape(-1, SIGNS))


def _sampler(model):
    def run(batches):
        import pyarrow as pa

        restorer = _restorer(model.value)
        for batch in batches:
            for i, texts in _texts(batch.column(0), restorer):
                found, at = features(texts)
                rows = [found[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, len(texts)), pa.array(rows, pa.binary())], names=["label", "features"])

    return run


def _scorer(model, weights):
    """Rows with a column __text, which becomes __score."""

    def run(batches):
        import pyarrow as pa

        restorer, w = _restorer(model.value), np.frombuffer(weights.value, np.float32).astype(np.float64)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            others = [k for k in range(batch.num_columns) if k != at]
            for i, texts in _texts(batch.column(at), restorer):
                own = [batch.column(k).slice(i, len(texts)) for k in others] + [pa.array(score(w, *features(texts)))]
                yield pa.RecordBatch.from_arrays(own, names=[batch.schema.names[k] for k in others] + ["__score"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, most_bytes: int = TRAIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """(text, label) of labelled documents outside the held-out fold, and all such labels.

    At most `most` documents, each label equally welcome, chosen by a hash of the id, and in that order as many as come to `most_bytes` of text; an
    id that several rows have counts once, with the text of the least hash.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(fold_column(F.col("doc_id"), folds) != held_out)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    key, half = F.xxhash64("doc_id"), most // 2
    chosen = known.where("label = 1").orderBy(key).limit(half).unionByName(known.where("label = 0").orderBy(key).limit(half))
    text = F.coalesce("text", F.lit(""))
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("th", F.octet_length("text").alias("size"))).alias("own"))
    within = F.sum("own.size").over(Window.partitionBy("label").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))  # `most` rows in all
    found = settled(found.withColumn("bytes", within).where(F.col("bytes") <= most_bytes // 2).select("doc_id", "own.th", "label"))
    return texts.join(F.broadcast(found), ["doc_id", "th"]).dropDuplicates(["doc_id"]).select("text", "label"), known


def with_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column __score, learnt from labels (doc_id, toxic) of rows outside the held-out fold."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(letter_model(docs).tobytes())
    training, known = training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, TRAIN_ROWS)
    sample = mapped(training, _sampler(model), "label int, features binary").toPandas()
    y = sample["label"].to_numpy().astype(np.float64)
    found = [np.frombuffer(x, "<i4") for x in sample["features"]]
    fitted = calibrated(found, y, known.agg(F.avg("label")).first()[0] or 0.0)
    weights = spark.sparkContext.broadcast(fitted.astype(np.float32).tobytes())
    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    return mapped(docs.withColumn("__text", F.coalesce("text", F.lit(""))), _scorer(model, weights), schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    held_out: crc32 of the id as text, modulo 4, is 2. Such rows, null ids and null labels are not learnt from; an id with
    several label rows counts once, as toxic if any says so. Null texts are empty and scored like any text. Without labels
    every score is one half. Rows that repeat others give repeated rows; other columns play no part; no rows in, no rows out.
    """
    found = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    held_out = fold_column(F.col("doc_id"), FOLDS) == HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic."""
    return with_scores(docs, labels).where(F.col("__score") < THRESHOLD).drop("__score")
