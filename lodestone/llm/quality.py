"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of about PASSAGE bytes. Each passage is encoded from shares of byte classes, of hashed byte pairs and
of repeated words; gated attention weighs the passages, and a logistic output scores the weighted sum. Encoder, attention and
output are learnt together from document labels alone, on at most TRAIN_ROWS labelled documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fold_column, mapped
from lodestone.llm.pieces import chunks, flat_bytes
from lodestone.llm.repeats import _digests, _sums
from lodestone.llm.toxicity import training_rows

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
PASSAGE = 512
TRAIN_ROWS = 4000
PAIRS, HIDDEN, GATE = 128, 32, 16
EPOCHS, BATCH, RATE = 30, 64, 3e-3

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!?", b"|", b"%&$#@*", b";:", b"()[]{}<>", b"\"'`", b"=+-_/\\~^"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
_CLASS[128:] = len(_CLASSES) + 1
_KINDS = len(_CLASSES) + 2
WIDTH = _KINDS + PAIRS + 5


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages (float32 rows) of each text, at least one a text, and n+1 offsets."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // PASSAGE))
    bags = np.concatenate([[0], np.cumsum(count)])
    total = int(bags[-1])
    text = np.repeat(np.arange(len(size)), count)
    start = offsets[text] + (np.arange(total) - bags[text]) * PASSAGE
    end = np.minimum(start + PASSAGE, offsets[text + 1])
    length = np.maximum(1, end - start).astype(np.float32)
    owner = np.repeat(np.arange(total), end - start)
    out = np.zeros((total, WIDTH), np.float32)
    if len(data):
        kinds = np.bincount(owner * _KINDS + _CLASS[data], minlength=total * _KINDS).reshape(total, _KINDS)
        out[:, :_KINDS] = kinds / length[:, None]
        pair = (data[:-1].astype(np.int64) * 31 + data[1:] * 7) % PAIRS
        pairs = np.bincount(owner[:-1] * PAIRS + pair, minlength=total * PAIRS).reshape(total, PAIRS)
        out[:, _KINDS : _KINDS + PAIRS] = np.sqrt(pairs / length[:, None])
        word = data > 32
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(a):
            of = owner[a]
            n = np.bincount(of, minlength=total)
            key = np.unique((of.astype(np.uint64) << np.uint64(32)) | (_digests(_sums(data, 0), a, b) >> np.uint64(32)))
            distinct = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=total)
            more = out[:, _KINDS + PAIRS :]
            more[:, 0] = distinct / np.maximum(1, n)
            more[:, 1] = np.bincount(of, weights=b - a, minlength=total) / np.maximum(1, n) / 10
            more[:, 2] = n / length
    out[:, -2] = (np.log1p(size) / 10)[text]
    out[:, -1] = 1
    return out, bags


def _initial(rng) -> dict[str, np.ndarray]:
    draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    return {"W": draw(WIDTH, HIDDEN), "c": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE, 1)[:, 0], "o": draw(HIDDEN, 1)[:, 0], "b": np.zeros(1)}


def forward(p: dict, x: np.ndarray, bags: np.ndarray):
    """Scores of bags, and what the gradient needs."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    h = np.tanh(((x - p["mean"]) / p["scale"]) @ p["W"] + p["c"])
    t, g = np.tanh(h @ p["V"]), sig(h @ p["U"])
    e = (t * g) @ p["w"]
    owner = np.repeat(np.arange(len(bags) - 1), np.diff(bags))
    e = np.exp(e - np.maximum.reduceat(e, bags[:-1])[owner])
    a = e / np.add.reduceat(e, bags[:-1])[owner]
    z = np.add.reduceat(h * a[:, None], bags[:-1], axis=0)
    return sig(z @ p["o"] + p["b"][0]), (h, t, g, a, z, owner)


def _gradient(p: dict, x, bags, y):
    s, (h, t, g, a, z, owner) = forward(p, x, bags)
    d = (s - y) / len(y)
    dz = d[:, None] * p["o"]
    da = (h * dz[owner]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, bags[:-1])[owner])
    dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    xs = (x - p["mean"]) / p["scale"]
    return {"W": xs.T @ dh + 1e-4 * p["W"], "c": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "o": z.T @ d + 1e-4 * p["o"], "b": np.array([d.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Parameters learnt by Adam; bags are matrices of passages."""
    rng = np.random.default_rng(11)
    p = _initial(rng)
    every = np.concatenate(bags) if bags else np.zeros((1, WIDTH))
    p["mean"], p["scale"] = every.mean(axis=0), every.std(axis=0) + 1e-3
    if not bags:
        return p | {"o": np.zeros(HIDDEN)}
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            grad = _gradient(p, np.concatenate([bags[k] for k in own]).astype(np.float64), np.concatenate([[0], np.cumsum([len(bags[k]) for k in own])]), labels[own])
            step += 1
            for k, v in grad.items():
                m = moment[k]
                m[0] = 0.9 * m[0] + 0.1 * v
                m[1] = 0.999 * m[1] + 0.001 * v * v
                p[k] = p[k] - RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return p


def _encoded(column):
    data, offsets = flat_bytes(column)
    for i, j in chunks(offsets, 1 << 20):
        yield i, *passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _sampler(batches):
    import pyarrow as pa

    for batch in batches:
        for i, x, bags in _encoded(batch.column(0)):
            rows = [x[a:b].tobytes() for a, b in zip(bags[:-1], bags[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, len(rows)), pa.array(rows, pa.binary())], names=["label", "bag"])


def _scorer(parameters):
    def run(batches):
        import pyarrow as pa

        p = parameters.value
        for batch in batches:
            for i, x, bags in _encoded(batch.column(1)):
                s, _ = forward(p, x, bags)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(s)), pa.array(s)], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted; the score is the likelihood of quality 1.

    held_out: crc32 of the id as text, modulo 5, is 0. Such rows, null ids and null labels are not learnt from; an id with
    several label rows counts once, with the largest. Null texts are empty, one empty passage, and scored like any text. Without
    labels every score is one half. Rows that repeat others give repeated rows; other columns play no part; no rows in, no rows out.
    """
    training, known = training_rows(docs, labels, "quality", FOLDS, HELD_OUT, TRAIN_ROWS)
    sample = mapped(training, _sampler, "label int, bag binary").toPandas()
    y = sample["label"].to_numpy().astype(np.float64)
    fitted = fit([np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in sample["bag"]], y)
    if len(y):  # the sample favours the rarer label; the constant is put back to the labels' true shares
        clip = lambda p: min(max(p, 1e-3), 1 - 1e-3)
        share, own = clip(known.agg(F.avg("label")).first()[0]), clip(y.mean())
        fitted["b"] = fitted["b"] + np.log(share / (1 - share)) - np.log(own / (1 - own))
    parameters = docs.sparkSession.sparkContext.broadcast(fitted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = mapped(rows, _scorer(parameters), "doc_id long, score double")
    return out.select("doc_id", (fold_column(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
