"""A character language model of a corpus: counts of four letters in a row within words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import mapped
from lodestone.llm.pieces import chunks, flat_bytes

#: a-z as 1..26; 0 is whatever is no such letter, as the end of a word.
SIGNS = 27
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)


def _counter(batches):
    import pyarrow as pa

    total = np.zeros(SIGNS**4, np.int64)
    for batch in batches:
        data, offsets = flat_bytes(batch.column(0))
        for i, j in chunks(offsets, 1 << 19):
            own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            code = np.zeros(len(own) + 3 * (j - i) + 3, np.int64)  # three ends of word before each text
            code[np.arange(len(own)) + 3 * (np.repeat(np.arange(j - i), np.diff(at)) + 1)] = _CODE[own]
            gram = ((code[:-3] * SIGNS + code[1:-2]) * SIGNS + code[2:-1]) * SIGNS + code[3:]
            total += np.bincount(gram, minlength=SIGNS**4)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])


def letter_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities [context of three, next letter], from all texts, with add-a-tenth smoothing.

    Each partition counts on its own and the counts are summed in a shuffle; the table has SIGNS ** 4 entries at most, whatever the corpus.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = mapped(texts, _counter, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full(SIGNS**4, 0.1)
    counts[rows["gram"].to_numpy()] += rows["n"].to_numpy()
    counts = counts.reshape(-1, SIGNS)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
