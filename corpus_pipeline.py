"""Five stages from raw documents to packed training sequences; each stage's rows are written and read again by the next.

toxicity: documents that the classifier predicts toxic go; labels come from the labels table beside documents.
exact_dedup: one row of each group of equal texts stays.
near_dedup: one row of each group of near copies stays (shingles of five words, similarity of 0.8 or more).
repeated_substrings: every string of 200 bytes that also starts elsewhere is removed from the texts; documents stay.
packing: what is left becomes sequences of at most 1024 tokens.
"""

from __future__ import annotations

import public_tokenizers

from lodestone.llm import exact, neardup, packing, repeats, toxicity
from lodestone.llm.common import stored, table

SHINGLE, SIMILARITY = 5, 80


def drop_toxic(spark, docs, sf_dir):
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark, docs, sf_dir):
    return exact.keep_one_of_each(docs)


def drop_near_copies(spark, docs, sf_dir):
    return neardup.keep_one_of_each(docs, SHINGLE, SIMILARITY)


def drop_repeats(spark, docs, sf_dir):
    return repeats.without_repeats(docs)


def pack(spark, docs, sf_dir):
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("repeated_substrings", drop_repeats),
    ("packing", pack),
]

#: Models and suffix sorting are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents table of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
