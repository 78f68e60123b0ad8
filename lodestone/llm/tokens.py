"""Token ids of documents as binary files in the order of ids, and reading them back.

Documents are dealt out by ranges of doc_id; a task tokenizes its range and writes files of at most FILE_IDS ids (more
only where one document is longer), each with its own frequency table shared by all of its blocks. The files are rows
of a Parquet table (part, number, first, n_docs, n_ids, doc_ids, lengths, payload), so that any store Spark can write will do and
a retried task can't leave half a file; payload is the format of rans.py.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import PLAIN_FILES, mapped, new_path

FILE_IDS = 4 << 20
FILE_SCHEMA = "part int, number int, first long, n_docs long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
BACK_SCHEMA = "doc_id long, part int, own_start long, n_tokens long, ids_crc32 long"


def _encoder(vocabulary: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from lodestone.llm.bytebpe import byte_bpe
        from lodestone.llm.rans import encode_file

        part, number, first = TaskContext.get().partitionId(), 0, 0
        held_ids, held_docs, held_n, held = [], [], [], 0

        def file():
            ids = np.concatenate(held_ids)
            docs = [d for x in held_docs for d in x]
            lengths = np.concatenate(held_n)
            row = [part, number, first, len(docs), len(ids), docs, lengths.tolist(), encode_file(ids)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["part", "number", "first", "n_docs", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, offsets, ids in byte_bpe(vocabulary).encode(batch.column(1)):
                if held and held + len(ids) > FILE_IDS:
                    yield file()
                    number, first = number + 1, first + held
                    held_ids, held_docs, held_n, held = [], [], [], 0
                held_ids.append(ids.copy())
                held_docs.append(docs[i : i + len(offsets) - 1])
                held_n.append(np.diff(offsets))
                held += len(ids)
        if held:
            yield file()

    return run


def write_tokens(df: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text (null: empty), each followed by the end id, in ascending doc_id order.

    Null ids come first; rows that share an id are ordered by a hash of the text, then by text, so that they needn't meet in one task. Other columns play no part. An empty input gives
    an empty table.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "th").sortWithinPartitions("doc_id", "th", "text").select("doc_id", "text")
    mapped(ordered, _encoder(vocabulary), FILE_SCHEMA).write.options(**PLAIN_FILES).parquet(path)


def _decoder(batches):
    import pyarrow as pa

    from lodestone.llm.rans import File

    for batch in batches:
        for row in range(batch.num_rows):
            part, first, docs, lengths, payload = (batch.column(k)[row] for k in range(5))
            ids = File(payload.as_py()).decode().astype("<u4")
            n = np.array(lengths.as_py(), np.int64)
            ends = np.cumsum(n)
            if len(ids) != (ends[-1] if len(n) else 0):
                raise ValueError("a token file doesn't hold the ids that it lists")
            crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([docs.values, pa.array([part.as_py()] * len(n), pa.int32()), pa.array(ends - n + first.as_py()), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "part", "own_start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = mapped(files.select("part", "first", "doc_ids", "lengths", "payload"), _decoder, BACK_SCHEMA)
    return rows.join(parts, "part").select("doc_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, vocabulary: str) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    path = new_path(df.sparkSession, "tokens")
    write_tokens(df, path, vocabulary)
    return read_tokens(df.sparkSession, path)
