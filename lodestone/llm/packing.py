"""Hierarchical best-fit packing of tokenized documents into sequences.

A document longer than a sequence is cut so that all its pieces but the first are whole sequences. The other pieces are
packed best-fit, largest first, within each partition; nearly full bins are final, and all others go up a tree as items of
their fill: neighbouring groups meet in as many tasks as rows_per_part items each take, until one group is left or bins don't get
fewer any more, as where no two of them fit together. So no task grows with the input and no bin is left out.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import mapped, settled

CAPACITY = 1024
#: Bins with at most so many free places are final.
NEARLY = 4
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(vocabulary: str, capacity: int, with_ids: bool):
    def run(batches):
        import pyarrow as pa

        from lodestone.llm.bytebpe import byte_bpe

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, offsets, ids in byte_bpe(vocabulary).encode(batch.column(1)):
                wide = ids.astype("<u4")
                out = []
                for k in range(len(offsets) - 1):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    end, piece = a + ((b - a) % capacity or capacity), 0
                    at = a
                    while at < b:
                        own = wide[at:end]
                        out.append((docs[i + k], piece, at - a, end - at, zlib.crc32(own.tobytes()), *([own] if with_ids else [])))
                        at, end, piece = end, end + capacity, piece + 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    return run


def cut(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of every text (null: empty), the end id included; with_ids adds the ids themselves."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return mapped(rows, _cutter(vocabulary, capacity, with_ids), PIECE_SCHEMA + ", ids array<int>" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: items largest first, each into the fullest bin that has room for it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has exactly r free places
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


BIN_SCHEMA = "final boolean, part int, fill int, items array<struct<a: long, b: int>>"


def _packer(capacity: int, last: bool):
    """Rows (part, fill, items): one task holds whole parts; their bins come out."""

    def run(batches):
        import pyarrow as pa

        groups: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for part, fill, items in zip(batch.column("part").to_pylist(), batch.column("fill").to_pylist(), batch.column("items").to_pylist()):
                sizes, held = groups.setdefault(part, ([], []))
                sizes.append(fill)
                held.append(items)
        item = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int32())]))
        for group, (sizes, held) in groups.items():
            sizes = np.array(sizes)
            bins = best_fit(sizes, capacity)
            fills = np.array([int(sizes[b].sum()) for b in bins])
            final = (fills >= capacity - NEARLY) | last
            for i in range(0, len(bins), 4096):
                chosen = range(i, min(i + 4096, len(bins)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(final[i : i + 4096]), pa.array([group] * len(chosen), pa.int32()), pa.array(fills[i : i + 4096], pa.int32()), pa.array([[x for j in bins[k] for x in held[j]] for k in chosen], item)],
                    names=["final", "part", "fill", "items"],
                )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_part: int = 8192) -> DataFrame:
    """sequence_id and offset for each piece (doc_id, piece, start, length, ...), whose columns are kept as they are.

    Whole pieces are sequences of their own. The others are numbered within the partitions of the settled pieces; equal ids, repeated
    rows and nulls are told apart by that number, so every row has its place. No rows in, no rows out.
    """
    marked = settled(pieces.withColumn("row", F.monotonically_increasing_id()))
    full = marked.where(F.col("length") == capacity).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = marked.where(F.col("length") < capacity)
    parts = max(1, -(-short.count() // rows_per_part))
    size = F.col("length").cast("int")
    todo = short.select(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), size.alias("fill"), F.array(F.struct(F.col("row").alias("a"), size.alias("b"))).alias("items"))
    done = []
    while True:
        level = settled(mapped(todo.repartitionById(parts, F.col("part")), _packer(capacity, parts == 1), BIN_SCHEMA))
        done.append(level.where("final"))
        open_ = level.where("NOT final")
        left = open_.count() if parts > 1 else 0
        if not left:
            break
        fewer = -(-left // rows_per_part)
        if fewer >= parts:  # the same bins would meet again
            done.append(open_)
            break
        todo = open_.select(F.floor(F.col("part") * fewer / parts).cast("int").alias("part"), "fill", "items")
        parts = fewer
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    placed = bins.select(F.col("items")[0]["a"].alias("sequence_id"), F.posexplode("items").alias("at", "item"), "items")
    before = F.aggregate(F.slice("items", 1, F.col("at")), F.lit(0).cast("long"), lambda s, x: s + x["b"])
    placed = placed.select("sequence_id", before.alias("offset"), F.col("item.a").alias("row"))
    out = short.join(placed, "row").select(*marked.columns, "sequence_id", "offset").unionByName(full)
    return out.drop("row")


def packed(df: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut(df, vocabulary, capacity), capacity)


def token_sequences(df: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves, of at most `capacity` ids each: sequence_id, ids and the documents (doc_id, piece) in their order."""
    pieces = pack(cut(df, vocabulary, capacity, with_ids=True), capacity)
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = pieces.groupBy("sequence_id").agg(own.alias("own"))
    return rows.select("sequence_id", F.flatten(F.transform("own", lambda x: x["ids"])).alias("ids"), F.transform("own", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"))).alias("documents"))
