"""Two-pass external shuffle into shards.

Pass one scatters whole records by a seeded hash into buckets that fit in memory, pass two orders each bucket by the
engine's Fisher-Yates array shuffle. A record's place in the whole order is its place in the bucket plus the rows of the
buckets before it; cutting the order into equal runs gives shards whose row counts are at most one apart, and as a bucket then
lies in one shard or a few neighbours, its task writes it without moving it again. Shards are files in the shared folder, and what is told of a record is read from them.

The engine's shuffle draws from a generator of its partition, so buckets get a number of partitions, and an order in each, that
follow from the rows alone: the layout depends neither on how rows come in nor on the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import PLAIN_FILES, new_path, settled

SHARDS = 24
SEED = 20_240_229
#: Rows, and bytes of the records, that a bucket holds on average at most.
BUCKET_ROWS = 2048
BUCKET_BYTES = 32 << 20
#: Partitions of buckets at most.
PARTS = 4096
#: Hashes of repeated rows that are sent to every task; with more, all rows are grouped.
MOST_REPEATED = 200_000
#: Buckets whose counts are summed in one go when the places of buckets are found.
SPAN = 4096


def _starts(counts: DataFrame) -> DataFrame:
    """bucket and the rows of all buckets before it, in two levels, so that no task sums all of them."""
    spans = counts.withColumn("span", F.floor(F.col("bucket") / SPAN))
    above = spans.groupBy("span").agg(F.sum("n").alias("span_n"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    above = above.select("span", F.coalesce(F.sum("span_n").over(before), F.lit(0)).alias("span_start"))
    within = Window.partitionBy("span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(above, "span").select("bucket", (F.col("own") + F.col("span_start")).alias("first"))


def _copies(df: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """digest, copy and record of each row, digest and copy alone, the number of rows and their bytes; rows equal in every column are numbered from 1, so that each gets a bucket of its own."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    digest = F.xxhash64(*columns).alias("digest")
    # nested columns count as their JSON
    size = sum((F.coalesce(F.octet_length(c) if t in ("string", "binary") else F.lit(8) if t in _PLAIN else F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c, (_, t) in zip(columns, df.dtypes)), F.lit(0))
    found = settled(df.select(digest, size.cast("long").alias("size")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    total = found.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    rows = df.select(digest, F.struct(*columns).alias("record"))
    told_apart = lambda x: x.groupBy("digest", "record").agg(F.count(F.lit(1)).alias("copies")).select("digest", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "record")
    one = F.lit(1).alias("copy")
    keys = found.where("n = 1").select("digest", one)
    if not total["repeated"]:
        out = rows.select("digest", one, "record")
    elif total["repeated"] <= MOST_REPEATED:
        again = F.broadcast(found.where("n > 1").select("digest"))
        more = told_apart(rows.join(again, "digest", "left_semi"))
        out, keys = rows.join(again, "digest", "left_anti").select("digest", one, "record").unionByName(more), keys.unionByName(more.drop("record"))
    else:
        out = told_apart(rows)
        keys = out.drop("record")
    return out, keys, total["n"] or 0, total["bytes"] or 0


_PLAIN = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Every column of df as Parquet under path, in a folder per shard and in the order of the column slot.

    Rows that repeat others in every column are dealt out like any rows. Columns are of types that Spark can compare. The same rows, seed
    and number of shards give the same files' rows. A shard is several files, one of each task that holds buckets of it.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    rows, keys, n, size = _copies(df.select(*[F.col(f"`{c}`") for c in names]))
    buckets = max(1, -(-n // BUCKET_ROWS), -(-size // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "digest", "copy"), F.lit(buckets))
    scattered = rows.withColumn("bucket", bucket)
    # the partitions asked for here hold whole buckets, so that grouping moves nothing again
    gathered = scattered.repartition(min(buckets, PARTS), "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("digest", "copy", "record"))).alias("held"))
    mixed = gathered.sortWithinPartitions("bucket").select("bucket", F.call_function("shuffle", F.col("held"), F.lit(seed)).alias("held"))
    starts = settled(_starts(keys.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))))
    place = (F.col("first") + F.col("at")).alias("__place")
    placed = mixed.select("bucket", F.posexplode("held").alias("at", "row")).join(F.broadcast(starts), "bucket").select(place, *[F.col("row.record")[c].alias(c) for c in names])
    shard = F.expr(f"cast(__place * {shards} div {max(1, n)} as int)")  # whole numbers: a quotient in floating point may be one too small
    slot = F.expr(f"__place - (cast(__place * {shards} div {max(1, n)} as bigint) * {n} + {shards - 1}) div {shards}")
    flat = placed.select(shard.alias("shard"), slot.cast("long").alias("slot"), *[F.col(f"`{c}`") for c in names])
    flat.sortWithinPartitions("shard", "slot").write.options(**PLAIN_FILES).partitionBy("shard").parquet(path, compression="zstd")


def sharded(df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards written by write_shards into the shared folder and read back, one row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: counts of shards differ by one at most, and slots are gapless from 0. size is the text's UTF-8
    bytes plus 8; a null text has none and the crc of the empty text. Equal texts are spread over all shards. The same rows and
    seed give the same order; no rows in, no rows out. All columns of df are written.
    """
    path = new_path(df.sparkSession, "shards")
    write_shards(df, path, shards, seed)
    fields = [df.schema[c] for c in (id_col, text_col)]
    schema = T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    back = df.sparkSession.read.schema(schema).parquet(path)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return back.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
