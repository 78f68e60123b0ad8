"""How stated tables meet a corpus: checked broadcasts, blocks, results that are kept, and numbers in order without one task for all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a table may have to be sent to every task.
MOST_ROWS = 10_000
#: Rows of a block of the smaller side where a table is too large for that.
BLOCK_ROWS = 5_000
#: Order values that are numbered in one go.
SPAN = 4096


def is_small(df: DataFrame, most: int = MOST_ROWS) -> bool:
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df to be broadcast if it has at most `most` rows; a larger one is left to the planner, with all its rows."""
    return F.broadcast(df) if is_small(df, most) else df


def every_pair(corpus: DataFrame, asked: DataFrame, on: str) -> DataFrame:
    """Rows of both with an equal value of `on`, which may be the same for all, as a stated table meets a whole corpus.

    A small table of questions is sent to every task. A larger one is dealt into blocks, and each part of the corpus meets one block in one task.
    """
    n = asked.limit(MOST_ROWS + 1).count()
    if n <= MOST_ROWS:
        return corpus.join(F.broadcast(asked), on)
    blocks = -(-asked.count() // BLOCK_ROWS)
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = corpus.withColumn("__part", F.pmod(F.xxhash64(*corpus.columns), F.lit(parts))).withColumn("__block", every(blocks))
    right = asked.withColumn("__block", F.pmod(F.xxhash64(*asked.columns), F.lit(blocks)).cast("int")).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return left.join(right, [on, "__block", "__part"]).drop("__block", "__part")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on one machine without such a setting, as in tests, a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once into the shared folder and read from there, so that what is above it isn't computed for each use."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: str, order: str, name: str, first: int = 0, span: int = SPAN) -> DataFrame:
    """df with numbers without gaps within each value of `by`, in the order of a whole-number column.

    Rows are counted in spans of the order, the counts of a `by` are summed, and each span is numbered by itself, so that no task sorts all rows of a `by`.
    """
    spans = df.withColumn("__span", F.floor(F.col(order) / span))
    counts = spans.groupBy(by, "__span").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "__span", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")).withColumnsRenamed({by: "__by", "__span": "__at"})
    within = F.row_number().over(Window.partitionBy(by, "__span").orderBy(order))
    out = spans.withColumn("__own", within).join(starts, F.col(by).eqNullSafe(F.col("__by")) & F.col("__span").eqNullSafe(F.col("__at")))
    return out.withColumn(name, F.col("__start") + F.col("__own") - 1 + first).drop("__span", "__own", "__by", "__at", "__start")
