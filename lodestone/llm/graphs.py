"""Connected components of an edge table: by alternating large-star and small-star steps, and by pointer jumping where the edges are a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import settled, stored


#: Edges of a task, where rounds have few.
EDGES_AT_ONCE = 100_000


def _few(edges: DataFrame, n: int) -> DataFrame:
    """edges, of which there are about n, in no more tasks than they need: rounds on a small graph are then small jobs."""
    return edges.coalesce(max(1, -(-n // EDGES_AT_ONCE)))


def _step(edges: DataFrame, *marks) -> tuple[DataFrame, tuple]:
    """edges written once, and marks taken of what was written."""
    out = stored(edges, "edges")
    return out, tuple(out.agg(*marks).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the ends of edges (u, v); comp is the least node reachable. Self-loops and repeats do no harm.

    Minima are taken with partial sums and joined back, so a node with very many edges is nowhere gathered.
    """
    marks = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    now, mark = _step(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), *marks)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = stored(_few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), mark[0]), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = mark
        now, mark = _step(_few(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), mark[0]), *marks)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def forest(edges: DataFrame) -> DataFrame:
    """(node, comp) as components(), for edges (u, v) with u < v and one edge for each v: every node jumps to its parent's parent until none moves."""
    now = settled(edges.select(F.col("v").alias("node"), F.col("u").alias("comp")))
    n, moved = now.count(), 1
    while moved:
        up = now.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        jumped = now.join(up, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp"), F.col("above").isNotNull().alias("went"))
        now, (moved,) = _step(_few(jumped, n), F.count_if(F.col("went")))
        now = now.select("node", "comp")
    return now.unionByName(now.select(F.col("comp").alias("node"), "comp").distinct())
