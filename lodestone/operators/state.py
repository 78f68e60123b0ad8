"""State tables of resumable jobs and logs: latest-wins upserts, compatibility gates, and reuse of earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the given columns; what an upsert leaves."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def after_restart(sessions: DataFrame) -> DataFrame:
    """Jobs that were in flight are paused, and can go on where they have completed something."""
    flying = F.col("status").isin("queued", "running", "stopping")
    status = F.when(flying, "paused").otherwise(F.col("status"))
    return sessions.withColumn("status", status).withColumn("resumable", (status == "paused") & (F.col("completed") > 0))


def compatible(state: DataFrame, current: dict[str, str]) -> DataFrame:
    """State whose hash, versions and models are the current ones; the rest is stale."""
    keep = F.lit(True)
    for column, value in current.items():
        keep = keep & F.col(column).eqNullSafe(F.lit(value))
    return state.where(keep)


def reused(chunks: DataFrame, committed: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Each chunk with its earlier result by content_hash: the committed one first, then that of the checkpoint; null where it is still to do."""
    a, b = committed.select("content_hash", F.col("result").alias("a")), checkpoint.select("content_hash", F.col("result").alias("b"))
    out = chunks.join(a, "content_hash", "left").join(b, "content_hash", "left")
    origin = F.when(F.col("a").isNotNull(), "committed").when(F.col("b").isNotNull(), "checkpoint").otherwise("todo")
    return out.withColumn("result", F.coalesce("a", "b")).withColumn("origin", origin).drop("a", "b")


#: What may follow on each state of a job.
FOLLOWS = {"queued": ["running", "paused", "failed"], "running": ["stopping", "failed", "ready"], "stopping": ["paused", "failed"], "paused": ["queued"], "failed": ["queued"], "ready": ["queued"]}


def job_outcomes(events: DataFrame) -> DataFrame:
    """(job_id, state, refused) after a job's events (job_id, at, state), from `queued` on: one that may not follow on the state a job is in is refused and changes nothing.

    A job has a few events; they are folded in order inside the row.
    """
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in FOLLOWS.items() for b in bs])
    steps = F.sort_array(F.collect_list(F.struct("at", "state")))
    ordered = events.groupBy("job_id").agg(F.transform(steps, lambda x: x["state"]).alias("states"))
    start = F.struct(F.lit("queued").alias("state"), F.lit(0).alias("refused"))

    def step(now, to):
        fits = F.array_contains(allowed, F.concat(now["state"], F.lit(">"), to))
        return F.struct(F.when(fits, to).otherwise(now["state"]).alias("state"), (now["refused"] + F.when(fits, 0).otherwise(1)).alias("refused"))

    return ordered.select("job_id", F.aggregate("states", start, step).alias("end")).select("job_id", "end.state", "end.refused")


def reuse_counts(items: DataFrame, known: DataFrame) -> DataFrame:
    """Per run (run_id, content_hash): rows, distinct hashes, and how many of these are known (content_hash) and needn't be made again."""
    once = items.groupBy("run_id", "content_hash").agg(F.count(F.lit(1)).alias("n"))
    met = once.join(known.select("content_hash").distinct().withColumn("known", F.lit(True)), "content_hash", "left")
    return met.groupBy("run_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), F.count_if(F.coalesce("known", F.lit(False))).alias("reused"))
