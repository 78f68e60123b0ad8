"""Exact deduplication that splits off heavy hitters.

A frequent-items sketch (Misra-Gries counters with bounded state, merged map-side) names digests that may be
frequent. Their true counts and winners are then aggregated, and this table of at most WINNERS rows is broadcast, so
that rows of large groups are settled where they lie. All other digests are rare and take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, settled

#: Counters of the sketch: a digest with more than about 1/750 of the rows is certain to be named.
COUNTERS = 1024
#: Rows of the broadcast table at most.
WINNERS = 512


def text_digest(text):
    """SHA-256 of the text with A-Z lower-cased, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def _settled_groups(rows: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(digest, keep_id, group_size) of the heavy digests, a table small enough to broadcast or None, and of all others; rows: (doc_id, digest)."""
    named = rows.agg(F.expr(f"approx_top_k(hex(digest), {WINNERS}, {COUNTERS})").alias("top")).first()["top"] or []
    heavy = [bytes.fromhex(x["item"]) for x in named if x["count"] > 1]
    best = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    if not heavy:
        return None, rows.groupBy("digest").agg(*best)
    is_heavy = F.col("digest").isin(heavy)
    return settled(rows.where(is_heavy).groupBy("digest").agg(*best)), rows.where(~is_heavy).groupBy("digest").agg(*best)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. The largest id of a group stays; a
    null id is smaller than any other, and stays only in a group without other ids. Rows that repeat an id and its
    text count one by one in group_size, and all of them carry kept when the id is the one that stays. No rows in, no
    rows out. Other columns of the input play no part.
    """
    rows = settled(df.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")))
    heavy, light = _settled_groups(rows)
    found = rows.join(light, "digest")  # one row a digest on the right; counts are summed before they are joined, so a digest just below the heavy ones is in no window
    if heavy is not None:
        found = rows.join(F.broadcast(heavy), "digest", "left_anti").join(light, "digest").unionByName(rows.join(F.broadcast(heavy), "digest"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups() keeps, one where a row itself is repeated.

    Ids and digests alone settle who stays. Rows of heavy digests that go, go where they lie; the others meet the rows that stay in one shuffle by digest.
    Other columns are kept as they are; of rows that repeat the id and text that stay, one is kept.
    """
    rows = settled(docs.select(F.col("doc_id"), text_digest(F.col("text")).alias("digest")))
    heavy, light = _settled_groups(rows)
    name = lambda df: df.select(F.col("keep_id").alias("__id"), F.col("digest").alias("__of"))
    same, stays = F.col("__digest") == F.col("__of"), F.col("doc_id").eqNullSafe(F.col("__id"))
    kept, left = name(light), docs.withColumn("__digest", text_digest(F.col("text")))
    if heavy is not None:
        kept = kept.unionByName(name(heavy))
        left = left.join(F.broadcast(name(heavy)), same, "left").where(F.col("__of").isNull() | stays).drop("__id", "__of")
    out = left.join(kept, same & stays, "left_semi")
    twice = rows.join(kept, (F.col("digest") == F.col("__of")) & stays, "left_semi").groupBy("doc_id", "digest").count().where("count > 1")
    if not twice.isEmpty():
        out = out.dropDuplicates(["doc_id", "__digest"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
