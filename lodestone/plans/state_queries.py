"""Queries of logs, usage, checkpoints, job states, budgets and period plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import state as S
from lodestone.plans.registry import query
from lodestone.sources.tables import table


@query(
    "query_insights",
    "SELECT count(*) AS queries, count(*) FILTER (WHERE event_type = 'error') AS unanswerable, round(avg(value), 4) AS mean_latency, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') * 1.0 / greatest(count(*), 1) AS share FROM events",
)
def query_insights(spark, d):
    bad = F.count_if(F.col("event_type") == "error")
    n = F.count(F.lit(1))
    return table(spark, d, "events").agg(n.alias("queries"), bad.alias("unanswerable"), F.round(F.avg("value"), 4).alias("mean_latency"), F.countDistinct("user_id").alias("users"), (bad / F.greatest(n, F.lit(1))).alias("share"))


@query("recent_queries", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_queries(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "user_id", "event_type")


@query("usage_totals", "SELECT event_type, count(*) AS n, round(sum(coalesce(value, 0)), 2) AS total, CAST(sum(CAST(coalesce(json_extract_string(props, '$.k'), '0') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def usage_totals(spark, d):
    tokens = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 2).alias("total"), F.sum(tokens).alias("tokens"))


@query("checkpoint_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def checkpoint_latest(spark, d):
    return S.latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("job_states", "SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus IN ('P', 'O') THEN 'paused' ELSE 'ready' END AS status, o_orderstatus IN ('P', 'O') AND o_orderkey % 3 > 0 AS resumable FROM orders")
def job_states(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("ready")
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), (F.col("o_orderkey") % 3).alias("completed"))
    return S.after_restart(jobs).select("job_id", "status", "resumable")


@query("compatible_state", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#2'")
def compatible_state(spark, d):
    return S.compatible(table(spark, d, "part"), {"p_type": "ECONOMY", "p_brand": "Brand#2"}).select("p_partkey")


@query(
    "result_reuse",
    """WITH c AS (SELECT doc_id, sha256(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))) AS h FROM documents), a AS (SELECT h, min(doc_id) AS r FROM c WHERE doc_id % 3 = 0 GROUP BY 1), b AS (SELECT h, min(doc_id) AS r FROM c WHERE doc_id % 3 = 1 GROUP BY 1)
    SELECT doc_id, coalesce(a.r, b.r) AS result, CASE WHEN a.r IS NOT NULL THEN 'committed' WHEN b.r IS NOT NULL THEN 'checkpoint' ELSE 'todo' END AS origin FROM c LEFT JOIN a USING (h) LEFT JOIN b USING (h)""",
)
def result_reuse(spark, d):
    from lodestone.functions.text import content_hash

    chunks = table(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    part = lambda r: chunks.where(F.col("doc_id") % 3 == r).groupBy("content_hash").agg(F.min("doc_id").alias("result"))
    return S.reused(chunks, part(0), part(1)).select("doc_id", "result", "origin")


@query(
    "trust_priority",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.9 ELSE 0.75 END::DOUBLE AS priority FROM orders WHERE coalesce(o_orderstatus <> 'P', true)",
)
def trust_priority(spark, d):
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).when(F.col("o_orderpriority") == "2-HIGH", 0.9).otherwise(0.75)
    return table(spark, d, "orders").where(F.coalesce(F.col("o_orderstatus") != "P", F.lit(True))).select("o_orderkey", priority.alias("priority"))


@query(
    "comparison_matrix",
    """WITH e AS (SELECT c_mktsegment AS object, o_orderpriority AS facet, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), o AS (SELECT DISTINCT c_mktsegment AS object FROM customer), f AS (SELECT DISTINCT o_orderpriority AS facet FROM orders)
    SELECT object, facet, coalesce(n, 0) AS n, n IS NULL AS missing FROM o CROSS JOIN f LEFT JOIN e USING (object, facet)""",
)
def comparison_matrix(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    met = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("object"), F.col("o_orderpriority").alias("facet")).agg(F.count(F.lit(1)).alias("n"))
    # objects and facets are the few names of a plan
    cells = customers.select(F.col("c_mktsegment").alias("object")).distinct().crossJoin(orders.select(F.col("o_orderpriority").alias("facet")).distinct())
    out = cells.join(met, ["object", "facet"], "left")
    return out.select("object", "facet", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("n").isNull().alias("missing"))


@query(
    "period_gaps",
    "WITH p AS (SELECT DISTINCT o_custkey AS plan_id, year(o_orderdate) AS y FROM orders), g AS (SELECT plan_id, y, y - lag(y) OVER (PARTITION BY plan_id ORDER BY y) AS step FROM p) SELECT plan_id, CAST(min(y) AS INTEGER) AS first, CAST(max(y) AS INTEGER) AS last, count(*) FILTER (WHERE step > 1) AS gaps FROM g GROUP BY 1",
)
def period_gaps(spark, d):
    periods = table(spark, d, "orders").select(F.col("o_custkey").alias("plan_id"), F.year("o_orderdate").alias("y")).distinct()
    step = F.col("y") - F.lag("y").over(Window.partitionBy("plan_id").orderBy("y"))
    return periods.withColumn("step", step).groupBy("plan_id").agg(F.min("y").alias("first"), F.max("y").alias("last"), F.count_if(F.col("step") > 1).alias("gaps"))


@query(
    "facet_quota",
    "SELECT o_orderpriority AS facet, o_orderkey AS id, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 12",
)
def facet_quota(spark, d):
    best = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(best)).where("rank <= 12").select(F.col("o_orderpriority").alias("facet"), F.col("o_orderkey").alias("id"), "rank")


@query("usage_by_hour", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def usage_by_hour(spark, d):
    """An extension: the roll-up that streaming.usage keeps up to date, here over the whole table."""
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
