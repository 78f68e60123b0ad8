"""Queries of entity resolution, plans and verdicts, published records, timelines, jobs and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import ingest as I
from lodestone.operators import planning as P
from lodestone.operators import retrieval as R
from lodestone.operators import state as S
from lodestone.plans.registry import query
from lodestone.plans.retrieval_queries import questions
from lodestone.plans.text_queries import FACETS, _HITS, fold_sql, words_sql
from lodestone.sources.records import record_rows
from lodestone.sources.tables import table


def registry(spark, d):
    """Suppliers as curated persons with an alias; every third is forced, and every fourth has years."""
    key = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(key.alias("ord"), F.when(key % 5 == 0, "EVENT").otherwise("PERSON").alias("kind"), F.col("s_name").alias("canonical_name"), F.array(F.concat(F.lit("Bí danh "), key)).alias("aliases"), (key % 3 == 0).alias("forced"))
    year = lambda first: F.when(F.col("ord") % 4 == 0, first + F.col("ord") % 100).cast("int")
    return rows.withColumns({"year_start": year(1900), "year_end": year(1905)})


@query(
    "entity_resolve",
    f"""WITH s AS (SELECT s_suppkey AS k, s_name AS n, concat('Bí danh ', s_suppkey) AS a, CASE WHEN s_suppkey % 5 = 0 THEN 'EVENT' ELSE 'PERSON' END AS t FROM supplier),
    q AS (SELECT concat(' Ông ', n) AS surface, n AS bare, k, n, a, t, 1 AS how FROM s UNION ALL SELECT a, a, k, n, a, t, 2 FROM s UNION ALL SELECT concat('Chiến dịch ', k), concat('Chiến dịch ', k), k, n, a, t, 3 FROM s)
    SELECT surface, CASE how WHEN 3 THEN 'EVENT' WHEN 2 THEN CASE WHEN k % 3 = 0 THEN t ELSE 'PERSON' END ELSE 'PERSON' END AS kind,
      CASE how WHEN 3 THEN surface WHEN 2 THEN CASE WHEN k % 3 = 0 OR t = 'PERSON' THEN n ELSE a END ELSE n END AS canonical_name,
      CASE how WHEN 3 THEN surface WHEN 2 THEN CASE WHEN k % 3 = 0 OR t = 'PERSON' THEN concat(n, '|', a) ELSE a END ELSE concat(n, '|', trim(surface), CASE WHEN t = 'PERSON' THEN concat('|', a) ELSE '' END) END AS aliases FROM q""",
)
def entity_resolve(spark, d):
    """Suppliers by their name after a title, by their alias, and campaigns that nobody curated; all given as persons."""
    key, name = F.col("s_suppkey"), F.col("s_name")
    told = F.array(F.concat(F.lit(" Ông "), name), F.concat(F.lit("Bí danh "), key), F.concat(F.lit("Chiến dịch "), key))
    names = table(spark, d, "supplier").select(F.explode(told).alias("surface"), F.lit("person").alias("kind"))
    return I.resolved(names, registry(spark, d)).select("surface", "kind", "canonical_name", F.array_join("aliases", "|").alias("aliases"))


@query(
    "alias_expand",
    """SELECT concat('bi DANH ', s_suppkey) AS surface, concat(s_name, '|Bí danh ', s_suppkey) AS spellings, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 1900 + s_suppkey % 100 END AS INTEGER) AS year_start, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 1905 + s_suppkey % 100 END AS INTEGER) AS year_end FROM supplier
    UNION ALL SELECT concat('nobody ', s_suppkey), '', NULL, NULL FROM supplier""",
)
def alias_expand(spark, d):
    names = table(spark, d, "supplier").select(F.explode(F.array(F.concat(F.lit("bi DANH "), "s_suppkey"), F.concat(F.lit("nobody "), "s_suppkey"))).alias("surface"))
    return I.expanded(names, registry(spark, d)).withColumn("spellings", F.array_join("spellings", "|"))


_WORDS = ["Ai chỉ huy", "Kinh tế", "Chiến dịch nào", "Thời kỳ", "người", "nhân vật", "Trại", "khi nào"]


@query(
    "planner_fallback_class",
    f"""WITH q AS (SELECT item_id AS plan_id, concat([{', '.join(f"'{w}'" for w in _WORDS)}][1 + item_id % {len(_WORDS)}], ' ', CASE WHEN item_id % 3 = 0 THEN '' ELSE text END) AS asked FROM benchmark),
    l AS (SELECT plan_id, lower(asked) AS a, concat(' ', regexp_replace(lower(asked), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ') AS w FROM q)
    SELECT plan_id, regexp_matches(a, '[0-9]|ai |người|khi nào|bao nhiêu') AS verify, CASE WHEN regexp_matches(w, ' (ai|nhân vật|người|lãnh đạo|chỉ huy) ') THEN 'person' WHEN regexp_matches(w, ' (giai đoạn|thời kỳ|thời đại) ') THEN 'period' WHEN regexp_matches(w, ' (sự kiện|chiến dịch|trận|khởi nghĩa) ') THEN 'event' ELSE 'none' END AS suggestion FROM l""",
)
def planner_fallback_class(spark, d):
    words = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (1 + F.col("item_id") % len(_WORDS)).cast("int"))
    asked = F.concat(words, F.lit(" "), F.when(F.col("item_id") % 3 == 0, "").otherwise(F.col("text")))
    return P.plans_without_model(table(spark, d, "benchmark").select(F.col("item_id").alias("plan_id"), asked.alias("asked"))).select("plan_id", "verify", "suggestion")


@query(
    "requirement_verify_reconcile",
    """WITH r AS (SELECT DISTINCT o_custkey AS plan_id, CAST(o_orderkey AS VARCHAR) AS rid, o_orderkey % 3 > 0 AS required, o_orderkey % 11 = 0 AS said, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'covered' WHEN o_orderstatus = 'P' THEN 'repaired' ELSE 'missing' END AS word FROM orders),
    g AS (SELECT *, required AND coalesce(word NOT IN ('covered', 'repaired'), true) AS gap FROM r),
    p AS (SELECT plan_id, coalesce(bool_or(word = 'repaired'), false) AS repaired, bool_or(gap) AS gaps, coalesce(string_agg(CASE WHEN gap OR said THEN rid END, ',' ORDER BY rid), '') AS missing FROM g GROUP BY 1),
    v AS (SELECT plan_id, missing, repaired, CASE WHEN plan_id % 2 = 0 THEN 'supported' ELSE 'corrected' END AS word, CASE WHEN plan_id % 3 = 0 THEN '' ELSE 'mended' END AS mended, gaps FROM p),
    s AS (SELECT *, CASE WHEN repaired THEN 'corrected' WHEN gaps AND word = 'supported' THEN 'insufficient' ELSE word END AS claimed FROM v)
    SELECT plan_id, CASE WHEN claimed = 'corrected' AND mended = '' THEN 'insufficient' ELSE claimed END AS status, CASE WHEN word = 'supported' AND NOT repaired THEN 'draft' ELSE mended END AS answer, missing FROM s""",
)
def requirement_verify_reconcile(spark, d):
    """Customers as plans and their orders as requirements; how an order stands is what a verifier says of it."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("requirement_id"), "o_orderstatus").distinct()
    word = F.when(F.col("o_orderstatus") == "F", "covered").when(F.col("o_orderstatus") == "P", "repaired").otherwise("missing")
    told = F.collect_list(F.when(F.col("k") % 5 != 0, F.struct("requirement_id", word.alias("status"))))
    verdicts = orders.groupBy("plan_id").agg(told.alias("coverage"), F.concat(F.collect_list(F.when(F.col("k") % 11 == 0, F.col("requirement_id"))), F.array(F.lit("unknown"))).alias("missing"))
    verdicts = verdicts.withColumns({"draft": F.lit("draft"), "status": F.when(F.col("plan_id") % 2 == 0, "supported").otherwise("corrected"), "corrected": F.when(F.col("plan_id") % 3 != 0, " mended ")})
    return P.settled(orders.select("plan_id", "requirement_id", (F.col("k") % 3 > 0).alias("required")), verdicts).withColumn("missing", F.array_join("missing", ","))


@query(
    "published_record_text",
    """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS t FROM orders), f AS (SELECT k, s, concat(day(t), '/', month(t), '/', year(t)) AS shown, year(t) AS y FROM o)
    SELECT concat('published:periods/p/events.json:o', k) AS id, concat('Order ', k) AS heading, CAST(k % 1000 AS INTEGER) AS sequence, CAST(y AS INTEGER) AS year_start,
      concat('Bản ghi sự kiện: Order ', k, ', state ', s, ', tại Port ', k % 7, ', bắt đầu ngày ', shown, '.', chr(10), 'Sự kiện: Order ', k, chr(10), 'Tóm tắt: state ', s, ' .', chr(10), 'Thời gian bắt đầu: ', shown, chr(10), 'Chi tiết: line one', chr(10), 'Nội dung: Port ', k % 7, chr(10), 'Chi tiết: line two') AS text FROM f""",
)
def published_record_text(spark, d):
    """Orders as published events, with a place and lines at some depth, an empty value and pictures."""
    key = F.col("o_orderkey")
    steps = F.array(F.struct(F.struct(F.concat(F.lit("Port "), key % 7).alias("content")).alias("diadiem"), F.lit("line one").alias("detail")))
    more = F.array(F.struct(F.lit(None).cast("struct<content:string>").alias("diadiem"), F.lit("line two").alias("detail")))
    content = F.struct(F.concat(steps, more).alias("acts"), F.array(F.lit("x.png")).alias("images"), F.lit("").alias("warCause"))
    record = F.struct(F.concat(F.lit("o"), key).alias("id"), F.lit("published").alias("status"), F.concat(F.lit("Order "), key).alias("title"), F.concat(F.lit("state "), "o_orderstatus", F.lit(" .")).alias("summary"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("startDate"), content.alias("content"), (key % 1000).alias("sortOrder"))
    # a record costs far more than the bytes of its order, so orders are dealt over all tasks first
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    rows = orders.select(F.lit("periods/p/events.json").alias("path"), F.parse_json(F.to_json(record)).alias("record"))
    return record_rows(rows).select("id", "heading", "sequence", "year_start", "text")


@query(
    "timeline_terms",
    f"""WITH t AS (SELECT doc_id, {words_sql('text')} AS w FROM documents), s AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM t),
    x AS (SELECT item_id AS window_id, text, 1990 + item_id % 10 AS a, 1995 + item_id % 10 AS b FROM benchmark),
    q AS (SELECT DISTINCT window_id, unnest(list_concat({words_sql('text')}, [CAST(a AS VARCHAR), CAST((a + b) // 2 AS VARCHAR), CAST(b AS VARCHAR)])) AS term FROM x),
    p AS (SELECT term, doc_id, n AS doc_len, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    l AS (SELECT window_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len))), 6) AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY 1, 2),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, doc_id) AS n FROM l) WHERE n <= 225),
    m AS (SELECT window_id, doc_id, score FROM k JOIN x USING (window_id) WHERE doc_id % 3 = 0 OR 1985 + doc_id % 25 BETWEEN a AND b)
    SELECT window_id, doc_id, score, CAST(row_number() OVER (PARTITION BY window_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM m QUALIFY rank <= 5""",
)
def timeline_terms(spark, d):
    """Documents of a third have no years of their own nor of a source."""
    year = F.when(F.col("doc_id") % 3 != 0, 1985 + F.col("doc_id") % 25).cast("int")
    docs = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, year).alias("y0"), F.when(F.col("doc_id") % 2 == 0, year).alias("y1"), F.concat(F.lit("s"), year).alias("source_id"))
    sources = docs.where("source_id IS NOT NULL").select("source_id", F.substring("source_id", 2, 4).cast("int").alias("y0")).distinct().withColumn("y1", F.col("y0"))
    windows = questions(spark, d).select(F.col("query_id").alias("window_id"), F.col("text").alias("question"), (1990 + F.col("query_id") % 10).cast("int").alias("start"), (1995 + F.col("query_id") % 10).cast("int").alias("end"))
    return R.timeline_search(docs, windows, 5, sources)


@query(
    "corpora_union",
    """SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_totalprice AS score, 'orders' AS corpus, CAST(NULL AS VARCHAR) AS kind FROM orders UNION ALL SELECT user_id, event_id, CAST(value AS DOUBLE), 'events', event_type FROM events""",
)
def corpora_union(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    events = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), F.col("value").cast("double").alias("score"), F.col("event_type").alias("kind"))
    return R.corpora(("orders", orders), ("events", events))


@query(
    "job_outcomes",
    """WITH s(i, state) AS (VALUES (0, 'running'), (1, 'stopping'), (2, 'paused'), (3, 'ready'), (4, 'queued')), e AS (SELECT c_custkey AS k, n AS nth, (c_custkey * 7 + n * n * 3) % 5 AS i FROM customer, range(4) t(n)),
    w AS (SELECT k, list(state ORDER BY nth) AS st FROM e JOIN s USING (i) GROUP BY 1),
    a AS (SELECT ['queued>running', 'queued>paused', 'queued>failed', 'running>stopping', 'running>failed', 'running>ready', 'stopping>paused', 'stopping>failed', 'paused>queued', 'failed>queued', 'ready>queued'] AS ok),
    f AS (SELECT k, list_reduce(list_prepend('queued|0', st), lambda x, y: CASE WHEN list_contains(ok, concat(split_part(x, '|', 1), '>', y)) THEN concat(y, '|', split_part(x, '|', 2)) ELSE concat(split_part(x, '|', 1), '|', CAST(split_part(x, '|', 2) AS INTEGER) + 1) END) AS z FROM w, a)
    SELECT k AS job_id, split_part(z, '|', 1) AS state, CAST(split_part(z, '|', 2) AS INTEGER) AS refused FROM f""",
)
def job_outcomes(spark, d):
    states = F.array(*[F.lit(s) for s in ("running", "stopping", "paused", "ready", "queued")])
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("at"))
    at = ((F.col("job_id") * 7 + F.col("at") * F.col("at") * 3) % 5).cast("int")
    return S.job_outcomes(rows.select("job_id", "at", F.get(states, at).alias("state")))


@query(
    "reuse_counts",
    """WITH h AS (SELECT coalesce(source, '?') AS run_id, md5(coalesce(text, '')) AS h, doc_id FROM documents), k AS (SELECT DISTINCT h FROM h WHERE doc_id % 4 = 0)
    SELECT run_id, count(*) AS rows, count(DISTINCT h.h) AS distinct_rows, count(DISTINCT k.h) AS reused FROM h LEFT JOIN k ON k.h = h.h GROUP BY 1""",
)
def reuse_counts(spark, d):
    items = table(spark, d, "documents").select(F.coalesce("source", F.lit("?")).alias("run_id"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"), "doc_id")
    return S.reuse_counts(items, items.where("doc_id % 4 = 0").select("content_hash"))


@query(
    "facet_backfill_counts",
    f"""WITH f AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {h} THEN '{n}' END" for n, h in _HITS.items())}], lambda x: x IS NOT NULL) AS new FROM (SELECT doc_id, {fold_sql('text')} AS k FROM documents)),
    o AS (SELECT doc_id, new, CASE WHEN doc_id % 3 = 0 THEN new ELSE ['result'] END AS old FROM f)
    SELECT facet, count(*) FILTER (WHERE list_contains(old, facet)) AS old_n, count(*) FILTER (WHERE list_contains(new, facet)) AS new_n, count(*) FILTER (WHERE list_contains(old, facet) <> list_contains(new, facet)) AS changed
    FROM o, (SELECT unnest([{', '.join(f"'{n}'" for n in FACETS)}]) AS facet) GROUP BY 1""",
)
def facet_backfill_counts(spark, d):
    fresh = table(spark, d, "documents").select("doc_id", X.facets(F.col("text"), FACETS).alias("new"))
    return X.facet_changes(fresh.withColumn("old", F.when(F.col("doc_id") % 3 == 0, F.col("new")).otherwise(F.array(F.lit("result")))), list(FACETS))
