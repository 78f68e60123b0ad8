"""Queries of the retrieval channels, their fusion, gates, budgets and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import retrieval as R
from lodestone.operators.models import known_names
from lodestone.plans.registry import query
from lodestone.plans.text_queries import fold_sql, words_sql
from lodestone.sources.tables import page_text, table

_TOKENS = f"t AS (SELECT doc_id, {words_sql('text')} AS w FROM documents)"
_BM25 = f"""{_TOKENS}, s AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM t),
 q AS (SELECT DISTINCT query_id, unnest({words_sql('text')}) AS term FROM (SELECT item_id AS query_id, text FROM benchmark)),
 p AS (SELECT term, doc_id, len AS doc_len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 lex AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len))), 6) AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY 1, 2),
 lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex) WHERE rank <= 10)"""
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_VECTOR = f"""v AS (SELECT c.vec_id AS doc_id, q.vec_id AS query_id, round({_DOT('c.embedding', 'q.embedding')} / (sqrt({_DOT('c.embedding', 'c.embedding')}) * sqrt({_DOT('q.embedding', 'q.embedding')})), 6) AS score FROM embeddings c JOIN embeddings q ON q.vec_id < (SELECT count(*) FROM benchmark)),
 vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v) WHERE rank <= 10)"""
_PHRASE = f"""ph AS (SELECT item_id AS query_id, array_to_string(({words_sql('text')})[1:3], ' ') AS phrase FROM benchmark),
 ek AS (SELECT doc_id, {fold_sql('text')} AS k FROM documents),
 e AS (SELECT query_id, doc_id, length(k) AS n FROM ph JOIN ek ON phrase <> '' AND contains(concat(' ', k, ' '), concat(' ', phrase, ' '))),
 exact AS (SELECT query_id, doc_id, CAST(1.0 AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, doc_id) AS rank FROM e) WHERE rank <= 10)"""


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical(spark, d):
    return R.bm25(table(spark, d, "documents"), questions(spark, d), 10)


def vector(spark, d):
    vectors = table(spark, d, "embeddings")
    n = table(spark, d, "benchmark").count()
    asked = vectors.where(F.col("vec_id") < n).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.vector_top(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), asked, 10)


def first_phrases(spark, d):
    tokens = F.filter(F.split(X.fold_key(F.col("text")), " "), lambda w: F.length(w) >= 2)
    return questions(spark, d).select("query_id", F.array_join(F.slice(tokens, 1, 3), " ").alias("phrase"))


def exact(spark, d):
    return R.phrase_hits(table(spark, d, "documents"), first_phrases(spark, d), 10)


def channels(spark, d):
    """The exact, lexical and vector channels; texts are read once for the first two."""
    return R.text_channels(table(spark, d, "documents"), questions(spark, d), first_phrases(spark, d), 10) | {"vector": vector(spark, d)}


@query("lexical_top_k", f"WITH {_BM25} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM lexical")
def lexical_top_k(spark, d):
    return lexical(spark, d)


@query("vector_top_k", f"WITH {_VECTOR} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM vector")
def vector_top_k(spark, d):
    return vector(spark, d)


@query("exact_phrase_hits", f"WITH {_PHRASE} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM exact")
def exact_phrase_hits(spark, d):
    return exact(spark, d)


@query(
    "hybrid_retrieval",
    f"""WITH {_BM25}, {_VECTOR}, {_PHRASE},
 a AS (SELECT query_id, doc_id, rank, 'exact' AS channel, 4.0::DOUBLE AS weight, NULL::DOUBLE AS cosine FROM exact UNION ALL SELECT query_id, doc_id, rank, 'vector', 1.0, score FROM vector UNION ALL SELECT query_id, doc_id, rank, 'lexical', 1.0, NULL FROM lexical),
 g AS (SELECT query_id, doc_id, round(sum(weight / (60 + rank)), 9) AS rrf, coalesce(max(cosine), 0) AS cosine, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, bool_or(channel = 'exact') AS direct FROM a GROUP BY 1, 2),
 r AS (SELECT *, round(rrf / max(rrf) OVER (PARTITION BY query_id), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, cosine DESC, doc_id) AS rank FROM g)
 SELECT query_id, doc_id, channels, direct, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
)
def hybrid_retrieval(spark, d):
    return R.fused(channels(spark, d), 8)


_NAMED = f"""en AS (SELECT item_id AS query_id, array_to_string(({words_sql('text')})[4:5], ' ') AS name FROM benchmark),
 eh AS (SELECT query_id, doc_id FROM en JOIN ek ON name <> '' AND contains(concat(' ', k, ' '), concat(' ', name, ' '))),
 entity AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM eh) WHERE rank <= 10)"""


@query(
    "hybrid_four_channels",
    f"""WITH {_BM25}, {_VECTOR}, {_PHRASE}, {_NAMED},
 a AS (SELECT query_id, doc_id, rank, 'exact' AS channel, 4.0::DOUBLE AS weight, NULL::DOUBLE AS cosine FROM exact UNION ALL SELECT query_id, doc_id, rank, 'entity', 2.5, NULL FROM entity UNION ALL SELECT query_id, doc_id, rank, 'vector', 1.0, score FROM vector UNION ALL SELECT query_id, doc_id, rank, 'lexical', 1.0, NULL FROM lexical),
 g AS (SELECT query_id, doc_id, round(sum(weight / (60 + rank)), 9) AS rrf, coalesce(max(cosine), 0) AS cosine, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, bool_or(channel = 'exact') AS direct FROM a GROUP BY 1, 2),
 z AS (SELECT *, round(rrf / max(rrf) OVER (PARTITION BY query_id), 6) AS score, round(rrf + CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 0.002 ELSE 0 END, 9) AS lifted FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lifted DESC, cosine DESC, doc_id) AS rank FROM z)
 SELECT query_id, doc_id, channels, direct, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 24""",
)
def hybrid_four_channels(spark, d):
    """All four channels, names of entities being two words of the question, with well-labelled documents as official ones."""
    name = F.array_join(F.slice(F.filter(F.split(X.fold_key(F.col("text")), " "), lambda w: F.length(w) >= 2), 4, 2), " ")
    wanted = questions(spark, d).select("query_id", name.alias("search_key")).where("search_key <> ''")
    found = known_names(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), wanted.select("search_key").distinct().withColumns({"kind": F.lit("NAME"), "canonical_name": F.col("search_key")}))
    entity = R.key_hits(found.select(F.col("chunk_id").alias("doc_id"), F.col("name").alias("search_key")), wanted, 10)
    official = table(spark, d, "labels").where("quality = 1")
    return R.fused(channels(spark, d) | {"entity": entity}, 24, official)


@query(
    "entity_channel",
    f"""WITH k AS (SELECT DISTINCT p_partkey AS doc_id, {fold_sql('p_name')} AS search_key FROM part), w AS (SELECT DISTINCT p_brand AS query_id, {fold_sql('p_name')} AS search_key FROM part),
    h AS (SELECT DISTINCT query_id, doc_id FROM k JOIN w USING (search_key)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM h)
    SELECT query_id, doc_id, CAST(1.0 AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 24""",
)
def entity_channel(spark, d):
    part = table(spark, d, "part")
    keys = part.select(F.col("p_partkey").alias("doc_id"), X.fold_key(F.col("p_name")).alias("search_key"))
    wanted = part.select(F.col("p_brand").alias("query_id"), X.fold_key(F.col("p_name")).alias("search_key")).distinct()
    return R.key_hits(keys, wanted, 24)


@query(
    "timeline_windows",
    """WITH w AS (SELECT unnest(range(1995, 2002, 2)) AS s), o AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, o_totalprice AS score FROM orders),
    r AS (SELECT concat('w', s) AS window_id, id, y AS y0, score, row_number() OVER (PARTITION BY s ORDER BY score DESC, id) AS rank FROM o JOIN w ON y BETWEEN s AND s + 1)
    SELECT window_id, id, CAST(y0 AS INTEGER) AS y0, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def timeline_windows(spark, d):
    start = spark.range(1995, 2002, 2).select(F.concat(F.lit("w"), "id").alias("window_id"), F.col("id").cast("int").alias("start"), (F.col("id") + 1).cast("int").alias("end"))
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y0"), F.lit(None).cast("int").alias("y1"), F.col("o_totalprice").alias("score"))
    # with no end year of its own a record ends in the year it starts
    return R.in_windows(records.withColumn("y1", F.col("y0")), start, 5).select("window_id", "id", "y0", "score", "rank")


@query(
    "temporal_gate",
    """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate) END AS y0 FROM orders) SELECT id, CAST(y0 AS INTEGER) AS y0 FROM o WHERE y0 IS NULL OR y0 BETWEEN 1996 AND 1998""",
)
def temporal_gate(spark, d):
    y0 = F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.year("o_orderdate"))
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), y0.alias("y0"), F.lit(None).cast("int").alias("y1"), F.lit(1996).alias("start"), F.lit(1998).alias("end"))
    return R.temporal_gate(items).select("id", "y0")


_STOP = ", ".join(f"'{w}'" for w in X.RECORD_STOP)


@query(
    "published_search",
    rf"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
      trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages),
    k AS (SELECT page_id, {fold_sql("concat_ws(' ', title, body)")} AS k, {fold_sql('title')} AS h FROM p),
    q AS (SELECT item_id AS query_id, u.t AS t, u.i FROM (SELECT item_id, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'t': w[i], 'i': i}})) AS u FROM (SELECT item_id, list_filter({words_sql('text')}, lambda t: t NOT IN ({_STOP})) AS w FROM benchmark))),
    u AS (SELECT query_id, t, min(i) AS i FROM q GROUP BY 1, 2), o AS (SELECT query_id, list(t ORDER BY i) AS w FROM u GROUP BY 1),
    c AS (SELECT query_id, page_id, len(w) AS n, len(list_filter(w, lambda t: contains(k, t))) AS hits, len(list_filter(w, lambda t: contains(h, t))) AS title_hits, contains(k, array_to_string(w[1:5], ' ')) AS opening FROM o, k),
    s AS (SELECT query_id, page_id, round(CASE WHEN hits < 2 OR hits / n < 0.28 THEN 0.0 ELSE least(1.0, 0.72 * (hits / n) + 0.20 * title_hits / n + CASE WHEN opening THEN 0.12 ELSE 0.0 END) END, 6) AS score FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM s WHERE score > 0)
    SELECT query_id, page_id AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""",
)
def published_search(spark, d):
    pages = page_text(table(spark, d, "pages")).select(F.col("page_id").alias("doc_id"), "title", "body")
    return R.published_top(pages, questions(spark, d), 6)


@query(
    "composite_rank",
    """WITH i AS (SELECT o_custkey % 50 AS query_id, o_orderkey % 400 AS doc_id, round(o_totalprice / 500000, 4) AS raw, round((o_orderkey % 100) / 100, 4) AS covered, o_orderstatus = 'F' AS reviewed FROM orders),
    b AS (SELECT query_id, doc_id, max(raw) AS raw, max(covered) AS covered, bool_or(reviewed) AS reviewed FROM i GROUP BY 1, 2),
    v AS (SELECT query_id, doc_id, round(0.55 * raw + 0.45 * covered + CASE WHEN reviewed THEN 0.12 ELSE 0 END, 9) AS v FROM b),
    s AS (SELECT query_id, doc_id, round(v / max(v) OVER (PARTITION BY query_id), 6) AS score FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
)
def composite_rank(spark, d):
    items = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("query_id"), (F.col("o_orderkey") % 400).alias("doc_id"), F.round(F.col("o_totalprice") / 500000, 4).alias("raw"), F.round((F.col("o_orderkey") % 100) / 100, 4).alias("covered"), (F.col("o_orderstatus") == "F").alias("reviewed"))
    return R.composite(items, 10)


@query(
    "evidence_reservation",
    """WITH i AS (SELECT o_custkey % 20 AS query_id, o_orderkey AS doc_id, o_totalprice AS score, o_orderpriority = '1-URGENT' AS curated, o_orderstatus = 'F' AS detail FROM orders),
    a AS (SELECT *, row_number() OVER (PARTITION BY query_id, curated ORDER BY score DESC, doc_id) AS n FROM i), b AS (SELECT *, curated AND n <= 12 AS t0 FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id, t0, detail ORDER BY score DESC, doc_id) AS m FROM b),
    t AS (SELECT query_id, doc_id, score, CASE WHEN t0 THEN 0 WHEN detail AND m <= 16 THEN 1 ELSE 2 END AS tier FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, doc_id) AS rank FROM t) SELECT query_id, doc_id, score, CAST(tier AS INTEGER) AS tier, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 48""",
)
def evidence_reservation(spark, d):
    items = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"), (F.col("o_orderpriority") == "1-URGENT").alias("curated"), (F.col("o_orderstatus") == "F").alias("detail"))
    return R.reserved(items, [("curated", 12), ("detail", 16)], 48).select("query_id", "doc_id", "score", "tier", "rank")


@query(
    "requirement_coverage",
    """WITH r AS (SELECT c_custkey AS requirement_id, c_nationkey AS plan_id FROM customer), e AS (SELECT o_custkey AS requirement_id, year(o_orderdate) AS y FROM orders),
    w AS (SELECT unnest([1996, 1998, 2000]) AS y), c AS (SELECT requirement_id, count(DISTINCT y) AS n FROM e WHERE y IN (SELECT y FROM w) GROUP BY 1)
    SELECT plan_id, count(*) AS required, count(*) FILTER (WHERE c.n = 3) AS covered, string_agg(CASE WHEN coalesce(c.n, 0) < 3 THEN CAST(r.requirement_id AS VARCHAR) END, ',' ORDER BY r.requirement_id) AS missing FROM r LEFT JOIN c USING (requirement_id) GROUP BY 1""",
)
def requirement_coverage(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("requirement_id"), F.col("c_nationkey").alias("plan_id"))
    found = table(spark, d, "orders").where(F.year("o_orderdate").isin(1996, 1998, 2000)).groupBy(F.col("o_custkey").alias("requirement_id")).agg(F.countDistinct(F.year("o_orderdate")).alias("n"))
    rows = wanted.join(found, "requirement_id", "left").withColumn("gap", F.coalesce("n", F.lit(0)) < 3)
    gaps = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("gap"), F.col("requirement_id")))), lambda x: x.cast("string")), ",")
    return rows.groupBy("plan_id").agg(F.count(F.lit(1)).alias("required"), F.count_if(F.col("n") == 3).alias("covered"), F.nullif(gaps, F.lit("")).alias("missing"))


@query(
    "answer_confidence",
    """WITH a AS (SELECT o_custkey AS id, count(*) FILTER (WHERE o_orderstatus = 'F') AS covered, count(*) AS required, round(avg(o_totalprice) / 600000, 6) AS score, min(o_orderpriority) AS p, count(*) FILTER (WHERE o_orderstatus = 'P') // 6 AS conflicts FROM orders GROUP BY 1),
    v AS (SELECT *, CASE p WHEN '1-URGENT' THEN 'supported' WHEN '2-HIGH' THEN 'corrected' WHEN '3-MEDIUM' THEN 'not_run' ELSE 'insufficient' END AS verdict, least(1.0, covered / greatest(required, 1)) AS cover FROM a)
    SELECT id, verdict, round(round(least(greatest(0, least(1, 0.45::DOUBLE * cover + 0.30::DOUBLE * score + 0.25::DOUBLE * CASE verdict WHEN 'supported' THEN 1.0 WHEN 'corrected' THEN 0.82 WHEN 'not_run' THEN 0.78 ELSE 0.25 END)),
      CASE WHEN conflicts > 0 THEN 0.6 ELSE 1 END, CASE WHEN verdict = 'corrected' THEN 0.8 ELSE 1 END, CASE WHEN verdict = 'insufficient' THEN 0.4 ELSE 1 END, CASE WHEN cover < 1 THEN 0.65 ELSE 1 END), 6), 4) AS confidence FROM v""",
)
def answer_confidence(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("covered"), F.count(F.lit(1)).alias("required"), F.round(F.avg("o_totalprice") / 600000, 6).alias("score"), F.min("o_orderpriority").alias("p"), F.floor(F.count_if(F.col("o_orderstatus") == "P") / 6).alias("conflicts"))
    verdict = F.when(F.col("p") == "1-URGENT", "supported").when(F.col("p") == "2-HIGH", "corrected").when(F.col("p") == "3-MEDIUM", "not_run").otherwise("insufficient")
    rows = rows.withColumn("verdict", verdict)
    return rows.select("id", "verdict", F.round(R.confidence(F.col("covered"), F.col("required"), F.col("score"), F.col("verdict"), F.col("conflicts")), 4).alias("confidence"))


@query(
    "content_suggestions",
    rf"""WITH p AS (SELECT page_id, list_distinct({words_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}) AS t FROM pages), q AS (SELECT item_id, list_distinct({words_sql('text')}) AS w FROM benchmark),
    s AS (SELECT item_id, page_id, round(2.0 * len(list_intersect(t, w)) / (len(t) + len(w)), 6) AS dice FROM q, p WHERE len(list_intersect(t, w)) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dice DESC, page_id) AS rank FROM s)
    SELECT item_id, page_id, dice, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""",
)
def content_suggestions(spark, d):
    titles = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), X.words(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("words"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), X.words(F.col("text")).alias("words"))
    return R.alike(titles, asked, 3).withColumnsRenamed({"query_id": "item_id", "doc_id": "page_id"})


@query(
    "exact_two_phrases",
    f"""WITH ph AS (SELECT item_id AS query_id, i AS ord, array_to_string(w[1 + 3 * i : 3 + 3 * i], ' ') AS phrase FROM (SELECT item_id, {words_sql('text')} AS w FROM benchmark), range(2) t(i)),
    ek AS (SELECT doc_id, {fold_sql('text')} AS k FROM documents WHERE doc_id % 7 > 0 AND source IS DISTINCT FROM (SELECT min(source) FROM documents)),
    e AS (SELECT query_id, ord, doc_id, row_number() OVER (PARTITION BY query_id, ord ORDER BY length(k), doc_id) AS r FROM ph JOIN ek ON phrase <> '' AND contains(concat(' ', k, ' '), concat(' ', phrase, ' ')))
    SELECT query_id, doc_id, CAST(1.0 AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ord, r) AS INTEGER) AS rank FROM e WHERE r <= 10""",
)
def exact_two_phrases(spark, d):
    """Two phrases a question over the chunks that are on: every seventh is off, and one source is."""
    docs = table(spark, d, "documents")
    sources = docs.where("source IS NOT NULL").select(F.col("source").alias("source_id")).distinct().crossJoin(docs.agg(F.min("source").alias("off")))  # one row
    chunks = docs.select("doc_id", "text", F.col("source").alias("source_id"), (F.col("doc_id") % 7 > 0).alias("active"))
    on = R.active(chunks, sources.select("source_id", (F.col("source_id") != F.col("off")).alias("active")))
    phrases = questions(spark, d).select("query_id", F.posexplode(F.array(*[F.array_join(F.slice(R.tokens_of(F.col("text")), 1 + 3 * i, 3), " ") for i in range(2)])).alias("ord", "phrase"))
    return R.phrase_hits(on, phrases, 10)


@query(
    "eval_concepts",
    f"""WITH k AS (SELECT doc_id, {fold_sql('text')} AS k FROM documents) SELECT doc_id, (contains(k, 'the') OR contains(k, 'les')) AND (contains(k, 'tion') OR contains(k, 'ung')) AS required_ok, NOT (contains(k, 'password') OR contains(k, 'idiot')) AS forbidden_ok FROM k""",
)
def eval_concepts(spark, d):
    key = X.fold_key(F.col("text"))
    has = lambda w: F.contains(key, F.lit(w))
    return table(spark, d, "documents").select("doc_id", ((has("the") | has("les")) & (has("tion") | has("ung"))).alias("required_ok"), (~(has("password") | has("idiot"))).alias("forbidden_ok"))


@query(
    "chat_history_window",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6",
)
def chat_history_window(spark, d):
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").withColumn("n", F.row_number().over(order)).where("n <= 6").select("conv_id", "turn", "role")
