"""Queries over texts: keys, hashes, years, headings, repeated lines, facets, names and relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import facets as D
from lodestone.functions import text as X
from lodestone.functions.ontology import canonical_relation, canonical_relation_sql
from lodestone.operators import ingest as I
from lodestone.operators.joins import numbered
from lodestone.plans.registry import query
from lodestone.sources.tables import page_text, table


def fold_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(replace(lower(coalesce({x}, '')), 'đ', 'd')), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g'))"


def type_sql(x: str) -> str:
    return f"trim(regexp_replace(upper(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))), '[^A-Z0-9]+', '_', 'g'), '_')"


def words_sql(x: str) -> str:
    return f"list_filter(string_split({fold_sql(x)}, ' '), lambda w: length(w) >= 2)"


#: Facets over the test corpora's own vocabulary; users bring theirs.
FACETS = {"result": ["tion the", "ment de"], "forces": ["and the", "les de"], "scope": ["that", "que"], "policy": ["with", "und"]}
GENERIC = ["nation", "order", "part"]
PREFIXES = {"EVENT": ["hiep dinh ", "chien dich ", "red "], "DOCUMENT": ["nghi quyet ", "small "], "ORGANIZATION": ["uy ban ", "customer "]}


@query("text_fold_key", f"SELECT doc_id, md5({fold_sql('text')}) AS folded, length({fold_sql('text')}) AS n FROM documents")
def text_fold_key(spark, d):
    key = X.fold_key(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(key).alias("folded"), F.length(key).cast("long").alias("n"))


@query("text_content_hash", "SELECT doc_id, sha256(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))) AS content_hash FROM documents")
def text_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query(
    "text_first_occurrence",
    """WITH h AS (SELECT doc_id, source, sha256(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))) AS content_hash FROM documents),
    f AS (SELECT *, row_number() OVER (PARTITION BY source, content_hash ORDER BY doc_id) AS nth FROM h)
    SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS sequence FROM f WHERE nth = 1""",
)
def text_first_occurrence(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", X.content_hash(F.col("text")).alias("h"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("source", "h").orderBy("doc_id"))).where("nth = 1")
    return numbered(first.select("doc_id", "source"), "source", "doc_id", "sequence").withColumn("sequence", F.col("sequence").cast("long"))


@query(
    "text_metadata",
    """SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS word_count, list_min(y) AS year_start, list_max(y) AS year_end
    FROM (SELECT doc_id, text, list_transform(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: regexp_full_match(x, '1[0-9]{3}|20[0-9]{2}')), lambda x: CAST(x AS INTEGER)) AS y FROM documents)""",
)
def text_metadata(spark, d):
    rows = table(spark, d, "documents").withColumn("y", X.years(F.col("text")))
    return rows.select("doc_id", X.word_count(F.col("text")).cast("long").alias("word_count"), F.array_min("y").alias("year_start"), F.array_max("y").alias("year_end"))


@query(
    "text_heading",
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '') AS lines FROM documents),
    f AS (SELECT doc_id, lines[1] AS s, len(lines) AS n FROM l),
    m AS (SELECT *, len(regexp_extract_all(s, '\\p{L}')) AS letters, len(regexp_extract_all(s, '\\p{Lu}')) AS uppers FROM f)
    SELECT doc_id, CASE WHEN n >= 2 AND length(s) BETWEEN 3 AND 120 AND len(regexp_extract_all(s, '\\S+')) <= 18 AND NOT regexp_matches(s, '[.,;?!]$')
      AND (regexp_matches(s, '(?i)^(?:chương|phần|mục|tiết|[IVXLC]+[.)]|[0-9]+(?:\\.[0-9]+)*[.)])\\s*') OR (letters > 0 AND uppers >= 0.65 * letters)) THEN s ELSE '' END AS heading FROM m""",
)
def text_heading(spark, d):
    return table(spark, d, "documents").select("doc_id", X.heading(F.col("text")).alias("heading"))


#: A line of their source's name stands at the top of two documents in three, so that running lines occur.
_TITLED = "SELECT source, doc_id, CASE WHEN doc_id % 3 > 0 THEN concat('Book  of ', source, chr(10), text) ELSE coalesce(text, '') END AS text FROM documents WHERE source IS NOT NULL"
_RUNNING = f"""d AS ({_TITLED}), l AS (SELECT source, doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '') AS rows FROM d),
    u AS (SELECT DISTINCT source, doc_id, line FROM (SELECT source, doc_id, unnest(rows) AS line FROM l) WHERE length(line) <= 160), n AS (SELECT source, count(*) AS pages FROM d GROUP BY 1),
    c AS (SELECT u.source, line, count(*) AS n FROM u GROUP BY 1, 2), r AS (SELECT source, line, c.n FROM c JOIN n USING (source) WHERE c.n >= greatest(3, round_even(0.35 * pages, 0)))"""


def titled(spark, d):
    text = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Book  of "), "source", F.lit("\n"), "text")).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").where("source IS NOT NULL").select("source", F.col("doc_id").alias("page"), text.alias("text"))


@query("text_running_lines", f"WITH {_RUNNING} SELECT source, line, n FROM r")
def text_running_lines(spark, d):
    return I.running_lines(titled(spark, d))


@query("repeated_line_removal", f"WITH {_RUNNING}, g AS (SELECT source, list(line) AS gone FROM r GROUP BY 1) SELECT source, doc_id AS page, md5(array_to_string(list_filter(rows, lambda s: g.gone IS NULL OR NOT list_contains(g.gone, s)), chr(10))) AS text FROM l LEFT JOIN g USING (source)")
def repeated_line_removal(spark, d):
    return I.without_running_lines(titled(spark, d)).select("source", "page", F.md5("text").alias("text"))


_BODY = "array_to_string(list_transform(range(1, 15), lambda i: concat('line ', i, ' of ', doc_id, ' ', repeat('word ', 14))), chr(10))"


@query(
    "footnote_strip",
    f"""WITH b AS (SELECT doc_id, {_BODY} AS body FROM documents)
    SELECT doc_id, md5(CASE WHEN doc_id % 5 IN (0, 1) THEN array_to_string(list_transform(string_split(body, chr(10)), lambda s: trim(s)), chr(10)) WHEN doc_id % 5 = 2 THEN concat(body, chr(10), '1. a matter', chr(10), '2. another') WHEN doc_id % 5 = 3 THEN concat(body, chr(10), '2. NXB X, tr 4') ELSE concat('1. NXB X, tr 4', chr(10), body) END) AS text FROM b""",
)
def footnote_strip(spark, d):
    """Notes that cite and rise, one that lies low, notes that cite nothing, notes without a first one, and a note at the top."""
    line = lambda i: F.concat(F.lit("line "), i, F.lit(" of "), "doc_id", F.lit(" "), F.repeat(F.lit("word "), F.lit(14)))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(14)), line), "\n")
    k = F.col("doc_id") % 5
    notes = {0: "1. NXB X, tr 12.\n2. Sdd, tr 40.\n3. Van kien, tap 5.", 1: "1. Tai lieu, 1950", 2: "1. a matter\n2. another", 3: "2. NXB X, tr 4"}
    text = F.concat(F.lit("1. NXB X, tr 4\n"), body)
    for r, note in notes.items():
        text = F.when(k == r, F.concat(body, F.lit("\n" + note))).otherwise(text)
    return table(spark, d, "documents").select("doc_id", F.md5(I.without_footnotes(text)).alias("text"))


@query(
    "content_page_range",
    """WITH p AS (SELECT DISTINCT o_orderkey AS k, n AS page, CASE WHEN n = 3 AND o_orderkey % 2 = 0 THEN 'opens' WHEN n = 8 AND o_orderkey % 3 = 0 OR n = 4 AND o_orderkey % 7 = 0 THEN 'refers' ELSE '' END AS kind FROM orders, range(1, 10) t(n)),
    c AS (SELECT k, min(page) FILTER (WHERE kind = 'opens') AS a FROM p GROUP BY 1), r AS (SELECT k, min(page) AS b FROM p JOIN c USING (k) WHERE kind = 'refers' AND page > a GROUP BY 1),
    f AS (SELECT k, a, b, coalesce(a, 1) AS x, coalesce(b - 1, 9) AS y FROM c LEFT JOIN r USING (k))
    SELECT CAST(k AS VARCHAR) AS source, CASE WHEN y - x + 1 < 3 THEN 1 ELSE x END AS first, CASE WHEN y - x + 1 < 3 THEN 9 ELSE y END AS last, CASE WHEN y - x + 1 < 3 OR a IS NULL THEN 'full_document' WHEN b IS NOT NULL THEN 'chapter_1_to_references' ELSE 'chapter_1_to_end' END AS detection FROM f""",
)
def content_page_range(spark, d):
    # keys are few bytes and their pages are work: they stay dealt over all tasks
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").distinct()
    rows = keys.withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))))
    refers = ((F.col("page") == 8) & (F.col("k") % 3 == 0)) | ((F.col("page") == 4) & (F.col("k") % 7 == 0))
    text = F.when((F.col("page") == 3) & (F.col("k") % 2 == 0), "Chương  I\nthe first things").when(refers, "Tài liệu tham khảo\n[1] a book").otherwise("a page of text")
    return I.body_range(rows.select(F.col("k").cast("string").alias("source"), "page", text.alias("text")))


@query(
    "running_header_strip",
    "WITH b AS (SELECT doc_id, list_transform(range(1, 7), lambda i: concat('line ', i, ' of ', doc_id, ' ', repeat('word ', 14), '.')) AS rows FROM documents) SELECT doc_id, md5(CASE WHEN doc_id % 4 IN (0, 1) THEN array_to_string(rows, chr(10)) WHEN doc_id % 4 = 2 THEN concat('Chương IV', chr(10), array_to_string(rows, chr(10))) ELSE concat('Chuomg IV: the end of it...', chr(10), rows[1]) END) AS text FROM b",
)
def running_header_strip(spark, d):
    line = lambda i: F.concat(F.lit("line "), i, F.lit(" of "), "doc_id", F.lit(" "), F.repeat(F.lit("word "), F.lit(14)), F.lit("."))
    rows = F.transform(F.sequence(F.lit(1), F.lit(6)), line)
    body, k = F.array_join(rows, "\n"), F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit("Chuomg IV: the end of it...\n_______\n"), body)).when(k == 1, F.concat(F.lit("Lịch sử Việt Nam tập 12\n"), body)).when(k == 2, F.concat(F.lit("Chương IV\n"), body)).otherwise(F.concat(F.lit("Chuomg IV: the end of it...\n"), rows[0]))
    return table(spark, d, "documents").select("doc_id", F.md5(I.without_running_header(text)).alias("text"))


@query("text_distinct_words", f"SELECT item_id, array_to_string(list_sort(list_distinct({words_sql('text')})), ' ') AS words FROM benchmark")
def text_distinct_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.sort_array(X.words(F.col("text"))), " ").alias("words"))


@query(
    "text_search_terms",
    f"""WITH w AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(lower(text), '{X.QUERY_WORD}'), lambda w: trim(w, '_-')), lambda w: length({fold_sql('w')}) >= 2 AND {fold_sql('w')} NOT IN ('the', 'of', 'and')) AS w FROM benchmark),
    u AS (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w), f AS (SELECT item_id, t, min(i) AS i FROM u GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM f) SELECT item_id, string_agg(t, ' ' ORDER BY n) AS terms FROM r WHERE n <= 14 GROUP BY 1""",
)
def text_search_terms(spark, d):
    terms = X.capped_search_terms(F.col("text"), ["the", "of", "and"])
    return table(spark, d, "benchmark").select("item_id", F.array_join(terms, " ").alias("terms")).where("terms <> ''")


@query(
    "text_detail_phrases",
    f"""WITH t AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark), n AS (SELECT item_id, w, unnest([2, 3]) AS k FROM t),
    g AS (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT item_id, k, w, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM n))
    SELECT phrase, count(DISTINCT item_id) AS items FROM g GROUP BY 1""",
)
def text_detail_phrases(spark, d):
    tokens = F.filter(F.split(X.fold_key(F.col("text")), " "), lambda w: F.length(w) >= 2)
    rows = table(spark, d, "benchmark").select("item_id", tokens.alias("w")).select("item_id", F.explode(F.concat(X.grams(F.col("w"), 2), X.grams(F.col("w"), 3))).alias("phrase"))
    return rows.groupBy("phrase").agg(F.countDistinct("item_id").alias("items"))


_HITS = {name: " OR ".join(f"contains(k, '{t}')" for t in terms) for name, terms in FACETS.items()}


@query(
    "text_facets",
    f"SELECT doc_id, concat_ws(',', {', '.join(f'''CASE WHEN {h} THEN '{n}' END''' for n, h in _HITS.items())}) AS facets FROM (SELECT doc_id, {fold_sql('text')} AS k FROM documents)",
)
def text_facets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.facets(F.col("text"), FACETS), ",").alias("facets"))


@query(
    "facet_backfill_report",
    f"""WITH k AS (SELECT {fold_sql('text')} AS k FROM documents), f AS (SELECT unnest(list_filter([{', '.join(f"CASE WHEN {h} THEN '{n}' END" for n, h in _HITS.items())}], lambda x: x IS NOT NULL)) AS facet FROM k)
    SELECT facet, count(*) AS n FROM f GROUP BY 1""",
)
def facet_backfill_report(spark, d):
    rows = table(spark, d, "documents").select(F.explode(X.facets(F.col("text"), FACETS)).alias("facet"))
    return rows.groupBy("facet").agg(F.count(F.lit(1)).alias("n"))


@query(
    "entity_ids",
    f"""WITH e AS (SELECT 'PART' AS kind, p_name AS name FROM part UNION SELECT 'PERSON', c_name FROM customer)
    SELECT kind, name, concat_ws(':', lower(kind), substr(replace({fold_sql('name')}, ' ', '-'), 1, 96), substr(sha256(concat_ws(':', kind, {fold_sql('name')})), 1, 10)) AS canonical_id FROM e""",
)
def entity_ids(spark, d):
    parts = table(spark, d, "part").select(F.lit("PART").alias("kind"), F.col("p_name").alias("name"))
    people = table(spark, d, "customer").select(F.lit("PERSON").alias("kind"), F.col("c_name").alias("name"))
    return parts.unionByName(people).distinct().select("kind", "name", X.canonical_id(F.col("kind"), F.col("name")).alias("canonical_id"))


_STARTS = " ".join("WHEN " + " OR ".join(f"starts_with(k, '{p}')" for p in ps) + f" THEN '{kind}'" for kind, ps in PREFIXES.items())


@query(
    "entity_surfaces",
    f"""WITH e AS (SELECT p_name AS name FROM part UNION SELECT c_name FROM customer UNION SELECT n_name FROM nation UNION SELECT CAST(o_totalprice AS VARCHAR) FROM orders UNION SELECT CAST(year(o_orderdate) AS VARCHAR) FROM orders),
    k AS (SELECT name, {fold_sql('name')} AS k FROM e), t AS (SELECT *, CASE {_STARTS} ELSE '' END AS inferred FROM k)
    SELECT name, inferred, (k <> '' AND k NOT IN ('nation', 'order', 'part') AND NOT regexp_matches(k, '^[0-9][0-9 .,/-]*(nguoi|quan|binh si|chien si|nam|thang|ngay)?$') AND NOT regexp_matches(k, '^(nam )?(1[0-9]{{3}}|20[0-9]{{2}})$')
      AND (regexp_matches(name, '[A-Z]') OR inferred <> '')) AS valid FROM t""",
)
def entity_surfaces(spark, d):
    orders = table(spark, d, "orders")
    names = [table(spark, d, "part").select(F.col("p_name").alias("name")), table(spark, d, "customer").select("c_name"), table(spark, d, "nation").select("n_name"), orders.select(F.col("o_totalprice").cast("string")), orders.select(F.year("o_orderdate").cast("string"))]
    rows = names[0]
    for more in names[1:]:
        rows = rows.union(more)
    rows = rows.distinct()
    return rows.select("name", X.inferred_type(F.col("name"), PREFIXES).alias("inferred"), X.surface_is_name(F.col("name"), GENERIC, PREFIXES).alias("valid"))


RAW_RELATIONS = ["Thành lập", "diễn ra tại", "PART_OF", "chỉ huy trưởng", "gây ra", "hợp tác", "đối đầu với", "ký hiệp định", "has stage x", "trước khi", "mentioned in"]


@query(
    "relation_canonical",
    "WITH r AS (SELECT raw, event_type, count(*) AS n FROM (VALUES " + ", ".join(f"('{r}')" for r in RAW_RELATIONS) + f") v(raw), events GROUP BY 1, 2), f AS (SELECT raw, event_type, n, {type_sql('raw')} AS k, {type_sql('event_type')} AS e FROM r) SELECT raw, event_type, n, {canonical_relation_sql('k')} AS canonical, {canonical_relation_sql('e')} AS event_canonical FROM f",
)
def relation_canonical(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.withColumn("raw", F.explode(F.array(*[F.lit(r) for r in RAW_RELATIONS])))
    return rows.select("raw", "event_type", "n", canonical_relation(F.col("raw")).alias("canonical"), canonical_relation(F.col("event_type")).alias("event_canonical"))


@query(
    "display_dates",
    """SELECT o_orderkey, concat(day(o_orderdate), '/', month(o_orderdate), '/', year(o_orderdate)) AS shown, CAST(regexp_extract(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '(1[0-9]{3}|20[0-9]{2})', 1) AS INTEGER) AS year FROM orders""",
)
def display_dates(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", X.display_date(iso).alias("shown"), F.get(X.years(iso), F.lit(0)).alias("year"))


#: A marker of each domain in turn, and two of which the first domain counts, before the questions' texts.
_MARKED = [*(words[i % len(words)] for i, words in enumerate(D.DOMAIN_MARKERS.values())), "", "nhà Lê và Hiệp định"]
_DOMAIN = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(k, '{w}')" for w in words) + f" THEN '{name}'" for name, words in D.DOMAIN_MARKERS.items()) + " ELSE 'historical_event' END"
_ASKED = f"(SELECT item_id, {fold_sql('concat([' + ', '.join(repr(m) for m in _MARKED) + f'][1 + item_id % {len(_MARKED)}], chr(32), text)')} AS k FROM benchmark)"
_FACETS_OF = lambda table: "CASE d " + " ".join(f"WHEN '{n}' THEN '{','.join(fs)}'" for n, fs in table.items()) + f" ELSE '{','.join(table['historical_event'])}' END"
_EVOLVING = {n: list(dict.fromkeys(D.EVOLVING_CORE + fs)) for n, fs in D.EVOLVING.items()}


def _marked(spark, d):
    marker = F.get(F.array(*[F.lit(m) for m in _MARKED]), (F.col("item_id") % len(_MARKED)).cast("int"))
    return table(spark, d, "benchmark").select("item_id", F.concat(marker, F.lit(" "), "text").alias("text"))


@query("question_domain", f"SELECT item_id, {_DOMAIN} AS domain FROM {_ASKED}")
def question_domain(spark, d):
    return _marked(spark, d).select("item_id", D.question_domain(F.col("text")).alias("domain"))


@query("facet_domain_lists", f"SELECT item_id, {_FACETS_OF(D.COMPARED)} AS compared, {_FACETS_OF(_EVOLVING)} AS evolving FROM (SELECT item_id, {_DOMAIN} AS d FROM {_ASKED})")
def facet_domain_lists(spark, d):
    rows = _marked(spark, d).select("item_id", D.question_domain(F.col("text")).alias("domain"))
    return rows.select("item_id", F.array_join(D.comparison_facets(F.col("domain")), ",").alias("compared"), F.array_join(D.evolution_facets(F.col("domain")), ",").alias("evolving"))


@query(
    "page_texts",
    r"""WITH b AS (SELECT page_id, url, html, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g') AS bare FROM pages)
    SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_replace(bare, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM b""",
)
def page_texts(spark, d):
    return page_text(table(spark, d, "pages"))
