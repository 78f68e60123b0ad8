"""Property-graph operators over nodes (id, label, title, ...) and edges (src, dst, type, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.ontology import CANONICAL, canonical_relation
from lodestone.functions.text import fold_key
from lodestone.operators.joins import is_small


def label_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by label and by relation type as (kind, name, n)."""
    a = nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    b = edges.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    return a.unionByName(b)


def ontology_preview(edges: DataFrame) -> DataFrame:
    """Per relation type: its canonical name, count, and whether it would be migrated."""
    counts = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("type", canonical_relation(F.col("type")).alias("canonical"), "n", (~F.col("type").isin(CANONICAL)).alias("migrates"))


def migrated(edges: DataFrame) -> DataFrame:
    """Edges under canonical types; raw_type keeps the first name an edge had."""
    raw = F.coalesce("raw_type", "type") if "raw_type" in edges.columns else F.col("type")
    return edges.withColumn("raw_type", raw).withColumn("type", canonical_relation(F.col("type")))


def search(nodes: DataFrame, text: str, limit: int = 100, label: str = "", labels: list[str] | None = None) -> DataFrame:
    """Nodes (id, label, title, and aliases and search_keys where there are such columns) that a text is part of: title or an alias, whatever the case, or a search key, folded. By title and id.

    label narrows to one label, which must be among the visible `labels`; an empty text finds all.
    """
    if label and labels is not None and label not in labels:
        raise ValueError(f"not a visible label: {label}")
    low, key = F.lower(F.lit(text.strip())), fold_key(F.lit(text))
    hit = F.contains(F.lower(F.coalesce("title", "id")), low)
    if "aliases" in nodes.columns:
        hit = hit | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), low))
    if "search_keys" in nodes.columns:
        hit = hit | F.exists(F.coalesce("search_keys", F.array().cast("array<string>")), lambda k: F.contains(k, key))
    found = nodes if not text.strip() else nodes.where(hit)
    found = found.where(F.col("label") == label) if label else found if labels is None else found.where(F.col("label").isin(labels))
    return found.orderBy("title", "id").limit(max(1, min(limit, 100)))


def relations_found(nodes: DataFrame, edges: DataFrame, text: str, kind: str = "", limit: int = 100) -> DataFrame:
    """Edges (type, and raw_type where there is one) whose type, first type or either end's title holds a text, whatever the case: type, src, dst, source, target. By type and titles."""
    low = F.lower(F.lit(text.strip()))
    a, b = nodes.select(F.col("id").alias("src"), F.col("title").alias("source")), nodes.select(F.col("id").alias("dst"), F.col("title").alias("target"))
    chosen = edges.where(F.col("type") == kind) if kind else edges
    joined = chosen.join(a, "src").join(b, "dst")
    said = [c for c in ("type", "raw_type", "source", "target") if c in joined.columns]
    hit = F.exists(F.array(*[F.coalesce(c, F.lit("")) for c in said]), lambda x: F.contains(F.lower(x), low))
    return joined.where(hit).orderBy("type", "source", "target", "src", "dst").limit(max(1, min(limit, 100))).select("type", "src", "dst", "source", "target")


def structure(sources: DataFrame, pages: DataFrame, chunks: DataFrame, links: DataFrame, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """links (src, dst, type) with those that were missing, and a report of every source: source_id, page_nodes, chunk_nodes, linked_pages, linked_chunks, repaired_pages, repaired_chunks, valid.

    sources: (source_id); pages: (page_id, source_id); chunks: (chunk_id, source_id, page_id, page). A source has its pages, and a page its chunks; a chunk without a page_id belongs to
    that of its page number, if there is one. A source is valid when all its pages and chunks are linked, and are as many as expected (source_id, pages, chunks).
    """
    own = chunks.select("chunk_id", "source_id", F.coalesce("page_id", F.concat("source_id", F.lit("-p"), "page")).alias("page_id"))
    page_wanted = pages.join(sources, "source_id", "left_semi").select(F.col("source_id").alias("src"), F.col("page_id").alias("dst"), F.lit("HAS_PAGE").alias("type"))
    chunk_wanted = own.join(pages.select("page_id"), "page_id", "left_semi").select(F.col("page_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("HAS_CHUNK").alias("type"))
    linked_chunks = links.where("type = 'HAS_CHUNK'").select("dst").distinct()  # a chunk that hangs on any page isn't moved
    page_missing = page_wanted.join(links, ["src", "dst", "type"], "left_anti")
    chunk_missing = chunk_wanted.join(linked_chunks, "dst", "left_anti").select("src", "dst", "type")
    whole = links.select("src", "dst", "type").unionByName(page_missing).unionByName(chunk_missing).distinct()
    report = (_counts_by_source if _named_after_sources(sources, pages, own, links) else _structure_counts)(sources, pages, own, links)
    valid = (F.col("linked_pages") == F.col("page_nodes")) & (F.col("linked_chunks") == F.col("chunk_nodes"))
    if expected is not None:
        report = report.join(expected.select("source_id", F.col("pages").alias("__p"), F.col("chunks").alias("__c")), "source_id", "left")
        valid = valid & F.coalesce(F.col("linked_pages") == F.col("__p"), F.lit(True)) & F.coalesce(F.col("linked_chunks") == F.col("__c"), F.lit(True))
    return whole, report.withColumn("valid", valid).drop("__p", "__c")


_COUNTS = ["page_nodes", "chunk_nodes", "linked_pages", "linked_chunks", "repaired_pages", "repaired_chunks"]


def _source_of(name: str) -> Column:
    """The source in the id of a page or a chunk that is named after it: what stands before the first "-p"."""
    return F.substring_index(name, "-p", 1)


def _named_after_sources(sources: DataFrame, pages: DataFrame, own: DataFrame, links: DataFrame) -> bool:
    """Whether each page and chunk is named after its source, and both ends of each link after one, so that an id alone tells where it belongs. Rows are read for this, and none is dealt."""
    ids = [sources.schema["source_id"], *(pages.schema[c] for c in ("page_id", "source_id")), *(own.schema[c] for c in ("chunk_id", "source_id", "page_id")), *(links.schema[c] for c in ("src", "dst"))]
    if any(x.dataType != StringType() for x in ids):
        return False
    told = lambda df, sound: df.select(F.coalesce(sound, F.lit(False)).alias("sound"))
    every = told(sources, F.col("source_id") == _source_of("source_id"))
    every = every.unionByName(told(pages, F.col("source_id") == _source_of("page_id")))
    every = every.unionByName(told(own, (F.col("source_id") == _source_of("page_id")) & (F.col("source_id") == _source_of("chunk_id"))))
    every = every.unionByName(told(links.where("type = 'HAS_PAGE'"), F.col("src") == _source_of("dst")))
    every = every.unionByName(told(links.where("type = 'HAS_CHUNK'"), _source_of("src") == _source_of("dst")))
    return every.agg(F.min("sound")).first()[0] is True


# What a row tells of a page, a chunk or a source.
_PAGE, _LINK, _SAID, _HUNG, _ASKED = 1, 2, 4, 8, 16


def _counts_by_source(sources: DataFrame, pages: DataFrame, own: DataFrame, links: DataFrame) -> DataFrame:
    """_structure_counts() where ids are named after sources: every row is dealt once, by its source, with the rest of its ids, and what belongs together meets there."""
    rest = lambda name, source: F.substring(F.col(name), F.length(source) + 1, F.length(name))
    none = F.lit(None).cast("string")
    row = lambda df, source, page, chunk, kind: df.select(source.alias("source_id"), page.alias("page"), chunk.alias("chunk"), F.lit(kind).cast("byte").alias("kind"))
    at = _source_of("src")
    rows = row(sources, F.col("source_id"), none, none, _ASKED)
    rows = rows.unionByName(row(pages, F.col("source_id"), rest("page_id", F.col("source_id")), none, _PAGE))
    rows = rows.unionByName(row(links.where("type = 'HAS_PAGE'"), F.col("src"), rest("dst", F.col("src")), none, _LINK))
    rows = rows.unionByName(row(own, F.col("source_id"), rest("page_id", F.col("source_id")), rest("chunk_id", F.col("source_id")), _SAID))
    rows = rows.unionByName(row(links.where("type = 'HAS_CHUNK'"), at, rest("src", at), rest("dst", at), _HUNG))
    tells = lambda kind: F.col("kind").bitwiseAND(F.lit(kind).cast("byte")) != 0
    once = rows.repartition("source_id").groupBy("source_id", "page", "chunk").agg(F.bit_or("kind").alias("kind"))
    once = once.withColumn("there", F.max(tells(_PAGE)).over(Window.partitionBy("source_id", "page")))
    # a chunk hangs where it is linked, or else where it should be
    a_page, said, hung = F.col("chunk").isNull() & tells(_PAGE), tells(_SAID), tells(_HUNG)
    met = once.groupBy("source_id", "chunk").agg(
        F.max(tells(_ASKED)).alias("asked"), F.count_if(a_page).alias("page_nodes"), F.count_if(a_page & ~tells(_LINK)).alias("repaired_pages"),
        F.max(said).alias("said"), F.max(hung).alias("hangs"), F.max(said & F.col("there")).alias("said_there"), F.max(hung & F.col("there")).alias("hung_there"),
    )
    linked = F.when(F.col("hangs"), F.col("hung_there")).otherwise(F.col("said_there"))
    every = met.groupBy("source_id").agg(
        F.max("asked").alias("asked"), F.sum("page_nodes").alias("page_nodes"), F.count_if("said").alias("chunk_nodes"), F.sum("page_nodes").alias("linked_pages"),
        F.count_if(linked).alias("linked_chunks"), F.sum("repaired_pages").alias("repaired_pages"), F.count_if(~F.col("hangs") & F.col("said_there")).alias("repaired_chunks"),
    )
    return every.where("asked").select("source_id", *_COUNTS)


def _structure_counts(sources: DataFrame, pages: DataFrame, own: DataFrame, links: DataFrame) -> DataFrame:
    """The counts of structure()'s report. Every row is dealt three times at most, by its chunk, its page and its source, and repeated rows count once.

    A chunk that has one place is a number from then on; one with several keeps its id as far as the source, so that no source counts it twice.
    """
    one, none = F.lit(1), F.lit(0)
    place = lambda page_id, source_id, chunk_id=F.lit(None), page=none, link=none, n=none, repaired=none, nodes=none: F.struct(
        page_id.alias("page_id"), source_id.alias("source_id"), chunk_id.cast(own.schema["chunk_id"].dataType).alias("chunk_id"), page.alias("page"), link.alias("link"), n.alias("n"), repaired.alias("repaired"), nodes.alias("nodes")
    )
    # by chunk: where it hangs, or else where it should
    said = own.select("chunk_id", F.struct("page_id", "source_id").alias("own"), F.lit(False).alias("hangs"))
    hung = links.where("type = 'HAS_CHUNK'").select(F.col("dst").alias("chunk_id"), F.struct(F.col("src").alias("page_id"), F.lit(None).cast(own.schema["source_id"].dataType).alias("source_id")).alias("own"), F.lit(True).alias("hangs"))
    met = said.unionByName(hung).where("chunk_id IS NOT NULL").repartition("chunk_id").groupBy("chunk_id")
    met = met.agg(F.collect_set(F.when(F.col("hangs"), F.col("own"))).alias("at"), F.collect_set(F.when(~F.col("hangs"), F.col("own"))).alias("own"))
    hangs, has = F.size("at") > 0, F.size("own")
    first = lambda name: F.get(name, none)
    single = place(F.when(hangs, first("at")["page_id"]).otherwise(first("own")["page_id"]), first("own")["source_id"], n=one, repaired=F.when(hangs, none).otherwise(one), nodes=has)
    several = F.concat(
        F.transform(F.when(hangs, F.col("at")).otherwise(F.col("own")), lambda x: place(x["page_id"], x["source_id"], F.col("chunk_id"), repaired=F.when(hangs, none).otherwise(one))),
        F.transform(F.array_distinct(F.transform("own", lambda x: x["source_id"])), lambda x: place(first("own")["page_id"], x, nodes=one)),
    )
    chunk_rows = met.select(F.explode(F.when((F.size("at") <= 1) & (has <= 1), F.array(single)).otherwise(several)).alias("x")).select("x.*")
    # by page: whether there is one, and the sources that it hangs on when all is repaired
    page_rows = pages.select(place(F.col("page_id"), F.col("source_id"), page=one).alias("x")).select("x.*")
    link_rows = links.where("type = 'HAS_PAGE'").select(place(F.col("dst"), F.col("src"), link=one).alias("x")).select("x.*")
    rows = page_rows.unionByName(link_rows).unionByName(chunk_rows).withColumn("lone", F.when(F.col("page_id").isNull(), F.xxhash64("source_id")))
    rows = rows.repartition("page_id", "lone").groupBy("page_id", "lone", "source_id", "chunk_id")
    rows = rows.agg(F.max("page").alias("page"), F.max("link").alias("link"), F.sum("n").alias("n"), F.sum("repaired").alias("repaired"), F.sum("nodes").alias("nodes"))
    at, known = Window.partitionBy("page_id", "lone"), F.col("page_id").isNotNull()
    rows = rows.withColumns({"there": F.when(known, F.max("page").over(at)).otherwise(none), "total": F.sum("n").over(at), "several": F.max(F.col("chunk_id").isNotNull()).over(at)})
    held = F.greatest("page", "link") * F.col("there")
    rows = rows.withColumn("by", F.collect_set(F.when(F.col("several") & (held > 0), F.col("source_id"))).over(at))
    told = lambda source_id, chunk_id=F.lit(None), **counts: F.struct(source_id.alias("source_id"), chunk_id.cast(own.schema["chunk_id"].dataType).alias("chunk_id"), *[counts.get(c, none).cast("long").alias(c) for c in _COUNTS])
    page = F.when(known, F.col("page")).otherwise(none)
    plain = told(F.col("source_id"), page_nodes=page, chunk_nodes=F.col("nodes"), linked_pages=held, linked_chunks=held * F.col("total"), repaired_pages=page * (1 - F.col("link")), repaired_chunks=F.col("there") * F.col("repaired"))
    twice = F.concat(F.array(told(F.col("source_id"), F.col("chunk_id"), repaired_chunks=F.col("there") * F.col("repaired"))), F.transform("by", lambda s: told(s, F.col("chunk_id"), linked_chunks=one)))
    counts = rows.select(F.explode(F.when(F.col("chunk_id").isNull(), F.array(plain)).otherwise(twice)).alias("x")).select("x.*").where("source_id IS NOT NULL")
    # by source
    every = sources.select(told(F.col("source_id")).alias("x")).select("x.*").withColumn("asked", F.lit(True))
    every = every.unionByName(counts.withColumn("asked", F.lit(False))).repartition("source_id").groupBy("source_id", "chunk_id")
    once = lambda c: F.when(F.col("chunk_id").isNull(), F.sum(c)).otherwise(F.least(F.sum(c), one)).alias(c)
    every = every.agg(F.max("asked").alias("asked"), *[once(c) for c in _COUNTS]).groupBy("source_id").agg(F.max("asked").alias("asked"), *[F.sum(c).alias(c) for c in _COUNTS])
    return every.where("asked").select("source_id", *_COUNTS)


def source_chunks(chunks: DataFrame, mentions: DataFrame, report: DataFrame, page: int | None = None, spellings: list[str] | None = None, limit: int = 80, by: str = "chunk_id") -> DataFrame:
    """The first chunks (source_id, chunk_id, page, sequence, text) of each valid source with the names of their entities, an empty list without any.

    mentions: (chunk_id, name), or names under another column of the chunks, `by`, which is null where nothing is mentioned. page narrows to one page, spellings to texts that hold one of
    them, whatever the case. Names are put together before they are joined, and only the chunks that stay meet them.
    """
    rows = chunks.join(report.where("valid").select("source_id"), "source_id", "left_semi")
    rows = rows if page is None else rows.where(F.col("page") == page)
    rows = rows if not spellings else rows.where(F.exists(F.array(*[F.lower(F.lit(x)) for x in spellings]), lambda x: F.contains(F.lower("text"), x)))
    order = Window.partitionBy("source_id").orderBy("sequence", "chunk_id")
    rows = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= max(1, min(limit, 200)))
    names = mentions.groupBy(by).agg(F.sort_array(F.collect_set("name")).alias("entities")).withColumn("__lone", F.lit(0).cast("long"))
    lone = F.when(F.col(by).isNull(), F.xxhash64("source_id", "chunk_id")).otherwise(F.lit(0))  # chunks without a mention aren't dealt to one task
    return rows.withColumn("__lone", lone).join(names, [by, "__lone"], "left").drop("__lone").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def neighbours(nodes: DataFrame, edges: DataFrame, cap: int = 12) -> DataFrame:
    """(id, other, type, direction) of edges at the given nodes in either direction, at most cap a node by (type, other, direction). Edges are read once, and meet the nodes when each end has its first cap."""
    way = lambda at, other, name: F.struct(F.col(at).alias("id"), F.col(other).alias("other"), "type", F.lit(name).alias("direction"))
    both = edges.select(F.explode(F.array(way("src", "dst", "out"), way("dst", "src", "in"))).alias("e")).select("e.*").where("id IS NOT NULL")
    order = Window.partitionBy("id").orderBy("type", "other", "direction")
    first = both.withColumn("at", F.row_number().over(order)).where(F.col("at") <= cap)
    return first.join(nodes.select("id").distinct(), "id", "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no edge."""
    return nodes.join(edges, nodes["id"] == edges["src"], "left_anti").join(edges, nodes["id"] == edges["dst"], "left_anti")


def missing_links(children: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(src, dst, type) that children (id, parent) should have and edges of that type lack."""
    wanted = children.select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit(kind).alias("type"))
    return wanted.join(edges.where(F.col("type") == kind), ["src", "dst"], "left_anti").select("src", "dst", "type")


def component_export(nodes: DataFrame, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a label with their neighbours (is_member false), and the edges between them."""
    members = nodes.where(F.col("label") == label).select("id")
    touched = edges.join(members, edges["src"] == members["id"], "left_semi").unionByName(edges.join(members, edges["dst"] == members["id"], "left_semi")).distinct()
    ends = touched.select(F.col("src").alias("id")).unionByName(touched.select(F.col("dst").alias("id"))).unionByName(members).distinct()
    return nodes.join(ends, "id", "left_semi").withColumn("is_member", F.col("label") == label), touched


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new brings, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def type_conflicts(entities: DataFrame) -> DataFrame:
    """Search keys under which entities (id, kind, search_key) of two kinds or more stand: key, kinds, ids."""
    return entities.groupBy("search_key").agg(F.countDistinct("kind").alias("n_kinds"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.countDistinct("id").alias("n_ids")).where("n_kinds >= 2")


#: Edges of a task that meets a mapping.
EDGES_OF_TASK = 1_000_000


def rewired(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends mapped (old, new) where a mapping exists; loops that arise go, and equal edges are one, as are those that come repeated.

    A small mapping is sent to every task. For a larger one edges are dealt over as many tasks as their number asks for, so that what a task sorts doesn't grow with the table.
    """
    dealt = lambda df, by: df
    if is_small(mapping):
        mapping = F.broadcast(mapping)
    elif (tasks := -(-edges.count() // EDGES_OF_TASK)) > int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        dealt = lambda df, by: df.repartition(tasks, by)
    a, b = mapping.toDF("src", "new_src"), mapping.toDF("dst", "new_dst")
    out = dealt(dealt(edges, "src").join(a, "src", "left"), "dst").join(b, "dst", "left")
    out = out.select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "type")
    return out.where("src <> dst").distinct()
