"""Administration of the knowledge tables: uniqueness, guards, deletion, property edits, clean-up, prompts, logs, exports and audits.

Tables are immutable files, so every change is a function from tables to tables; versioned() writes a new version and then points to it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.ontology import CANONICAL
from lodestone.functions.payload import check_property, log_payload
from lodestone.functions.text import fold_key, inferred_type
from lodestone.operators import graph as G

#: Keys that must be unique.
UNIQUE = {"sources": ["id"], "pages": ["page_id"], "chunks": ["chunk_id"], "entities": ["canonical_id"], "query_log": ["id"], "usage_log": ["id"], "config": ["id"]}


def violations(tables: dict[str, DataFrame], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """(name, key, n) of keys that occur more than once or are null."""
    out = None
    for name, keys in (UNIQUE if unique is None else unique).items():
        if name in tables:
            null = F.lit(False)
            for k in keys:
                null = null | F.col(k).isNull()
            one = tables[name].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | null)
            one = one.select(F.lit(name).alias("name"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n")
            out = one if out is None else out.unionByName(one)
    return out


def guarded(edges: DataFrame) -> DataFrame:
    """Edges as they are; reading one whose type isn't canonical fails."""
    known = F.coalesce(F.col("type").isin(CANONICAL), F.lit(False))
    return edges.withColumn("type", F.when(known, F.col("type")).otherwise(F.raise_error(F.concat(F.lit("not a canonical relation: "), F.coalesce("type", F.lit("null"))))))


def without_source(tables: dict[str, DataFrame], source: str) -> dict[str, DataFrame]:
    """Tables sources (id), pages, chunks, mentions, edges (each with source_id) and entities (canonical_id, source_ids) without a source; entities left without mentions and edges go."""
    out = {k: v.where(~F.col("id" if k == "sources" else "source_id").eqNullSafe(F.lit(source))) for k, v in tables.items() if k != "entities"}
    entities = tables["entities"].withColumn("source_ids", F.array_remove("source_ids", source))
    touched = F.array_contains(tables["entities"]["source_ids"], source)
    used = out["mentions"].select("canonical_id").unionByName(out["edges"].select(F.col("src").alias("canonical_id"))).unionByName(out["edges"].select(F.col("dst").alias("canonical_id"))).distinct()
    marked = tables["entities"].select("canonical_id", touched.alias("touched"))
    orphans = marked.where("touched").join(used, "canonical_id", "left_anti").select("canonical_id")
    return out | {"entities": entities.join(orphans, "canonical_id", "left_anti")}


def with_source(tables: dict[str, DataFrame], new: dict[str, DataFrame], source: str) -> dict[str, DataFrame]:
    """Tables after a source is indexed again: its old rows go, new ones come, and entities known before keep their lists with the new values after them."""
    kept = {k: v.where(~F.col("id" if k == "sources" else "source_id").eqNullSafe(F.lit(source))) for k, v in tables.items() if k != "entities"}
    out = {k: v.unionByName(new[k], allowMissingColumns=True) if k in new else v for k, v in kept.items()}
    old = tables["entities"].withColumn("source_ids", F.array_remove("source_ids", source))
    lists = [c for c, kind in old.dtypes if kind.startswith("array")]
    both = old.alias("a").join(new["entities"].alias("b"), F.col("a.canonical_id") == F.col("b.canonical_id"), "full")
    merged = [F.array_distinct(F.concat(F.coalesce(f"a.{c}", F.array()), F.coalesce(f"b.{c}", F.array()))).alias(c) if c in lists else F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in old.columns]
    entities = both.select(*merged)
    used = out["mentions"].select("canonical_id").unionByName(out["edges"].select(F.col("src").alias("canonical_id"))).unionByName(out["edges"].select(F.col("dst").alias("canonical_id"))).distinct()
    orphans = entities.where(F.size("source_ids") == 0).join(used, "canonical_id", "left_anti").select("canonical_id")
    return out | {"entities": entities.join(orphans, "canonical_id", "left_anti")}


def with_metadata(sources: DataFrame, chunks: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources (id, title, ...) with the changed values of changes (id, ...), where those aren't null, and chunks (source_id, source_title) with the titles as they then are."""
    named = [c for c in changes.columns if c != "id"]
    fresh = changes.select("id", *[F.col(c).alias(f"new_{c}") for c in named])
    joined = sources.join(fresh, "id", "left")
    after = joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in named else F.col(c) for c in sources.columns])
    titles = after.select(F.col("id").alias("source_id"), F.col("title").alias("own_title"))
    told = chunks.join(titles, "source_id", "left")
    return after, told.select(*[F.coalesce("own_title", "source_title").alias(c) if c == "source_title" else F.col(c) for c in chunks.columns])


def search_keys(name: Column, aliases: Column) -> Column:
    keys = F.transform(F.concat(F.array(name), F.coalesce(aliases, F.array())), fold_key)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != "")))


def with_property(rows: DataFrame, id_col: str, row_id, name: str, value, protected: set[str]) -> tuple[DataFrame, object]:
    """Rows with one value of one row changed, and the value before. Names of entities and their aliases carry their search keys along.

    Raises ValueError for a protected name or a value that can't be stored, and KeyError where there is no such row.
    """
    check_property(name, value)
    if name in protected or name not in rows.columns:
        raise ValueError(f"{name} can't be edited")
    found = rows.where(F.col(id_col) == row_id).select(name).limit(1).collect()
    if not found:
        raise KeyError(row_id)
    here = F.col(id_col) == row_id
    new = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
    after = rows.withColumn(name, F.when(here, new.cast(rows.schema[name].dataType)).otherwise(F.col(name)))
    if name in ("name", "aliases") and "search_keys" in rows.columns:
        after = after.withColumn("search_keys", F.when(here, search_keys(F.col("name"), F.col("aliases"))).otherwise(F.col("search_keys")))
    return after, found[0][0]


def with_edge_property(edges: DataFrame, edge_id, name: str, value, protected: set[str]) -> tuple[DataFrame, object]:
    """As with_property(), for edges by their column edge_id; the type can't be edited."""
    return with_property(edges, "edge_id", edge_id, name, value, protected | {"edge_id", "src", "dst", "type"})


def without_edge(edges: DataFrame, edge_id) -> tuple[DataFrame, dict]:
    """Edges without one, and that edge; KeyError where there is none."""
    found = edges.where(F.col("edge_id") == edge_id).limit(1).collect()
    if not found:
        raise KeyError(edge_id)
    return edges.where(~F.col("edge_id").eqNullSafe(F.lit(edge_id))), found[0].asDict()


def set_prompt(config: DataFrame, text: str) -> DataFrame:
    """Rows (text, updated_at) with a new prompt, which active_prompt() then finds; blank ones are refused."""
    if not text.strip():
        raise ValueError("a prompt has a text")
    fresh = config.sparkSession.range(1).select(F.lit(text.strip()).alias("text"), F.current_timestamp().alias("updated_at"))
    return config.select("text", "updated_at").unionByName(fresh)


def write_audit(parts: dict[str, DataFrame], path: str) -> None:
    """Each part of audit() as JSON lines under path, and path/counts with the number of rows of each."""
    counts = None
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        counts = one if counts is None else counts.unionByName(one)
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/counts")


def without_node(nodes: DataFrame, edges: DataFrame, node) -> tuple[DataFrame, DataFrame, int]:
    """Nodes and edges without a node and what hangs on it, and how many edges that were."""
    at = F.coalesce((F.col("src") == node) | (F.col("dst") == node), F.lit(False))
    return nodes.where(~F.col("id").eqNullSafe(F.lit(node))), edges.where(~at), edges.where(at).count()


def without_legacy(nodes: DataFrame, edges: DataFrame, pipeline: str, labels: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of the given labels and edges of the pipeline, and a report (kind, deleted, remaining)."""
    kept_nodes, kept_edges = F.coalesce(F.col("label").isin(labels), F.lit(False)), F.col("pipeline").eqNullSafe(F.lit(pipeline))
    count = lambda df, ok, kind: df.agg(F.count_if(~ok).alias("deleted"), F.count_if(ok).alias("remaining")).select(F.lit(kind).alias("kind"), "deleted", "remaining")
    return nodes.where(kept_nodes), edges.where(kept_edges), count(nodes, kept_nodes, "node").unionByName(count(edges, kept_edges, "edge"))


def versioned(tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables under a new version of root, then the pointer; readers see all tables of one version."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/versions")
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    newest = spark.read.parquet(f"{root}/versions").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{root}/{newest}/{name}")


def active_prompt(config: DataFrame, default: str) -> str:
    """The text of the newest row (text, updated_at), or the default."""
    row = config.agg(F.max_by("text", "updated_at").alias("text")).first()
    return row["text"] or default


def append_log(spark: SparkSession, path: str, entries: list[dict]) -> None:
    """Append entries as rows (id, payload JSON, created_at); values that aren't flat become JSON themselves."""
    rows = [(str(e.get("id") or uuid.uuid4()), json.dumps(log_payload({k: v for k, v in e.items() if k != "id"}), ensure_ascii=False, sort_keys=True)) for e in entries]
    spark.createDataFrame(rows, "id string, payload string").withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def export_json(nodes: DataFrame, edges: DataFrame, label: str, path: str) -> None:
    """The component of a label as JSON lines: path/nodes and path/edges; vectors are left out."""
    members, touched = G.component_export(nodes, edges, label)
    members.drop("embedding").write.json(f"{path}/nodes")
    touched.write.json(f"{path}/edges")


def entity_keys(entities: DataFrame) -> DataFrame:
    """(search_key, id, kind) of entities (canonical_id, name, kind, aliases), one row for each distinct key."""
    keys = search_keys(F.col("name"), F.col("aliases"))
    return entities.select(F.explode(keys).alias("search_key"), F.col("canonical_id").alias("id"), "kind")


def typed_targets(entities: DataFrame, prefixes: dict[str, list[str]]) -> DataFrame:
    """Keys whose wording tells their type, under which several entities stand: (search_key, kind, target, members).

    The target is the entity of that kind whose own name has the key, or else the one with the least id.
    """
    rows = entity_keys(entities).join(entities.select(F.col("canonical_id").alias("id"), fold_key(F.col("name")).alias("own_key")), "id")
    rows = rows.withColumn("told", inferred_type(F.col("search_key"), prefixes)).where("told <> ''")
    fits = F.when((F.col("kind") == F.col("told")) & (F.col("own_key") == F.col("search_key")), 0).otherwise(1)
    out = rows.groupBy("search_key", "told").agg(F.min_by("id", F.struct(fits, F.col("id"))).alias("target"), F.countDistinct("id").alias("members"))
    return out.where("members > 1").withColumnRenamed("told", "kind")


def audit(entities: DataFrame, edges: DataFrame, prefixes: dict[str, list[str]], generic: list[str]) -> dict[str, DataFrame]:
    """The parts of an audit report: keys with several types, merge targets, surfaces that name nothing, and relation types to migrate."""
    from lodestone.functions.text import surface_is_name

    return {
        "type_conflicts": G.type_conflicts(entity_keys(entities)),
        "targets": typed_targets(entities, prefixes),
        "invalid": entities.where(~surface_is_name(F.col("name"), generic, prefixes)).select("canonical_id", "name", "kind"),
        "relations": G.ontology_preview(edges).where("migrates"),
    }
