"""Readers: tables, the property graph over them, pages with their tags taken out, and manifest-checked published content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, title) of regions, nations, customers, suppliers and parts."""
    parts = [("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name"), ("part", "p", "p_partkey", "p_name")]
    out = None
    for name, prefix, key, title in parts:
        one = table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(name).alias("label"), F.col(title).alias("title"))
        out = one if out is None else out.unionByName(one)
    return out


def graph_edges(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """(src, dst, type): nations in regions, customers and suppliers in nations, parts and their suppliers, once each or, repeated, as often as lines have them."""
    of = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    nation = table(spark, sf_dir, "nation").select(of("n", "n_nationkey").alias("src"), of("r", "n_regionkey").alias("dst"), F.lit("PART_OF").alias("type"))
    customer = table(spark, sf_dir, "customer").select(of("c", "c_custkey").alias("src"), of("n", "c_nationkey").alias("dst"), F.lit("thành viên của").alias("type"))
    supplier = table(spark, sf_dir, "supplier").select(of("s", "s_suppkey").alias("src"), of("n", "s_nationkey").alias("dst"), F.lit("Diễn ra tại").alias("type"))
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    line = line if repeated else line.distinct()
    line = line.select(of("s", "l_suppkey").alias("src"), of("p", "l_partkey").alias("dst"), F.lit("viện trợ").alias("type"))
    return nation.unionByName(customer).unionByName(supplier).unionByName(line)


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, body) of HTML pages: scripts, styles, comments and tags out, white space collapsed."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), r"\s+", " "))
    return pages.select("page_id", "url", title.alias("title"), body.alias("body"))


ELIGIBLE = r"^(periods\.json|periods/(.*/)?events\.json|persons/[^/]+/[^/]+\.json)$"
MOST_BYTES = 8_000_000
MANIFEST_SCHEMA = "contentVersion string, files map<string, struct<url string, sha256 string>>"


def published(spark: SparkSession, root: str) -> DataFrame:
    """(version, path, record) of the published records under root that manifest.json lists.

    The manifest has {"contentVersion", "files": {path: {"url", "sha256"}}}, with urls relative to root. Files that aren't eligible, or have no url or digest, are left
    out; a listed file that is missing, too large, or whose bytes differ from its digest fails the whole load. A file holds one record or a list of
    them; those with status `published` stay.
    """
    manifest = spark.read.option("multiLine", True).schema(MANIFEST_SCHEMA).json(f"{root}/manifest.json")
    listed = manifest.select("contentVersion", F.explode("files").alias("path", "f")).select(F.col("contentVersion").alias("version"), "path", "f.url", "f.sha256")
    listed = listed.where(F.col("path").rlike(ELIGIBLE) & ~F.col("path").endswith("/index.json") & (F.coalesce("url", F.lit("")) != "") & (F.coalesce("sha256", F.lit("")) != ""))
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    files = files.select(F.expr(f"substring(path, instr(path, '{base}') + {len(base)})").alias("url"), "length", "content")
    joined = listed.join(files, "url", "left")
    sound = F.coalesce((F.sha2("content", 256) == F.lower("sha256")) & (F.col("length") <= MOST_BYTES), F.lit(False))
    checked = joined.select("version", "path", F.when(sound, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("published file differs from its manifest: "), "path"))).alias("content"))
    text = F.trim(F.col("content").cast("string"))
    variant = F.parse_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))))
    rows = checked.select("version", "path", F.explode(F.variant_get(variant, "$", "array<variant>")).alias("record"))
    return rows.where(F.try_variant_get("record", "$.status", "string") == "published")


class Snapshot:
    """A published corpus that is read again after `ttl` seconds; when a read fails the last good one is served."""

    def __init__(self, load, ttl: float = 300.0, clock=None):
        import time

        self._load, self._ttl, self._clock = load, ttl, clock or time.monotonic
        self._held, self._at, self.version, self.error = None, None, 0, None

    def get(self) -> DataFrame:
        now = self._clock()
        if self._held is None or now - self._at >= self._ttl:
            try:
                fresh = self._load().cache()
                fresh.count()
                self._held, self.error = fresh, None
                self.version += 1
            except Exception as e:  # the last good snapshot stays; the error is kept for reports
                if self._held is None:
                    raise
                self.error = e
            self._at = now
        return self._held
