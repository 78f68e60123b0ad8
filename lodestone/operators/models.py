"""Deterministic stand-ins for the models that a deployment plugs in: an embedder, an extractor of known names, a selector and an extractive answer.

A deployment brings its own as tables or columns of the same shape; everything downstream is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import collapsed, fold_key, grams, once, words
from lodestone.operators.joins import is_small

WIDTH = 64
LONGEST_NAME = 5


def embedding(text: Column, width: int = WIDTH) -> Column:
    """Counts of hashed folded words in `width` places, scaled to length 1; a text without words has zeros. For questions; embedded() is for corpora."""
    places = F.transform(F.filter(F.split(fold_key(text), " "), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(width)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    both = once(counts, lambda c: F.struct(c.alias("c"), norm(c).alias("n")))
    return once(both, lambda s: F.transform(s["c"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0).cast("float")))


def embedded(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, v) of documents (doc_id, text) as embedding() has them, from counts of (document, place)."""
    found = docs.select("doc_id", F.explode(F.filter(F.split(fold_key(F.col("text")), " "), lambda w: w != "")).alias("word")).groupBy("doc_id", F.pmod(F.xxhash64("word"), F.lit(width)).cast("int").alias("place")).agg(F.count(F.lit(1)).alias("n"))
    by_doc = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("counts"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    v = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("counts", i) / F.col("norm"), F.lit(0.0)).cast("float"))
    return docs.select("doc_id").join(by_doc, "doc_id", "left").select("doc_id", v.alias("v"))


def known_names(chunks: DataFrame, aliases: DataFrame) -> DataFrame:
    """Findings (chunk_id, name, kind) of alias keys (kind, search_key, canonical_name) among runs of up to LONGEST_NAME words; an equi-join, so names are never tried one by one."""
    keys = aliases.select("kind", "search_key", "canonical_name")
    spread = chunks.select("chunk_id", F.split(fold_key(F.col("text")), " ").alias("w"))
    if is_small(keys):  # runs are put together only where a name may begin, and only those that are names leave a chunk
        names = sorted({r["search_key"] for r in keys.select("search_key").distinct().collect() if r["search_key"] is not None})
        firsts: dict[int, set[str]] = {}
        for name in names:
            firsts.setdefault(len(name.split(" ")), set()).add(name.split(" ")[0])
        at = lambda n: F.filter(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)), lambda i: F.element_at("w", i).isin(sorted(firsts[n])))
        run = lambda n: F.coalesce(F.transform(at(n), lambda i: F.array_join(F.slice("w", i, n), " ")), F.array().cast("array<string>"))
        sizes = [n for n in sorted(firsts) if n <= LONGEST_NAME]
        found = F.filter(F.array_distinct(F.flatten(F.array(*map(run, sizes)))), lambda x: x.isin(names)) if sizes else F.array().cast("array<string>")
        met = spread.select("chunk_id", F.explode(found).alias("search_key")).join(F.broadcast(keys), "search_key")
    else:
        runs = F.array_distinct(F.flatten(F.array(*[grams(F.col("w"), n) for n in range(1, LONGEST_NAME + 1)])))
        met = spread.select("chunk_id", F.explode(runs).alias("search_key")).join(keys, "search_key")
    return met.select("chunk_id", F.col("canonical_name").alias("name"), "kind").distinct()


def lexical_selection(requirements: DataFrame, candidates: DataFrame, most: int = 3) -> DataFrame:
    """For each requirement (plan_id, requirement_id, question) the candidates (plan_id, evidence_id, text) of its plan that share most of its words, half at least: (.., at, evidence_id)."""
    asked = requirements.select("plan_id", "requirement_id", words(F.col("question")).alias("asked"))
    met = candidates.select("plan_id", "evidence_id", words(F.col("text")).alias("own")).join(asked, "plan_id")
    met = met.withColumn("share", F.size(F.array_intersect("asked", "own")) / F.greatest(F.size("asked"), F.lit(1))).where("share >= 0.5")
    order = Window.partitionBy("plan_id", "requirement_id").orderBy(F.desc("share"), "evidence_id")
    return met.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("plan_id", "requirement_id", "at", "evidence_id")


def extract_answer(selected: DataFrame, sentences: int = 3) -> DataFrame:
    """(plan_id, answer) from the first sentence of the best selected items (plan_id, evidence_id, text, score)."""
    first = F.regexp_extract(collapsed(F.col("text")), r"^(.*?[.!?])(\s|$)", 1)
    lead = F.when(first == "", F.substring(collapsed(F.col("text")), 1, 300)).otherwise(first)
    order = Window.partitionBy("plan_id").orderBy(F.desc("score"), "evidence_id")
    rows = selected.select("plan_id", "evidence_id", "score", lead.alias("lead")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= sentences)
    in_order = F.sort_array(F.collect_list(F.struct("n", "lead")))
    return rows.groupBy("plan_id").agg(F.array_join(F.transform(in_order, lambda x: x["lead"]), " ").alias("answer"))
