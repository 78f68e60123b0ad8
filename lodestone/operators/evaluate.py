"""Evaluation of answers against cases: required concepts, forbidden ones, mode, confidence and requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import collapsed, without_accents

CASE_SCHEMA = "id string, mode string, question string, requiredConcepts array<array<string>>, forbiddenConcepts array<string>, minimumRequirements int, maximumConfidence double"


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON file that holds a list of them."""
    return spark.read.option("multiLine", True).schema(CASE_SCHEMA).json(path)


def concept_key(x: Column) -> Column:
    """Lower case, without accents, one blank between words; punctuation stays."""
    return collapsed(F.lower(without_accents(F.coalesce(x, F.lit("")))))


def outcomes(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a case: id, answered, missing_concepts, forbidden_hits, passed. answers: (id, answer, mode, confidence, requirements).

    A group of required concepts is met by any of its alternatives. A case without an answer fails.
    """
    rows = cases.join(answers.select("id", F.lit(True).alias("answered"), concept_key(F.col("answer")).alias("key"), F.col("mode").alias("own_mode"), "confidence", "requirements"), "id", "left")
    has = lambda c: F.contains(F.coalesce("key", F.lit("")), concept_key(c))
    lacking = F.filter(F.coalesce("requiredConcepts", F.array()), lambda g: ~F.exists(g, has))
    hits = F.filter(F.coalesce("forbiddenConcepts", F.array()), has)
    rows = rows.select(
        "id", F.coalesce("answered", F.lit(False)).alias("answered"), F.size(lacking).alias("missing_concepts"), F.size(hits).alias("forbidden_hits"),
        F.coalesce(F.col("mode").isNull() | (F.col("mode") == F.col("own_mode")), F.lit(False)).alias("mode_ok"),
        F.coalesce(F.col("confidence") <= F.coalesce("maximumConfidence", F.lit(1.0)), F.lit(False)).alias("confidence_ok"),
        F.coalesce(F.col("requirements") >= F.coalesce("minimumRequirements", F.lit(0)), F.lit(False)).alias("requirements_ok"),
    )
    passed = F.col("answered") & (F.col("missing_concepts") == 0) & (F.col("forbidden_hits") == 0) & F.col("mode_ok") & F.col("confidence_ok") & F.col("requirements_ok")
    return rows.withColumn("passed", passed)
