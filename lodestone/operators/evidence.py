"""Evidence of many plans at once: subject scans, detail phrases, the reservation of a budget, selection against requirements, citations and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import fold_key, grams
from lodestone.operators.joins import small
from lodestone.session import ship

CURATED, DETAIL, PER_WINDOW, PER_QUERY, TOTAL = 12, 16, 5, 5, 48

# Folded words that steer a question and say nothing of its subject.
CONTROL_WORDS = [
    "ai", "bao", "cac", "cho", "co", "cua", "duoc", "gi", "gom", "hay", "khi", "la", "luc", "luong", "moi", "nao", "nhom", "nhung", "o", "phan", "tham", "gia", "thanh",
    "the", "thuoc", "tim", "trong", "vai", "tro", "va", "ve", "voi", "dong", "gop", "hinh", "thuc",
]
# End of fixed values.


def overlaps(y0: Column, y1: Column, start: Column, end: Column) -> Column:
    """Three-valued: null for undated items; one known year stands for both."""
    return (F.coalesce(y0, y1) <= end) & (F.coalesce(y1, y0) >= start)


def subject_scan(docs: DataFrame, phrases: DataFrame, limit: int = 240) -> DataFrame:
    """Documents (doc_id, sequence, text) that hold any phrase of a plan (plan_id, phrase), ignoring case: score 0.5, in their own order, with the phrases found.

    Plans' phrases are a stated, small set, and each text is lower-cased once before it meets them.
    """
    low = phrases.select("plan_id", "phrase", F.lower("phrase").alias("low")).where("trim(low) <> ''")
    texts = docs.select("doc_id", "sequence", F.lower("text").alias("low_text"))
    probe = texts.join(small(low), F.contains("low_text", F.col("low")))
    met = probe.groupBy("plan_id", "doc_id", "sequence").agg(F.sort_array(F.collect_set("phrase")).alias("matched"))
    order = Window.partitionBy("plan_id").orderBy("sequence", "doc_id")
    out = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(20, min(limit, 320)))
    return out.select("plan_id", "doc_id", F.lit(0.5).alias("score"), "matched", "rank")


def detail_phrases(question: Column, subject: Column, control: list[str] | None = None) -> Column:
    """Pairs and triples of folded words without steering words that aren't part of the subject."""
    control = CONTROL_WORDS if control is None else control
    tokens, own = F.split(fold_key(question), " "), F.split(fold_key(subject), " ")
    every = F.array_distinct(F.concat(grams(tokens, 2), grams(tokens, 3)))
    steering = F.array(*[F.lit(w) for w in control]) if control else F.array().cast("array<string>")
    return F.filter(every, lambda g: ~F.arrays_overlap(F.split(g, " "), steering) & (F.size(F.array_except(F.split(g, " "), own)) > 0))


def detail_hits(scanned: DataFrame, queries: DataFrame, per_query: int = 4) -> DataFrame:
    """The best scanned items (plan_id, doc_id, score, key) of each query (plan_id, ord, phrases) by words of phrases found, share found and score.

    key is the folded text. Score becomes at least .70 and a twentieth of that sum, .97 at most. Items without a column plan_id meet the queries of all plans:
    those that share a phrase, a pair or triple of words as detail_phrases gives them.
    """
    if "plan_id" in scanned.columns:
        met = scanned.join(queries, "plan_id").withColumn("found", F.filter("phrases", lambda p: F.contains(F.concat(F.lit(" "), "key", F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))))
        words = F.aggregate(F.transform("found", lambda p: F.size(F.split(p, " "))), F.lit(0), lambda s, n: s + n)
        lexical = words + F.size("found") / F.greatest(F.size("phrases"), F.lit(1)) + 0.05 * F.col("score")
        met = met.where(F.size("found") > 0).withColumn("lexical", F.round(lexical, 9))
    else:
        tokens = F.split("key", " ")
        every = F.array_distinct(F.concat(grams(tokens, 2), grams(tokens, 3)))
        asked = queries.select("plan_id", "ord", F.size("phrases").alias("n"), F.explode("phrases").alias("phrase"))
        shared = scanned.select("doc_id", "score", F.explode(every).alias("phrase")).join(asked, "phrase")
        lexical = F.sum(F.size(F.split("phrase", " "))) + F.count(F.lit(1)) / F.greatest(F.col("n"), F.lit(1)) + 0.05 * F.col("score")
        met = shared.groupBy("plan_id", "ord", "n", "doc_id", "score").agg(F.round(lexical, 9).alias("lexical"))
    order = Window.partitionBy("plan_id", "ord").orderBy(F.desc("lexical"), "doc_id")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_query)
    score = F.greatest("score", F.least(F.lit(0.97), 0.70 + F.col("lexical") / 20))
    return best.select("plan_id", "ord", "doc_id", F.round(score, 6).alias("score"), "rank")


RESERVED_SCHEMA = "plan_id string, doc_id long, score double, tier string, rank int"


def _fill(items, detail, windows, queries):
    """(doc_id, tier) of one plan, in order."""
    score = dict(zip(items["doc_id"], items["score"]))
    taken: dict[int, str] = {}

    def take(ids, tier, most=None):
        n = 0
        for i in ids:
            if most is not None and n >= most:
                break
            if i in score and i not in taken:
                taken[i] = tier
                n += 1

    by_score = lambda ids: sorted(ids, key=lambda i: (-score[i], i))
    curated = items[items["curated"]].sort_values(["priority", "score", "doc_id"], ascending=[False, False, True])
    take(curated["doc_id"].tolist(), "curated", CURATED)
    take(detail, "detail", DETAIL)
    for ids in windows:
        take([i for i in ids if i in score][:PER_WINDOW], "window")
    for ids in queries:
        take(by_score({i for i in ids if i in score and i not in taken}), "query", PER_QUERY)
    take(by_score(score), "rest", max(0, TOTAL - len(taken)))
    return list(taken.items())[:TOTAL]


def _gate(items: DataFrame, plans: DataFrame | None) -> DataFrame:
    if plans is None:
        return items
    met = items.join(plans.select("plan_id", "start", "end"), "plan_id", "left")
    return met.where(F.coalesce(overlaps(F.col("y0"), F.col("y1"), F.col("start"), F.col("end")), F.lit(True))).drop("start", "end")


def reserve(items: DataFrame, hits: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """The evidence of each plan: plan_id, doc_id, score, tier, rank.

    items: (plan_id, doc_id, score, curated, priority, y0, y1), the best score an item has; hits: (plan_id, kind, ord, rank, doc_id) with kind detail,
    window or query; plans: (plan_id, start, end) gates items that are provably outside. Tiers in turn: curated, details in their order, the first of
    each window, the best of each query, then the rest by score. A query only counts items that no earlier query took, which is a
    sequence of choices: one plan's rows, a few hundred by the limits of the channels, are settled by one call.
    """
    import pandas as pd

    ship(items.sparkSession)
    gated = _gate(items, plans)
    best = gated.groupBy("plan_id", "doc_id").agg(F.max("score").alias("score"), F.max("curated").alias("curated"), F.max("priority").alias("priority"))
    one = best.select("plan_id", F.lit("item").alias("kind"), F.lit(0).alias("ord"), F.lit(0).alias("rank"), "doc_id", "score", "curated", F.col("priority").cast("double").alias("priority"))
    more = hits.select("plan_id", "kind", F.col("ord").cast("int").alias("ord"), F.col("rank").cast("int").alias("rank"), "doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("curated"), F.lit(0.0).alias("priority"))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        plan = rows["plan_id"].iloc[0]
        of = lambda kind: rows[rows["kind"] == kind].sort_values(["ord", "rank", "doc_id"])
        lists = lambda kind: [g["doc_id"].tolist() for _, g in of(kind).groupby("ord", sort=True)]
        mine = rows[rows["kind"] == "item"]
        score = dict(zip(mine["doc_id"], mine["score"]))
        out = _fill(mine, of("detail")["doc_id"].tolist(), lists("window"), lists("query"))
        return pd.DataFrame([(plan, i, score[i], tier, n + 1) for n, (i, tier) in enumerate(out)], columns=["plan_id", "doc_id", "score", "tier", "rank"])

    return one.unionByName(more).groupBy("plan_id").applyInPandas(settle, RESERVED_SCHEMA)


def selection(returned: DataFrame, requirements: DataFrame, candidates: DataFrame, windows: DataFrame, most: int = 8) -> DataFrame:
    """What a selector's answer is worth: one row of each requirement, with plan_id, requirement_id, evidence (ordered ids) and missing.

    returned: (plan_id, requirement_id, at, evidence_id); unknown ids and repeats go, and the first `most` of a requirement stay. requirements: (plan_id, requirement_id,
    required, windows); candidates: (plan_id, evidence_id, y0, y1); windows: (plan_id, window_id, start, end). Where a requirement has windows,
    dated evidence must overlap one of them. It is missing when it is required and has nothing, or when all its evidence is dated
    and leaves one of its windows uncovered.
    """
    keys = ["plan_id", "requirement_id"]
    known = returned.join(candidates.select("plan_id", "evidence_id", "y0", "y1"), ["plan_id", "evidence_id"]).join(requirements.select(*keys), keys, "left_semi")
    first = known.groupBy(*keys, "evidence_id").agg(F.min("at").alias("at"), F.first("y0").alias("y0"), F.first("y1").alias("y1"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "evidence_id"))).where(F.col("n") <= most)
    asked = requirements.select(*keys, F.explode("windows").alias("window_id")).join(windows.select("plan_id", "window_id", "start", "end"), ["plan_id", "window_id"])
    tested = first.join(asked, keys, "left").withColumn("hit", overlaps(F.col("y0"), F.col("y1"), F.col("start"), F.col("end")))
    undated = F.col("y0").isNull() & F.col("y1").isNull()
    fits = tested.groupBy(*keys, "evidence_id", "at").agg((F.max(F.col("window_id").isNull()) | F.max(F.col("y0").isNull()) | F.coalesce(F.max("hit"), F.lit(False))).alias("fits"), F.max(undated).alias("undated")).where("fits")
    kept = tested.join(fits.select(*keys, "evidence_id"), [*keys, "evidence_id"], "left_semi")
    covered = kept.where("window_id IS NOT NULL").groupBy(*keys, "window_id").agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"))
    gaps = covered.groupBy(*keys).agg(F.count_if(~F.col("hit")).alias("open"))
    held = fits.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence"), F.max("undated").alias("undated"))
    out = requirements.select(*keys, "required").join(held, keys, "left").join(gaps, keys, "left")
    none = F.col("evidence").isNull()
    missing = F.when(none, F.col("required")).otherwise(~F.col("undated") & (F.coalesce("open", F.lit(0)) > 0))
    return out.select(*keys, F.coalesce("evidence", F.array().cast(dict(held.dtypes)["evidence"])).alias("evidence"), missing.alias("missing"))


def citations(items: DataFrame, chosen: DataFrame, excerpt: int = 420) -> DataFrame:
    """Chosen items (plan_id, doc_id) with title and excerpt; a source without a title is named by its id."""
    met = items.join(chosen.select("plan_id", "doc_id").distinct(), ["plan_id", "doc_id"], "left_semi")
    title = F.coalesce(F.nullif(F.trim("source_title"), F.lit("")), "source_id")
    return met.select("plan_id", "doc_id", title.alias("title"), F.substring("text", 1, excerpt).alias("excerpt"), "score")


def merged(candidates: DataFrame, more: DataFrame) -> DataFrame:
    """Candidates after a further search: each item once, with its best score."""
    return candidates.select("plan_id", "doc_id", "score").unionByName(more.select("plan_id", "doc_id", "score")).groupBy("plan_id", "doc_id").agg(F.max("score").alias("score"))
