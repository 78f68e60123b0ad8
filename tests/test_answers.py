"""Plans, evidence, suggestions, evaluation and the deterministic models, on small cases whose results are known."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from lodestone.operators import evaluate as V
from lodestone.operators import evidence as E
from lodestone.operators import models as M
from lodestone.operators import planning as P
from lodestone.operators import suggest as U


def read(spark, *payloads, asked="Q"):
    rows = [(str(i), asked, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)]
    return P.read_plans(spark.createDataFrame(rows, "plan_id string, asked string, payload string"))


def test_plans_are_read_leniently(spark):
    many = {"requirements": [{"question": str(i)} for i in range(20)], "retrievalQueries": [str(i) for i in range(20)]}
    odd = {"mode": "x", "timeWindows": [{"start": "1975", "end": 1968}, {"start": "a", "end": 1}], "yearStart": 1, "requirements": [{"question": " "}, 3], "retrievalQueries": ["a", " a ", ""], "suggestionType": "?"}
    full = {"mode": "comparison", "requirements": [{"id": "z", "question": " q ", "required": False, "timeWindowIds": ["w", "", "w"]}, {"question": "p", "required": None}], "requiresVerification": True, "suggestionType": "event", "subject": " S "}
    plan, years, long, broken, none, whole = sorted(read(spark, odd, {"yearStart": 1950, "yearEnd": "1940"}, many, "{no json", None, full).collect(), key=lambda r: r.plan_id)
    assert (plan.mode, plan.suggestion, plan.year_start, plan.year_end) == ("explanatory_rag", "none", 1968, 1975)
    assert [r.question for r in plan.requirements] == ["Q"] and plan.queries == ["a"] and [w.id for w in plan.windows] == ["w1"]
    assert (years.year_start, years.year_end) == (1940, 1950) and len(long.requirements) == 8 and len(long.queries) == 12
    assert broken.queries == none.queries == ["Q"] and broken.requirements[0].required
    assert [tuple(r) for r in whole.requirements] == [("z", "q", "fact", False, ["w"]), ("r2", "p", "fact", False, [])] and (whole.verify, whole.suggestion, whole.subject) == (True, "event", "S")


def test_plans_without_a_model(spark):
    kinds = {"Ai chỉ huy trận này?": "person", "Chiến dịch Điện Biên Phủ": "event", "Thời kỳ Lê sơ": "period", "Kinh tế": "none", "Trại lính": "none", "Kinh tế năm 1954": "none"}
    got = {r.asked: r for r in P.plans_without_model(spark.createDataFrame([(q, q) for q in kinds], "plan_id string, asked string")).collect()}
    assert {q: r.suggestion for q, r in got.items()} == kinds and got["Kinh tế năm 1954"].verify and not got["Kinh tế"].verify


PLAN = {"subject": "S", "dateRange": "1950", "requirements": [{"id": "a", "question": "qa"}, {"id": "b", "question": "qb", "required": False}]}


def test_recovery_asks_only_for_required_gaps(spark):
    plans = read(spark, *[PLAN] * 4)
    outcomes = [("0", ["a", "b"], [], 3), ("1", ["b"], [], 3), ("2", ["a"], ["c"], 3), ("3", ["a"], [], 0)]
    got = P.recovery(plans, spark.createDataFrame(outcomes, "plan_id string, missing array<string>, conflicts array<string>, candidates int")).collect()
    assert [(r.plan_id, r.question, r.queries, [x.id for x in r.requirements]) for r in got] == [("0", "S qa 1950", ["S qa 1950"], ["a"])]


CLAIM = "plan_id string, at int, text string, evidence_ids array<string>, requirement_ids array<string>, risk string"


def test_claims_and_when_answers_are_verified(spark):
    single = {"requirements": [{"id": "a", "question": "qa"}]}
    plans = read(spark, single, single, single, PLAN, single)
    requirements = P.plan_requirements(plans)
    claims = [(str(i), 0, " t ", ["x", "e", "e"], ["a", "?"], None) for i in (0, 1, 3)] + [("0", 1, "u", ["x"], ["a"], "low"), ("4", 0, "t", ["e"], ["a"], "high")]
    evidence = spark.createDataFrame([(str(i), "e") for i in range(5)], "plan_id string, evidence_id string")
    sound = P.sound_claims(spark.createDataFrame(claims, CLAIM), evidence, requirements)
    assert sorted(map(tuple, sound.where("plan_id = '0'").collect())) == [("0", 0, "t", ["e"], ["a"], "low")]
    answers = spark.createDataFrame([("0", "plain", []), ("1", "in 1954", []), ("2", "plain", []), ("3", "plain", []), ("4", "plain", [])], "plan_id string, answer string, conflicts array<string>")
    assert {r.plan_id: r.needed for r in P.verification(plans, answers, sound).collect()} == {"0": False, "1": True, "2": True, "3": True, "4": True}


def test_verdicts_are_settled(spark):
    requirements = spark.createDataFrame([(p, r, r == "a") for p in "1234" for r in "ab"], "plan_id string, requirement_id string, required boolean")
    verdicts = [
        ("1", "draft", "supported", None, [("a", "covered"), ("?", "missing")], []),
        ("2", "draft", "supported", " ", [], []),
        ("3", "draft", "supported", " new ", [("a", "missing"), ("a", "repaired")], ["b", "?"]),
        ("4", "draft", "corrected", "", [("a", "covered")], []),
    ]
    schema = "plan_id string, draft string, status string, corrected string, coverage array<struct<requirement_id string, status string>>, missing array<string>"
    got = sorted(map(tuple, P.settled(requirements, spark.createDataFrame(verdicts, schema)).collect()))
    assert got == [("1", "supported", "draft", []), ("2", "insufficient", "draft", ["a"]), ("3", "corrected", "new", ["b"]), ("4", "insufficient", "", [])]


def test_presentation_and_echo(spark):
    plans = read(spark, PLAN, PLAN | {"mode": "direct_fact"}, PLAN | {"mode": "comparison"}, PLAN | {"requirements": [{"question": "q", "answerType": "Force_Roles"}]})
    assert [r.p for r in plans.orderBy("plan_id").select(P.presentation().alias("p")).collect()] == ["keywords", "none", "contrast", "inventory"]
    asked = "Vì sao thắng lợi nhanh?"
    answers = {"## Vì sao thắng lợi nhanh?\n\nBody": "Body", "## Nguyên nhân\nBody": "## Nguyên nhân\nBody", "  x ": "x", "# Vì sao thắng lợi nhanh": ""}
    rows = spark.createDataFrame([(k, k, asked) for k in answers], "plan_id string, answer string, question string")
    assert {r.plan_id: r.answer for r in P.without_echo(rows).collect()} == answers
    prompts = spark.createDataFrame([("<old>",), (" p ",), (None,)], "t string").select(P.effective_prompt(F.col("t"), "d", ["<old>"]).alias("p"))
    assert [r.p for r in prompts.collect()] == ["d", "p", "d"]


def test_subject_scan_and_details(spark):
    docs = spark.createDataFrame([(1, 5, "The Red Fort fell"), (2, 3, "red fort and red wall"), (3, 1, "none")], "doc_id long, sequence int, text string")
    phrases = spark.createDataFrame([("p", "Red Fort"), ("p", "wall"), ("p", " ")], "plan_id string, phrase string")
    got = E.subject_scan(docs, phrases).orderBy("rank").collect()
    assert [(r.doc_id, r.matched) for r in got] == [(2, ["Red Fort", "wall"]), (1, ["Red Fort"])]
    said = spark.createDataFrame([("vai trò công nhân Hà Nội", "Hà Nội")], "q string, s string").select(E.detail_phrases(F.col("q"), F.col("s")).alias("p")).first()["p"]
    assert said == ["cong nhan", "nhan ha", "cong nhan ha", "nhan ha noi"]
    scanned = spark.createDataFrame([("p", 1, 0.5, "x cong nhan y"), ("p", 2, 0.5, "cong nhan ha noi"), ("p", 3, 0.5, "cong cuoc")], "plan_id string, doc_id long, score double, key string")
    queries = spark.createDataFrame([("p", 0, ["cong nhan", "nhan ha"])], "plan_id string, ord int, phrases array<string>")
    hits = [(r.doc_id, r.score) for r in E.detail_hits(scanned, queries).orderBy("rank").collect()]
    assert hits == [(2, round(0.70 + (4 + 1 + 0.025) / 20, 6)), (1, round(0.70 + (2 + 0.5 + 0.025) / 20, 6))]


ITEM = "plan_id string, doc_id long, score double, curated boolean, priority double, y0 int, y1 int"
HIT = "plan_id string, kind string, ord int, rank int, doc_id long"


def test_reservation_of_all_tiers(spark):
    # one plan: 60 items of falling score; a low curated one, a detail, a window and two queries that prefer the same items
    items = [("p", i, 1 - i / 100, i == 59, 1.0, 1950, None) for i in range(60)] + [("p", 99, 0.99, False, 1.0, 1800, 1801)]
    hits = [("p", "detail", 0, 1, 58), ("p", "window", 0, 1, 57), ("p", "window", 0, 2, 59), ("p", "query", 0, 1, 99)]
    hits += [("p", "query", q, i, i) for q in (0, 1) for i in range(30, 45)]
    plans = spark.createDataFrame([("p", 1940, 1960)], "plan_id string, start int, end int")
    got = E.reserve(spark.createDataFrame(items, ITEM), spark.createDataFrame(hits, HIT), plans).orderBy("rank").collect()
    assert len(got) == 48 and [(r.doc_id, r.tier) for r in got[:3]] == [(59, "curated"), (58, "detail"), (57, "window")]
    assert [r.doc_id for r in got if r.tier == "query"] == list(range(30, 40))  # the second query goes on where the first stopped
    assert [r.doc_id for r in got if r.tier == "rest"] == [*range(0, 30), *range(40, 45)]
    assert E.reserve(spark.createDataFrame([], ITEM), spark.createDataFrame([], HIT)).count() == 0


def test_selection_against_windows(spark):
    requirements = spark.createDataFrame([("p", "a", True, ["w1", "w2"]), ("p", "b", True, []), ("p", "c", False, []), ("p", "d", True, ["w1", "w2"])], "plan_id string, requirement_id string, required boolean, windows array<string>")
    windows = spark.createDataFrame([("p", "w1", 1950, 1954), ("p", "w2", 1965, 1968)], "plan_id string, window_id string, start int, end int")
    candidates = spark.createDataFrame([("p", "e1", 1951, None), ("p", "e2", 1972, None), ("p", "e3", None, None)], "plan_id string, evidence_id string, y0 int, y1 int")
    returned = [("p", "a", 0, "e1"), ("p", "a", 1, "e2"), ("p", "a", 2, "zz"), ("p", "d", 0, "e3"), ("p", "d", 1, "e1"), ("p", "d", 2, "e1"), ("p", "?", 0, "e1")]
    got = E.selection(spark.createDataFrame(returned, "plan_id string, requirement_id string, at int, evidence_id string"), requirements, candidates, windows).collect()
    assert {r.requirement_id: (r.evidence, r.missing) for r in got} == {"a": (["e1"], True), "b": ([], True), "c": ([], False), "d": (["e3", "e1"], False)}


def test_citations_and_merge(spark):
    items = spark.createDataFrame([("p", 1, "s", " ", "x" * 500, 0.5), ("p", 2, "s", "T", "y", 0.4)], "plan_id string, doc_id long, source_id string, source_title string, text string, score double")
    got = E.citations(items, spark.createDataFrame([("p", 1), ("p", 1)], "plan_id string, doc_id long")).collect()
    assert [(r.title, len(r.excerpt)) for r in got] == [("s", 420)]
    assert {(r.doc_id, r.score) for r in E.merged(items, items.withColumn("score", F.lit(0.45))).collect()} == {(1, 0.5), (2, 0.45)}


def test_suggestions(spark):
    rows = [
        ("p", 1, "event", "Chiến dịch Điện Biên Phủ", "periods/a/stages/b/events.json", "dien-bien-phu", 0.5, True),
        ("p", 2, "event", "Chiến dịch Hòa Bình", "periods/a/stages/b/events.json", "hoa-binh", 0.9, True),
        ("p", 3, "event", "Chiến dịch Việt Bắc", "periods/../stages/b/events.json", "viet-bac", 0.9, True),
        ("p", 4, "person", "Ai đó", "persons/a/x.json", "x", 0.9, True),
        ("q", 5, "person", "Võ Nguyên Giáp", "persons/a/giap.json", "giap", 0.2, False),
        ("q", 6, "person", "Người khác", "persons/a/khac.json", "khac", 0.9, True),
        ("r", 7, "period", "Kỳ", "periods.json", "ky", 0.1, False),
    ]
    items = spark.createDataFrame(rows, "plan_id string, record_id long, kind string, heading string, path string, published_id string, score double, selected boolean")
    plans = spark.createDataFrame([("p", "event", "Điện Biên Phủ", "không nhắc"), ("q", "person", "", "Do Võ Nguyên Giáp chỉ huy"), ("r", "period", "", "")], "plan_id string, kind string, subject string, answer string")
    got = {(r.plan_id, r.app_path) for r in U.suggestions(items, plans).collect()}
    assert got == {("p", "/event/a/b/dien-bien-phu"), ("q", "/person/a/giap"), ("r", "/period-detail/ky")}
    named = U.mentioned(items.where("plan_id = 'q'").drop("plan_id"), plans).collect()
    assert [(r.plan_id, r.record_id) for r in named] == [("q", 5)]


def test_evaluation(spark, tmp_path):
    cases = [
        {"id": "1", "mode": "direct_fact", "question": "q", "requiredConcepts": [["Hà Nội", "Thăng Long"], ["1954"]], "forbiddenConcepts": ["Huế"], "minimumRequirements": 1},
        {"id": "2", "mode": "direct_fact", "question": "q", "requiredConcepts": [["x"]], "minimumRequirements": 1, "maximumConfidence": 0.5},
        {"id": "3", "mode": "direct_fact", "question": "q", "requiredConcepts": []},
    ]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    answers = spark.createDataFrame([("1", "Năm 1954, ha noi", "direct_fact", 0.9, 1), ("2", "x và huế", "direct_fact", 0.9, 1)], "id string, answer string, mode string, confidence double, requirements int")
    got = {r.id: (r.missing_concepts, r.passed) for r in V.outcomes(V.cases(spark, str(tmp_path / "cases.json")), answers).collect()}
    assert got == {"1": (0, True), "2": (0, False), "3": (0, False)}


def test_models(spark):
    row = spark.createDataFrame([("a b a",), ("",)], "t string").select(M.embedding(F.col("t"), 16).alias("v")).collect()
    assert abs(sum(x * x for x in row[0].v) - 1) < 1e-6 and set(row[1].v) == {0.0}
    texts = spark.createDataFrame([(1, "a b a é"), (2, ""), (3, None)], "doc_id long, text string")
    one = {r.doc_id: r.v for r in texts.select("doc_id", M.embedding(F.col("text"), 16).alias("v")).collect()}
    assert {r.doc_id: r.v for r in M.embedded(texts, 16).collect()} == one
    chunks = spark.createDataFrame([("c", "Ở Điện Biên Phủ, Bác Hồ nói")], "chunk_id string, text string")
    aliases = spark.createDataFrame([("LOCATION", "dien bien phu", "Điện Biên Phủ"), ("PERSON", "bac ho", "Hồ Chí Minh"), ("PERSON", "bac", "X Y")], "kind string, search_key string, canonical_name string")
    assert {r.name for r in M.known_names(chunks, aliases).collect()} == {"Điện Biên Phủ", "Hồ Chí Minh", "X Y"}
    requirements = spark.createDataFrame([("p", "a", "red wall")], "plan_id string, requirement_id string, question string")
    candidates = spark.createDataFrame([("p", "e1", "a red fox. More."), ("p", "e2", "the red wall stood. More."), ("p", "e3", "x")], "plan_id string, evidence_id string, text string")
    assert [r.evidence_id for r in M.lexical_selection(requirements, candidates).orderBy("at").collect()] == ["e2", "e1"]
    assert M.extract_answer(candidates.withColumn("score", F.lit(1.0)), 2).first()["answer"] == "a red fox. the red wall stood."


def test_mentions_are_the_first_of_all_headings(spark, monkeypatch):
    words = ["a", "an", "the", "red wall", "red", "wall of stone", "stone and iron gates", "gates", "iron", "nd ir", "é", "nowhere at all in any text", "", " - "]
    records = [(i, "x" if i % 9 else "y", words[i % len(words)]) for i in range(140)]
    texts = ["The RED wall of stone and iron gates", "stone, and iron gates; red", "", "nothing", "gates " * 50 + "red walls", "e", "  a red"]
    answers = [(f"p{i}", "y" if i == 3 else "x", t) for i, t in enumerate(texts)] + [("p0", "x", "iron, a second answer"), ("p9", None, "red")]
    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower().replace("é", "e")).split())
    want = {}
    for plan in {a[0] for a in answers}:
        hits = sorted((fold(t).find(fold(h)) + 1, r) for p, k, t in answers if p == plan for r, kind, h in records if kind == k and fold(h) and fold(h) in fold(t))
        want |= {(plan, n + 1): hit for n, hit in enumerate(hits[:5])}
    for most in (500_000, 3):
        monkeypatch.setattr(U, "BLOCK_HEADINGS", most)
        got = U.mentioned(spark.createDataFrame(records, "record_id long, kind string, heading string"), spark.createDataFrame(answers, "plan_id string, kind string, answer string"), 5).collect()
        assert {(r.plan_id, r["rank"]): (r.place, r.record_id) for r in got} == want


def test_pages_without_an_end_of_their_body_are_answers(spark, tmp_path):
    spark.createDataFrame([(1, "", "<html><title>Red fort</title><body>one"), (2, "", "<html><title>Two</title><body>on the red  fort")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = entry_points.queries()["suggest_mentions"](spark, str(tmp_path)).collect()
    assert {(r.plan_id, r.record_id) for r in got} == {("p1", 1), ("p2", 1), ("p2", 2)}
