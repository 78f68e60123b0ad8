"""Resolution of names, structure of sources, search, timelines, unions and edits of edges, on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import admin as A
from lodestone.operators import graph as G
from lodestone.operators import ingest as I
from lodestone.operators import joins as J
from lodestone.operators import models as M
from lodestone.operators import retrieval as R
from lodestone.operators import state as S
from lodestone.sources.records import record_rows

REGISTRY = "ord int, kind string, canonical_name string, aliases array<string>, forced boolean, year_start int, year_end int"


def registry(spark):
    rows = [(1, "PERSON", "Hồ Chí Minh", ["Bác Hồ", "Nguyễn Ái Quốc"], False, 1890, 1969), (2, "ORGANIZATION", "Việt Minh", ["Mặt trận Việt Minh"], True, None, None), (3, "EVENT", "Hiệp định Paris", [], False, 1973, 1973)]
    return spark.createDataFrame(rows, REGISTRY)


def test_names_are_resolved(spark):
    names = [("bác hồ", "person"), ("Chủ tịch Hồ Chí Minh", "PERSON"), ("Đại tướng Võ Nguyên Giáp", "PERSON"), ("Ông Giáp", "PERSON"), ("Mặt trận Việt Minh", "PERSON"), ("Chiến dịch Biên giới", "LOCATION"), ("Đảo Cồn Cỏ", None)]
    got = {r.surface: (r.kind, r.canonical_name, r.aliases) for r in I.resolved(spark.createDataFrame(names, "surface string, kind string"), registry(spark)).collect()}
    assert got["bác hồ"] == ("PERSON", "Hồ Chí Minh", ["Hồ Chí Minh", "bác hồ", "Nguyễn Ái Quốc"])
    assert got["Chủ tịch Hồ Chí Minh"] == ("PERSON", "Hồ Chí Minh", ["Hồ Chí Minh", "Chủ tịch Hồ Chí Minh", "Bác Hồ", "Nguyễn Ái Quốc"])
    assert got["Đại tướng Võ Nguyên Giáp"][1] == "Võ Nguyên Giáp" and got["Ông Giáp"][1] == "Ông Giáp"  # one word isn't a name by itself
    assert got["Mặt trận Việt Minh"][:2] == ("ORGANIZATION", "Việt Minh") and got["Chiến dịch Biên giới"][0] == "EVENT" and got["Đảo Cồn Cỏ"][0] == "LOCATION"


def test_spellings(spark):
    names = spark.createDataFrame([("Nguyen Ai Quoc",), ("ai đó",), (None,)], "surface string")
    got = {r.surface: (r.spellings, r.year_start) for r in I.expanded(names, registry(spark)).collect()}
    assert got == {"Nguyen Ai Quoc": (["Hồ Chí Minh", "Bác Hồ", "Nguyễn Ái Quốc"], 1890), "ai đó": ([], None), None: ([], None)}


def structure(spark, links, expected=None):
    sources = spark.createDataFrame([("s",), ("empty",)], "source_id string")
    pages = spark.createDataFrame([("s-p1", "s"), ("s-p2", "s")], "page_id string, source_id string")
    chunks = spark.createDataFrame([("c1", "s", None, 1), ("c2", "s", "s-p2", 2), ("c3", "s", "gone", 9)], "chunk_id string, source_id string, page_id string, page int")
    return G.structure(sources, pages, chunks, spark.createDataFrame(links, "src string, dst string, type string"), expected)


def test_structure_is_repaired_and_verified(spark):
    links, report = structure(spark, [("s", "s-p1", "HAS_PAGE"), ("s-p2", "c1", "HAS_CHUNK")])
    assert sorted(map(tuple, links.collect())) == [("s", "s-p1", "HAS_PAGE"), ("s", "s-p2", "HAS_PAGE"), ("s-p2", "c1", "HAS_CHUNK"), ("s-p2", "c2", "HAS_CHUNK")]
    got = {r.source_id: r.asDict() for r in report.collect()}
    assert got["s"] == {"source_id": "s", "page_nodes": 2, "chunk_nodes": 3, "linked_pages": 2, "linked_chunks": 2, "repaired_pages": 1, "repaired_chunks": 1, "valid": False}  # c3 has no page to hang on
    assert got["empty"]["valid"] and got["empty"]["page_nodes"] == 0
    again = structure(spark, [tuple(r) for r in links.collect()])[1].where("source_id = 's'").first()
    assert (again.repaired_pages, again.repaired_chunks) == (0, 0)
    expected = spark.createDataFrame([("empty", 1, None)], "source_id string, pages int, chunks int")
    assert not structure(spark, [], expected)[1].where("source_id = 'empty'").first()["valid"]


def test_structure_counts_what_hangs_on_several_ends(spark):
    """Against sets: repeated rows, chunks of several sources, on several pages or on none, pages of several sources, and ids that are null."""
    import random

    for seed in range(3):
        draw = random.Random(seed)
        ids = lambda *names: draw.choice([*names, None]) if draw.random() < 0.1 else draw.choice(names)
        sources = [(ids("s", "t", "u"),) for _ in range(4)]
        pages = [(ids("s-p1", "s-p2", "t-p1", "x", "y"), ids("s", "t", "u")) for _ in range(6)]
        chunks = [(ids("c1", "c2", "c3", "c4", "c5", "c6"), ids("s", "t"), ids("s-p1", "x", "gone") if draw.random() < 0.5 else None, ids(1, 2)) for _ in range(9)]
        links = [(ids("s", "t", "u"), ids("s-p1", "t-p1", "x", "gone"), "HAS_PAGE") for _ in range(3)] + [(ids("s-p1", "x", "y", "gone"), ids("c1", "c2", "c7"), "HAS_CHUNK") for _ in range(4)]
        own = [(c, s, p or (f"{s}-p{n}" if s and n else None)) for c, s, p, n in chunks]
        there = {p for p, _ in pages if p}
        page_missing = {(s, p) for p, s in pages if (s, p, "HAS_PAGE") not in links and s and p}
        hung = {c for _, c, kind in links if kind == "HAS_CHUNK" and c}
        chunk_missing = [(p, c, s) for c, s, p in own if p in there and c and c not in hung]
        on_pages = {(s, p) for s, p, kind in links if kind == "HAS_PAGE" and p in there} | page_missing
        on_chunks = {(p, c) for p, c, kind in links if kind == "HAS_CHUNK" and c} | {(p, c) for p, c, _ in chunk_missing}
        want = {}
        for (s,) in sources:
            some = [{p for p, x in pages if x == s and p}, {c for c, x, _ in own if x == s and c}, {p for x, p in on_pages if x == s}, {c for x, p in on_pages if x == s for q, c in on_chunks if p == q}, {p for x, p in page_missing if x == s}, {c for _, c, x in chunk_missing if x == s}]
            want[s] = [len(x) for x in some] if s else [0] * 6
        tables = [(sources, "source_id string"), (pages, "page_id string, source_id string"), (chunks, "chunk_id string, source_id string, page_id string, page int"), (links, "src string, dst string, type string")]
        report = G.structure(*[spark.createDataFrame(*t) for t in tables])[1]
        assert {r[0]: list(r[1:7]) for r in report.select("source_id", "page_nodes", "chunk_nodes", "linked_pages", "linked_chunks", "repaired_pages", "repaired_chunks").collect()} == want


def test_structure_deals_its_rows_three_times(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    report = G.structure(none("source_id string"), none("page_id string, source_id string"), none("chunk_id string, source_id string, page_id string, page int"), none("src string, dst string, type string"))[1]
    assert report._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3


def test_chunks_of_sources(spark):
    chunks = spark.createDataFrame([("c1", "s", 1, 1, "About Red"), ("c2", "s", 2, 2, "blue"), ("c3", "t", 1, 1, "red")], "chunk_id string, source_id string, page int, sequence int, text string")
    mentions = spark.createDataFrame([("c1", "B"), ("c1", "A"), ("c1", "A")], "chunk_id string, name string")
    report = spark.createDataFrame([("s", True), ("t", False)], "source_id string, valid boolean")
    assert [(r.chunk_id, r.entities) for r in G.source_chunks(chunks, mentions, report).orderBy("sequence").collect()] == [("c1", ["A", "B"]), ("c2", [])]
    assert [r.chunk_id for r in G.source_chunks(chunks, mentions, report, spellings=["RED", "x"]).collect()] == ["c1"]
    assert [r.chunk_id for r in G.source_chunks(chunks, mentions, report, page=2).collect()] == ["c2"]


def test_search_of_nodes_and_relations(spark):
    nodes = spark.createDataFrame([("1", "Entity", "Hà Nội", ["Thăng Long"], ["ha noi", "thang long"]), ("2", "Chunk", None, None, None)], "id string, label string, title string, aliases array<string>, search_keys array<string>")
    assert [r.id for r in G.search(nodes, "thăng").collect()] == ["1"] and [r.id for r in G.search(nodes, "HA NOI").collect()] == ["1"]
    assert [r.id for r in G.search(nodes, "2").collect()] == ["2"] and G.search(nodes, "", label="Chunk").count() == 1 and G.search(nodes, " ", limit=0).count() == 1
    with pytest.raises(ValueError):
        G.search(nodes, "", label="Other", labels=["Chunk"])
    edges = spark.createDataFrame([("1", "2", "LED", "chỉ huy")], "src string, dst string, type string, raw_type string")
    assert G.relations_found(nodes, edges, "CHỈ").count() == 1 and G.relations_found(nodes, edges, "nội", kind="LED").count() == 1 and G.relations_found(nodes, edges, "x").count() == 0


def test_edges_and_prompts_are_edited(spark, tmp_path):
    edges = spark.createDataFrame([("e1", "a", "b", "LED", "x"), ("e2", "b", "c", "LED", None)], "edge_id string, src string, dst string, type string, note string")
    after, before = A.with_edge_property(edges, "e1", "note", "y", set())
    assert before == "x" and {r.edge_id: r.note for r in after.collect()} == {"e1": "y", "e2": None}
    with pytest.raises(ValueError):
        A.with_edge_property(edges, "e1", "type", "OTHER", set())
    left, gone = A.without_edge(edges, "e1")
    assert [r.edge_id for r in left.collect()] == ["e2"] and gone["src"] == "a"
    with pytest.raises(KeyError):
        A.without_edge(edges, "none")
    config = spark.createDataFrame([], "text string, updated_at timestamp")
    assert A.active_prompt(A.set_prompt(config, " new "), "default") == "new"
    with pytest.raises(ValueError):
        A.set_prompt(config, " ")
    A.write_audit({"one": edges, "none": edges.limit(0)}, str(tmp_path / "audit"))
    assert {r.part: r.n for r in spark.read.json(str(tmp_path / "audit" / "counts")).collect()} == {"one": 2, "none": 0}


def test_several_phrases_and_what_is_off(spark):
    docs = spark.createDataFrame([(1, "red wall and blue door", True, "s"), (2, "red wall", None, "s"), (3, "red wall", False, "s"), (4, "red wall", True, "off"), (5, "blue door", True, None)], "doc_id long, text string, active boolean, source_id string")
    on = R.active(docs, spark.createDataFrame([("off", False), ("s", None)], "source_id string, active boolean"))
    assert sorted(r.doc_id for r in on.collect()) == [1, 2, 5]
    phrases = spark.createDataFrame([(7, 0, "Red Wall"), (7, 1, "blue door"), (8, 0, " ")], "query_id long, ord int, phrase string")
    assert [(r.doc_id, r.rank) for r in R.phrase_hits(on, phrases, 10).orderBy("rank").collect()] == [(2, 1), (1, 2), (5, 3), (1, 4)]
    assert [(r.doc_id, r.rank) for r in R.phrase_hits(on, phrases, 10, scan_limit=1).orderBy("rank").collect()] == [(1, 1), (1, 2)]


def test_large_tables_of_questions_meet_in_blocks(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, "k") for i in range(30)], "doc_id int, key string")
    asked = spark.createDataFrame([(q, "k" if q % 2 else "z") for q in range(12)], "query_id int, key string")
    want = sorted((d, q) for d in range(30) for q in range(1, 12, 2))
    for most in (100, 5):
        monkeypatch.setattr(J, "MOST_ROWS", most)
        monkeypatch.setattr(J, "BLOCK_ROWS", 4)
        assert sorted((r.doc_id, r.query_id) for r in J.every_pair(corpus, asked, "key").collect()) == want


def test_numbers_run_on_over_spans(spark):
    rows = [("a", i * 3) for i in range(50)] + [(None, 7), (None, 200), ("b", 5)]
    got = J.numbered(spark.createDataFrame(rows, "source string, doc_id long"), "source", "doc_id", "n", span=16).collect()
    assert sorted((str(r.source), r.doc_id, r.n) for r in got) == sorted([("a", i * 3, i) for i in range(50)] + [("None", 7, 0), ("None", 200, 1), ("b", 5, 0)])


def test_published_scores_by_parts_of_words(spark):
    records = spark.createDataFrame([(1, "Red forts", "of hundreds", "time"), (2, "blue", "red", "fort"), (3, "none", "", None)], "doc_id long, title string, body string, context string")
    asked = spark.createDataFrame([(1, "red fort"), (2, "nothing at all"), (3, "")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in R.published_top(records, asked, 5, []).collect()}
    assert got == {(1, 1): 1.0}  # both words in title and text, and in a row; the other has one word in its text


def test_union_and_zip(spark):
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "at int, v string"), spark.createDataFrame([(0, 1.0), (1, 2.0)], "at int, w double")
    assert sorted((r.at, r.v, r.w) for r in R.zipped(a, b).collect()) == [(0, "x", 1.0), (1, "y", 2.0)]
    with pytest.raises(Exception, match="one side lacks row 1"):
        R.zipped(a, b.where("at = 0")).collect()
    both = R.corpora(("a", a), ("b", b))
    assert sorted((r.corpus, r.at) for r in both.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_jobs(spark):
    events = [("j", i, s) for i, s in enumerate(["running", "ready", "running"])] + [("k", 0, "ready")]
    assert {r.job_id: (r.state, r.refused) for r in S.job_outcomes(spark.createDataFrame(events, "job_id string, at int, state string")).collect()} == {"j": ("ready", 1), "k": ("queued", 1)}


def test_reservation_equals_taking_in_turn(spark):
    import random

    rng = random.Random(3)
    rows = [(q, i, rng.randint(0, 20) / 10, rng.random() < 0.2, rng.random() < 0.4) for q in range(4) for i in range(90)]
    got = R.reserved(spark.createDataFrame(rows, "query_id int, doc_id int, score double, curated boolean, detail boolean"), [("curated", 5), ("detail", 7)], 20).collect()
    for q in range(4):
        left, want = sorted([r for r in rows if r[0] == q], key=lambda r: (-r[2], r[1])), []
        for tier, (flag, quota) in enumerate(((3, 5), (4, 7))):
            taken = [r for r in left if r[flag]][:quota]
            want += [(r[1], tier) for r in taken]
            left = [r for r in left if r not in taken]
        want = (want + [(r[1], 2) for r in left])[:20]
        assert [(r.doc_id, r.tier) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_reuse(spark):
    items = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "b"), ("t", "c")], "run_id string, content_hash string")
    got = {r.run_id: (r.rows, r.distinct_rows, r.reused) for r in S.reuse_counts(items, spark.createDataFrame([("a",), ("a",)], "content_hash string")).collect()}
    assert got == {"r": (3, 2, 1), "t": (1, 1, 0)}


def test_records_are_read_at_any_depth_without_a_shuffle(spark):
    deep = {"id": "a", "status": "published", "title": "T", "content": {"b": {"c": [1, {"d [{": [[{"detail": 'say "[{" \\\\'}], None, "end"]}], "images": [{"detail": "no"}]}, "a": ["x", "", "x"]}}
    rows = spark.createDataFrame([("periods/p/events.json", json.dumps(deep))] * 2, "path string, json string").select("path", F.parse_json("json").alias("record"))
    found = record_rows(rows)
    assert [r.text.split("\n") for r in found.collect()] == [["Bản ghi sự kiện: T.", "Sự kiện: T", "x", "1", 'Chi tiết: say "[{" \\\\', "end"]] * 2
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_documents_are_scored_where_they_are_read(spark, monkeypatch):
    texts = ["red fort red", "red", "blue fort of stone", "", None, "of of of stone", "Réd FORT!", "a b c"] + ["red fort"] * 30
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([("x", "red fort"), ("y", "stone of nothing"), ("z", "absent")], "query_id string, text string")
    rows = lambda: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in R.bm25(docs, asked, 4).collect())
    monkeypatch.setattr(R, "MOST_FOUND", 5)
    got, plan = rows(), R.bm25(docs, asked, 4)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(R, "MOST_CELLS", 0)
    assert got == rows() and len(got) == 6


def test_a_key_sends_only_its_first_rows_to_questions(spark):
    entities = spark.createDataFrame([(i, "k") for i in range(500)] * 2, "doc_id long, search_key string")
    wanted = spark.createDataFrame([(q, "k") for q in range(20)], "query_id long, search_key string")
    found = R.key_hits(entities, wanted, 3)
    assert {(r.query_id, r["rank"], r.doc_id) for r in found.collect()} == {(q, n + 1, n) for q in range(20) for n in range(3)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("row_number") == 4  # each with its limit before the shuffle


def test_names_alone_leave_a_chunk(spark):
    chunks = spark.createDataFrame([(1, "the red fort of the red fort"), (2, "red"), (3, None), (4, "a b c d e f")], "chunk_id long, text string")
    aliases = spark.createDataFrame([("N", "red fort", "Fort"), ("N", "the red", "Red"), ("M", "red fort", "Fort"), ("N", "b c d e f", "five"), ("N", "a b c d e f", "six"), ("N", "red", "Red")], "kind string, search_key string, canonical_name string")
    found = M.known_names(chunks, aliases)
    assert {(r.chunk_id, r.name, r.kind) for r in found.collect()} == {(1, "Fort", "N"), (1, "Fort", "M"), (1, "Red", "N"), (2, "Red", "N"), (4, "five", "N")} and found.count() == 5
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()


def test_neighbours_read_edges_once(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "T"), ("b", "a", "S"), ("a", "a", "T"), ("c", "a", "R"), ("d", "c", "R"), (None, "b", "R")], "src string, dst string, type string")
    found = G.neighbours(nodes, edges, 3)
    assert {(r.id, r.other, r.type, r.direction, r["at"]) for r in found.collect()} == {
        ("a", "c", "R", "in", 1), ("a", "b", "S", "in", 2), ("a", "a", "T", "in", 3), ("b", None, "R", "in", 1), ("b", "a", "S", "out", 2), ("b", "a", "T", "in", 3),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [src") == 1


def test_texts_are_read_once_for_words_and_phrases(spark, monkeypatch):
    texts = ["red fort red", "red", "a blue fort of stone", "", None, "of of of stone", "Réd FORT!", "a b c", "the red forty", "of a blue fort"] + ["red fort"] * 30
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([("x", "red fort"), ("y", "stone of nothing"), ("z", "absent")], "query_id string, text string")
    phrases = spark.createDataFrame([("x", "Red Fort", 0), ("x", "red", 1), ("y", "a blue", 0), ("y", "stone", 1), ("z", "!", 0), ("z", "b c", 1)], "query_id string, phrase string, ord int")
    rows = lambda found: {name: sorted(((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str) for name, df in found.items()}
    both = R.text_channels(docs, asked, phrases, 4)
    assert all("translate" not in df._jdf.queryExecution().toString() for df in both.values())  # texts aren't folded again
    got = rows(both)
    assert got == rows({"exact": R.phrase_hits(docs, phrases, 4), "lexical": R.bm25(docs, asked, 4)}) and [len(x) for x in got.values()] == [13, 7]
    unnamed = docs.unionByName(spark.createDataFrame([(None, "b c")], docs.schema))
    exact = lambda found: sorted(((r.query_id, r["rank"], r.doc_id) for r in found.collect()), key=str)
    assert exact(R.text_channels(unnamed, asked, phrases, 4)["exact"]) == exact(R.phrase_hits(unnamed, phrases, 4))
    monkeypatch.setattr(R, "MOST_CELLS", 0)
    assert rows(R.text_channels(docs, asked, phrases, 4)) == got


def test_vectors_are_scored_where_they_are_read(spark, monkeypatch):
    import random

    draw = random.Random(7)
    vectors = [(i, [draw.choice([-1.0, 0.25, 0.5, 3.0]) + draw.random() * (i % 3) for _ in range(3 + i % 2)]) for i in range(300)] + [(300 + i, [1.0, 2.0, 3.0]) for i in range(40)]
    vectors += [(400, None), (401, []), (402, [1.0, None, 2.0]), (403, [float("nan"), 1.0, 1.0]), (404, [1e200, 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0])]
    corpus = spark.createDataFrame(vectors, "doc_id long, v array<float>").repartition(3)
    asked = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [1.0, -1.0, 0.5, 0.25]), ("b", [2.0, 0.5, 1.0]), ("c", [1.0, 1.0])], "query_id string, q array<float>")
    rows = lambda: sorted(((r.query_id, r["rank"], r.doc_id, str(r.score)) for r in R.vector_top(corpus, asked, 6).collect()), key=str)
    monkeypatch.setattr(R, "MOST_FOUND", 5)
    got, plan = rows(), R.vector_top(corpus, asked, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    monkeypatch.setattr(R, "_vectors_by_rows", lambda *_: None)
    assert got == rows() and len(got) == 12


def test_structure_of_ids_named_after_sources_deals_rows_once(spark):
    import random

    for seed in range(3):
        draw = random.Random(seed)
        page, chunk = lambda s=None: f"{s or draw.choice('stu')}-p{draw.randint(1, 4)}", lambda s: f"{s}-p{draw.randint(1, 4)}-c{draw.randint(1, 4)}"
        sources = [(draw.choice("stuv"),) for _ in range(4)]
        pages = [(p, p[0]) for p in (page() for _ in range(9))] + [("t", "t")]  # a page may have the name of its source alone
        chunks = [(chunk(s), s, page(s) if draw.random() < 0.5 else None, draw.randint(1, 5)) for s in (draw.choice("stu") for _ in range(20))]
        links = [(p[0], p, "HAS_PAGE") for p in (page() for _ in range(7))] + [(page(s), chunk(s), "HAS_CHUNK") for s in (draw.choice("stu") for _ in range(12))] + [("t", "t-p1-c1", "HAS_CHUNK"), ("x", "y", "OTHER")]
        tables = [(sources, "source_id string"), (pages, "page_id string, source_id string"), (chunks, "chunk_id string, source_id string, page_id string, page int"), (links, "src string, dst string, type string")]
        frames = [spark.createDataFrame(*t) for t in tables]
        report = G.structure(*frames)[1]
        assert report._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        own = frames[2].selectExpr("chunk_id", "source_id", "coalesce(page_id, concat(source_id, '-p', page)) page_id")
        apart = G._structure_counts(frames[0], frames[1], own, frames[3])
        got = sorted(map(tuple, report.select(apart.columns).collect()))
        assert got == sorted(map(tuple, apart.collect())) and any(any(r[1:]) for r in got)
        assert apart.dtypes == report.select(apart.columns).dtypes
    strays = [("s-p1", "t"), (None, "s"), ("t-p1", None)]  # any one of them has all rows dealt by their chunk, page and source
    for stray in strays:
        report = G.structure(frames[0], frames[1].unionByName(spark.createDataFrame([stray], frames[1].schema)), *frames[2:])[1]
        assert report._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3


def test_names_meet_the_chunks_that_stay_by_any_column(spark):
    chunks = spark.createDataFrame([("s", f"s-p1-c{i}", 1, i, "Red fort", i % 2 or None) for i in range(6)], "source_id string, chunk_id string, page int, sequence int, text string, part int")
    names = spark.createDataFrame([(1, "B"), (1, "A"), (1, "B"), (3, "C"), (None, "D")], "part int, name string")
    report = spark.createDataFrame([("s", True)], "source_id string, valid boolean")
    found = G.source_chunks(chunks, names, report, limit=4, by="part").orderBy("sequence").collect()
    assert [(r.sequence, r.entities) for r in found] == [(0, []), (1, ["A", "B"]), (2, []), (3, ["A", "B"])]
