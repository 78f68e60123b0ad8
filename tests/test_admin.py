"""Administration of tables, and published records as text."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import admin as A
from lodestone.operators.joins import small
from lodestone.sources.records import published_rows

EDGE = "src string, dst string, type string, source_id string, pipeline string"
ENTITY = "canonical_id string, name string, kind string, aliases array<string>, source_ids array<string>, search_keys array<string>"


@pytest.fixture
def tables(spark):
    return {
        "sources": spark.createDataFrame([("s1", "One"), ("s2", "Two")], "id string, title string"),
        "pages": spark.createDataFrame([("p1", "s1"), ("p2", "s2")], "page_id string, source_id string"),
        "chunks": spark.createDataFrame([("c1", "s1", "One"), ("c2", "s2", "Two")], "chunk_id string, source_id string, source_title string"),
        "mentions": spark.createDataFrame([("c1", "e1", "s1"), ("c2", "e2", "s2")], "chunk_id string, canonical_id string, source_id string"),
        "edges": spark.createDataFrame([("e1", "e2", "LED", "s1", "v2"), ("e2", "e3", "PART_OF", "s2", None)], EDGE),
        "entities": spark.createDataFrame([("e1", "A", "PERSON", [], ["s1"], ["a"]), ("e2", "B", "PERSON", ["Bê"], ["s1", "s2"], ["b"]), ("e3", "C", "EVENT", [], ["s2"], ["c"])], ENTITY),
    }


def ids(df, c):
    return sorted(r[c] for r in df.collect())


def test_deleting_a_source(tables):
    out = A.without_source(tables, "s1")
    assert ids(out["sources"], "id") == ["s2"] and ids(out["chunks"], "chunk_id") == ["c2"] and ids(out["edges"], "type") == ["PART_OF"]
    assert ids(out["entities"], "canonical_id") == ["e2", "e3"] and out["entities"].where("canonical_id = 'e2'").first()["source_ids"] == ["s2"]


def test_indexing_a_source_again(spark, tables):
    new = {"chunks": spark.createDataFrame([("c9", "s1", "One")], tables["chunks"].schema), "mentions": spark.createDataFrame([("c9", "e2", "s1"), ("c9", "e4", "s1")], tables["mentions"].schema), "sources": tables["sources"].where("id = 's1'"), "entities": spark.createDataFrame([("e2", "B", "PERSON", ["Bi", "Bê"], ["s1"], ["bi"]), ("e4", "D", "PERSON", [], ["s1"], ["d"])], ENTITY)}
    once = A.with_source(tables, new, "s1")
    assert ids(once["chunks"], "chunk_id") == ["c2", "c9"] and ids(once["entities"], "canonical_id") == ["e2", "e3", "e4"]
    e2 = once["entities"].where("canonical_id = 'e2'").first()
    assert (e2.aliases, e2.source_ids) == (["Bê", "Bi"], ["s2", "s1"])
    twice = A.with_source(once, new, "s1")
    for name in once:
        assert sorted(map(str, once[name].collect())) == sorted(map(str, twice[name].collect()))


def test_metadata_reaches_chunks(spark, tables):
    changes = spark.createDataFrame([("s1", "Uno"), ("s2", None)], "id string, title string")
    sources, chunks = A.with_metadata(tables["sources"], tables["chunks"], changes)
    assert ids(sources, "title") == ["Two", "Uno"] and ids(chunks, "source_title") == ["Two", "Uno"]


def test_property_edits(tables):
    after, before = A.with_property(tables["entities"], "canonical_id", "e2", "name", "Bảo", {"canonical_id"})
    assert before == "B" and after.where("canonical_id = 'e2'").first()["search_keys"] == ["bao", "be"]
    assert after.where("canonical_id = 'e1'").first()["search_keys"] == ["a"]
    with pytest.raises(ValueError):
        A.with_property(tables["entities"], "canonical_id", "e2", "canonical_id", "x", {"canonical_id"})
    with pytest.raises(KeyError):
        A.with_property(tables["entities"], "canonical_id", "nobody", "name", "x", set())


def test_guards_and_removal(spark, tables):
    assert A.guarded(tables["edges"]).count() == 2
    with pytest.raises(Exception, match="not a canonical relation"):
        A.guarded(spark.createDataFrame([("a", "b", "nonsense", "s", "v")], EDGE)).collect()
    nodes = spark.createDataFrame([("e1", "Entity"), ("e2", "Entity"), ("x", "Old")], "id string, label string")
    left, edges, degree = A.without_node(nodes, tables["edges"], "e2")
    assert (left.count(), edges.count(), degree) == (2, 0, 2)
    kept, edges, report = A.without_legacy(nodes, tables["edges"], "v2", ["Entity"])
    assert kept.count() == 2 and edges.count() == 1 and {tuple(r) for r in report.collect()} == {("node", 1, 2), ("edge", 1, 1)}


def test_violations(spark, tables):
    twice = tables | {"pages": tables["pages"].union(tables["pages"]).union(spark.createDataFrame([(None, "s")], tables["pages"].schema))}
    assert {(r.name, r.key, r.n) for r in A.violations(twice).collect()} == {("pages", "p1", 2), ("pages", "p2", 2), ("pages", "", 1)}


def test_versions_logs_and_exports(spark, tables, tmp_path):
    A.versioned({"sources": tables["sources"]}, str(tmp_path / "kb"))
    A.versioned({"sources": tables["sources"].where("id = 's2'")}, str(tmp_path / "kb"))
    assert ids(A.current(spark, str(tmp_path / "kb"), "sources"), "id") == ["s2"]
    A.append_log(spark, str(tmp_path / "log"), [{"id": "1", "q": "x", "m": {"b": 1, "a": 2}}])
    A.append_log(spark, str(tmp_path / "log"), [{"id": "2", "q": "y"}])
    rows = {r.id: json.loads(r.payload) for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert rows == {"1": {"q": "x", "m": '{"a":2,"b":1}'}, "2": {"q": "y"}}
    config = spark.createDataFrame([("old", 1), ("new", 2)], "text string, updated_at int")
    assert A.active_prompt(config, "d") == "new" and A.active_prompt(config.limit(0), "d") == "d"
    nodes = spark.createDataFrame([("e1", "P", "A"), ("e2", "Q", "B"), ("e3", "Q", "C")], "id string, label string, title string")
    A.export_json(nodes, tables["edges"].select("src", "dst", "type"), "P", str(tmp_path / "out"))
    assert ids(spark.read.json(str(tmp_path / "out" / "nodes")), "id") == ["e1", "e2"]


def test_audit(spark, tables):
    entities = spark.createDataFrame([("1", "Trận A", "EVENT", [], [], []), ("2", "tran a", "LOCATION", ["x"], [], []), ("3", "1954", "EVENT", [], [], [])], ENTITY)
    report = A.audit(entities, tables["edges"].select("src", "dst", F.lit("thuộc").alias("type")), {"EVENT": ["tran "]}, [])
    assert [(r.search_key, r.n_kinds) for r in report["type_conflicts"].collect()] == [("tran a", 2)]
    assert [(r.search_key, r.kind, r.target, r.members) for r in report["targets"].collect()] == [("tran a", "EVENT", "1", 2)]
    assert ids(report["invalid"], "canonical_id") == ["3"] and report["relations"].first()["canonical"] == "PART_OF"


def test_a_large_table_is_not_broadcast(spark):
    few, many = small(spark.range(3), 5), small(spark.range(9), 5)
    assert "hint" in few._jdf.queryExecution().logical().toString().lower() and "hint" not in many._jdf.queryExecution().logical().toString().lower() and many.count() == 9


def test_published_records(spark, tmp_path):
    event = [{"id": "dbp", "status": "published", "title": "Chiến thắng ", "summary": "Tóm  tắt.", "startDate": "1954-05-07T00:00:00Z", "content": {"warSummary": [{"detail": "d1", "diadiem": {"content": "Điện Biên"}}], "images": ["x"]}, "sortOrder": 3}]
    person = {"slug": "giap", "status": "published", "name": "Võ Nguyên Giáp", "title": "Đại tướng", "achievements": ["a", "a", "b"]}
    files = {}
    for path, value in (("periods/a/events.json", event), ("persons/thoi-ky/giap.json", person), ("periods.json", [{"id": "p", "status": "published", "title": "Kỳ"}, {"id": "q", "title": "nháp"}])):
        raw = json.dumps(value, ensure_ascii=False).encode()
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(raw)
        files[path] = {"url": path, "sha256": hashlib.sha256(raw).hexdigest()}
    (tmp_path / "manifest.json").write_text(json.dumps({"contentVersion": "v1", "files": files}))
    got = {r.id: r for r in published_rows(spark, str(tmp_path)).collect()}
    assert set(got) == {"published:periods/a/events.json:dbp", "published:persons/thoi-ky/giap.json:giap", "published:periods.json:p"}
    e, p = got["published:periods/a/events.json:dbp"], got["published:persons/thoi-ky/giap.json:giap"]
    assert e.text.split("\n")[0] == "Bản ghi sự kiện: Chiến thắng, Tóm tắt, tại Điện Biên, bắt đầu ngày 7/5/1954."
    assert "Thời gian bắt đầu: 7/5/1954" in e.text and "Chi tiết: d1" in e.text and (e.year_start, e.sequence, e.context) == (1954, 3, "a")
    assert p.heading == "Võ Nguyên Giáp" and p.text.split("\n")[:2] == ["Bản ghi nhân vật: Võ Nguyên Giáp.", "Thời kỳ trong ứng dụng: thoi ky."] and p.text.count("\na") == 1
