import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import retrieval as R
from lodestone.operators import state as S
from lodestone.sources.tables import Snapshot, page_text, published
from lodestone.streaming.usage import roll_up


def test_fusion_weighs_channels(spark):
    row = "query_id int, doc_id int, rank int"
    exact, lexical = spark.createDataFrame([(1, 7, 1)], row), spark.createDataFrame([(1, 8, 1), (1, 7, 2)], row)
    got = R.fused({"exact": exact, "lexical": lexical}, 5).orderBy("rank").collect()
    assert [(r.doc_id, r.channels, r.direct) for r in got] == [(7, "exact,lexical", True), (8, "lexical", False)]
    assert got[0].score == 1.0 and got[1].score == round((1 / 61) / (4 / 61 + 1 / 62), 6)


def test_reservation_takes_tiers_in_turn(spark):
    rows = [(1, i, i / 100, i < 3, i % 2 == 0) for i in range(30)]
    items = spark.createDataFrame(rows, "query_id int, doc_id int, score double, curated boolean, detail boolean")
    got = [(r.doc_id, r.tier) for r in R.reserved(items, [("curated", 2), ("detail", 3)], 7).orderBy("rank").collect()]
    assert got == [(2, 0), (1, 0), (28, 1), (26, 1), (24, 1), (29, 2), (27, 2)]


def test_temporal_gate_keeps_undated(spark):
    rows = [(1, None, None), (2, 1972, None), (3, 1966, 1970), (4, 1960, 1964)]
    items = spark.createDataFrame(rows, "id int, y0 int, y1 int").withColumns({"start": F.lit(1965), "end": F.lit(1968)})
    assert sorted(r.id for r in R.temporal_gate(items).collect()) == [1, 3]


def test_confidence_caps(spark):
    rows = [(2, 2, 1.0, "supported", 0, 1.0), (2, 2, 1.0, "supported", 1, 0.6), (1, 2, 1.0, "supported", 0, 0.65), (2, 2, 1.0, "insufficient", 0, 0.4)]
    df = spark.createDataFrame(rows, "c int, r int, s double, v string, k int, want double")
    for r in df.select("want", R.confidence(*[F.col(x) for x in "crsvk"]).alias("got")).collect():
        assert r.got == r.want


def test_graph_edits(spark):
    edges = spark.createDataFrame([("a", "b", "thành lập"), ("b", "c", "PART_OF"), ("a", "c", "PART_OF")], "src string, dst string, type string")
    nodes = spark.createDataFrame([("a", "x", "A"), ("b", "x", "B"), ("c", "y", "C"), ("d", "y", "D")], "id string, label string, title string")
    assert [r.id for r in G.orphans(nodes, edges).collect()] == ["d"]
    assert {(r.type, r.raw_type) for r in G.migrated(edges).collect()} == {("FOUNDED", "thành lập"), ("PART_OF", "PART_OF")}
    merged = G.rewired(edges, spark.createDataFrame([("b", "a")], "old string, new string"))
    assert [tuple(r) for r in merged.collect()] == [("a", "c", "PART_OF")]
    members, touched = G.component_export(nodes, edges, "y")
    assert {(r.id, r.is_member) for r in members.collect()} == {("a", False), ("b", False), ("c", True), ("d", True)} and touched.count() == 2


def test_state(spark):
    rows = [("k", 1, "old"), ("k", 2, "new")]
    assert S.latest(spark.createDataFrame(rows, "key string, at int, v string"), ["key"], "at").first()["v"] == "new"
    jobs = spark.createDataFrame([("a", "running", 3), ("b", "queued", 0), ("c", "ready", 9)], "id string, status string, completed int")
    assert {(r.id, r.status, r.resumable) for r in S.after_restart(jobs).collect()} == {("a", "paused", True), ("b", "paused", False), ("c", "ready", False)}


def write_published(root, tamper=False):
    record = json.dumps([{"id": 1, "status": "published", "title": "A"}, {"id": 2, "status": "draft", "title": "B"}]).encode()
    (root / "periods" / "x").mkdir(parents=True)
    (root / "periods" / "x" / "events.json").write_bytes(record + (b" " if tamper else b""))
    files = {"periods/x/events.json": {"url": "periods/x/events.json", "sha256": hashlib.sha256(record).hexdigest()}, "other/x.json": {"url": "other/x.json", "sha256": "0"}}
    (root / "manifest.json").write_text(json.dumps({"contentVersion": "v1", "files": files}))


def test_published_content(spark, tmp_path):
    write_published(tmp_path)
    got = published(spark, str(tmp_path)).select("path", F.variant_get("record", "$.title", "string").alias("t")).collect()
    assert [tuple(r) for r in got] == [("periods/x/events.json", "A")]


def test_tampered_content_fails_the_load(spark, tmp_path):
    write_published(tmp_path, tamper=True)
    with pytest.raises(Exception, match="differs from its manifest"):
        published(spark, str(tmp_path)).collect()


def test_snapshot_serves_the_last_good_one(spark):
    now, loads = [0.0], []

    def load():
        loads.append(1)
        if len(loads) == 2:
            raise OSError("gone")
        return spark.range(len(loads))

    snapshot = Snapshot(load, ttl=10, clock=lambda: now[0])
    assert snapshot.get().count() == 1
    now[0] = 11.0
    assert snapshot.get().count() == 1 and isinstance(snapshot.error, OSError)
    now[0] = 22.0
    assert snapshot.get().count() == 3 and snapshot.version == 2


def test_page_text(spark):
    html = "<html><title>T &amp; U</title><script>var x='</p>'</script><!-- c --><p>a<b>b</b>\n c</p></html>"
    row = page_text(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")).first()
    assert row.title == "T &amp; U" and row.body == "T &amp; U a b c"


def test_usage_stream(spark, tmp_path):
    logs = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type")
    logs.write.parquet(str(tmp_path / "in"))
    roll_up(spark, str(tmp_path / "in"), logs.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = logs.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").count()
    assert got.count() > 0
    assert got.join(want, ["hour", "event_type"]).where("n = count").count() == got.count()


def test_rewired_is_dealt_by_the_number_of_edges(spark, monkeypatch):
    monkeypatch.setattr(G, "EDGES_OF_TASK", 50, raising=False)
    monkeypatch.setattr(G, "is_small", lambda df: False, raising=False)
    rows = [(f"n{i % 40}" if i % 11 else None, f"n{i * i % 23}", "AB"[i % 2]) for i in range(400)]
    mapping = {f"n{i}": f"n{i % 7}" for i in range(5, 30)}
    found = G.rewired(spark.createDataFrame(rows, "src string, dst string, type string"), spark.createDataFrame(list(mapping.items()), "old string, new string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    new = {(mapping.get(a, a), mapping.get(b, b), t) for a, b, t in rows if a}
    assert sorted(map(tuple, found.collect())) == sorted(e for e in new if e[0] != e[1])
    assert ", 8), REPARTITION_BY_NUM" in plan  # 400 edges, 50 a task
