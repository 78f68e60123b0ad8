import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import packing, rans, shards, tokens, wordbpe
from lodestone.llm.common import new_path
from tests.llm import cases

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def frame(spark, rows):
    return spark.createDataFrame(rows, cases.SCHEMA).withColumnRenamed("lang", "part")


def byte_ids(rows):
    return [e.ids + [2] for e in library(BYTE).encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 5, 3000, 700_000])
def test_files_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype(np.uint16)
    file = rans.File(rans.encode_file(ids))
    assert np.array_equal(file.decode(), ids)
    parts = file.segments()
    assert np.array_equal(np.concatenate([file.decode([p]) for p in parts]) if parts else np.zeros(0), ids)  # any part on its own


def test_damage_is_found():
    data = bytearray(rans.encode_file(np.arange(5000, dtype=np.uint16) % 700))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        rans.File(bytes(data)).decode()


def test_token_files(spark):
    rows = [r for r in cases.odd_rows() if r[0] != 3]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    ids = byte_ids(rows)
    at, want = 0, []
    for i in order:
        want.append((rows[i][0], at, len(ids[i]), zlib.crc32(u32(ids[i]))))
        at += len(ids[i])
    got = tokens.round_trip(frame(spark, rows), BYTE).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def twins(n=2048):
    """Two words without a letter in common at any place that every polynomial hash modulo a power of two takes for one."""
    return ["".join(pair[bin(i).count("1") % 2] for i in range(n)) for pair in ("ab", "ba")]


def test_token_files_of_repeated_ids_and_twin_words(spark):
    rows = cases.odd_rows() + [(7000 + i, t, "", "", 0) for i, t in enumerate(twins())] + [(None, f"no id {i}", "", "", 0) for i in range(30)]
    ids = byte_ids(rows)
    got = sorted(tokens.round_trip(frame(spark, rows), BYTE).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r[0], len(x), zlib.crc32(u32(x))) for r, x in zip(rows, ids))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)


def test_token_files_of_no_rows(spark):
    assert tokens.round_trip(frame(spark, []), BYTE).collect() == []


def test_word_bpe(spark):
    rows = cases.odd_rows() + [(100 + i, t, "", "", 0) for i, t in enumerate(["Hello World's", "ÉCOLE İx Σας", "antidisestablishmentarianism" * 5, "<|endoftext|>", *twins(), "y" * 70_000])]
    t = library(WORD)
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, wordbpe.coded(frame(spark, rows), WORD).collect()), key=str) == sorted(want, key=str)
    assert wordbpe.coded(frame(spark, []), WORD).collect() == []


def test_backtracking_equals_merging():
    import random

    rng, t, own = random.Random(2), library(WORD), wordbpe.word_bpe(WORD)
    for _ in range(3000):
        text = "".join(rng.choice("etaoinshrdé'1 ") for _ in range(rng.randint(1, 40)))
        assert own.one(text) == t.encode(text, add_special_tokens=False).ids


def test_pieces_of_every_length_are_compared_whole():
    import pyarrow as pa

    from lodestone.llm.bytebpe import ByteBpe

    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abé7-")) for _ in range(rng.choice([1, 7, 8, 9, 15, 16, 17, 18, 40]))) for _ in range(60)) for _ in range(60)] + twins()
    for bpe, t, tail in ((ByteBpe(BYTE), library(BYTE), [2]), (wordbpe.WordBpe(WORD), library(WORD), [])):
        for _ in range(2):  # the second time out of the table
            got = [ids[a:b].tolist() for _, at, ids in bpe.encode(pa.array(texts)) for a, b in zip(at[:-1], at[1:])]
            assert got == [x.ids + tail for x in t.encode_batch(texts, add_special_tokens=False)]


def test_texts_beyond_the_limit_of_whole_arrays(monkeypatch):
    import pyarrow as pa

    from lodestone.llm import bytebpe

    text = "some plain words, 12 of them; " * 300
    want = {t: library(t).encode(text, add_special_tokens=False).ids for t in (BYTE, WORD)}
    for limit in (1 << 20, 100):
        monkeypatch.setattr(bytebpe, "LONG", limit)
        monkeypatch.setattr(wordbpe, "LONG", limit)
        for bpe, path, tail in ((bytebpe.ByteBpe(BYTE), BYTE, [2]), (wordbpe.WordBpe(WORD), WORD, [])):
            assert next(iter(bpe.encode(pa.array([text]))))[2].tolist() == want[path] + tail


def test_sequences_hold_the_ids_of_their_documents(spark):
    rows = cases.near_rows() + [r for r in cases.odd_rows() if r[0] != 3 and r[0] is not None and r[0] > 39]
    rows = list({r[0]: r for r in rows}.values())
    ids = dict(zip([r[0] for r in rows], byte_ids(rows)))
    got = packing.token_sequences(frame(spark, rows), BYTE).collect()
    for r in got:
        own = []
        for d in r.documents:
            first = len(ids[d.doc_id]) % 1024 or 1024
            own += ids[d.doc_id][:first] if d.piece == 0 else ids[d.doc_id][first + 1024 * (d.piece - 1) : first + 1024 * d.piece]
        assert r.ids == own and len(own) <= 1024
    assert sum(len(r.ids) for r in got) == sum(map(len, ids.values()))


def test_bins_that_never_fit_together_end_the_tree(spark):
    pieces = [(i, 0, 0, 600, 0) for i in range(500)]
    got = packing.pack(spark.createDataFrame(pieces, packing.PIECE_SCHEMA), rows_per_part=20).collect()
    assert len(got) == 500 == len({r.sequence_id for r in got}) and {r.offset for r in got} == {0}


def test_packing(spark):
    rows = cases.odd_rows() + cases.near_rows() + [(7000 + i, t, "", "", 0) for i, t in enumerate(twins())]
    got = packing.packed(frame(spark, rows), BYTE).collect()
    ids = byte_ids(rows)
    want = Counter()
    for r, own in zip(rows, ids):
        end, at, piece = len(own) % 1024 or 1024, 0, 0
        while at < len(own):
            want[(r[0], piece, at, end - at, zlib.crc32(u32(own[at:end])))] += 1
            at, end, piece = end, end + 1024, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by_sequence) <= -(-sum(map(len, ids)) // 1024) + 2
    assert packing.packed(frame(spark, []), BYTE).collect() == []


def test_packing_merges_up_the_tree(spark):
    rng = np.random.default_rng(3)
    pieces = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 1024, 3000))]
    df = spark.createDataFrame(pieces, packing.PIECE_SCHEMA)
    got = packing.pack(df, rows_per_part=40).groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in got) == sum(p[3] for p in pieces) and max(r[1] for r in got) <= 1024
    assert len(got) <= 1.08 * len(packing.best_fit(np.array([p[3] for p in pieces]), 1024))  # 75 parts of 40 pieces each


def check_shards(rows, got, n):
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min([sizes[s] for s in range(n)]) <= 1
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding(spark):
    rows = cases.odd_rows() + [(5000, "same", "", "", 0)] * 40 + cases.near_rows()
    got = shards.sharded(frame(spark, rows)).collect()
    check_shards(rows, got, 24)
    raws = [(r[0], (r[1] or "").encode()) for r in rows]  # ids repeat among these rows
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(b) + 8, zlib.crc32(b)) for i, b in raws)
    assert {r.law for r in got} == {"rows"}
    assert shards.sharded(frame(spark, [])).collect() == []


def test_shards_are_written_whole(spark, tmp_path):
    rows = cases.near_rows()
    shards.write_shards(spark.createDataFrame(rows, cases.SCHEMA), str(tmp_path / "out"), shards=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select("doc_id", "text", "lang", "source", "n_chars").collect())) == Counter(rows)
    assert back.select("shard").distinct().count() == 5


def test_shards_are_the_rows_of_the_query(spark, tmp_path):
    rows = cases.odd_rows() + [(5000, "same", "", "", 0)] * 40 + cases.near_rows() + [(6000 + i, "very long " * 50_000, "", "", i) for i in range(3)]
    shards.write_shards(frame(spark, rows), str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert Counter(tuple(r)[:5] for r in back.select("doc_id", "text", "part", "source", "n_chars").collect()) == Counter(rows)
    place = lambda i, t, shard, slot: (i, zlib.crc32((t or "").encode()), shard, slot)
    files = Counter(place(r.doc_id, r.text, r.shard, r.slot) for r in back.collect())
    other = spark.createDataFrame(rows[::-1], cases.SCHEMA).withColumnRenamed("lang", "part").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in shards.sharded(other).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == files  # the order and the parts in which rows come play no part


@pytest.mark.parametrize("most", [0, 200_000])
def test_shards_of_many_buckets(spark, monkeypatch, most):
    monkeypatch.setattr(shards, "MOST_REPEATED", most, raising=False)
    rows = [(i % 5000, f"text {i % 5000}", "", "", 0) for i in range(9000)]
    first = sorted(map(tuple, shards.sharded(frame(spark, rows)).drop("grown_shard").collect()))
    check_shards(rows, shards.sharded(frame(spark, rows)).collect(), 24)
    assert first == sorted(map(tuple, shards.sharded(frame(spark, rows[::-1]).repartition(5)).drop("grown_shard").collect()))
    path = new_path(spark, "out")
    shards.write_shards(frame(spark, rows), path)
    back = spark.read.parquet(path).select("doc_id", F.octet_length("text") + 8, F.crc32(F.col("text").cast("binary")), F.lit("rows"), "shard", "slot")
    assert first == sorted(map(tuple, back.collect()))
