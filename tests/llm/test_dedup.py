import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import bwt, exact, graphs, neardup, repeats
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, cases.SCHEMA).withColumnRenamed("lang", "digest")  # an extra column with an inner name


def brute_exact(rows):
    digest = [hashlib.sha256((r[1] or "").translate(LOWER).encode()).hexdigest() for r in rows]
    best, size = {}, Counter(digest)
    for d, r in zip(digest, rows):
        best[d] = r[0] if best.get(d) is None else best[d] if r[0] is None else max(best[d], r[0])
    return sorted([(r[0], best[d], size[d], r[0] == best[d], d) for d, r in zip(digest, rows)], key=str)


def test_exact_on_odd_and_hot_rows(spark):
    rows = cases.odd_rows() + [(1000 + i, "Hot TEXT" if i % 2 else "hot text", "en", "s", 1) for i in range(200)]
    assert sorted(map(tuple, exact.exact_groups(frame(spark, rows)).collect()), key=str) == brute_exact(rows)


def test_exact_on_no_rows(spark):
    assert exact.exact_groups(frame(spark, [])).collect() == []


def test_exact_keeps_one_row_of_each(spark):
    rows = cases.odd_rows()
    kept = exact.keep_one_of_each(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    texts = [(r.text or "").translate(LOWER) for r in kept]
    assert len(texts) == len(set(texts)) == len({(r[1] or "").translate(LOWER) for r in rows})


def brute_near(rows, k, threshold=80):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER))
        sets.append(set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else {tuple(w)} if w else set())
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                head[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        own = r[0] if not sets[i] else min((x for x in groups[find(i)] if x is not None), default=None)
        out.append((r[0], len(sets[i]), own, r[0] == own))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups(spark, k):
    rows = cases.near_rows() + [(900 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in cases.odd_rows()]
    got = sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_groups(frame(spark, rows), k).collect()], key=str)
    assert got == brute_near(rows, k)


def test_near_groups_searches_mixed_buckets(spark):
    """Chains of copies, each like the next only: links that no pivot shows."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        base[i] = f"v{i}"
        rows.append((i, " ".join(base), "en", "s", 1))
    got = sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_groups(frame(spark, rows), 2).collect()], key=str)
    assert got == brute_near(rows, 2)


def test_twin_words_are_not_taken_for_one(spark):
    from tests.llm.test_tokens import twins

    a, b = twins()
    rows = [(1, f"{a} {a} {b}", "", "", 0), (2, f"{b} {b} {a}", "", "", 0), (3, f"{a} {b}", "", "", 0), (4, f"{b} {a}", "", "", 0)]
    got = sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_groups(frame(spark, rows), 2).collect()], key=str)
    assert got == brute_near(rows, 2)
    repeated = [(i, w + "x" * i, "", "", 0) for i, w in enumerate((a, b))]
    assert sorted(map(tuple, repeats.report(frame(spark, repeated)).collect()), key=str) == brute_repeats(repeated)


def test_near_groups_on_no_rows(spark):
    assert neardup.near_groups(frame(spark, [])).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (7, 7), (103, 101)]
    got = dict(map(tuple, graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 103: 100}


def test_forest(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, v) for v in range(101, 140)] + [(120, 200)]
    got = dict(map(tuple, graphs.forest(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in [*range(100, 140), 200]}}
    assert graphs.forest(spark.createDataFrame([], "u long, v long")).collect() == []


def test_suffix_order_and_common_prefixes():
    import random

    rng = random.Random(4)
    for _ in range(60):
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 7))]
        size = np.array([len(s) for s in strings])
        got, lcp = bwt.build(lambda who, j: np.array([strings[w][len(strings[w]) - 1 - j] for w in who], np.uint8), size, 255, np.uint8, 254)  # noqa: B023
        suffixes = sorted((tuple(s[i:]) + (d - 1000,), d, i) for d, s in enumerate(strings) for i in range(len(s) + 1))
        assert got.tolist() == [strings[d][i - 1] if i else 255 for _, d, i in suffixes]
        for r in range(1, len(suffixes)):
            a, b = suffixes[r - 1][0], suffixes[r][0]
            n = next(i for i in range(len(a)) if a[i] != b[i])
            assert lcp[r] == n


def brute_repeats(rows, n=200):
    raws = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + n] for b in raws for i in range(len(b) - n + 1))
    out = []
    for r, b in zip(rows, raws):
        covered = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                covered[i : i + n] = True
        spans = int((np.diff(covered.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((r[0], len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeated_substrings(spark):
    rows = cases.passage_rows() + [r for r in cases.odd_rows() if len(r[1] or "") < 100_000]
    assert sorted(map(tuple, repeats.report(frame(spark, rows)).collect()), key=str) == brute_repeats(rows)


def test_repeated_substrings_with_many_kinds(spark):
    rows = cases.passage_rows(90, seed=8)
    docs = repeats.keyed(frame(spark, rows), "doc_id", "text")
    spans = repeats.repeated_spans(docs, many=3)
    joined = docs.join(spans, repeats._same_doc(docs, spans), "left").select(docs["doc_id"], "text", "spans")
    got = sorted(map(tuple, repeats.mapped(joined, repeats._reporter(200), repeats.REPORT_SCHEMA).collect()), key=str)
    assert got == brute_repeats(rows)


def test_texts_of_few_letters(spark):
    """Strings that come again at the next byte or a few further, whole and within other text."""
    rows = [(0, "x" * 4000, "", "", 0), (1, "ab" * 1500, "", "", 0), (2, "q" + "abc" * 70 + "z", "", "", 0), (3, "hello" + "x" * 500 + "bye" + "x" * 210, "", "", 0), (4, "".join("abc"[i * i % 3] for i in range(3000)), "", "", 0), (5, "abc" * 66, "", "", 0)]
    assert sorted(map(tuple, repeats.report(frame(spark, rows)).collect()), key=str) == brute_repeats(rows)


def test_repeats_in_long_texts(spark):
    rng = np.random.default_rng(12)
    run = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = run(900)
    long = run(1_048_400) + passage + run(1_400_000) + passage + run(50)  # the passage lies across the edge of a part
    rows = [(0, long, "", "", 0), (1, "x" * 1_000_000, "", "", 0), (2, run(300), "", "", 0)]
    got = {r.doc_id: r for r in repeats.report(frame(spark, rows)).collect()}
    assert (got[0].n_bytes, got[0].n_removed, got[0].n_spans) == (len(long), 1800, 2)
    assert got[0].kept_sha256 == hashlib.sha256(long.replace(passage, "").encode()).hexdigest()
    assert (got[1].n_removed, got[1].n_spans) == (1_000_000, 1) and got[2].n_removed == 0


def test_removal_with_clashing_columns(spark):
    rows = [(r[0], r[1], 7, "x", "t", 1) for r in cases.passage_rows()]
    names = "doc_id long, text string, n_chars int, spans string, th string, piece int"
    got = repeats.without_repeats(spark.createDataFrame(rows, names))
    assert dict(got.dtypes)["n_chars"] == "int" and got.columns == ["doc_id", "text", "n_chars", "spans", "th", "piece"]
    assert all(r.n_chars == len(r.text) and (r.spans, r.th, r.piece) == ("x", "t", 1) for r in got.collect())


def test_removal_keeps_letters_whole(spark):
    rows = cases.passage_rows()
    got = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    want = {r[0]: r for r in brute_repeats(rows)}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.n_chars == len(r.text)
        assert 0 <= want[i][1] - want[i][2] - len(r.text.encode()) <= 2 * want[i][3]


def test_repeats_on_no_rows(spark):
    assert repeats.report(frame(spark, [])).collect() == []
