import random

import numpy as np
import pytest

from lodestone.llm import quality, topk, toxicity
from lodestone.llm.chars import SIGNS, letter_model
from lodestone.llm.common import fold_of
from tests.llm import cases

BAD = ["idiot", "moron", "scum", "loser"]


def corpus(n=500, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "on", "er", "ti", "an", "re"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randint(20, 80))], i % 6 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        good = i % 5 != 0
        text = (" " if good else "!! ").join(w if good else w.upper() for w in words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    extra = [(10_000 + i, r[1], *r[2:]) for i, r in enumerate(cases.odd_rows())] + [(None, None, None, None, None), (0, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows + extra, cases.SCHEMA).withColumnRenamed("lang", "score")
    return docs, spark.createDataFrame(labels + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), labels


def held_out(rows, labels, column, folds, remainder):
    by_id = {r[0]: r[column] for r in labels}
    out = []
    for r in rows:
        assert r.held_out == (fold_of(r.doc_id, folds) == remainder)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in by_id:
            out.append((by_id[r.doc_id], r.predicted))
    return sum(a == b for a, b in out) / len(out)


def test_toxicity(spark, tables):
    docs, labels, known = tables
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == docs.count()
    assert held_out(got, known, 2, 4, 2) > 0.95
    assert toxicity.scored(docs.limit(0), labels).collect() == []
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_quality(spark, tables):
    docs, labels, known = tables
    got = quality.scored(docs, labels).collect()
    assert len(got) == docs.count()
    assert held_out(got, known, 1, 5, 0) > 0.95
    assert quality.scored(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_disguised_words_are_restored(spark):
    docs = spark.createDataFrame([(i, "the idiot and the loser in that moron scum of a night " * 3) for i in range(20)], "doc_id long, text string")
    model = letter_model(docs)
    assert model.shape == (SIGNS**3, SIGNS) and np.allclose(np.exp(model).sum(axis=1), 1, atol=1e-3)
    for token, word in {"1d10t": "idiot", "l.o.s.e.r": "loser", "m o r o n": "moron", "$cum": "scum", "idiiiiiot": "idiot"}.items():
        assert toxicity.SUSPECT.fullmatch(token) and toxicity.restore(token, model) == word
    assert toxicity.restore("", model) == "" and toxicity.SUSPECT.search("plain words, as ever. 1234") is None


def test_attention_gradient():
    rng = np.random.default_rng(1)
    p = quality._initial(rng) | {"mean": np.zeros(quality.WIDTH), "scale": np.ones(quality.WIDTH)}
    x, bags, y = rng.normal(size=(7, quality.WIDTH)), np.array([0, 3, 4, 7]), np.array([1.0, 0, 1])

    def loss(p):
        s, _ = quality.forward(p, x, bags)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)) + 0.5e-4 * ((p["W"] ** 2).sum() + (p["o"] ** 2).sum())

    grad = quality._gradient(p, x, bags, y)
    for name, at in (("W", (3, 2)), ("V", (1, 4)), ("U", (5, 0)), ("w", (3,)), ("o", (7,)), ("b", (0,)), ("c", (9,))):
        moved = [p | {name: p[name].copy()} for _ in range(2)]
        moved[0][name][at] += 1e-5
        moved[1][name][at] -= 1e-5
        assert abs((loss(moved[0]) - loss(moved[1])) / 2e-5 - grad[name][at]) < 1e-6


def brute_top(rows, k=10):
    sound = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in sound:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 4) / 2]) for i in range(700)]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0]), (1100, [float("nan"), 0.0, 0.0, 0.0]), (None, [0.0] * 4), (1200, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", df_none())
    assert set(map(tuple, topk.top_k(df).collect())) == brute_top(rows)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert set(map(tuple, topk.top_k(few).collect())) == brute_top(rows[:4])
    assert topk.top_k(few.limit(0)).collect() == []


def df_none():
    from pyspark.sql import functions as F

    return F.lit(None).cast("int")


def test_search_prunes_and_is_exact():
    rng = np.random.default_rng(4)
    points = np.concatenate([c + rng.integers(-2, 3, (150, 6)) for c in rng.integers(-90, 90, (8, 6))])
    ids = rng.permutation(len(points)) * 7
    got = topk.search(points[:30], ids[:30], points, ids, 5)
    for q in range(30):
        scores = points @ points[q]
        want = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:5]
        assert [(q, int(ids[i]), int(scores[i])) for i in want] == [g for g in got if g[0] == q]


def test_cover_tree_nests_covers_and_separates():
    rng = np.random.default_rng(9)
    points = np.concatenate([c + rng.integers(-3, 4, (200, 5)) for c in rng.integers(-500, 500, (9, 5))]).astype(float)
    inner, todo = 0, [topk.cover_tree(points)]
    assert sorted(topk.cover_tree(points).rows.tolist()) == list(range(len(points)))
    while todo:
        node = todo.pop()
        assert np.sqrt(((points[node.rows] - node.center) ** 2).sum(axis=1)).max() <= node.radius
        if node.children:
            inner += 1
            heads = np.array([c.center for c in node.children])
            assert (heads[0] == node.center).all() and sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
            gaps = np.sqrt(((heads[:, None] - heads) ** 2).sum(axis=2))[~np.eye(len(heads), dtype=bool)]
            assert gaps.min() > node.radius / 2 and max(c.radius for c in node.children) <= node.radius / 2
            todo += node.children
    assert inner > 3


def test_top_k_over_many_blocks(spark, monkeypatch):
    """Clusters, a hot vector, repeated rows and ids, several widths: blocks of many pivots, some of which queries never meet."""
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(10)
    rows = [(i, (rng.normal(size=6) * 0.05 + rng.choice([-1.0, 1.0], 6)).tolist()) for i in range(1, 900)]
    rows += [(1000 + i, [0.5] * 6) for i in range(400)] + [(100, rows[3][1]), (200, rows[199][1]), (200, rows[199][1]), (7, rows[6][1])] + [(5000 + 50 * i, [0.25 * i, 1.0]) for i in range(9)] + [(9000, []), (9001, [])]
    got = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(got).collect())
    v = [(i, tuple(int(np.floor(1024 * x)) for x in e)) for i, e in rows]
    want = []
    for q, own in {x for x in v if x[0] % 100 == 0}:
        found = sorted((-sum(a * b for a, b in zip(own, c)), i) for i, c in v if i != q and len(c) == len(own))[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert got == sorted(want)


DISGUISES = {
    "idio7": "idiot", "a$$": "ass", "worthle55": "worthless", "worthle$$": "worthless", "stuupid": "stupid", "iiddiioott": "idiot", "d é b i l e": "débile",
    "s,t,u,p,i,d": "stupid", "s/t/u/p/i/d": "stupid", "s\nt\nu\np\ni\nd": "stupid", "s   t   u   p   i   d": "stupid", "a s t u p i d": "a stupid", "s t u p i d i d i o t": "stupid idiot",
}


@pytest.mark.parametrize("token", DISGUISES)
def test_disguises_that_reach_the_lattice(spark, token):
    texts = ["the idiot is a stupid and worthless person", "what a worthless ass", "un débile est la", "a stupid letter of a stupid idiot"] * 50
    model = letter_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    found = toxicity.Restorer(model).words(f"so {token}\tso" if " " in token else f"so {token} so")
    assert f" {DISGUISES[token]} " in f" {' '.join(found)} "


def cheapest(token, model):
    """The least cost of all ways through a token's lattice, and their words, one by one."""
    T, found = toxicity, []

    def told(context, letter):
        if letter == " ":
            return -float(model[context, 0]), 0
        if "a" <= letter <= "z":
            return -float(model[context, ord(letter) - 96]), (context * SIGNS + ord(letter) - 96) % SIGNS**3
        return 0.0, context * SIGNS**2 % SIGNS**3

    def walk(at, context, last, cost, word):
        if at == len(token):
            return found.append((cost - float(model[context, 0]), word.strip()))
        c = token[at]
        letters = c if c.isalpha() and c not in T.LEET else T.LEET.get(c, "")
        for x in letters:
            more, to = told(context, x)
            if last == c:
                walk(at + 1, context, c, cost + T.DROPPED_REPEAT, word)
                walk(at + 1, to, c, cost + T.KEPT_DOUBLE + more, word + x)
            else:
                walk(at + 1, to, c, cost + more + T.SUBSTITUTED * (x != c), word + x)
        if c in T.GAPS:
            walk(at + 1, context, last, cost, word)
            if context:
                walk(at + 1, 0, "", cost + T.SPLIT + told(context, " ")[0], word + " ")
        elif not letters or c in T._SIGN:
            walk(at + 1, context, last, cost + T.DROPPED_SIGN * (1 + 4 * (c in T.LEET)), word)

    walk(0, 0, "", 0.0, "")
    least = min(found)[0]
    return {w for cost, w in found if cost < least + 1e-4}


def test_viterbi_against_all_ways_through_the_lattice():
    rng, numbers = random.Random(8), np.random.default_rng(8)
    model = np.log(numbers.dirichlet(np.ones(SIGNS) * 0.4, SIGNS**3) + 1e-4).astype(np.float32)
    for _ in range(300):
        token = "".join(rng.choice("abst015$!.- é") for _ in range(rng.randint(1, 8)))
        assert toxicity.restore(token, model) in cheapest(token, model), token
    for _ in range(300):
        token = "".join(rng.choice("abté") * rng.choice([1, 1, 2, 3, 9]) for _ in range(rng.randint(1, 4)))
        assert toxicity.collapsed(token, model) in cheapest(token, model), token


def test_restored_words_take_the_place_of_disguised_ones(spark):
    docs = spark.createDataFrame([(i, "the idiot and the loser in that moron scum of a night " * 3) for i in range(20)], "doc_id long, text string")
    restorer = toxicity.Restorer(letter_model(docs))
    for _ in range(2):
        assert restorer.restored("that 1d10t in\tn i g h t of the\n l.o.s.e.r").split() == "that idiot in night of the loser".split()
    assert restorer.restored("plain words, as ever. 1234") == "plain words, as ever. 1234" and restorer.restored("") == ""
    long = "a1" * 50_000
    assert len(restorer.restored(long)) <= len(long)


def test_plain_words_are_not_told_again():
    model = np.log(np.full((SIGNS**3, SIGNS), 1 / SIGNS, np.float32))
    assert toxicity.Restorer(model).words("stupid! plain 1234 words") == []
