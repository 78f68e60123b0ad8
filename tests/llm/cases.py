"""Small tables for the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Nulls, empties, ties, repeats and a long text."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = ["", None, "   ", "one", "One", "ONE two", "naïve café “q” — x", "日本語 のテキスト", "a  b\n\nc\t", "it's don't 'tis ''s", long, "x" * 5000, "ab" * 700]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "without id"), (3, "one"), (3, "one"), (50, None), (51, "")]
    return [(i, t, None if i is None else "en", "s", None) for i, t in rows]


def near_rows(n=40, seed=1):
    """Groups of edited copies among unlike texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for g in range(n):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(rows)]


def passage_rows(n=60, seed=2):
    rng = random.Random(seed)
    run = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    passage, rows = run(420), []
    for i in range(n):
        t = run(rng.randint(0, 400))
        if i % 3 == 0:
            t += passage + run(rng.randint(0, 90))
        if i % 11 == 0:
            t = t + t
        rows.append((i, t, "en", "s", len(t)))
    return rows
