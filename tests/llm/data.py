"""Small tables with the odd cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, lang="en", source="s"):
    return [(i, t, lang, source, len(t) if t is not None else None) for i, t in enumerate(texts)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def odd(spark):
    """Nulls in any column, empty and blank texts, ties, repeated rows, a very long text."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return frame(
        spark,
        [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \t\n", None, None, 3), (4, "one two three four five six", "en", "s", 27), (4, "one two three four five six", "en", "s", 27), (5, "one two three  four five six", "en", None, 28), (None, "no id here at all my friend", "en", "s", 27), (None, None, None, None, None), (6, long, "de", "s", len(long)), (7, "x", None, "s", 1)],
    )


def near_copies(seed=3, groups=12, copies=9, n=90):
    """Documents of random words, and copies with a few words changed."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    boiler = [r.choice(vocabulary) for _ in range(40)]
    texts = []
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, n))] + (boiler if g % 2 else [])
        texts.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
    r.shuffle(texts)
    return texts
