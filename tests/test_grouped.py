"""Groups of near duplicates."""

import random
import time

import numpy as np

from lexfold.operators import dedup


def test_pairs_are_found_once(spark):
    text = " ".join(f"w{i}" for i in range(80))
    d = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, "something else entirely is said here")], "doc_id long, text string")
    groups = dedup.grouped(dedup.near_pairs(d))
    assert sorted((r["doc_id"], r["group_id"]) for r in groups.collect()) == [(1, 1), (2, 1), (3, 1)]
    assert "Generate" not in groups._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_are_those_of_brute_force(spark):
    r = random.Random(7)
    rows, texts = [], []
    for size in [5, 6, 7, 19, 20, 21, 22, 23, 38, 39, 40, 41, 42, 60, 61, 80, 130, 131, 137, 400]:
        texts.append([f"w{r.randrange(3000)}" for _ in range(size)])
    for base in list(texts):
        for _ in range(6):
            t = base[: len(base) - r.randint(0, len(base) // 40)] + [f"e{r.randrange(99)}"] * r.randint(0, 1 + len(base) // 60)
            for _ in range(r.randint(0, len(t) // 130)):
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 1)] = [f"n{r.randrange(99)}"] * r.randint(0, 2)
            texts.append(t if r.random() < 0.8 else list(base))
    rows = [(i, ("  " if i % 3 else "\t").join(t).upper() if i % 2 else " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "one two three four")]
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, x in rows if len(w := (x or "").lower().split()) >= 5}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    expected = {}
    for i, s in sets.items():
        for j, z in sets.items():
            a, b = first[frozenset(s)], first[frozenset(z)]
            if i < j and i == a and (b == j or a == b) and len(s & z) / len(s | z) >= 0.95:
                expected[i, j] = len(s & z) / len(s | z)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(x["a"], x["b"]): x["similarity"] for x in dedup.near_pairs(d).collect()}
    assert got == expected and sum(x < 1 for x in got.values()) > 20
    assert dedup.near_pairs(d.filter("doc_id >= 900")).count() == 0


def test_frequent_trigrams_bring_no_sets_together():
    r = np.random.default_rng(3)
    common = r.integers(0, 1 << 64, 300, np.uint64)  # in every set, of which half the elements are others
    edges, parts = dedup._bands(0.95)
    seen = [dedup._signatures(np.unique(np.concatenate([common, r.integers(0, 1 << 64, 300, np.uint64)])), 0.95, edges, parts) for _ in range(200)]
    assert len(np.unique(np.concatenate(seen))) > 0.99 * sum(map(len, seen))
    assert max(map(len, seen)) <= 0.15 * 600  # of a set, what is shuffled


def _shuffled(spark):
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_sets_without_a_partner_are_not_shuffled(spark):
    r = random.Random(5)
    d = spark.createDataFrame([(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(1000))) for i in range(300)], "doc_id long, text string")
    before = _shuffled(spark)
    assert dedup.near_pairs(d).count() == 0
    time.sleep(1)  # figures of stages arrive a little later
    assert _shuffled(spark) - before < 300 * 998 * 8 / 3
