"""The index of vectors against brute force."""

import math
import random

import numpy as np
import pytest

from lexfold.operators import vector_index as vi
from lexfold.session import importable

SF = "/root/testdata"


def table(spark, rows):
    return importable(spark).createDataFrame(rows, "id long, v array<float>").repartition(3)


def brute(rows, queries, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == len(rows[0][1])]
    m = np.array([v for _, v in good], np.float32).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    at = {i: x for (i, _), x in zip(good, m)}
    ids = np.array([i for i, _ in good])
    return {q: [int(i) for i in ids[np.lexsort((ids, -np.round(m @ at[q], 12)))][:k]] for q in queries if q in at}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query, []).append((-round(r.sim, 12), r.id))
    return {q: [i for _, i in sorted(x)] for q, x in out.items()}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    hubs = [[r.gauss(0, 1) for _ in range(12)] for _ in range(20)]
    made = [(i, [c + r.gauss(0, 0.4) for c in r.choice(hubs)]) for i in range(900)]
    copies = [(2000 + i, made[0][1]) for i in range(400)]  # a third are copies of one
    return made + copies + [(5000, [0.0] * 12), (5001, None), (5002, [1.0] * 5), (5003, [math.nan] * 12), (None, made[1][1])]


def test_exact_way_and_recall(spark, monkeypatch, rows):
    monkeypatch.setattr(vi, "BLOCK", 64)
    monkeypatch.setattr(vi, "QUERIES", 7)
    monkeypatch.setattr(vi, "HELD", 2)
    df = table(spark, rows)
    index = vi.VectorIndex.build(df, recall=0.95)
    assert len(index.centres) == 36 and 1 <= index.probes < 20  # clusters: few cells are enough
    assert index.blocks.selectExpr("max(size(ids)) AS m", "sum(size(ids)) AS n").first() == (64, 1300)
    asked = df.filter("id % 10 = 0")
    want = brute(rows, [i for i, _ in rows if i is not None and i % 10 == 0], 20)
    assert found(index.search(asked, 20, exact=True)) == want
    near = found(index.search(asked, 20))
    assert np.mean([len(set(near[q]) & set(x)) / len(x) for q, x in want.items()]) >= 0.9
    again = vi.VectorIndex(spark, index.path)
    assert again.probes == index.probes and found(again.search(asked.filter("id = 10"), 5, exact=True)) == brute(rows, [10], 5)


def test_recall_on_the_table(spark):
    v = importable(spark).read.parquet(f"{SF}/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v")
    index, asked = vi.VectorIndex.build(v), v.filter("id % 50 = 0")
    held = [(r.id, list(r.v)) for r in v.collect()]
    want = brute(held, [i for i, _ in held if i % 50 == 0], 50)
    near = found(index.search(asked, 50))
    assert near.keys() == want.keys() and np.mean([len(set(near[q]) & set(x)) / 50 for q, x in want.items()]) >= 0.9


def test_few_and_no_vectors(spark):
    empty = table(spark, [])
    assert vi.VectorIndex.build(empty).search(empty, 5).collect() == []
    one = table(spark, [(1, [1.0, 2.0])])
    index = vi.VectorIndex.build(one)
    assert found(index.search(one, 5)) == {1: [1]} and index.search(table(spark, [(2, [0.0, 0.0]), (3, [1.0]), (4, None)]), 5).collect() == []
