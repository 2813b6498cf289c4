"""Clusters and codes of vectors against plain loops and their SQL."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexfold.llm import kd_clusters as kd
from lexfold.llm import vector_codes as vc
from lexfold.llm.registry import ORACLE
from lexfold.session import importable

SCHEMA = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.001"


def some(n=300, d=64, seed=1, spread=0.3, scale=1.0):
    """Vectors around a few centres on a coarse grid, so that ties occur; a third are copies of one vector."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(7)]
    out = []
    for i in range(n):
        v = [round(8 * (c + r.gauss(0, spread))) / 8 * scale for c in r.choice(centres)]
        out.append((i, out[0][1] if i % 3 == 2 else v, r.choice([None, 1, 2])))
    return out


def odd():
    nan, inf = math.nan, math.inf
    return [(1000, None, 1), (1001, [nan] * 64, 1), (1002, [0.5] * 63 + [inf], None), (1003, [0.5] * 63 + [None], 2), (1004, [], 2), (1005, [0.25] * 63, 2), (5, [0.125] * 64, None), (5, [0.125] * 64, None), (None, [-0.3] * 64, None)]


def good(rows, sizes):
    return [(i, v, lb) for i, v, lb in rows if v is not None and sizes(len(v)) and all(x is not None and math.isfinite(x) for x in v)]


def ints(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def clusters(rows, k=40, rounds=5, d=64):
    """Plain loops over all vectors and centroids."""
    kept = [(i, ints(v, 256)) for i, v, _ in good(rows, lambda n: n == d)]
    first = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1]))[:k]
    c = [v for _, v in first]
    dist = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q))
    near = lambda p: min((dist(p, q), j) for j, q in enumerate(c))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j])] if j in of else q for j, q in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, e in found:
        inertia[j] = inertia.get(j, 0) + e
    return sorted(((i, j, e, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, e in found), key=str)


def codes(rows, d=64, parts=8, entries=16, rounds=6):
    kept = [(i, ints(v, 4096), lb) for i, v, lb in good(rows, lambda n: n == d)]
    cut = lambda v, p: v[p * (d // parts) : (p + 1) * (d // parts)]
    first = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, q)), j) for j, q in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v, _ in kept:
                of.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(x) // len(of[j]) for x in zip(*of[j])] if j in of else q for j, q in enumerate(books[p])]
    found = []
    for i, v, lb in kept:
        hit = [near(cut(v, p), books[p]) for p in range(parts)]
        found.append((i, "".join(f"{j:02x}" for _, j in hit), sum(e for e, _ in hit), lb))
    total = {}
    for _, _, e, lb in found:
        total[lb] = total.get(lb, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for q in b for x in q).encode()).hexdigest()
    return sorted(((i, c, e, total[lb], digest) for i, c, e, lb in found), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n, scale, leaf", [(300, 1.0, 16), (300, 1.0, 1), (120, 30000.0, 4), (7, 1.0, 16)])
def test_clusters_equal_plain_loops(spark, monkeypatch, n, scale, leaf):
    monkeypatch.setattr(kd, "BLOCK", 50)
    monkeypatch.setattr(kd.grown, "__defaults__", (leaf,))
    rows = some(n, scale=scale) + odd()
    df = importable(spark).createDataFrame(rows, SCHEMA).repartition(3)
    assert got(kd.kd_kmeans(df)) == clusters(rows)


def test_pruning_keeps_the_nearest_of_all():
    r = np.random.default_rng(4)
    c = r.integers(-40, 40, (25, 3))
    p = r.integers(-40, 40, (2000, 3))
    order, nodes = kd.grown(p, 2)
    b = kd.Block(p[order], nodes)
    whole, _, leaves, left = b.filtered(c)
    assert len(whole) > 10 and left.sum() < 0.5 * left.size  # it does prune
    plain = ((p[order][:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert (b.labels(c) == plain).all()
    total = {}
    for keys, n, s in b.sums_of(c):
        for k, m, t in zip(keys, n, s):
            x = total.setdefault(int(k), [0, 0])
            x[0], x[1] = x[0] + m, x[1] + t
    assert all(x[0] == (plain == k).sum() and (x[1] == p[order][plain == k].sum(0)).all() for k, x in total.items())


@pytest.mark.parametrize("n, scale", [(300, 1.0), (100, 2000.0), (5, 1.0)])
def test_codes_equal_plain_loops(spark, monkeypatch, n, scale):
    monkeypatch.setattr(vc, "BLOCK", 64)
    rows = some(n, scale=scale) + odd()
    df = importable(spark).createDataFrame(rows, SCHEMA).repartition(3)
    assert got(vc.vector_codes(df)) == codes(rows)


@pytest.mark.parametrize("length", [1, 3, 8, 12])
def test_bounds_drop_no_nearest_entry(length):
    r = np.random.default_rng(length)
    for top in (3, 4096, 1 << 27):
        x, e = r.integers(-top, top, (500, length)), r.integers(-top, top, (16, length))
        e[3] = e[9] = x[0]
        d = np.square(x[:, None] - e[None]).sum(2)
        j, least = vc.nearest(x, e)
        assert (j == d.argmin(1)).all() and (least == d.min(1)).all()


def test_other_lengths(spark):
    rows = [(i, [float(i % 5), 1.0, float(i)], 1) for i in range(40)]
    df = importable(spark).createDataFrame(rows, SCHEMA)
    assert vc.vector_codes(df).collect() == []  # three components are no eight parts
    assert got(vc.vector_codes(df, parts=3)) == codes(rows, d=3, parts=3)
    with pytest.raises(Exception, match="beyond"):
        vc.vector_codes(importable(spark).createDataFrame([(1, [1e30] * 8, 1)], SCHEMA)).collect()


def test_odd_tables(spark):
    df = importable(spark).createDataFrame(some(60) + odd(), SCHEMA)
    wide = df.withColumn("cluster", F.lit("x")).withColumn("points", F.lit(1)).withColumn("of", F.lit(2)).withColumn("a.b", F.lit(3))
    assert got(kd.kd_kmeans(wide)) == got(kd.kd_kmeans(df)) and got(vc.vector_codes(wide)) == got(vc.vector_codes(df))
    assert kd.kd_kmeans(df.limit(0)).collect() == [] and vc.vector_codes(df.limit(0)).collect() == []
    none = df.filter("embedding IS NULL")
    assert kd.kd_kmeans(none).collect() == [] and vc.vector_codes(none).collect() == []


@pytest.mark.parametrize("name, run", [("op12_kd_clusters", kd.op12_kd_clusters), ("op13_vector_codes", vc.op13_vector_codes)])
def test_queries_equal_their_sql(spark, name, run):
    path = f"{SF}/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = run(importable(spark), SF)
    assert got(df) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall(), key=str)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(path).collect()]
    assert got(df) == (clusters if "12" in name else codes)(rows)
