"""The classifier and its words against numpy; rates are fitted to the optimum."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexfold.llm import mixing
from tests.llm import data


def _rates(spark, p, targets):
    df = spark.createDataFrame([(i, 100, [float(x) for x in row]) for i, row in enumerate(p)], "i long, tokens long, p array<double>")
    steps = mixing.fit(df, F.col("tokens"), F.col("p"), targets)
    return np.array([r["r"] for r in df.select("i", mixing._rate(F.col("p"), steps).alias("r")).orderBy("i").collect()])


def test_targets_are_met_where_domains_overlap(spark):
    r = np.random.default_rng(3)
    toxic = r.uniform(0.015, 0.06, 400)
    poor = r.uniform(0.1, 0.4, 400)
    p = np.stack([1 - toxic - poor, poor, toxic], axis=1)
    p[:40] = [0.995, 0.004, 0.001]
    rate = _rates(spark, p, [0.9, 0.09, 0.01])
    mass = rate @ p
    assert (rate >= 0).all() and np.allclose(mass / mass.sum(), [0.9, 0.09, 0.01], rtol=1e-3)


def test_rates_are_optimal_where_targets_cannot_be_met(spark):
    r = random.Random(4)
    p = np.array([[1 - x - y, x, y] for x, y in ((r.uniform(0.2, 0.3), r.uniform(0.1, 0.2)) for _ in range(200))])
    rate = _rates(spark, p, [0.9, 0.09, 0.01])
    base = 100 * p.sum(0)
    off = 100 * rate @ p - max(base[0] / 0.9, 0) * np.array([0.9, 0.09, 0.01])
    gradient = p @ (off / base)
    assert (rate >= 0).all() and (gradient > -1e-4).all() and np.abs(gradient[rate > 1e-6]).max() < 1e-4


def _labelled(n=300, seed=8):
    r = random.Random(seed)
    common = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows, kinds = [], []
    for i in range(n):
        kind = "toxic" if i % 10 == 0 else "poor" if i % 4 == 0 else "good"
        words = [r.choice(common) + r.choice(["", "s", ",", "."]) for _ in range(30)]
        if kind == "toxic" and r.random() < 0.8:
            words[r.randrange(30)] = "vile" + r.choice(["", "!", "."])
        if kind == "poor" and r.random() < 0.7:
            words[r.randrange(30)] = "junkyard" + r.choice(["", "s"])
        rows.append((i, " ".join(words), "en", "s", 0))
        kinds.append((i, kind))
    return rows, kinds


def _features(w):
    bare = w.strip(mixing.AROUND)
    return bare, w.replace(bare, "") if bare else w


def test_posteriors_are_those_of_the_regression_and_held_out_documents_are_recognised(spark):
    rows, kinds = _labelled()
    docs = data.frame(spark, rows)
    domains = spark.createDataFrame([k for k in kinds if k[0] < 200], "doc_id long, domain string")
    names = ["good", "poor", "toxic"]
    model = mixing.train(docs, domains, names)
    got = mixing.scored(docs, ["doc_id"], model, "m").orderBy("doc_id").collect()
    known = sorted({x for _, text, *_ in rows for w in text.split() for x in _features(w)})
    word = {r["h"]: r["s"] for r in spark.createDataFrame([(w,) for w in known], "s string").select("s", F.xxhash64("s").alias("h")).collect()}
    assert {"vile", "junkyard"} <= {word[h] for h, _ in model.words}
    for r, (_, text, *_) in zip(got, rows):
        has = {x for w in text.split() for x in _features(w)}
        logits = np.array(model.prior) + sum((np.array(odds) for h, odds in model.words if word[h] in has), np.zeros(3))
        assert np.allclose(r["m"]["p"], np.exp(logits) / np.exp(logits).sum(), atol=1e-4) and r["m"]["tokens"] == 30
    held = [(names[int(np.argmax(r["m"]["p"]))], k) for r, (_, k) in zip(got[200:], kinds[200:])]
    assert sum(a == b for a, b in held) / len(held) > 0.8  # a good share of the marked ones; guessing good gives 0.68


def test_stages_take_dotted_and_clashing_columns(spark, tmp_path):
    rows, kinds = _labelled(60)
    docs = data.frame(spark, rows).withColumn("a.b", F.lit(1)).withColumn("mixing", F.lit("mine")).withColumn("tokens", F.lit(2))
    spark.createDataFrame([(i, int(k == "good"), int(k == "toxic")) for i, k in kinds], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = mixing.mix_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and 0 < out.count() <= 3 * len(rows)


def test_words_count_whole_and_each_has_a_cell_of_its_own(spark):
    r = random.Random(9)
    kinds = [(i, "toxic" if i % 2 else "good") for i in range(200)]
    # words that differ behind their first letters only
    rows = [(i, " ".join([r.choice(["plain", "other"]), "internationalisation" if k == "toxic" else "internationalism"]), "en", "s", 0) for i, k in kinds]
    docs = data.frame(spark, rows)
    model = mixing.train(docs, spark.createDataFrame(kinds, "doc_id long, domain string"), ["good", "poor", "toxic"])
    got = mixing.scored(docs, ["doc_id"], model, "m").collect()
    assert all((x["m"]["p"][2] > 0.9) == (x["doc_id"] % 2 == 1) for x in got)


def test_cells_hold_every_hash():
    r = random.Random(10)
    for n in (1, 2, 3, 50, 5000, 40000):
        hashes = [r.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
        if n > 2:
            hashes[1] = hashes[0] ^ (1 << 63)  # alike but for one bit
            hashes[2] = hashes[0] ^ 1
        hashes = list(set(hashes))
        shifts, cells = mixing.perfect_cells(hashes)
        for h in hashes:
            at = (h & ((1 << 64) - 1)) >> shifts[h & (len(shifts) - 1)] & (8 * len(shifts) - 1)
            assert cells[at] == h
        assert len(cells) == len(hashes) and len(shifts) <= 8 * n


def test_marks_around_words_count(spark):
    kinds = [(i, "poor" if i % 2 else "good") for i in range(200)]
    r = random.Random(11)
    rows = [(i, " ".join(["".join(r.choices("abcdefgh", k=9)) + ("%%%" if k == "poor" else "") for _ in range(3)]), "en", "s", 0) for i, k in kinds]
    docs = data.frame(spark, rows)
    model = mixing.train(docs, spark.createDataFrame(kinds, "doc_id long, domain string"), ["good", "poor", "toxic"])
    got = mixing.scored(docs, ["doc_id"], model, "m").collect()
    assert all((x["m"]["p"][1] > 0.9) == (x["doc_id"] % 2 == 1) for x in got)
