"""Quality estimates are concentrated to the end, and outliers are judged by a bound that moderate junk meets."""

import itertools
import random

import numpy as np

from lexfold.llm import quality_rules
from tests.llm import data


def test_moderate_junk_goes(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(150)]
    junk = [" ".join(word() + "%" * (k % 5 < 3) for k in range(60)) for _ in range(12)]
    rows, name = quality_rules.judged(data.frame(spark, data.rows(clean + junk)))
    assert {x["doc_id"] for x in rows.filter(f"{name}.kept").collect()} == set(range(150))


def test_small_groups_are_judged_by_their_language(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    text = lambda odd: " ".join(word() + "%&" * odd for _ in range(60))
    rows = [(i, text(0), "en", "large", 0) for i in range(80)] + [(100 + i, text(i == 9), "en", "ten rows", 0) for i in range(10)]
    rows += [(200 + i, text(i == 9), "fr", "another ten", 0) for i in range(10)] + [(300, text(0), None, None, 0)]
    out, name = quality_rules.judged(data.frame(spark, rows))
    kept = {x["doc_id"] for x in out.filter(f"{name}.kept").collect()}
    assert kept == {x[0] for x in rows} - {109, 209}  # French, too small itself, is judged by all documents
    few, name = quality_rules.judged(data.frame(spark, rows[80:86]))
    assert few.filter(f"{name}.kept").count() == 6  # too few for any estimate


def test_estimates_are_those_of_brute_force(spark, monkeypatch):
    """Of groups of twelve, all subsets of nine are tried."""
    monkeypatch.setattr(quality_rules, "MIN_GROUP", 5)
    r, groups = np.random.default_rng(11), {}
    for g in range(12):
        x = r.normal(1, 0.4, (12, 4)) @ r.normal(0, 1, (4, 4))
        x[:3] += r.normal(6, 2, 4)  # a quarter of outliers
        groups[f"g{g}"] = x
    rows = [("en", g, *map(float, x)) for g, xs in groups.items() for x in xs]
    stats = spark.createDataFrame(rows, "lang string, g string, x1 double, x2 double, x3 double, x4 double")
    got = {x["g"]: x for x in quality_rules.fit(stats).collect()}
    floors, least = np.diag(np.square(quality_rules.FLOORS)), 0
    for g, x in groups.items():
        det = lambda part: np.linalg.slogdet(quality_rules.CORRECTION * np.cov(part.T, bias=True) + floors)[1]
        best = min(itertools.combinations(range(12), 9), key=lambda part: det(x[list(part)]))
        ours = 2 * sum(np.log(got[g][f"l{i}{i}"]) for i in range(1, 5))
        assert ours > det(x[list(best)]) - 1e-6
        least += ours < det(x[list(best)]) + 1e-6
        if ours < det(x[list(best)]) + 1e-6:
            assert np.allclose([got[g][f"m{i}"] for i in range(1, 5)], x[list(best)].mean(0))
            low = np.array([[got[g][f"l{i}{j}"] if j <= i else 0 for j in range(1, 5)] for i in range(1, 5)])
            y = x[0] - x[list(best)].mean(0)
            row = spark.createDataFrame([(*map(float, x[0]), *(got[g][c] for c in ("m1", "m2", "m3", "m4", *quality_rules.FACTOR)))], ["x1", "x2", "x3", "x4", "m1", "m2", "m3", "m4", *quality_rules.FACTOR])
            d2 = row.select(quality_rules._distance(quality_rules._columns(), quality_rules._columns()).alias("d")).first()["d"]
            assert np.isclose(d2, y @ np.linalg.solve(low @ low.T, y))
    assert least >= 9, least
