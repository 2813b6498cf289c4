"""Stemmed search over an index against plain loops over all texts."""

import math
import re

import pytest

from lexfold.functions.english import STOP, stem, terms
from lexfold.operators import text_index as ti
from lexfold.session import importable

SF = "/root/testdata/sf0.001"
QUERIES = ["other things", "thing", '"of the thing"', "things OR nights OR passwords", "NOT thing", "night NOT thing", "thin*", "oth* AND ni*", "the", "", '"the of"', "le OR la", "und der", "password", "a OR thing", '"things others"', "passwords AND secret", "zzz", "NOT zzz", "others OR NOT things", "well-known", "s* NOT t*"]


@pytest.fixture(scope="module")
def texts(spark):
    extra = {-1: None, -2: "", -3: "The well-known thing. Nights of the things, and others!", -4: "thing of things of thing", -5: "things others thing " * 50, -6: "password secret secret password"}
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} | extra


@pytest.fixture(scope="module")
def index(spark, texts):
    docs = importable(spark).createDataFrame([*texts.items(), (None, "thing")], "doc_id long, text string").repartition(5)
    return ti.TextIndex.build(docs, block=16, shards=8)


def plain(text, query):
    """Rank of a text, None where it does not match: by definition, from all its words."""
    at = {}
    for t, p in terms(text):
        at.setdefault(t, []).append(p)
    ops = ti.asked(query)

    def hits(o):
        if o.prefix:
            return any(t.startswith(o.terms[0][0]) for t in at)
        return any(all(p + far in at.get(t, ()) for t, far in o.terms) for p in at.get(o.terms[0][0], ()))

    if not any(all(hits(o) != o.negated for o in b) for b in ops):
        return None
    keys = []
    for b in ops:
        for o in b:
            keys += [(t, o.prefix) for t, _ in o.terms if (t, o.prefix) not in keys]
    found = {k: [sorted(v) for t, v in at.items() if (t.startswith(k[0]) if k[1] else t == k[0])] for k in keys}
    if len(ops) == 1 and len(keys) > 1 and (len(ops[0]) > 1 or not ops[0][0].negated):
        r, some = 1.0, False
        for i, a in enumerate(keys):
            for b in keys[:i]:
                for p in {x for v in found[a] for x in v}:
                    for q in {x for v in found[b] for x in v}:
                        if p != q:
                            d, some = abs(p - q), True
                            r *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
        return 1 - r if some else 1e-20
    return 0.1 * sum(1 / j**2 for v in found.values() for x in v for j in range(1, len(x) + 1)) / 1.64493406685 / len(keys)


def expected(texts, query):
    if not ti.asked(query):
        return {}
    return {d: r for d, t in texts.items() if (r := plain(t, query)) is not None}


@pytest.mark.parametrize("query", QUERIES)
def test_matches_and_ranks(index, texts, query):
    want = expected(texts, query)
    got = {r.doc_id: r["rank"] for r in index.match(query).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-9, abs_tol=1e-15) for d in want)


@pytest.mark.parametrize("seed, k, offset", [(1, 5, 0), (2, 3, 4), (32, 50, 0)])
def test_best_are_those_of_a_scan(monkeypatch, index, texts, seed, k, offset):
    monkeypatch.setattr(ti, "SEED", seed)
    for query in ("other things", "things OR nights OR passwords", "thin*", "NOT thing", "zzz"):
        want = expected(texts, query)
        best = sorted(want, key=lambda d: (-round(want[d], 9), d))[offset : offset + k]
        got = index.top(query, k, offset).collect()
        assert [round(r["rank"], 9) for r in got] == [round(want[d], 9) for d in best]
        assert len({r.doc_id for r in got}) == len(best) and all(math.isclose(want[r.doc_id], r["rank"], rel_tol=1e-9, abs_tol=1e-15) for r in got)


def test_only_rows_of_the_terms_are_read(index):
    rows = index.postings(ti.asked("thing AND night"))
    assert {r.term for r in rows.select("term").collect()} == {"thing", "night"}
    assert len({re.search("shard=[0-9]+", f)[0] for f in rows.inputFiles()}) <= 8
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*shard", plan) and re.search(r"PushedFilters: \[[^]]*In\(term", plan)
    assert index.rows.selectExpr("max(size(docs)) AS m").first().m <= 16 * 4


def test_stop_words_keep_their_place():
    assert terms("The cat of the dogs") == [("cat", 2), ("dog", 5)] and ti.compiled('"cat of the dogs"') == "(cat <3> dog)"
    assert len(STOP) == 127 and all(stem(w) == s for w, s in {"relational": "relat", "hopping": "hop", "hoping": "hope", "generously": "generous", "skies": "sky"}.items())


def test_headlines(index, spark, texts):
    keys = [("night", False), ("thing", False)]
    text = " ".join(f"w{i}" for i in range(100)) + " the Nights. " + " ".join(f"x{i}" for i in range(100)) + " things, other thing " + " ".join(f"y{i}" for i in range(60))
    one, two = (ti._headline(text, keys, n, 20, 50) for n in (1, 2))
    assert one.startswith("<mark>things</mark>, other <mark>thing</mark> y0") and len(one.split()) == 20
    first, second = two.split(" ... ")
    assert "<mark>Nights</mark>" in first and second == one and 20 <= len(first.split()) <= 50
    assert ti._headline("none here", keys, 1, 20, 50) == "none here" and ti._headline("", keys, 1, 20, 50) == ""
    assert ti._headline("Thing", keys, 3, 20, 50) == "<mark>Thing</mark>"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.headline for r in index.headlines(index.top("thing", 5), docs, "thing").collect()}
    assert len(got) == 5 and all(re.search("<mark>[Tt]hings?</mark>", h) and len(h.split()) <= 51 for h in got.values())


def test_empty_table(spark):
    index = ti.TextIndex.build(importable(spark).createDataFrame([], "doc_id long, text string"))
    assert index.top("thing").collect() == [] and index.match("NOT thing").collect() == []


def test_blocks_are_inverted_whole_and_in_bounded_batches(monkeypatch):
    import random

    import pyarrow as pa

    from lexfold.functions.english import terms
    from lexfold.operators import text_index as T

    r = random.Random(5)
    docs = [(block, doc, " ".join(r.choice(["thing", "things", "of", "well-known", "a1", "ü", "-"]) for _ in range(r.randrange(30))) or None) for block in (0, 3) for doc in range(block, 90, 2)]
    monkeypatch.setattr(T, "FLUSH", 3)
    monkeypatch.setattr(T, "PLACES", 40)
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*docs[k : k + 7]), (pa.int32(), pa.int64(), pa.string()))], ["block", "doc_id", "text"]) for k in range(0, len(docs), 7)]
    out = list(T._inverted(iter(batches)))
    got = {(x["term"], x["block"]): (x["n"], x["top"], x["docs"], x["places"]) for b in out for x in b.to_pylist()}
    want = {}
    for block, doc, text in docs:
        found = {T.ALL: []}
        for t, at in terms(text):
            found.setdefault(t, []).append(at)
        for t, at in found.items():
            want.setdefault((t, block), []).append((doc, at))
    assert got == {k: (len(v), max(len(at) for _, at in v), [d for d, _ in v], [at for _, at in v]) for k, v in want.items()}
    assert all(b.num_rows <= 3 for b in out) and sum(b.num_rows for b in out) == len(got)
