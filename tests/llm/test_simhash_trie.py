"""SimHash fingerprints and their trie join against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from lexfold.llm import simhash_trie as st
from lexfold.session import importable
from tests.llm.data import frame, near_copies, odd, rows


def plain(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, errors=3):
    """Least index reachable, by comparing all."""
    a, label = np.array(fps, np.uint64), list(range(len(fps)))
    for i in range(len(fps)):
        if label[i] != i:
            continue
        ahead = [i]
        while ahead:
            j = ahead.pop()
            for k in np.flatnonzero(np.bitwise_count(a ^ a[j]) <= errors):
                if label[k] != i:
                    label[k] = i
                    ahead.append(k)
    return label


def near_prints(seed, centres=6, members=60, bits=5):
    """Random fingerprints and others some bits from them, a few chains among them."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(100)}
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(members):
            x = c
            for _ in range(r.randint(0, bits)):
                x ^= 1 << r.randrange(64)
            out.add(x)
            if r.random() < 0.1:
                c = x
    return sorted(out)


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_fingerprint_is_the_majority_of_all_shingles(monkeypatch, piece):
    monkeypatch.setattr(st, "PIECE", piece)
    for text in ["", " \n", "One", "one TWO", "a b c", "Ä b\x0bc ä D  e\tf", "x" * 500, *near_copies()[:20]]:
        assert st.fingerprint(text.encode()) % (1 << 64) == plain(text)
    assert st.fingerprint(None) == 0


@pytest.mark.parametrize("errors", [0, 1, 3, 4])
@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_one_of_the_turns_finds_each_link(monkeypatch, errors, chunk):
    monkeypatch.setattr(st, "CHUNK", chunk)
    fps = near_prints(errors)
    found = []
    for turn, back in enumerate(st._blocks(errors)):
        keys = sorted((((x << back) | (x >> (64 - back))) & (2**64 - 1), i) for i, x in enumerate(fps))
        root = st.linked(np.array([k for k, _ in keys], np.uint64), np.array([0]), np.array([len(keys)]), np.array(st._budgets(errors, turn)))
        found += [(keys[i][1], keys[j][1]) for i, j in enumerate(root)]
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
    assert label == classes(fps, errors)


@pytest.mark.parametrize("size", [4, 40, None])
def test_nodes_too_large_for_a_task_are_cut(spark, size):
    from lexfold.operators.components import components

    fps = near_prints(11, members=150, bits=4)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.label for r in components(st.links(df, 3, size)).collect()}
    same = {}
    for x, c in zip(signed, classes(fps)):
        same.setdefault(c, []).append(x)
    assert {x: got.get(x, x) for x in signed} == {x: min(v) for v in same.values() for x in v}


def test_documents(spark):
    data = rows(near_copies(groups=8, copies=12, n=200)) + [(500, None, "en", "s", None), (501, "", "en", "s", 0), (-3, " ", None, None, 1)]
    got = {r.doc_id: r for r in st.near_duplicates(frame(importable(spark), data)).collect()}
    fps = [plain(d[1]) for d in data]
    label = classes(fps)
    for i, d in enumerate(data):
        assert int(got[d[0]].fingerprint, 16) == fps[i] and len(got[d[0]].fingerprint) == 16
        assert got[d[0]].component_id == min(e[0] for e, c in zip(data, label) if c == label[i])


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    docs = odd(importable(spark)).withColumn("fp", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = st.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {1, 2, 3, None} and {r.component_id for r in zero} == {1} and {r.n_same for r in zero} == {4}
    assert st.near_duplicates(docs.limit(0)).collect() == []
    alone = frame(spark, [(None, "a b c d", None, None, 7)])
    assert [(r.doc_id, r.component_id) for r in st.near_duplicates(alone).collect()] == [(None, None)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = st.op11_simhash_trie(importable(spark), sf)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields][:3] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    label = classes([docs[i] for i in ids])
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got.collect()} == {i: (docs[i], ids[c]) for i, c in zip(ids, label)}
