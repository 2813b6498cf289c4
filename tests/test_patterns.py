"""Many terms and forms in one pass against one at a time."""

import random
import re

import pytest

from lexfold.operators import entities as E
from lexfold.operators import patterns
from lexfold.operators import search as S
from lexfold.plans.search import many_terms
from lexfold.session import importable
from lexfold.sources import corpus as C

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("library", [True, False])
def test_occurrences(monkeypatch, library):
    if not library:
        monkeypatch.setattr(patterns, "ahocorasick", None)
    r = random.Random(1)
    strings = ["".join(r.choice("ab ") for _ in range(r.randint(1, 4))) for _ in range(40)]
    for _ in range(50):
        text = "".join(r.choice("ab ") for _ in range(60))
        want = sorted((s, i) for s in set(strings) for i in range(len(text)) if text.startswith(s, i))
        assert sorted(patterns.occurrences(patterns.automaton(strings), text)) == want
    assert patterns.automaton([]) is None and list(patterns.occurrences(None, "a")) == []


def test_two_hundred_terms_as_one_at_a_time(spark, monkeypatch):
    docs = C.documents(importable(spark), SF).select("doc_id", "family_id", "text")
    terms = many_terms(spark, SF)
    assert len(terms) == 200
    fast = sorted(map(tuple, S.term_report(docs, terms).collect()))
    monkeypatch.setattr(S, "MANY", 10**9)
    slow = [sorted(map(tuple, S.term_report(docs, terms[k : k + 1]).select("term", "hits", "with_families").collect())) for k in (0, 50, 99, 100, 150, 198, 199)]
    by_term = {(f[1], f[2], f[3]) for f in fast}
    assert len(fast) == 200 and all(x in by_term for s in slow for x in s)
    some = terms[::20]
    want = sorted(map(tuple, S.term_report(docs, some).collect()))
    monkeypatch.setattr(S, "MANY", 1)
    assert sorted(map(tuple, S.term_report(docs, some).collect())) == want


def plain(text, forms, most=200):
    """Longest first, one search after another."""
    claimed, out = [], []
    for f in sorted({f for f in forms if f}, key=lambda f: (-len(f), f)):
        pattern = re.compile((r"\b" if f[0].isalnum() else "") + re.escape(f) + (r"\b" if f[-1].isalnum() else ""))
        at, found = 0, 0
        while found < most and (m := pattern.search(text, at)):
            at = m.start() + 1
            if not any(s < m.end() and m.start() < e for s, e in claimed):
                claimed.append((m.start(), m.end()))
                out.append((f, m.start(), m.end()))
                found += 1
    return sorted(out, key=lambda x: x[1])


def test_ten_thousand_forms():
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) for _ in range(3000)]
    forms = list({" ".join(r.choice(words) for _ in range(r.randint(1, 3))) + r.choice(["", "", ".", "'s"]) for _ in range(12_000)})[:10_000]
    places = E.Places(forms)
    for _ in range(3):
        text = " ".join(r.choice(words) for _ in range(150)) + ". J.B. " + r.choice(forms)
        near = [f for f in forms if f in text]
        assert [m[:3] for m in places.of(text)] == plain(text, near)
