"""Answers of a model against a plain reading of them."""

import json
import random
import re

from lexfold.operators import entities as E
from lexfold.operators import extraction as X
from lexfold.session import importable

NAMES = ["Jorge Rivera", "jorge rivera", "C.", "Them", "", "The Court", "Acme Corp", "plaintiff", "Li", 7, None, "x" * 600]


def text(v, most=500):
    return str(v).strip()[:most] if isinstance(v, str | int | float) else ""


def usable(n):
    return sum(c.isalnum() for c in n) >= 2 and n.strip(".,'\"“”‘’ ").lower() not in E.NON_NAME_TOKENS


def plain(raw):
    raw = raw.strip()
    if raw.startswith("```"):
        raw = raw.split("\n", 1)[1]
        raw = (raw[:-3] if raw.endswith("```") else raw).strip()
    try:
        data = json.loads(raw)
    except ValueError:
        return [], [], []
    if not isinstance(data, dict):
        return [], [], []
    of = lambda c, most: [x for x in (data.get(c) if isinstance(data.get(c), list) else [])[:most] if isinstance(x, dict)]
    several = lambda x, c: [text(y) for y in (x.get(c) if isinstance(x.get(c), list) else [])]
    ents = []
    for x in of("entities", 50):
        n = text(x.get("name"))
        if usable(n) and x.get("type") in X.ENTITY_TYPES and not any(re.search(p, n, re.I) for p in X.PROCESS_NOISE):
            forms = [f for f in several(x, "surface_forms") if usable(f)] or [n]
            ents.append((n, x["type"], forms[:10], text(x.get("role")) or None, [m.lower() for m in several(x, "emails") if "@" in m]))
    evs = []
    for x in of("events", 30):
        if text(x.get("description")):
            s = x.get("significance")
            evs.append((text(x["description"], 2000), x["type"] if x.get("type") in X.EVENT_TYPES else "other", text(x.get("date"), 10) or None, text(x.get("date_source")), max(1, min(5, int(s))) if isinstance(s, int) or (isinstance(s, str) and s.isdigit()) else 3, [p for p in several(x, "participants") if p]))
    rels = [(text(x.get("source")), text(x.get("target")), x["type"] if x.get("type") in X.RELATIONSHIP_TYPES else "other", text(x.get("evidence")) or None) for x in of("relationships", 30)]
    return ents, evs, [r for r in rels if r[0] and r[1] and r[0] != r[1]]


def made(r):
    some = lambda f, n: [f() for _ in range(r.randrange(n))]
    name = lambda: r.choice(NAMES)
    e = {"name": None}
    data = {
        "entities": some(lambda: r.choice([3, "x", None, {"name": name(), "type": r.choice(["person", "org", "robot", None]), "surface_forms": r.choice([None, "no list", some(name, 14)]), "role": r.choice([None, "", " CFO "]), "emails": r.choice([[], ["A@X.com", "no", 5]])}, e]), 90),
        "events": some(lambda: {"description": r.choice(["Met", "met", "", None, 5]), "type": r.choice(["meeting", "party"]), "date": r.choice([None, "2020-01-02", "2020-01-02T00:00"]), "significance": r.choice([None, 0, 4, "2", "high", 9]), "participants": r.choice([None, ["A", "", "B"]])}, 50),
        "relationships": r.choice([{}, some(lambda: {"source": r.choice(["A", "a", "B"]), "target": r.choice(["A", "B", ""]), "type": r.choice(["family", "odd"]), "evidence": r.choice([None, "e"])}, 50)]),
    }
    body = json.dumps(data)
    return r.choice([body, f"```json\n{body}\n```", f"  {body}\n", "sorry", "[1]", "", body])


def rows(items):
    return [tuple(x) for x in items]


def test_answers_and_slices(spark):
    r = random.Random(5)
    raws = [(d, s, made(r)) for d in range(20) for s in range(3)]
    got = X.parsed(importable(spark).createDataFrame(raws, "id int, slice int, raw string")).cache()
    want = {(d, s): plain(t) for d, s, t in raws}
    for g in got.collect():
        assert (rows(g.entities), rows(g.events), rows(g.relationships)) == want[g.id, g.slice]
    entities, events, relationships = X.merged(got)
    for d in range(20):
        ents, evs, rels = {}, {}, {}
        for s in range(3):
            for n, t, forms, role, mails in want[d, s][0]:
                h = ents.setdefault((t, n.lower()), [n, t, [], None, []])
                h[2], h[4], h[3] = list(dict.fromkeys(h[2] + forms)), list(dict.fromkeys(h[4] + mails)), h[3] or role
            for v in want[d, s][1]:
                evs.setdefault((v[0].lower(), v[1], v[2]), v)
            for x in want[d, s][2]:
                rels.setdefault((x[0].lower(), x[1].lower(), x[2]), x)
        of = lambda df: [tuple(x)[3:] for x in df.filter(f"id = {d}").orderBy("slice", "place").collect()]  # noqa: B023, E731
        if d < 4:
            assert of(entities) == [tuple(h) for h in ents.values()] and of(events) == list(evs.values()) and of(relationships) == list(rels.values())
    assert X.parsed(spark.createDataFrame([(1, 0, None)], "id int, slice int, raw string")).first()[2:] == ([], [], [])
