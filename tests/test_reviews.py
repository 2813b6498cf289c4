"""Decisions in parallel against one loop over all, in two ways of dealing rows."""

import datetime
import random

import pytest

from lexfold.operators import reviews as R
from lexfold.session import importable
from tests.test_persistence import norm, typo

ENTITY = "entity_id long, production_id int, kind string, name string, aliases array<string>, mentions long"


class Loop:
    """Entities with their mentions, all in one place."""

    def __init__(self, entities, places):
        self.e = {i: {"id": i, "production": p, "kind": k, "name": n, "aliases": list(a), "extra": m - len({x for x in places if x[0] == i}), "places": {(d, s) for j, d, s in places if j == i}, "snippets": []} for i, p, k, n, a, m in entities}

    def count(self, e):
        return e["extra"] + len(e["places"])

    def merge(self, w, lo):
        w["extra"] += lo["extra"]
        w["places"] |= lo["places"]
        w["snippets"] += lo["snippets"]
        for a in [lo["name"], *lo["aliases"]]:
            if a not in w["aliases"]:
                w["aliases"].append(a)
        del self.e[lo["id"]]


def people(r, n=40):
    tails = ["stone", "stones", "stoness", "rivera", "riverra", "lee"]
    entities = [(i, r.choice([1, 1, 1, 2]), r.choice(["person", "person", "person", "org"]), f"{r.choice(['Ann', 'Annn', 'Annnn', 'Joan'])} {r.choice(tails)}", [f"alias {r.randrange(9)}"], 0) for i in range(n)]
    places = sorted({(r.randrange(n), r.randrange(6), r.randrange(4)) for _ in range(n * 4)})
    return [(*e[:5], sum(p[0] == e[0] for p in places) + r.randrange(2)) for e in entities], places


@pytest.mark.parametrize("seed, parts", [(1, 1), (1, 6), (2, 3)])
def test_auto_resolve(spark, seed, parts):
    r = random.Random(seed)
    entities, places = people(r)
    chain = [(0, 100, 101), (1, 101, 102), (2, 102, 103), (3, 100, 101), (4, 104, 100), (5, 100, 105)]  # a chain, the pair again, a star
    entities += [(100 + k, 1, "person", f"ann{'n' * k} stone", [], 5 - k) for k in range(4)] + [(104, 1, "person", "anns stone", [], 9), (105, 1, "person", "an stone", [], 1)]
    suggestions = chain + [(10 + k, r.randrange(40), r.randrange(40)) for k in range(900)] + [(5000, 7, 999), (5001, None, 3)]
    loop = Loop(entities, places)
    status, merged = {at: "pending" for at, _, _ in suggestions}, {}
    names = {e[0]: norm(e[3]) for e in entities}
    for at, a, b in suggestions:
        if status[at] != "pending" or a not in loop.e or b not in loop.e or a == b:
            continue
        x, y = loop.e[a], loop.e[b]
        if x["kind"] != y["kind"] or x["production"] != y["production"] or not typo(names[a], names[b]):
            continue
        w, lo = (x, y) if loop.count(x) >= loop.count(y) else (y, x)
        loop.merge(w, lo)
        merged[at] = (w["id"], lo["id"])
        for other, p, q in suggestions:
            if status[other] == "pending" and lo["id"] in (p, q):
                status[other] = "accepted" if {p, q} == {a, b} else "rejected"
    spark = importable(spark)
    got = R.auto_resolve(spark.createDataFrame(suggestions, "at long, a long, b long").repartition(parts), spark.createDataFrame(entities, ENTITY).repartition(parts), spark.createDataFrame(places, "entity_id long, doc_id long, start_offset int")).collect()
    assert {g.at: g.status for g in got} == status
    assert {g.at: (g.winner, g.loser) for g in got if g.winner is not None} == merged and len(merged) > 5


@pytest.mark.parametrize("seed, parts", [(1, 1), (1, 6), (2, 3), (3, 4)])
def test_merge_verdicts(spark, seed, parts):
    r = random.Random(seed)
    entities, places = people(r)
    snippets = [(i, f"...  {r.choice(['Ann', 'JOAN'])}\n {r.choice(['Stone', 'lee', 'Rivera'])} said") for i in range(40) for _ in range(r.randrange(3))]
    suggestions = [(k, r.choice([1, 1, 2]), r.randrange(40), r.randrange(40), r.choice(["pending", "pending", "pending", "accepted"])) for k in range(70)]
    names = ["Ann Stone", "joan lee", " ", "Nobody Here", "Ann  Rivera"]
    verdicts = []
    for at in range(110):
        s = r.randrange(75)
        ends = suggestions[s][2:4] if s < 70 else (1, 2)
        corrections = [(r.choice([*ends, r.randrange(40), 999]), r.choice(names), r.choice([0.5, 0.9, 0.99])) for _ in range(r.randrange(3))]
        verdicts.append((at, s, r.choice(["merge", "merge", "distinct", "unsure"]), r.choice([None, None, *ends, 999]), r.choice([0.3, 0.85, 0.95]), corrections))
    loop = Loop(entities, places)
    for i, t in snippets:
        loop.e[i]["snippets"].append(t)
    status, want = {s[0]: s[4] for s in suggestions}, {}
    plain = lambda t: " ".join(t.split()).lower()
    for at, s, verdict, keep_id, confidence, corrections in verdicts:
        if s >= 70 or status[s] != "pending":
            want[at] = ("skipped", None, None, 0)
            continue
        _, production, a, b, _ = suggestions[s]
        renamed = 0
        for i, new, sure in corrections:
            e, new = loop.e.get(i), new.strip()
            if sure >= 0.85 and e and e["production"] == production and new and new != e["name"] and any(plain(new) in plain(t) for t in e["snippets"]):
                if e["name"] not in e["aliases"]:
                    e["aliases"].append(e["name"])
                e["name"] = new
                renamed += 1
        x, y = loop.e.get(a), loop.e.get(b)
        if verdict == "distinct":
            status[s] = "rejected"
            want[at] = ("dismissed", None, None, renamed)
        elif verdict != "merge" or confidence < 0.85:
            want[at] = ("annotated", None, None, renamed)
        elif x is None or y is None or x is y or x["production"] != y["production"] or x["kind"] != y["kind"]:
            want[at] = ("skipped", None, None, renamed)
        else:
            keep, drop = (x, y) if loop.count(x) >= loop.count(y) else (y, x)
            if keep_id in (a, b):
                keep, drop = (x, y) if keep_id == a else (y, x)
            loop.merge(keep, drop)
            for o, _, p, q, _ in suggestions:
                if status[o] == "pending" and drop["id"] in (p, q):
                    status[o] = "gone"
            status[s] = "accepted"
            want[at] = ("merged", keep["id"], drop["id"], renamed)
    spark = importable(spark)
    kind = "at long, suggestion_id long, verdict string, keep_id long, confidence double, corrections array<struct<entity_id:long,corrected_name:string,confidence:double>>"
    done, after = R.apply_merge_verdicts(
        spark.createDataFrame(verdicts, kind).repartition(parts), spark.createDataFrame(suggestions, "suggestion_id long, production_id int, a long, b long, status string"),
        spark.createDataFrame(entities, ENTITY).repartition(parts), spark.createDataFrame(snippets, "entity_id long, snippet string"), spark.createDataFrame(places, "entity_id long, doc_id long, start_offset int"),
    )
    assert {d.at: (d.outcome, d.keep, d.drop, d.renamed) for d in done.collect()} == want
    assert {"merged", "dismissed", "annotated", "skipped"} <= {w[0] for w in want.values()} and any(w[3] for w in want.values())
    got = {e.entity_id: e for e in after.collect()}
    assert all((e.merged_into is not None) == (i not in loop.e) for i, e in got.items())
    assert all((e.name, e.aliases, e.mentions) == (loop.e[i]["name"], loop.e[i]["aliases"], loop.count(loop.e[i])) for i, e in got.items() if i in loop.e)


@pytest.mark.parametrize("seed, parts", [(1, 1), (1, 5), (2, 3)])
def test_timeline_verdicts(spark, seed, parts):
    r = random.Random(seed)
    day = datetime.date(2020, 1, 2)
    events = [(i, "meeting", f"e{i}", day, "day", 3, r.random() < 0.15, [r.randrange(5) for _ in range(1)]) for i in range(50)]
    verdicts = []
    for at in range(120):
        ids = [r.randrange(52) for _ in range(r.randrange(1, 4))]
        verdicts.append((at, r.choice(["delete", "merge", "merge", "edit", "rerate", "odd"]), r.choice([None, 0.5, 0.8, 0.9, 1.0, 0.95]), r.randrange(52), ids, r.choice(ids + [3]), r.choice([None, "2021-05-06", "2021-02-30", "soon"]), r.choice([None, "month"]), r.choice([None, "", "new"]), r.choice([None, "payment", "party"]), r.choice([None, 0, 1, 5, 6])))
    now = {e[0]: dict(zip(("id", "type", "text", "date", "precision", "sig", "human", "parts"), (*e[:7], list(e[7])))) for e in events}
    want = {}
    for at, kind, sure, i, ids, keep, date, precision, text, typ, sig in verdicts:
        new = datetime.date(2021, 5, 6) if date == "2021-05-06" else None
        bad, e, outcome = date is not None and new is None, now.get(i), "skipped"
        if sure is None or sure < 0.8:
            pass
        elif kind == "merge":
            rest = [x for x in dict.fromkeys(ids) if x != keep]
            if len(ids) > 1 and keep in ids and all(x in now for x in ids) and not any(now[x]["human"] for x in rest) and not bad:
                outcome, k = "merged", now[keep]
                for x in rest:
                    k["parts"] += [p for p in now.pop(x)["parts"] if p not in k["parts"]]
                if not k["human"]:
                    k["text"] = text or k["text"]
                    if new and precision:
                        k["date"], k["precision"] = new, precision
        elif e and not e["human"]:
            if kind == "delete":
                outcome = "deleted"
                del now[i]
            elif kind == "rerate" and sig is not None and 1 <= sig <= 5:
                outcome, e["sig"] = "rerated", sig
            elif kind == "edit" and not bad and typ != "party":
                outcome, e["text"], e["type"] = "edited", text or e["text"], typ or e["type"]
                if new and precision:
                    e["date"], e["precision"] = new, precision
        want[at] = outcome
    spark = importable(spark)
    v = spark.createDataFrame(verdicts, "at long, kind string, confidence double, event_id long, event_ids array<long>, keep_id long, date string, precision string, description string, event_type string, significance int").repartition(parts)
    e = spark.createDataFrame(events, "event_id long, event_type string, description string, date date, precision string, significance int, human_edited boolean, participants array<long>").repartition(parts)
    done, after = R.apply_timeline_verdicts(v, e)
    assert {d.at: d.outcome for d in done.collect()} == want and len(set(want.values())) == 5
    got = {x.event_id: x for x in after.collect()}
    assert {i for i, x in got.items() if x.outcome == "kept"} == set(got) & set(now)
    assert all((x.event_type, x.description, x.date, x.precision, x.significance, x.participants) == tuple(now[i][k] for k in ("type", "text", "date", "precision", "sig", "parts")) for i, x in got.items() if i in now)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_dockets_of_the_tables(spark, sf):
    """The registered queries' own rows: a merge, a rename and a decision on what has gone are among them."""
    from lexfold.plans import analytics as A

    done, after = R.apply_merge_verdicts(*A.merge_docket(importable(spark), f"/root/testdata/{sf}"))
    outcomes = {d.outcome for d in done.collect()}
    assert {"merged", "dismissed", "skipped", "annotated"} <= outcomes and done.filter("renamed > 0").count() and after.filter("merged_into IS NOT NULL").count() == done.filter("outcome = 'merged'").count()
    done, after = R.apply_timeline_verdicts(*A.timeline_docket(spark, f"/root/testdata/{sf}"))
    assert {"merged", "deleted", "edited", "rerated", "skipped"} == {d.outcome for d in done.collect()}
    assert after.filter("outcome = 'gone' AND into IS NULL").count() == done.filter("outcome = 'deleted'").count()
