"""Answers of a model: merged as they pass, whatever their order and shape."""

import json

from lexfold.operators import extraction as X
from lexfold.plans import analytics


def test_answers_are_neither_sorted_nor_held_by_all_their_items(spark):
    for merged in X.merged(X.parsed(analytics.model_answers(spark, "/root/testdata/sf0.001"))):
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Sort [") == 1
        assert "raw" not in plan[plan.index("Sort [") :] and "from_json" not in plan[plan.index("Sort [") :]  # keys are sorted, no answers


def test_odd_elements_beside_good_ones_in_any_order(spark):
    person = {"name": " Ann\tLee\n", "type": " person ", "surface_forms": ["A. Lee", 5, None, " "], "emails": ["A@x.com"]}
    good = {"entities": [person, {"name": "Acme", "type": "org"}], "events": [{"description": "Met", "significance": 1e30}], "relationships": [{"source": "A", "target": "B"}]}
    odd = {"entities": ["ann lee", 7, None, {"name": "ANN\tLEE", "type": "person", "surface_forms": "Ann", "role": " cfo"}], "events": {"description": "Met"}, "relationships": [[], {"source": "a", "target": "b", "evidence": "later"}]}
    rows = [(2, 0, json.dumps(odd)), (1, 9, json.dumps(odd)), (1, 3, f"```json\n{json.dumps(good)}\n```"), (1, 5, "none"), (3, 0, None), (2, 1, " " + json.dumps(good) + "\n")]
    entities, events, relationships = X.merged(X.parsed(spark.createDataFrame(rows, "id int, slice int, raw string").repartition(3)))
    assert sorted(tuple(e) for e in entities.collect()) == [
        (1, 3, 0, "Ann\tLee", "person", ["A. Lee", "ANN\tLEE"], "cfo", ["a@x.com"]),
        (1, 3, 1, "Acme", "org", ["Acme"], None, []),
        (2, 0, 0, "ANN\tLEE", "person", ["ANN\tLEE", "A. Lee"], "cfo", ["a@x.com"]),
        (2, 1, 1, "Acme", "org", ["Acme"], None, []),
    ]
    assert sorted((e.id, e.slice, e.description, e.type, e.significance) for e in events.collect()) == [(1, 3, "Met", "other", 5), (2, 1, "Met", "other", 5)]
    assert sorted((r.id, r.slice, r.source, r.evidence) for r in relationships.collect()) == [(1, 3, "A", None), (2, 0, "a", "later")]
