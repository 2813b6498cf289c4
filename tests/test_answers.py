"""Plans over the answers of a model."""

from lexfold.operators import extraction
from lexfold.plans import analytics


def test_answers_are_read_once_and_by_all_tasks(spark):
    for merged in extraction.merged(extraction.parsed(analytics.model_answers(spark, "/root/testdata/sf0.001"))):
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Filter (size(" not in plan and plan.count("Exchange") == 1
