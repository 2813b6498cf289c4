from lexfold.plans import review


def test_mentions_are_dealt_by_their_number(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(review.entities(spark, sf).collect())
    monkeypatch.setattr(review, "MENTIONS", 100)
    many = review.entities(spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert sorted(many.collect()) == whole and len(whole) == 50
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan and f", {-(-lines // 100)}" in plan
