"""Queries read their whole table."""

from lexfold.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


def test_every_message_is_parsed(spark):
    asked = spark.read.parquet(f"{SF}/conversations.parquet")
    assert QUERIES["s13_parse_mail"](spark, SF).count() == asked.count() > 200
