"""Review queues, batches and the read-only tools an assistant gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.operators.ranks import running
from lexfold.sources import corpus as C


def queue_documents(docs: DataFrame, by_query: DataFrame | None = None, by_decision: DataFrame | None = None) -> DataFrame:
    """Documents of a queue: those of a slice of decisions if given, else of a query, else all."""
    if by_decision is not None:
        return docs.join(by_decision.select("doc_id").distinct(), "doc_id", "left_semi")
    return by_query if by_query is not None else docs


def new_batches(docs: DataFrame, batched: DataFrame, size: int) -> DataFrame:
    """Documents not yet batched, cut into batches of a production in Bates order: batch and position from 0."""
    left = docs.join(batched.select("doc_id").distinct(), "doc_id", "left_anti")
    placed = running(left.select("production_id", "bates_begin", "doc_id"), ["production_id"], ["bates_begin", "doc_id"], "_r")
    r = F.col("_r") - 1
    return placed.select("production_id", "doc_id", F.floor(r / size).alias("batch"), (r % size).cast("bigint").alias("position"))


class Tools:
    PAGE = 25

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def documents(self) -> DataFrame:
        return C.documents(self.spark, self.sf_dir)

    def tags(self) -> DataFrame:
        return C.document_tags(self.spark, self.sf_dir)

    def decisions(self) -> DataFrame:
        return C.decisions(self.spark, self.sf_dir)

    def messages(self) -> DataFrame:
        return C.messages(self.spark, self.sf_dir)

    def search(self, query: str) -> DataFrame:
        from lexfold.operators import search as S

        d = self.documents().select("doc_id", "bates_begin", S.tokens(F.col("text")).alias("w"))
        return d.filter(S.matches(F.col("w"), query)).drop("w")

    def page(self, rows: DataFrame, order: str, page: int = 1) -> DataFrame:
        return rows.orderBy(order).offset((page - 1) * self.PAGE).limit(self.PAGE)
