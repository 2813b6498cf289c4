"""Queries over indexes that are built from the tables: stemmed text search, neighbours of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.operators.text_index import TextIndex
from lexfold.operators.vector_index import VectorIndex
from lexfold.plans.registry import query
from lexfold.sources import corpus as C

TEXT_QUERY = '"things of others" OR thing* NOT seulement OR nights passwords'


@query("q2_stemmed_match")
def stemmed_match(spark: SparkSession, sf: str) -> DataFrame:
    """All matches of stems, phrases across stop words and prefixes, with ranks."""
    return TextIndex.build(C.documents(spark, sf)).match(TEXT_QUERY)


@query("q3_best_of_index")
def best_of_index(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty best, from the blocks whose bounds allow them."""
    return TextIndex.build(C.documents(spark, sf)).top("other things", 50)


@query("q4_fragments")
def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """The best page with headlines of two fragments."""
    docs = C.documents(spark, sf)
    index = TextIndex.build(docs)
    return index.headlines(index.top("other things", 50), docs, "other things", fragments=2)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return C.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("q11_nearest_by_index")
def nearest_by_index(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty nearest of every fiftieth vector, from the cells that hold at least 95 % of such neighbours."""
    v = _vectors(spark, sf)
    return VectorIndex.build(v).search(v.filter("id % 50 = 0"), 50).select("query", "id", F.round("sim", 4).alias("sim"))


@query("q11_nearest_exact", """SELECT query, id, round(sim, 4) AS sim FROM (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS sim
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) <= 50""")
def nearest_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The same from all cells: every query against all blocks."""
    v = _vectors(spark, sf)
    return VectorIndex.build(v).search(v.filter("id % 50 = 0"), 50, exact=True).select("query", "id", F.round("sim", 4).alias("sim"))
