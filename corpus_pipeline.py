"""Corpus preparation end to end: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes what its predecessor kept, as a table read from Parquet, and all but the last return the columns of
documents. Mixing repeats documents whose rate is above one, so packing may see a doc_id several times; it packs
each of these rows.

Null texts, and empty ones, count as having no words: the quality rules reject them. Null languages and sources are groups
of their own, null ids come after all others, and rows that repeat an id are treated one by one until near duplicates,
of which one row stays. Ties go to the smallest id, then to a hash of the text. Empty tables give no rows, and columns of
other names, whatever they are, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexfold.llm.common import written
from lexfold.llm.jaccard_join import keep_one_of_each_group
from lexfold.llm.line_dedup import drop_repeated_lines
from lexfold.llm.mixing import mix_stage
from lexfold.llm.packing import pack_stage
from lexfold.llm.quality_rules import keep_good

STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: The quality rules' estimates, the near-duplicate components, the fitted rates and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
