"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfold.storage import forget, fresh_path, shared_dir, written

__all__ = ["WS", "forget", "fresh_path", "let", "map_arrow", "shared_dir", "table", "words", "written"]

#: ASCII white space, as a Java regular expression class.
WS = r"[\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of other than ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+"), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """rows.mapInArrow(run, schema) for columns of any name, dots included; run reads and gives columns by position."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, [f"c{i}" for i in range(b.num_columns)])

    numbered = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns)))).mapInArrow(plain, numbered).toDF(*schema.names)
