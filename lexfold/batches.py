"""Values of Arrow batches one by one: of a batch's texts only a few are Python objects at a time."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

PIECE = 256  # rows


def mapped(one: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """one(*values) of every row, as an array."""
    n = len(columns[0])
    parts = [pa.array([one(*(c[i].as_py() for c in columns)) for i in range(a, min(a + PIECE, n))], kind) for a in range(0, n, PIECE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@contextlib.contextmanager
def fewer_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """So few rows go to Python at a time, of what is run meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
