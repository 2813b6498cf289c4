"""Decisions that depend on earlier ones, in parallel: folds in order within what can influence one another.

Rows say what they touch. Rows that touch a thing in common, over any number of steps, are a component; what happens in one
component never bears on another. So a fold over each component's rows in order gives what one loop over all rows gives,
however rows are dealt to tasks. Rows stream through a task in order: it holds the state of one component, not its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexfold.operators.components import components
from lexfold.storage import written

COMPONENT = "_component"
AT_ONCE = 10_000  # rows that a task gives at once


class Fold(Protocol):
    """The state of one component."""

    def row(self, row: dict) -> Iterator[tuple]:
        """Take the next row; rows to give."""

    def end(self) -> Iterator[tuple]:
        """Rows to give after the last one."""


def labelled(rows: DataFrame, touched: Column, alone: Column) -> DataFrame:
    """rows with their component: touched is an array of longs; where it is empty a row is alone, known by the long `alone`."""
    keyed = written(rows.withColumn("_keys", F.array_distinct(touched)), "touched")
    first = F.col("_keys")[0]
    edges = keyed.filter(F.size("_keys") > 1).select(first.alias("u"), F.explode(F.slice("_keys", 2, F.size("_keys"))).alias("v")).distinct()
    labels = components(edges).select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    named = keyed.withColumn("_node", F.try_element_at("_keys", F.lit(1))).join(labels, "_node", "left")
    return named.withColumn(COMPONENT, F.coalesce("_label", "_node", alone)).drop("_keys", "_node", "_label")


def values(column: pa.Array) -> list:
    """column.to_pylist(), by whole columns: value by value, rows with arrays of structs take longer to read than to fold."""
    kind, none = column.type, column.null_count
    if none == len(column):
        return [None] * len(column)
    if pa.types.is_struct(kind) and len({f.name for f in kind}) == kind.num_fields:
        names = [f.name for f in kind]
        out = [dict(zip(names, v)) for v in zip(*(values(c) for c in column.flatten()))] if names else column.to_pylist()
    elif pa.types.is_list(kind):
        inner, at = values(column.flatten()), np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy())].tolist()
        out = [inner[a:z] for a, z in zip(at, at[1:])]
    elif pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind):
        out = column.fill_null(pa.scalar(0).cast(kind) if not pa.types.is_boolean(kind) else False).to_numpy(zero_copy_only=False).tolist()
    elif pa.types.is_string(kind) or pa.types.is_date32(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)) if none else ():
        out[i] = None
    return out


def folded(rows: DataFrame, order: list[str], begin: Callable[[], Fold], schema: str) -> DataFrame:
    """What the folds of all components give; rows: of labelled()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, state = None, None
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(list(zip(*out)) or [[] for _ in kinds], kinds)], names=[t.name for t in kinds])
        for b in batches:
            names = b.schema.names
            for v in zip(*map(values, b.columns)):
                r = dict(zip(names, v))
                if state is None or r[COMPONENT] != now:
                    out += state.end() if state else ()
                    now, state = r[COMPONENT], begin()
                out += state.row(r)
                if len(out) > AT_ONCE:
                    yield batch()
                    out.clear()
        out += state.end() if state else ()
        yield batch()

    kinds = list(to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: a fold takes longer than its bytes tell
    return rows.repartition(tasks, COMPONENT).sortWithinPartitions(COMPONENT, *order).mapInArrow(run, schema)
