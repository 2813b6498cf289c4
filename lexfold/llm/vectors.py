"""Vectors as blocks of integers, for the operators that cluster and compress them.

Integers are held to 2^27 in magnitude, so that sums of squared differences of 64 components fit a long. Where all
numbers of a computation stay below 2^53, floats hold them exactly and are used, as they multiply faster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGEST = 1 << 27
BLOCK = 4096  # vectors


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def as_doubles(rows: DataFrame, column: str = "embedding") -> DataFrame:
    return rows.withColumn(column, F.col(column).cast("array<double>"))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x)."""
    x = np.floor(scale * x.astype(np.float64))
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"components beyond {LARGEST / scale:g} in magnitude: squared distances might not fit a long")
    return x.astype(np.int64)


def points(batch: pa.RecordBatch, at: int, scale: int) -> np.ndarray:
    """Integers of the vectors, all of one length, in a batch's column."""
    values = batch.column(at)
    return integers(values.flatten().to_numpy(zero_copy_only=False), scale).reshape(len(values), -1)


def plain(x: np.ndarray, exact_below: int) -> np.ndarray:
    """x as floats where numbers up to exact_below are exact in them, else as it is."""
    return x.astype(np.float64) if exact_below < 1 << 53 else x


def squared(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points from all of c, as integers."""
    top = int(max(np.abs(p).max(initial=0), np.abs(c).max(initial=0)))
    most = 4 * p.shape[1] * top * top
    a, b = plain(p, most), plain(c, most)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def summed(parts: DataFrame, keys: list[str], size: int) -> list:
    """Rows of keys, n and sums (exact integers), of partial n and sums per task."""
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    rows = parts.groupBy(*keys).agg(F.sum("n").alias("n"), *wide).collect()  # a row for each centroid or entry
    return [(*(r[k] for k in keys), int(r["n"]), [int(r[f"s{i}"]) for i in range(size)]) for r in rows]


def partial_sums(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and sums, over all of found: keys, counts and sums of rows."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for keys, counts, sums in found:
        for k, n, s in zip(keys.tolist(), counts.tolist(), sums):
            m, t = total.get(k, (0, 0))
            total[k] = (m + n, t + s)
    keys = sorted(total)
    return np.array(keys, np.int64), np.array([total[k][0] for k in keys], np.int64), np.array([total[k][1] for k in keys], np.int64)


def by_label(label: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels that occur, with counts and sums of their rows of x."""
    if not len(label):
        return label, label, x
    order = np.argsort(label, kind="stable")
    names, first = np.unique(label[order], return_index=True)
    return names, np.diff(np.append(first, len(label))), np.add.reduceat(x[order], first, axis=0)


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([r.tolist() for r in rows], pa.list_(kind))


SUMS = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])


def sums_batch(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, counts, sums = partial_sums(found)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts), lists(list(sums), pa.int64())], ["key", "n", "sums"])
