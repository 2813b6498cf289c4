"""Codes of vectors: parts of a vector by the nearest entry of a codebook, found through lower bounds.

A part is cut into segments of equal length. Of the segments' sums and the norms of what is left when their means are
taken away follows a lower bound of a part's distance from an entry: the means' distance times the length, and the
difference of the norms (a triangle inequality), squared and added up. Bounds go from one segment to two, four and
so on; at each level the most promising entry's distance is taken, entries whose bound is over the least distance known
are dropped, and what is left after the finest bound gets exact integer distances. Bounds are lowered by more than their rounding, and equal ones stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfold.llm.common import forget, map_arrow, table, written
from lexfold.llm.vectors import BLOCK, SUMS, as_doubles, by_label, finite, integers, points, summed, sums_batch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SLACK = 1e-9  # of the squared norms, by which bounds are lowered; their rounding is below 1e-12


class Segments:
    """Sums and residual norms of the segments of rows of x, at each level from coarse to fine."""

    def __init__(self, x: np.ndarray):
        v, self.levels, n = x.astype(np.float64), [], 1
        while x.shape[1] % n == 0 and n < x.shape[1] or n == 1:
            cut = v.reshape(len(v), n, -1)
            s = cut.sum(2)
            self.levels.append((s, np.sqrt(np.maximum((cut * cut).sum(2) - s * s / cut.shape[2], 0)), cut.shape[2]))
            n *= 2
        self.slack = SLACK * (v * v).sum(1)


def nearest(x: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the nearest entry of e, of equals the first, and its squared distance."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = Segments(x), Segments(e)

    def bound(level: int, i, j) -> np.ndarray:
        (s, r, n), (t, q, _) = a.levels[level], b.levels[level]
        return (np.square(s[i] - t[j]) / n + np.square(r[i] - q[j])).sum(-1) - a.slack[i] - b.slack[j]

    rows, entries = np.arange(len(x)), np.arange(len(e))
    low = bound(0, rows[:, None], entries[None])
    first = low.argmin(1)
    most = np.square(x - e[first]).sum(1)
    i, j = np.nonzero(low <= most[:, None])  # the first is among them
    for level in range(1, len(a.levels)):
        low = bound(level, i, j)
        begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        best = np.flatnonzero(low == np.minimum.reduceat(low, begin)[i])  # the most promising of each row, some more than once
        np.minimum.at(most, i[best], np.square(x[i[best]] - e[j[best]]).sum(1))
        stay = low <= most[i]  # the entry whose distance this is stays
        i, j = i[stay], j[stay]
    d = np.square(x[i] - e[j]).sum(1)
    begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    least = np.minimum.reduceat(d, begin)
    at = np.flatnonzero(d == least[i])
    at = at[np.concatenate([[True], i[at][1:] != i[at][:-1]])]
    return j[at], least


def _blocks(batches: Iterator[pa.RecordBatch], at: int, parts: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Of each row (columns of lists, points) the row, and its points by vector, part and position."""
    for b in batches:
        for i in range(b.num_rows):
            n = len(b.column(0)[i])
            yield b, i, np.frombuffer(b.column(at)[i].as_py(), "<i4").astype(np.int64).reshape(n, parts, -1)


def _integers(rows: DataFrame, scale: int) -> DataFrame:
    """Blocks of vectors: vec_ids, labels and points as bytes; rows: vec_id, label, embedding of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                b = batch.slice(k, BLOCK)
                held = [pa.array([b.column(c).to_pylist()], pa.list_(b.column(c).type)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*held, pa.array([points(b, 2, scale).astype("<i4").tobytes()])], ["ids", "labels", "points"])

    kind = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["vec_id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("points", T.BinaryType())])
    return written(map_arrow(rows.select("vec_id", "label", "embedding"), run, kind), "code-blocks")


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every kept row of rows (vec_id, embedding, label).

    Kept are vectors of finite components whose length is the commonest among them that `parts` divides (of equally
    common ones the greatest); x becomes floor(scale * x), which must stay within 2^27 in magnitude (a ValueError
    tells). Codebooks begin as the parts of the `entries` smallest vec_ids, of one vec_id the smaller vector first and
    nulls last; where fewer vectors are kept, there are as many entries. Rows that repeat a vec_id count one by one.
    Null labels are a group. Equal distances go to the smaller entry. An empty table gives no rows; other columns are
    ignored. Driver and tasks hold the codebooks; a round reads the blocks and shuffles a sum for each task and entry.
    """
    spark = rows.sparkSession
    whole = rows.filter(finite(F.col("embedding"))).select("vec_id", "label", "embedding")
    sizes = whole.groupBy(F.size("embedding").alias("d")).count().filter((F.col("d") % parts == 0) & (F.col("d") > 0))
    common = sizes.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = common[0]["d"] if common else parts
    kept = as_doubles(whole.filter(F.size("embedding") == d))
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    e = integers(np.array([r["embedding"] for r in start], np.float64), scale).reshape(len(start), parts, d // parts)
    blocks = _integers(kept, scale)
    for _ in range(rounds if len(e) else 0):

        def step(batches: Iterator[pa.RecordBatch], e: np.ndarray = e) -> Iterator[pa.RecordBatch]:
            def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for _, _, x in _blocks(batches, 2, parts):
                    for p in range(parts):
                        names, counts, sums = by_label(nearest(x[:, p], e[:, p])[0], x[:, p])
                        yield names * parts + p, counts, sums

            yield sums_batch(found())

        e = e.copy()
        for key, n, sums in summed(map_arrow(blocks, step, SUMS), ["key"], d // parts):
            e[key // parts, key % parts] = [s // n for s in sums]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x in _blocks(batches, 2, parts):
            found = [nearest(x[:, p], e[:, p]) for p in range(parts)]
            codes = ["".join(f"{c:02x}" for c in row) for row in zip(*(j.tolist() for j, _ in found))]
            error = np.sum([dist for _, dist in found], axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0)[i].values, b.column(1)[i].values, pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = written(map_arrow(blocks, last, kind), "codes")
    forget(spark, blocks)
    of_label = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "code-labels")
    digest = hashlib.sha256(",".join(str(x) for p in range(parts) for entry in e[:, p].tolist() for x in entry).encode()).hexdigest()
    joined = coded.join(of_label, F.col("label").eqNullSafe(F.col("of")))  # Spark broadcasts the sums only where their table is small
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by comparing every part with every entry."""
    out = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS (SELECT vec_id, label, s.s, v[1 + s.s * (len(v) // {parts}) : (s.s + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) s(s))""",
        f"""e0 AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY vec_id, x) - 1 AS j, x FROM p QUALIFY j < {entries})""",
    ]
    for r in range(rounds + 1):
        out.append(f"""d{r} AS (SELECT p.vec_id, p.label, p.s, p.x, e.j, list_sum(list_transform(list_zip(p.x, e.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d FROM p JOIN e{r} e ON e.s = p.s)""")
        out.append(f"""a{r} AS (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, s ORDER BY d, j) = 1)""")
        if r < rounds:
            out.append(f"""m{r} AS (SELECT s, j, list(m ORDER BY i) AS x FROM (SELECT s, j, i, (t - ((t % n) + n) % n) // n AS m FROM (SELECT s, j, i, sum(y) AS t, count(*) AS n
  FROM (SELECT s, j, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY s, j, i)) GROUP BY s, j)""")
            out.append(f"""e{r + 1} AS (SELECT e.s, e.j, CAST(coalesce(m.x, e.x) AS BIGINT[]) AS x FROM e{r} e LEFT JOIN m{r} m ON m.s = e.s AND m.j = e.j)""")
    out.append(f"""coded AS (SELECT vec_id, label, string_agg(printf('%02x', j), '' ORDER BY s) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)""")
    out = [x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out]
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY s, j)) FROM e{rounds}) AS codebooks_sha256
FROM coded"""


OP13_SQL = _sql()
