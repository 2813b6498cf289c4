"""A partitioned index of vectors by cosine: cells around centres, in blocks, with the exact way kept.

Centres are fitted on a bounded sample; every vector is put into the cell of its nearest centre and written as blocks of
at most BLOCK vectors in the cell's folder, so a cell of any size is many rows. How many cells a search probes is not
guessed: a sample of vectors is searched exactly once, and the least number of nearest cells that holds the asked share of
their true neighbours is stored with the index. On data without clusters that is a large share of all cells.

Searches are for many queries at once. Queries that probe a cell meet each of its blocks in batches of QUERIES, as a
product of matrices; a task keeps the best k of each query, and only these are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexfold.storage import forget, fresh_path, written

SAMPLE = 50_000  # vectors that centres are fitted on, at most
CELLS = 1_000  # at most
PROBES_FROM = 200  # vectors whose exact neighbours tell how many cells to probe
NEIGHBOURS = 50  # of each of these
BLOCK, QUERIES = 2_048, 256
HELD = 32  # batches of queries whose best a task keeps before it passes them on


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """id, v (doubles) of the vectors that have a direction: finite, not all zero, of the given length."""
    v = F.col("v").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("id").cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL").filter(good)
    return rows if size is None else rows.filter(F.size("v") == size)


def centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Directions around which the unit vectors of sample gather, at most cells of them."""
    r = np.random.default_rng(seed)
    c = sample[r.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(sample[k : k + 4096] @ c.T).argmax(1) for k in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1)
        c = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], c)
    return c


def _matrix(b: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, size)


class VectorIndex:
    """An index at a path; see the module."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.schema("size int, probes int, centres array<array<double>>").json(f"{path}/about").first()
        self.size, self.probes, self.centres = about["size"], about["probes"], np.array(about["centres"], np.float64).reshape(-1, about["size"])
        self.blocks = spark.read.schema("ids array<long>, units binary, cell int").parquet(f"{path}/blocks")

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, recall: float = 0.95, cells: int | None = None) -> VectorIndex:
        """Index all usable vectors (id, v) of the commonest length. recall: the mean share of neighbours to be found."""
        spark = vectors.sparkSession
        path = path or fresh_path(spark, "vector-index")
        sizes = usable(vectors).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
        size, n = (sizes[0]["size"], sizes[0]["count"]) if sizes else (1, 0)
        rows = usable(vectors, size)
        share = min(1.0, 2 * SAMPLE / max(1, n))
        some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
        c = centres(_unit(np.array([r["v"] for r in some], np.float64)), cells or min(CELLS, max(1, math.isqrt(n)))) if some else np.zeros((1, size))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    u = _unit(_matrix(b, 1, size))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array((u @ c.T).argmax(1), pa.int32()), pa.array([x.tobytes() for x in u.astype("<f8")])], ["id", "cell", "unit"])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = b.column(1).to_numpy()
                edge = np.flatnonzero(np.diff(cell)) + 1
                for start, end in zip(np.append(0, edge), np.append(edge, len(cell))):
                    for k in range(start, end, BLOCK):
                        s = b.slice(k, min(BLOCK, end - k))
                        yield pa.RecordBatch.from_arrays([pa.array([s.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(s.column(2).to_pylist())]), pa.array([int(cell[k])], pa.int32())], ["ids", "units", "cell"])

        dealt = written(rows.mapInArrow(assign, "id long, cell int, unit binary"), "cells")
        ordered = dealt.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell")
        ordered.mapInArrow(gather, "ids array<long>, units binary, cell int").write.option("compression", "zstd").partitionBy("cell").parquet(f"{path}/blocks")
        about = lambda probes: spark.createDataFrame([(size, probes, c.tolist())], "size int, probes int, centres array<array<double>>").coalesce(1).write.mode("overwrite").json(f"{path}/about")
        about(len(c))
        forget(spark, dealt)
        index = cls(spark, path)
        about(index._probes_for(rows, recall))
        return cls(spark, path)

    def _probes_for(self, rows: DataFrame, recall: float) -> int:
        """The least number of cells that hold, for a sample, the asked share of the exact neighbours."""
        asked = rows.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(PROBES_FROM)
        held = written(asked, "probes")
        where = self.search(held, NEIGHBOURS, exact=True, with_cell=True).groupBy("query").agg(F.collect_list("cell").alias("cells")).collect()  # of a sample
        queries = {r["id"]: r["v"] for r in held.collect()}
        need = []
        for r in where:
            order = np.argsort(-(_unit(np.array([queries[r["query"]]])) @ self.centres.T)[0], kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            need += [(int(rank[x]), 1 / len(r["cells"])) for x in r["cells"]]
        forget(self.spark, held)
        share = np.bincount([x for x, _ in need], [w for _, w in need], minlength=1).cumsum() / max(1, len(where))
        return int(np.argmax(share >= min(recall, share[-1]) - 1e-12)) + 1

    def search(self, queries: DataFrame, k: int, exact: bool = False, probes: int | None = None, with_cell: bool = False) -> DataFrame:
        """query, id, sim: the k nearest of each of queries (id, v), itself included where it is indexed.

        exact: of all vectors, else of those in the nearest cells. Equal ones by id. Queries that are no usable vectors of
        the index's length find nothing.
        """
        size, c, reach = self.size, self.centres, len(self.centres) if exact else min(probes or self.probes, len(self.centres))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    u = _unit(_matrix(b, 1, size))
                    cells = np.argsort(-(u @ c.T), axis=1, kind="stable")[:, :reach]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), reach)), pa.array(cells.ravel(), pa.int32()), pa.array([x.tobytes() for x in u.astype("<f8") for _ in range(reach)], pa.binary())], ["query", "cell", "unit"])

        salt = F.pmod(F.xxhash64("query"), F.lit(max(1, math.ceil(queries.count() / QUERIES)))).alias("batch")
        asked = usable(queries, size).mapInArrow(near, "query long, cell int, unit binary")
        batches = asked.groupBy("cell", salt).agg(F.array_sort(F.collect_list(F.struct("query", "unit"))).alias("x"))  # QUERIES of them, about
        batches = batches.select("cell", "batch", F.col("x.query").alias("queries"), F.col("x.unit").alias("asked"))

        def best(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, tuple[list[int], list]] = {}

            def flush() -> pa.RecordBatch:
                out = [(q, *x) for ids, found in held.values() for q, f in zip(ids, found) for x in zip(*(y.tolist() for y in f))]
                held.clear()
                cols = list(zip(*out)) or [[], [], [], []]
                return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32())], ["query", "id", "sim", "cell"])

            for b in rows:
                for i in range(b.num_rows):
                    cell, batch = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                    ids = b.column(2)[i].as_py()
                    u = np.frombuffer(b"".join(b.column(3)[i].as_py()), "<f8").reshape(-1, size)
                    names = b.column(4)[i].values.to_numpy()
                    sims = u @ np.frombuffer(b.column(5)[i].as_py(), "<f8").reshape(-1, size).T
                    key = (batch, tuple(ids))
                    _, found = held.setdefault(key, (ids, [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))] * len(ids)))
                    for j in range(len(ids)):
                        n, s, w = found[j]
                        n, s, w = np.append(n, names), np.append(s, sims[j]), np.append(w, np.full(len(names), cell))
                        top = np.lexsort((n, -s))[:k]
                        found[j] = (n[top], s[top], w[top])
                    if len(held) > HELD:
                        yield flush()
            yield flush()

        met = batches.join(self.blocks, "cell").select("cell", "batch", "queries", "asked", "ids", "units")
        found = met.mapInArrow(best, "query long, id long, sim double, cell int")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))  # Spark keeps k a query before the shuffle too
        out = found.withColumn("place", place).filter(F.col("place") <= k)
        return out.select("query", "id", "sim", *(["cell"] if with_cell else []))
