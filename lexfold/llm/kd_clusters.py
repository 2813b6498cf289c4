"""k-means whose assignments filter candidate centroids down kd-trees.

Each block of vectors has a kd-tree, built once: a node holds the number of its vectors, their sum and their box. In a
round, all centroids are candidates at the root. At a node the candidate nearest to the middle of the box is the
reference; a candidate that is strictly farther than it from every point of the box (it is enough to look at the
box's corner farthest in the candidate's direction) is dropped for all that is below. With one candidate left the
node counts as a whole; at a leaf the vectors meet the candidates that are left. All numbers are integers, so
rounds give the same centroids however vectors are dealt to tasks.
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
from lexfold.llm.vectors import BLOCK, SUMS, as_doubles, by_label, finite, integers, plain, points, squared, summed, sums_batch

K, ROUNDS, DIMENSION, SCALE = 40, 5, 64, 256
LEAF = 16  # vectors of a leaf, at most, unless they are equal


def grown(p: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """A kd-tree over points: their order, and a row (begin, end, left, right) for each node, children -1 at leaves."""
    order, nodes, ahead = np.arange(len(p)), [], [(0, len(p), -1, 0)]
    while ahead:
        a, b, parent, side = ahead.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        nodes.append([a, b, -1, -1])
        if b - a <= leaf:
            continue
        mine = p[order[a:b]]
        wide = mine.max(0) - mine.min(0)
        d = int(wide.argmax())
        if not wide[d]:
            continue
        mid = a + (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(mine[:, d], mid - a)]
        here = len(nodes) - 1
        ahead += [(mid, b, here, 1), (a, mid, here, 0)]
    return order, np.array(nodes, np.int64).reshape(-1, 4)


class Block:
    """Points in the order of a tree, with the sum and box of each node."""

    def __init__(self, p: np.ndarray, nodes: np.ndarray):
        self.p, (self.begin, self.end, self.left, self.right) = p, nodes.T
        running = np.concatenate([np.zeros((1, p.shape[1]), np.int64), np.cumsum(p, axis=0)])
        self.sums = running[self.end] - running[self.begin]
        self.low, self.high = np.empty_like(self.sums), np.empty_like(self.sums)
        for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
            if self.left[i] < 0:
                mine = p[self.begin[i] : self.end[i]]
                self.low[i], self.high[i] = mine.min(0), mine.max(0)
            else:
                self.low[i] = np.minimum(self.low[self.left[i]], self.low[self.right[i]])
                self.high[i] = np.maximum(self.high[self.left[i]], self.high[self.right[i]])

    def filtered(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes assigned as a whole and their centroids, and leaves with the candidates (a row of flags) left to them."""
        top = int(max(np.abs(self.p).max(initial=0), np.abs(c).max(initial=0)))
        most = 8 * self.p.shape[1] * top * top
        z, low, high = plain(c, most), plain(self.low, most), plain(self.high, most)
        norm = (z * z).sum(1)
        at, able = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        whole, owner, leaves, left = [], [], [], []
        while len(at):
            centre = low[at] + high[at]  # twice the middle
            near = norm - centre @ z.T  # squared distance from the middle, but for a term of the node alone
            best = np.where(able, near, np.iinfo(np.int64).max if near.dtype == np.int64 else np.inf).argmin(1)
            for r in np.unique(best):  # the reference of these nodes
                rows = np.flatnonzero(best == r)
                toward = z - z[r]
                corner = high[at[rows]] @ np.maximum(toward, 0).T + low[at[rows]] @ np.minimum(toward, 0).T
                able[rows] &= norm - norm[r] - 2 * corner <= 0  # the reference itself gives 0
            one = able.sum(1) == 1
            whole.append(at[one])
            owner.append(best[one])
            end = ~one & (self.left[at] < 0)
            leaves.append(at[end])
            left.append(able[end])
            at, able = at[~one & ~end], able[~one & ~end]
            at, able = np.concatenate([self.left[at], self.right[at]]), np.concatenate([able, able])
        return np.concatenate(whole), np.concatenate(owner), np.concatenate(leaves), np.concatenate(left)

    def resolved(self, leaves: np.ndarray, left: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the leaves' points, and the nearest candidate of each: of equals the first."""
        sizes = self.end[leaves] - self.begin[leaves]
        if not len(leaves):
            return sizes, sizes
        rows = np.repeat(self.begin[leaves] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        some = np.flatnonzero(left.any(0))
        d = np.where(np.repeat(left[:, some], sizes, axis=0), squared(self.p[rows], c[some]), np.iinfo(np.int64).max)
        return rows, some[d.argmin(1)]

    def sums_of(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Centroids with counts and sums of what is assigned to them."""
        whole, owner, leaves, left = self.filtered(c)
        for k in np.unique(owner):
            mine = whole[owner == k]
            yield np.array([k]), np.array([(self.end[mine] - self.begin[mine]).sum()]), self.sums[mine].sum(0)[None]
        rows, cluster = self.resolved(leaves, left, c)
        yield by_label(cluster, self.p[rows])

    def labels(self, c: np.ndarray) -> np.ndarray:
        whole, owner, leaves, left = self.filtered(c)
        out = np.empty(len(self.p), np.int64)
        for i, k in zip(whole, owner):
            out[self.begin[i] : self.end[i]] = k
        rows, cluster = self.resolved(leaves, left, c)
        out[rows] = cluster
        return out


def _trees(rows: DataFrame, scale: int) -> DataFrame:
    """A row for each block: vec_ids in the tree's order, their points and the tree's nodes, as bytes; rows: vec_id, embedding of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                b = batch.slice(k, BLOCK)
                p = points(b, 1, scale)
                order, nodes = grown(p)
                ids = b.column(0).take(pa.array(order))
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([p[order].astype("<i4").tobytes()]), pa.array([nodes.astype("<i4").tobytes()])], ["ids", "points", "nodes"])

    kind = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["vec_id"].dataType)), T.StructField("points", T.BinaryType()), T.StructField("nodes", T.BinaryType())])
    return written(map_arrow(rows.select("vec_id", "embedding"), run, kind), "kd-trees")


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, Block]]:
    for b in batches:
        for i in range(b.num_rows):
            read = lambda k: np.frombuffer(b.column(k)[i].as_py(), "<i4").astype(np.int64)  # noqa: B023, E731
            yield b.column(0)[i].values, Block(read(1).reshape(-1, d), read(2).reshape(-1, 4))


def kd_kmeans(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept row of rows (vec_id, embedding).

    Kept are vectors of `dimension` finite components; x becomes floor(scale * x), which must stay within 2^27 in
    magnitude (a ValueError tells). Centroids begin as the k vectors with the smallest sha256 of salt and vec_id, of one
    vec_id the smaller vector first; where fewer are kept, there are as many centroids. Rows that repeat a vec_id
    count one by one; a null vec_id is clustered, and begins a centroid only where ids are too few. Equal distances go
    to the smaller number. An empty table gives no rows; other columns are ignored.
    Driver and tasks hold k centroids; a round reads the trees and shuffles k sums for each task.
    """
    spark = rows.sparkSession
    kept = as_doubles(rows.filter((F.size("embedding") == dimension) & finite(F.col("embedding"))).select("vec_id", "embedding"))
    start = kept.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "embedding").limit(k).collect()
    c = integers(np.array([r["embedding"] for r in start], np.float64), scale).reshape(len(start), dimension)
    trees = _trees(kept, scale)
    for _ in range(rounds if len(c) else 0):

        def step(batches: Iterator[pa.RecordBatch], c: np.ndarray = c) -> Iterator[pa.RecordBatch]:
            yield sums_batch(x for _, b in _blocks(batches, dimension) for x in b.sums_of(c))

        c = c.copy()
        for key, n, sums in summed(map_arrow(trees, step, SUMS), ["key"], dimension):
            c[key] = [s // n for s in sums]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, b in _blocks(batches, dimension):
            cluster = b.labels(c)
            distance = np.square(b.p - c[cluster]).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = T.StructType([rows.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    found = written(map_arrow(trees, last, kind), "kd-assigned")
    forget(spark, trees)
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    total = sum(inertia.values())
    about = [(i, inertia[i], total, hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i in sorted(inertia)]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_kmeans(table(spark, sf_dir, "embeddings"))


def _sql(k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE) -> str:
    """The same by comparing every vector with every centroid."""
    parts = [
        f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS (SELECT vec_id, k.v, c, list_sum(list_transform(list_zip(k.v, z.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept k, c{r} z)""")
        parts.append(f"""a{r} AS (SELECT vec_id, v, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, (s - ((s % n) + n) % n) // n AS m FROM (SELECT c, i, sum(x) AS s, count(*) AS n
  FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i)) GROUP BY c)""")
            parts.append(f"""c{r + 1} AS (SELECT z.c, CAST(coalesce(m.v, z.v) AS BIGINT[]) AS v FROM c{r} z LEFT JOIN m{r} m ON m.c = z.c)""")
    parts = [p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts]
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} z ON z.c = a.c"""


OP12_SQL = _sql()
