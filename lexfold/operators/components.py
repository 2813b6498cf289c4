"""Connected components by alternating star contractions, with joins and aggregations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfold.storage import forget, written

ROWS = 200_000  # edges of a file, about


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node with an edge to another; edges: u, v, of any ordered type.

    A large star hands every larger neighbour of a node to the node's smallest one, a small star every smaller one;
    both use a minimum per node and a join back, so the neighbours of a hub are never gathered in one place. The
    depth shrinks by a constant factor each round. Loops and repeated edges are allowed. Edges get no more from round to
    round, so a round is written by as many tasks as their number needs.
    """
    spark = edges.sparkSession
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _fingerprint(now)
    while True:
        tasks = max(1, math.ceil(seen[0] / ROWS))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large.coalesce(tasks), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v")
        small = written(handed.union(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "edges")
        forget(spark, now, large)
        now, last = small, seen
        seen = _fingerprint(now)
        if seen == last:
            break
    labels = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return written(labels.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()).coalesce(tasks), "labels")
