"""Duplicate groups: equal hashes, near-equal word trigram sets, similar vectors; and what follows from groups."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfold.batches import fewer_rows
from lexfold.operators.clustering import met_blocks, packed_blocks, unpacked
from lexfold.operators.components import components
from lexfold.storage import forget, written

SHINGLE, LEAST_WORDS = 3, 5
DOCUMENTS = 500  # documents, or pairs with their sets, that go to Python at a time
FEW = 500_000  # rows of identifiers that are broadcast; more are joined by shuffle

U = np.uint64


def hash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (smallest doc_id) of documents that share a non-empty hash with another."""
    groups = docs.filter("sha256 <> ''").groupBy("sha256").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return docs.select("doc_id", "sha256").join(groups.drop("n"), "sha256").select("doc_id", "group_id")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _bands(threshold: float) -> tuple[list[int], list[int]]:
    """Smallest set size of each band, and into how many parts it cuts the range of the hashes.

    Sets of at most m elements whose similarity is the threshold or more differ in at most 2 * m * (1 - threshold) /
    (1 + threshold) elements; of one part more than that, at least one holds the same elements of both.
    """
    edges, parts = [1], []
    while edges[-1] < 1 << 31:
        edges.append(max(edges[-1] + 1, edges[-1] * 13 // 10))
        parts.append(int(2 * (edges[-1] - 1) * (1 - threshold) / (1 + threshold) + 1e-6) + 1)
    return edges, parts


def _signatures(s: np.ndarray, threshold: float, edges: list[int], parts: list[int]) -> np.ndarray:
    """A hash of the elements in each part of a sorted set, for the band of its size and those of larger similar sets."""
    upto = np.concatenate([np.zeros(1, U), np.cumsum(_mix(s), dtype=U)])
    found = []
    for band in range(bisect_right(edges, len(s)) - 1, bisect_right(edges, int(len(s) / threshold + 1e-6))):
        k = parts[band]
        begin = np.arange(k, dtype=U) * U(((1 << 64) - 1) // k)
        at = np.append(np.searchsorted(s, begin), len(s))
        found.append(_mix((upto[at[1:]] - upto[at[:-1]]) ^ _mix(np.arange(k, dtype=U) + U((band + 1) << 40))))
    return np.concatenate(found)


def _trigram_sets(docs: DataFrame, threshold: float, kind: str) -> DataFrame:
    """doc_id, n, key, t, s: size, digest, signatures and sorted hashes of the trigram set of documents with enough words."""
    words = F.array_remove(F.split(F.lower("text"), r"\s+"), "")
    edges, parts = _bands(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            some = np.flatnonzero(n >= LEAST_WORDS)
            if not len(some):
                continue
            w = pc.list_flatten(batch.column(1)).to_numpy().view(U)
            first = np.cumsum(n) - n
            x = _mix(w[:-2])
            for y in (w[1:-1], w[2:]):
                x = _mix(x * U(0x9E3779B97F4A7C15) + y)
            sets = [np.unique(x[first[i] : first[i] + n[i] - SHINGLE + 1]) for i in some]
            signs = [_signatures(s, threshold, edges, parts) for s in sets]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            t = pa.ListArray.from_arrays(np.cumsum([0, *map(len, signs)]).astype(np.int32), np.concatenate(signs).view(np.int64))
            columns = pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary()), t, pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *columns], ["doc_id", "n", "key", "t", "s"])

    return docs.select("doc_id", F.transform(words, lambda x: F.xxhash64(x)).alias("w")).mapInArrow(run, f"doc_id {kind}, n int, key binary, t array<bigint>, s binary")


def _overlaps(pairs: DataFrame, kind: str) -> DataFrame:
    """a, b, na, nb, both: elements that the sets sa and sb of each pair have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) for x, y in zip(batch.column(4), batch.column(5)))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int32())], ["a", "b", "na", "nb", "both"])

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}, na int, nb int, both int")


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is known to be small."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def near_pairs(docs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """a, b, similarity: exact Jaccard of lower-cased word trigram sets of documents of at least five words.

    Documents with equal sets are one class and only its first stands for it, with pairs of the others to it. The range of
    the hashes is cut into more parts than similar sets of about a size can differ in elements, so two of them agree in
    a whole part: only the parts' hashes are shuffled, and only sets of documents that share one are compared. A part has many
    trigrams, so frequent ones bring nothing together.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    with fewer_rows(spark, DOCUMENTS):
        sets = written(_trigram_sets(docs, threshold, kind), "trigrams")
    classes = sets.groupBy("key").agg(F.min("doc_id").alias("rep"))
    copies = written(sets.select("doc_id", "key").join(classes, "key").filter("doc_id <> rep"), "copies")
    parts = sets.join(_small(copies.select("doc_id", "key")), ["doc_id", "key"], "left_anti").select("doc_id", "n", F.explode("t").alias("t"))
    shared = written(parts.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("t"))).filter("m > 1").select("doc_id", "n", "t"), "shared")
    end = lambda e: shared.select(F.col("doc_id").alias(e), F.col("n").alias(f"n{e}"), "t")
    pairs = end("a").join(end("b"), "t").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-6))
    pairs = written(pairs.select("a", "b", "na", "nb").distinct(), "candidates")
    ends = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ends")
    some = written(sets.select("doc_id", "n", "s").join(_small(ends), "doc_id", "left_semi"), "sets")
    of = lambda e: some.select(F.col("doc_id").alias(e), F.col("n").alias(f"n{e}"), F.col("s").alias(f"s{e}"))
    with_sets = pairs.join(of("a"), ["a", "na"]).join(of("b"), ["b", "nb"])
    with fewer_rows(spark, DOCUMENTS):
        near = written(_overlaps(with_sets, kind).withColumn("similarity", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).filter(F.col("similarity") >= threshold).select("a", "b", "similarity"), "near")
    forget(spark, sets, shared, pairs, ends, some)
    same = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"))
    return near.union(same)


def similar_pairs(vectors: DataFrame, low: float, high: float) -> DataFrame:
    """a, b, similarity of vectors (id, v) with low <= cosine < high; exact, in blocks of rows against blocks of rows.

    Vectors are dealt to blocks by hash; two blocks meet once and are multiplied as matrices. The work is quadratic, as
    exactness asks; memory is that of blocks, nothing is copied for the meetings, and only pairs within the band come
    out. A zero vector is similar to nothing.
    """
    blocks, parts = packed_blocks(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (lo, mine, p), (hi, theirs, q) = unpacked(batch, k, "x_"), unpacked(batch, k, "y_")
                p, q = (v / np.where((norm := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, norm) for v in (p, q))
                s = p @ q.T
                i, j = np.nonzero((s >= low) & (s < high))
                once = (mine[i] < theirs[j]) if lo == hi else np.ones(len(i), bool)
                x, y = mine[i][once], theirs[j][once]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(s[i, j][once])], ["a", "b", "similarity"])

    return met_blocks(blocks, parts).filter("x_own <= y_own").mapInArrow(run, "a long, b long, similarity double")


def grouped(pairs: DataFrame) -> DataFrame:
    """doc_id, group_id (smallest member), score (largest similarity of a pair the document is in)."""
    pairs = written(pairs.select("a", "b", "similarity"), "pairs")  # found once
    labels = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    score = pairs.select(F.col("a").alias("node"), "similarity").union(pairs.select("b", "similarity")).groupBy("node").agg(F.max("similarity").alias("score"))
    return labels.join(score, "node").select(F.col("node").alias("doc_id"), F.col("label").alias("group_id"), "score")


def propagate(tags: DataFrame, groups: DataFrame, by: Column | str = "group_id") -> DataFrame:
    """doc_id, tag_id that members of a group should get from each other and do not have yet."""
    given = tags.join(groups, "doc_id").select(by, "tag_id").distinct()
    return groups.join(given, by).select("doc_id", "tag_id").distinct().join(tags.select("doc_id", "tag_id"), ["doc_id", "tag_id"], "left_anti")
