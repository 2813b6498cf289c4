"""SimHash near-duplicates by a binary trie joined with itself.

A text's fingerprint has the bits that are set in over half of its shingles' hashes. The distinct fingerprints form a
binary trie; pairs of its nodes are traversed together from the root, the bits in which they differ add up, and a pair
is pruned as soon as it is over its budget.

With e errors allowed, a fingerprint of e + 1 blocks is put into e + 1 tries, each beginning with another block and going
round. Of two fingerprints within e errors, one such turn has at most l - 1 errors in its first l blocks, for every l (a
pigeonhole argument on a ring). So the budget of a prefix of l blocks is l - 1: the first block must agree, which
deals each trie into subtrees, and deeper nodes are pruned earlier than by e alone.

Subtrees that are too large for one task are cut further: their pairs of nodes are followed by joins, some bits a round,
until both nodes of a pair are small enough. Within a task, pairs of nodes whose leaves are all linked already are
pruned too, so a dense group is not compared pair by pair, and each task gives a star of each group that it finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfold.llm.common import forget, map_arrow, table, written
from lexfold.operators.components import components

SHINGLE = 3
ERRORS = 3
BITS = 64
STEP = 8  # bits by which too large nodes are cut
LEAST, MOST = 512, 1 << 18  # leaves of a node for one task: more for more fingerprints, up to what a task holds easily
PIECE = 1 << 20  # bytes of a text that are cut into words at once
CHUNK = 1 << 16  # pairs of nodes that are followed at once
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _counts(text: bytes, size: int) -> tuple[np.ndarray, int]:
    """In how many of the text's shingles' hashes each bit is set, and the number of shingles."""
    counts, n, at, last = np.zeros(BITS, np.int64), 0, 0, []
    while at < len(text):
        cut = SPACE.search(text, min(len(text), at + PIECE))
        end = cut.start() if cut else len(text)
        words = last + text[at:end].lower().split()  # bytes: only A-Z and ASCII white space
        at = end
        if len(words) < size:
            last = words
            continue
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(size)))), np.uint64, len(words) - size + 1)
        for k in range(0, len(h), CHUNK):
            counts += np.unpackbits(h[k : k + CHUNK].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        n, last = n + len(h), words[len(words) - size + 1 :]
    if not n and last:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(last), 42)], np.uint64)
        counts, n = np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64), 1
    return counts, n


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, as a signed number; zero without words."""
    counts, n = _counts(text or b"", size)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((fingerprint(t.as_py(), size) for t in texts), pa.int64())], ["doc_id", "fp"])

    kind = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])
    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), run, kind)


def _blocks(errors: int) -> list[int]:
    """Where the blocks of a fingerprint begin."""
    return [BITS * k // (errors + 1) for k in range(errors + 1)]


def _budgets(errors: int, turn: int) -> list[int]:
    """Differing bits allowed in the first p bits of a turn, for p from 0 to BITS."""
    starts = [*_blocks(errors), BITS]
    sizes = [starts[k + 1] - starts[k] for k in range(errors + 1)]
    sizes = sizes[turn:] + sizes[:turn]
    return [0, *(full for full, n in enumerate(sizes) for _ in range(n))]


def _split(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First index within [lo, hi) of sorted keys whose bit (from the left) is set; it is clear at lo and set at hi - 1."""
    low, high, shift = lo.copy(), hi - 1, (BITS - 1 - bit).astype(np.uint64)
    while (high - low > 1).any():
        mid = (low + high) // 2
        one = (key[mid] >> shift & np.uint64(1)).astype(bool)
        high, low = np.where(one, mid, high), np.where(one, low, mid)
    return high


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits in which a and b agree."""
    x = a ^ b
    for k in (1, 2, 4, 8, 16, 32):
        x = x | x >> np.uint64(k)
    return BITS - np.bitwise_count(x).astype(np.int64)


class Trie:
    """Tries over groups of sorted, distinct keys: nodes of key ranges, chains of single children left out."""

    def __init__(self, key: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.key = key
        lo, hi, total, parts = starts, ends, len(starts), []
        while len(lo):
            depth = np.where(hi - lo > 1, _common(key[lo], key[hi - 1]), BITS)
            inner = np.flatnonzero(hi - lo > 1)
            mid = _split(key, lo[inner], hi[inner], depth[inner])
            left = np.full(len(lo), -1)
            left[inner] = total + 2 * np.arange(len(inner))
            total += 2 * len(inner)
            parts.append((lo, hi, depth, left))
            lo, hi = np.stack([lo[inner], mid], 1).ravel(), np.stack([mid, hi[inner]], 1).ravel()
        self.lo, self.hi, self.depth, self.left = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4


def linked(key: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """For each key the first of those it is linked with, over any number of steps, within its group."""
    t, root = Trie(key, starts, ends), np.arange(len(key))
    ahead = [(np.arange(len(starts)), np.arange(len(starts)))]  # pairs of nodes still to be followed, the last first
    runs = np.arange(len(key))  # equal along neighbours of one root
    while ahead:
        a, b = ahead.pop()
        if len(a) > CHUNK:
            ahead.append((a[CHUNK:], b[CHUNK:]))
            a, b = a[:CHUNK], b[:CHUNK]
        one = (runs[t.lo[a]] == runs[t.hi[a] - 1]) & (runs[t.lo[b]] == runs[t.hi[b] - 1]) & (root[t.lo[a]] == root[t.lo[b]])
        depth = np.minimum(t.depth[a], t.depth[b])
        differ = t.key[t.lo[a]] ^ t.key[t.lo[b]]
        errors = np.bitwise_count(np.where(depth > 0, differ >> (BITS - np.maximum(depth, 1)).astype(np.uint64), np.uint64(0)))
        go = ~one & (errors <= budget[depth])
        a, b, depth = a[go], b[go], depth[go]
        found = depth == BITS
        if found.any():
            root = _joined(root, t.lo[a[found]], t.lo[b[found]])
            runs = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        a, b = a[~found], b[~found]
        same = a == b
        x, left = a[~same], b[~same]
        swap = t.depth[x] > t.depth[left]
        x, left = np.where(swap, left, x), np.where(swap, x, left)  # x ends earlier: its children go on with the other
        s = t.left[a[same]]
        ahead += [pair for pair in ((np.concatenate([t.left[x], t.left[x] + 1, s]), np.concatenate([left, left, s + 1])), (np.concatenate([s, s + 1]),) * 2) if len(pair[0])]
    return root


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """root after the groups of u and v are made one, link by link; a group is known by its least index."""
    root = root.copy()
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        root[np.maximum(a, b)] = np.minimum(a, b)
        while (root[root] != root).any():
            root = root[root]


def _stars(errors: int):
    budgets = [np.array(_budgets(errors, k)) for k in range(errors + 1)]
    starts = _blocks(errors)

    def solve(rows: pa.Table) -> pa.RecordBatch:
        turn, key = rows.column(0).to_numpy(), rows.column(4).to_numpy()
        task = np.flatnonzero(np.concatenate([[True], np.any([np.diff(rows.column(k).to_numpy()) != 0 for k in range(4)], axis=0)]))
        ends = np.append(task[1:], len(key))
        u, v = [], []
        for k in np.unique(turn):
            mine = (turn[task] == k) & (ends - task > 1)
            lo, hi = task[mine], ends[mine]
            if not len(lo):
                continue
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
            keys = key[at].view(np.uint64)
            hi = np.cumsum(hi - lo)
            root = linked(keys, np.concatenate([[0], hi[:-1]]), hi, budgets[k])
            far = np.flatnonzero(root != np.arange(len(root)))
            back = starts[k]
            for out, i in ((u, root[far]), (v, far)):
                x = keys[i]
                out.append((x >> np.uint64(back) | x << np.uint64(BITS - back) if back else x).view(np.int64))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cat(u)), pa.array(cat(v))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            held = pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks() if held is not None else pa.Table.from_batches([b])
            same = np.all([held.column(k).to_numpy() == held.column(k)[-1].as_py() for k in range(4)], axis=0)
            done = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last task may go on in the next batch
            if done:
                yield solve(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def _turned(fp: Column, errors: int) -> Column:
    """The turns of a fingerprint, each with its number: block k first."""
    ways = [F.struct(F.lit(k).cast("tinyint").alias("turn"), (fp if not s else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, BITS - s))).alias("key")) for k, s in enumerate(_blocks(errors))]
    return F.inline(F.array(*ways))


def _prefix(key: Column, depth: int) -> Column:
    return key if depth == BITS else F.shiftrightunsigned(key, BITS - depth)


def _tasks(leaves: DataFrame, errors: int, size: int) -> DataFrame:
    """turn, depth, a, b, key: the leaves under each pair of nodes (a = b: one node) that one task follows."""
    spark = leaves.sparkSession
    depth = min(b - a for a, b in zip(_blocks(errors), [*_blocks(errors)[1:], BITS]))
    given = lambda rows, d, a, b: rows.select("turn", F.lit(d).cast("tinyint").alias("depth"), a.alias("a"), b.alias("b"), "key")
    node = _prefix(F.col("key"), depth)
    large = written(leaves.groupBy("turn", node.alias("a")).count().filter(F.col("count") > size).select("turn", "a"), "trie-large")
    if large.isEmpty():
        return given(leaves, depth, node, node)
    out = given(leaves.withColumn("a", node).join(large, ["turn", "a"], "left_anti"), depth, F.col("a"), F.col("a"))
    pairs = large.select("turn", "a", F.col("a").alias("b"), F.lit(0).alias("errors"))
    while True:
        up, depth = depth, min(BITS, depth + STEP)
        bits, low = depth - up, (1 << (depth - up)) - 1
        least = F.element_at(F.array(*(F.lit(_budgets(errors, k)[depth]) for k in range(errors + 1))), F.col("turn") + 1)
        nodes = pairs.select("turn", "a").union(pairs.select("turn", F.col("b").alias("a"))).distinct()
        under = leaves.withColumn("a", _prefix(F.col("key"), up)).join(nodes, ["turn", "a"], "left_semi")
        child = written(under.groupBy("turn", "a", _prefix(F.col("key"), depth).alias("c")).agg(F.count(F.lit(1)).alias("n")), "trie-nodes")
        masks = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("more")) for m in range(1 << bits) if m.bit_count() <= errors))
        left = pairs.join(child.withColumnRenamed("n", "an"), ["turn", "a"]).select("turn", "a", "b", "errors", "c", "an", F.inline(masks))
        left = left.withColumn("errors", F.col("errors") + F.col("more")).filter(F.col("errors") <= least)
        other = F.shiftleft("b", bits).bitwiseOR(F.col("c").bitwiseAND(F.lit(low)).bitwiseXOR(F.col("m")))
        left = left.select("turn", F.col("c").alias("a"), other.alias("b"), "errors", "an").dropDuplicates(["turn", "a", "b"])
        both = left.join(child.select("turn", F.col("c").alias("b"), F.col("n").alias("bn")), ["turn", "b"])
        both = written(both.withColumn("p", F.least("a", "b")).withColumn("q", F.greatest("a", "b")).select("turn", F.col("p").alias("a"), F.col("q").alias("b"), "errors", ((F.col("an") > size) | (F.col("bn") > size)).alias("more")).distinct(), "trie-pairs")
        ready = both.filter(~F.col("more"))
        sides = ready.select("turn", "a", "b", F.col("a").alias("node")).union(ready.filter("a <> b").select("turn", "a", "b", F.col("b").alias("node")))
        out = out.union(given(leaves.withColumn("node", _prefix(F.col("key"), depth)).join(sides, ["turn", "node"]), depth, F.col("a"), F.col("b")))
        pairs = both.filter("more").select("turn", "a", "b", "errors")
        if depth == BITS or pairs.isEmpty():
            return out


def links(fps: DataFrame, errors: int = ERRORS, size: int | None = None) -> DataFrame:
    """u, v: stars of linked fingerprints, whose components are those of all links; fps: fp, distinct, without nulls.

    size: leaves of a node that one task takes.
    """
    spark = fps.sparkSession
    leaves = written(fps.select(_turned(F.col("fp"), errors)), "trie-leaves")
    if size is None:
        size = min(MOST, max(LEAST, leaves.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    tasks = _tasks(leaves, errors, size)
    order = ["turn", "depth", "a", "b"]
    dealt = tasks.repartition(*order).sortWithinPartitions(*order, F.col("key").bitwiseXOR(F.lit(-(1 << 63))))  # unsigned
    return map_arrow(dealt, _stars(errors), T.StructType([T.StructField(c, T.LongType()) for c in ("u", "v")]))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, errors: int = ERRORS) -> DataFrame:
    """doc_id, fingerprint, component_id, n_same (rows of the same fingerprint) for every row of docs (doc_id, text).

    Null, empty and blank texts have fingerprint zero, which links like any other. Texts of fewer words than a shingle
    are one shingle. Rows that repeat a doc_id are linked one by one. A null doc_id is no component's number while the
    component has another. An empty table gives no rows; other columns are ignored.
    """
    held = written(fingerprints(docs, shingle), "simhash")
    fps = written(held.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same")), "simhash-distinct")
    labels = components(links(fps.select("fp"), errors))
    grouped = written(fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "simhash-groups")
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "label").select("fp", "component_id", "n_same")
    out = held.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")
    forget(docs.sparkSession, fps, labels)
    return out


def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
