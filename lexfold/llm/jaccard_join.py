"""Exact set-similarity join on word shingles by partitioning the universe of shingles.

Two sets of n and m shingles with a Jaccard similarity of 3/4 or more differ in at most H = (n + m) / 7 of them. Sets
are grouped in size bands, each twice as wide as the last, so partners lie in the same or neighbouring bands: a set
is indexed in its own band and, where it has smaller partners there, looked up in the band below. In a band, hashes are
cut into segments. If two sets agree in none of the first segments whose weights sum to H + 1, they differ in more than
H shingles: a segment of weight 1 stands for its exact content, one of weight 2 also for every content with one shingle
deleted. Empty segments need no signature, since a segment that only one of the sets fills is itself a difference.

How a band is cut, and whether its segments take exact contents or one-deletion neighbourhoods, is decided by measured
cost: while the sets are first computed, every task counts for each band and scheme the signatures it would emit and a
sketch of their second moment, the pairs they would bring together; sums over all documents give each band the scheme
of least cost. (Bands below FILLED shingles always take single ones: so few don't fill segments reliably.)

Every set emits some segments more than needed (its slack). Signatures that too many different clusters share
(boilerplate) take no part then, as long as a set leaves out no more weight than its slack: the pair still agrees
elsewhere. A pair must share as many signatures as its slack promises, less what was left out; what remains is pruned
by a lower bound from bucket counts (sketches, which the first reading gives for every set) and verified on whole sets,
which a second reading gives for the sets still in question only. Signatures many sets of one task share never meet
in one place: all but one of the sets skip the shuffle of signatures. Large clusters of near copies are first merged
through a few anchor signatures, and pairs within a merged cluster need no comparison.

Only sets that left out more than their slack (members of large families that are not quite similar) could miss each
other: those that share left-out signatures, directly or through others, form families, compared by blocks of bounded
size as products of incidence matrices, which give exact overlaps and emit nothing but links. This part alone grows
with the square of a family of different sets.

Documents with equal sets are one class throughout, known by the 128-bit digest of the set; signatures carry 48 bits of
it, and sets that agree in those are taken as candidates of each other.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.llm.common import forget, table, written
from lexfold.llm.packing import slices
from lexfold.operators.components import components

K = 5  # words of a shingle
SMALL_GROUP = 16  # clusters sharing a signature that are compared pair by pair at once
ANCHORS = 4  # segments through which large groups are first merged
SLACK = 0.06  # share of the largest size of a band that its sets emit beyond what they need
FILLED = 32  # bands of smaller sets have no choice of scheme
SCHEMES = ((0, 1), (2, 1), (4, 2))  # shingles a segment at the top of a band (0: each its own), weight of a segment
PAIR_COST = 0.25  # of a pair that signatures bring together, in signatures
COUNTERS = 256  # of the sketch of a scheme's pairs
SHARD_BYTES = 8 << 20  # of signatures that meet in one place, about
FLUSH_BYTES, FLUSH_CLASSES = 3 << 20, 30_000
TEXTS = 1_000  # texts that go to Python at a time
SLICE = 1 << 20  # bytes of text that are hashed at once
BLOCK, BLOCK_SHINGLES, COLUMNS = 1_000, 1 << 20, 4_096  # sets and their shingles in a block; shared shingles multiplied at once
BITMAP = 1 << 26  # most bits of the filter that spares other documents the second reading; any number of ids is correct

U = np.uint64
M1, M2, M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def band_edges(up_to: int = 1 << 40) -> list[int]:
    """Smallest size of each band; a set and any partner of at least 3/4 its size are at most one band apart."""
    edges = [1]
    while edges[-1] < up_to:
        edges.append(2 * edges[-1])
    return edges


EDGES = np.array(band_edges(), np.int64)


def cut(schemes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Segments of each band, and whether they take one-deletion neighbourhoods."""
    segments, paired = np.full(len(EDGES) - 1, 1 << 31, np.int64), np.zeros(len(EDGES) - 1, bool)
    for band in range(len(segments)):
        top = int(EDGES[band + 1]) - 1
        load, weight = SCHEMES[schemes.get(band, 1)] if top >= FILLED else SCHEMES[0]
        if load:
            segments[band] = min(1 << 31, max(1, top // load))
            paired[band] = weight == 2
    return segments, paired


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n, x, U)])) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts in A-Z folded to lower case, one after the other, and the number of words of each text.

    A word's bytes are the digits of a number modulo 2**64, taken from running sums over all bytes; words of over 200
    bytes, where such sums can be made to collide on purpose, are hashed one by one.
    """
    low = pc.ascii_lower(texts)
    offsets = np.frombuffer(low.buffers()[1], np.int32, len(low) + 1, 4 * low.offset).astype(np.int64)
    a, z = int(offsets[0]), int(offsets[-1])
    if z == a:
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8, z - a, a)
    offsets = offsets - a
    gap = SPACE[data]
    fresh = np.ones(len(data) + 1, bool)  # a word can begin here: after a gap, or with a text
    fresh[1:-1] = gap[:-1]
    fresh[offsets] = True
    begin = np.flatnonzero(~gap & fresh[:-1])
    stop = np.ones(len(data), bool)
    stop[:-1] = gap[1:] | fresh[1:-1]
    end = np.flatnonzero(~gap & stop) + 1
    power, back = _powers(len(data))
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * power[: len(data)])])
        word = _mix((run[end] - run[begin]) * back[begin] + (end - begin).astype(U) * M3)
    for i in np.flatnonzero(end - begin > 200):
        word[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes())
    return word, np.bincount(np.searchsorted(offsets, begin, side="right") - 1, minlength=len(texts))


class Shingles:
    """Sets of hashed word shingles of texts, one after the other: h (sorted and distinct within a text) and start."""

    def __init__(self, texts: pa.Array):
        word, count = word_hashes(texts)
        upto = np.concatenate([[0], np.cumsum(count)])
        n = len(word)
        with np.errstate(over="ignore"):
            h = np.zeros(n, U)
            for k in range(K):
                h[: max(n - k, 0)] = _mix(h[: max(n - k, 0)] ^ word[k:]) + M3
            doc = np.repeat(np.arange(len(count)), count)
            full = (np.arange(n) + K <= upto[1:][doc]) if n else np.zeros(0, bool)
            short = np.flatnonzero((count > 0) & (count < K))
            extra = np.zeros(len(short), U)
            for j, d in enumerate(short):  # fewer words than a shingle: the sequence as one, its length in the hash
                x = U(count[d])
                for w in word[upto[d] : upto[d + 1]]:
                    x = _mix(x ^ w) + M3
                extra[j] = x
        h, doc = np.concatenate([h[full], extra]), np.concatenate([doc[full], short])
        order = np.lexsort((h, doc)) if len(short) else None
        if order is None:  # texts are in order already: sort each by itself
            for a, b in zip(*(lambda s: (s[:-1], s[1:]))(np.searchsorted(doc, np.arange(len(count) + 1)))):
                h[a:b].sort()
        else:
            h, doc = h[order], doc[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.h, self.doc = h[keep], doc[keep]
        self.start = np.searchsorted(self.doc, np.arange(len(count) + 1))
        self.n = np.diff(self.start)

    def digests(self) -> np.ndarray:
        """(texts, 2) digest of each set; an empty set's is zero."""
        out = np.zeros((len(self.n), 2), U)
        with np.errstate(over="ignore"):
            a, b = _mix(self.h + M3), _mix(self.h ^ M1)
        some = np.flatnonzero(self.n)
        if len(some):
            out[some, 0] = np.add.reduceat(a, self.start[some])
            out[some, 1] = np.add.reduceat(b, self.start[some])
        return out


def nodes(digests: np.ndarray) -> pa.Array:
    """Digests as 16-byte strings."""
    return pa.Array.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(np.ascontiguousarray(digests.astype(">u8")).tobytes())]).cast(pa.binary())


def signatures(h: np.ndarray, doc: np.ndarray, n: np.ndarray, lower: bool, segments: np.ndarray, paired: np.ndarray) -> tuple[np.ndarray, ...]:
    """In a set's own band, or the one below: (signature, doc, weight, anchor) each emitted; and per set the band and its
    slack (weight emitted beyond H + 1; -1 where segments are too few). h, doc: the sets, one after the other."""
    band = np.searchsorted(EDGES, np.maximum(n, 1), side="right") - 1 - lower
    part = n > 0
    if lower:
        part &= band >= 0
        band = np.maximum(band, 0)
        part &= (3 * n + 3) // 4 <= EDGES[band + 1] - 1
        differ = (n + EDGES[band + 1] - 1) // 7
    else:
        differ = (n + 4 * n // 3) // 7
    slack = np.ceil(SLACK * EDGES[band + 1]).astype(np.int64) + 2  # one for a band: what two sets can leave out must not differ
    use = part[doc]
    h, doc = h[use], doc[use]
    with np.errstate(over="ignore"):
        seg = ((h >> U(32)) * segments[band][doc].astype(U)) >> U(32)
        element = _mix(h ^ M2)
        first = np.ones(len(h), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1])
        at = np.flatnonzero(first)
        if not len(at):
            zero = np.zeros(0, np.int64)
            return np.zeros(0, U), zero, zero, zero.astype(bool), band, np.where(part, -1, 0)
        size = np.diff(np.append(at, len(h)))
        content = np.add.reduceat(element, at)
        owner, place = doc[at], seg[at]
        weight = np.where(paired[band][owner] & (size > 1), 2, 1)
        upto = np.cumsum(weight)
        head = np.searchsorted(owner, np.arange(len(n)))
        before = upto - weight - np.concatenate([upto - weight, [0]])[head][owner]
        kept = before < (differ + 1 + slack)[owner]
        emitted = np.bincount(owner[kept], weight[kept], len(n)).astype(np.int64)
        salt = _mix(place + (band[owner].astype(U) << U(40)) + M3)
        exact = _mix(content[kept] ^ salt[kept])
        who, w, anchor = owner[kept], weight[kept], (before[kept] < ANCHORS) & (not lower)
        wide = kept & (weight == 2)
        if wide.any():
            each = np.repeat(wide, size)
            of = np.repeat(np.arange(len(at)), size)[each]
            exact = np.concatenate([exact, _mix((content[of] - element[each]) ^ salt[of])])
            who, w, anchor = np.concatenate([who, owner[of]]), np.concatenate([w, weight[of]]), np.concatenate([anchor, np.zeros(len(of), bool)])
        left = np.where(part, np.maximum(emitted - differ - 1, -1), 0)
        poor = np.flatnonzero(left < 0)  # too few segments filled: these meet each other under one signature
        if len(poor):
            exact = np.concatenate([exact, _mix(band[poor].astype(U) ^ M1)])
            who, w, anchor = np.concatenate([who, poor]), np.concatenate([w, np.ones(len(poor), np.int64)]), np.concatenate([anchor, np.zeros(len(poor), bool)])
    return exact, who, w, anchor, band, left


class Measure:
    """Signatures that each band's sets would emit under each scheme, and a sketch of how many pairs would share one."""

    def __init__(self):
        self.cuts = [cut(dict.fromkeys(range(len(EDGES)), k)) for k in range(len(SCHEMES))]
        self.emitted = np.zeros((len(EDGES), len(SCHEMES)), np.int64)
        self.z = np.zeros((len(EDGES), len(SCHEMES), COUNTERS), np.int64)

    def add(self, sets: Shingles) -> None:
        big = sets.n >= FILLED
        if not big.any():
            return
        take = big[sets.doc]
        h, doc = sets.h[take], sets.doc[take]
        n = np.where(big, sets.n, 0)
        for k in range(len(SCHEMES)):
            sig, who, _, _, band, _ = signatures(h, doc, n, False, *self.cuts[k])
            cell = band[who] * COUNTERS + (sig % U(COUNTERS)).astype(np.int64)
            sign = (sig >> U(40) & U(1)).astype(np.int64) * 2 - 1
            self.emitted[:, k] += np.bincount(band[who], minlength=len(EDGES))
            self.z[:, k] += np.bincount(cell, sign, len(EDGES) * COUNTERS).astype(np.int64).reshape(-1, COUNTERS)

    def rows(self) -> list[tuple[int, int, int, list[int]]]:
        return [(int(b), int(k), int(self.emitted[b, k]), self.z[b, k].tolist()) for b, k in zip(*np.nonzero(self.emitted))]


def least_cost(measured: DataFrame) -> tuple[dict[int, int], int]:
    """Scheme of each band, and how many signatures sets emit in their own bands; measured: band, scheme, emitted, z."""
    cells = measured.select("band", "scheme", F.posexplode("z").alias("cell", "z")).groupBy("band", "scheme", "cell").agg(F.sum("z").cast("double").alias("z"))
    moment = cells.groupBy("band", "scheme").agg(F.sum(F.col("z") * F.col("z")).alias("f2"))
    found = measured.groupBy("band", "scheme").agg(F.sum("emitted").alias("emitted")).join(moment, ["band", "scheme"]).collect()  # a row a band and scheme
    cost = {(r["band"], r["scheme"]): r["emitted"] + PAIR_COST * max(0.0, r["f2"] - r["emitted"]) / 2 for r in found}
    best = {b: min((c, k) for (x, k), c in cost.items() if x == b)[1] for b in {b for b, _ in cost}}
    return best, sum(r["emitted"] for r in found if best[r["band"]] == r["scheme"])


#: One run of signatures of a set: 48 bits of its digest, band with weight (64) and anchor (128), slack + 1 (up to 127)
#: with 128 for what many sets of the task share, and how many signatures follow.
RUN = np.dtype([("lo", "<u4"), ("hi", "<u2"), ("band", "u1"), ("left", "u1"), ("count", "u1")])
#: A set that shares a signature with many of its task: the signature's name, the set, the one that went on for all.
DIRECT = np.dtype([("sig", "<i8"), ("u", "<i8"), ("hub", "<i8"), ("band", "u1"), ("left", "u1")])


def short_id(digest: np.ndarray) -> np.ndarray:
    return (digest[:, 0] >> U(16)).astype(np.int64)


def _blobs(h: np.ndarray, doc: np.ndarray, n: np.ndarray, digest: np.ndarray, shards: int, segments: np.ndarray, paired: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Signatures of sets by shard (runs, then 4 bytes of each signature), and under negative shards what goes round them."""
    ids = short_id(digest)
    sig, who, flag, left = [], [], [], []
    for lower in (False, True):
        s, w, weight, anchor, band, slack = signatures(h, doc, n, lower, segments, paired)
        sig.append(s)
        who.append(w)
        flag.append((band[w] + 64 * (weight == 2) + 128 * anchor).astype(np.uint8))
        left.append((np.minimum(slack, 126) + 1)[w].astype(np.uint8))
    s, w, f, left = (np.concatenate(x) for x in (sig, who, flag, left))
    shard = ((s >> U(32)) % U(shards)).astype(np.int64)
    name = shard << 32 | (s & U(0xFFFFFFFF)).astype(np.int64)
    order = np.lexsort((w, name))
    name, w, f, left, shard = name[order], w[order], f[order], left[order], shard[order]
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (w[1:] != w[:-1])
    if not fresh.all():  # two signatures of a set under one name count once: the set promises less
        twice = np.bincount(w[~fresh], 1 + (f[~fresh] >> 6 & 1), len(n)).astype(np.int64)
        left = np.maximum(left.astype(np.int64) - twice[w], 0).astype(np.uint8)
    name, w, f, left, shard = name[fresh], w[fresh], f[fresh], left[fresh], shard[fresh]
    begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(name)))
    many = np.repeat(size > SMALL_GROUP, size)
    hub = np.repeat(begin, size)
    around = np.flatnonzero(many & (np.arange(len(name)) != hub))
    if len(around):
        out = np.zeros(len(around), DIRECT)
        out["sig"], out["u"], out["hub"], out["band"], out["left"] = name[around], ids[w[around]], ids[w[hub[around]]], f[around], left[around]
        for a in range(0, len(out), 40_000):
            yield -1 - (int(name[around[a]]) + a) % shards, out[a : a + 40_000].tobytes()
        left = left | (many * 128).astype(np.uint8)
        stay = np.ones(len(name), bool)
        stay[around] = False
        name, w, f, left, shard = name[stay], w[stay], f[stay], left[stay], shard[stay]
    order = np.lexsort((left, f, w, shard))
    name, w, f, left, shard = name[order], w[order], f[order], left[order], shard[order]
    where = np.searchsorted(shard, np.arange(shards + 1))
    for k in range(shards):
        mine = slice(where[k], where[k + 1])
        if where[k] == where[k + 1]:
            continue
        x, y, z = w[mine], f[mine], left[mine]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
        at = np.flatnonzero(new)
        new |= (np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))) % 255 == 0  # counts are of one byte
        at = np.flatnonzero(new)
        runs = np.zeros(len(at), RUN)
        who = ids[x[at]]
        runs["lo"], runs["hi"], runs["band"], runs["left"], runs["count"] = who & 0xFFFFFFFF, who >> 32, y[at], z[at], np.diff(np.append(at, len(x)))
        yield k, b"".join((len(at).to_bytes(4, "little"), runs.tobytes(), name[mine].astype("<u4").tobytes()))


def _open(blob: bytes) -> tuple[np.ndarray, ...]:
    """Low part of the name, set, band with flags, and slack + 1 with a flag, of each signature."""
    k = int.from_bytes(blob[:4], "little")
    runs = np.frombuffer(blob, RUN, k, 4)
    ids = runs["lo"].astype(np.int64) | runs["hi"].astype(np.int64) << 32
    each = lambda x: np.repeat(x, runs["count"])
    return np.frombuffer(blob, "<u4", offset=4 + k * RUN.itemsize), each(ids), each(runs["band"]), each(runs["left"])


def release() -> None:
    """Give freed memory back to the system at the end of a task, as workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def _emit_signatures(docs: DataFrame, shards: int, schemes: dict[int, int]) -> DataFrame:
    segments, paired = cut(schemes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, np.ndarray]] = {}
        seen, held_bytes = set(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            n = np.array([k for k, _ in held.values()], np.int64)
            h = np.concatenate([x for _, x in held.values()])
            digest = np.frombuffer(b"".join(held), ">u8").reshape(-1, 2).astype(U)
            rows = list(_blobs(h, np.repeat(np.arange(len(n)), n), n, digest, shards, segments, paired))
            held.clear()
            for a in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[a : a + 64]], pa.int32()), pa.array([b for _, b in rows[a : a + 64]], pa.binary())], ["shard", "blob"])

        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            for a, b in slices(texts, SLICE):
                sets = Shingles(texts.slice(a, b - a))
                keys = sets.digests().astype(">u8")
                for i in np.flatnonzero(sets.n):
                    key = keys[i].tobytes()
                    if key not in seen and key not in held:  # copies within a task are one
                        held[key] = int(sets.n[i]), sets.h[sets.start[i] : sets.start[i + 1]].copy()
                        held_bytes += 8 * int(sets.n[i])
                    if held_bytes > FLUSH_BYTES or len(held) >= FLUSH_CLASSES:
                        if len(seen) < 200_000:
                            seen.update(held)
                        yield from flush()
                        held_bytes = 0
        yield from flush()
        seen.clear()
        release()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "shard int, blob binary")


GROUPS = "kind int, u long, v long, sig long, band int, weight int, slack int, shared int"


def _rows(kind: int, u: np.ndarray, v: np.ndarray | None, sig: np.ndarray | None, flag: np.ndarray, left: np.ndarray, shared: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(u), 50_000):
        z = slice(a, a + 50_000)
        m = len(u[z])
        part = lambda x, t: pa.nulls(m, t) if x is None else pa.array(np.ascontiguousarray(x[z]), t)
        i32 = lambda x: pa.array(x[z].astype(np.int32))
        columns = [pa.array(np.full(m, kind, np.int32)), part(u, pa.int64()), part(v, pa.int64()), part(sig, pa.int64()), i32(flag & 63), i32(1 + (flag >> 6 & 1)), i32(left), pa.nulls(m, pa.int32()) if shared is None else i32(shared)]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "u", "v", "sig", "band", "weight", "slack", "shared"])


def _group(shards: DataFrame) -> DataFrame:
    """kind 0: candidate pairs (u, v) with how many signatures they share here, and their lesser slack; kind 1: members
    (u) of a signature that more than SMALL_GROUP classes share."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        if shard < 0:  # each row for itself
            for b in batches:
                for blob in b.column(1).to_pylist():
                    d = np.frombuffer(blob, DIRECT)
                    yield from _rows(1, d["u"], None, d["sig"], d["band"], d["left"].astype(np.int64) - 1, None)
                    star = d[(d["band"] & 128 > 0) & (d["u"] != d["hub"])]
                    yield from _rows(0, np.minimum(star["u"], star["hub"]), np.maximum(star["u"], star["hub"]), None, star["band"], np.full(len(star), -1), np.ones(len(star), np.int64))
            return
        opened = [_open(blob) for b in batches for blob in b.column(1).to_pylist()]
        sig, c, flag, left = (np.concatenate(x) for x in zip(*opened))
        del opened
        order = np.lexsort((c, sig))
        sig, c, flag, left = sig[order], c[order], flag[order], left[order]
        once = np.ones(len(sig), bool)
        once[1:] = (sig[1:] != sig[:-1]) | (c[1:] != c[:-1])
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        shared_by_many = np.maximum.reduceat(left >> 7, begin) > 0
        where = np.cumsum(once) - 1
        sig, c, flag, left = sig[once], c[once], flag[once], left[once]
        begin = where[begin]
        size = np.diff(np.append(begin, len(sig)))
        large = shared_by_many | (size > SMALL_GROUP)
        group = np.repeat(np.arange(len(begin)), size)
        slack = (left & 127).astype(np.int64) - 1
        pairs = []
        small = np.flatnonzero(((size > 1) & ~large)[group])
        for k in range(1, SMALL_GROUP):
            i = small[small + k < len(sig)]
            i = i[group[i] == group[i + k]]
            if not len(i):
                break
            pairs.append(np.stack([c[i], c[i + k], (flag[i] & 127).astype(np.int64), np.minimum(slack[i], slack[i + k])], 1))
        star = np.flatnonzero(large[group] & ((flag & 128) > 0))
        hub = begin[group[star]]
        star, hub = star[star != hub], hub[star != hub]
        pairs.append(np.stack([np.minimum(c[hub], c[star]), np.maximum(c[hub], c[star]), (flag[star] & 127).astype(np.int64), np.full(len(star), -1)], 1))
        pair, shared = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        yield from _rows(0, pair[:, 0], pair[:, 1], None, pair[:, 2], pair[:, 3], shared)
        big = np.flatnonzero(large[group])
        yield from _rows(1, c[big], None, sig[big].astype(np.int64) | np.int64(shard) << 32, flag[big], slack[big], None)
        del sig, c, flag, left, order, once, where, group, slack, pairs, pair, shared
        release()

    return shards.groupBy("shard").applyInArrow(run, GROUPS)


SETS = "doc_id long, h long, n_shingles long, node binary, sketch binary, band int, scheme int, emitted long, z array<long>"


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, node (digest of the set), sketch per row; and rows of measured costs, whose
    node is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "n_shingles", "node", "sketch", "band", "scheme", "emitted", "z"]
        measure = Measure()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in slices(texts, SLICE):
                sets = Shingles(texts.slice(a, b - a))
                measure.add(sets)
                m = b - a
                sketches = [sketch(sets.h[sets.start[i] : sets.start[i + 1]]) for i in range(m)]
                none = [pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), batch.column(2).slice(a, m), pa.array(sets.n.astype(np.int64)), nodes(sets.digests()), pa.array(sketches, pa.binary()), *none], names)
        rows = measure.rows()
        if rows:
            m = len(rows)
            of = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), *of], names)
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text")).mapInArrow(run, SETS)


def sketch(h: np.ndarray) -> bytes:
    """Counts of the hashes in about n / 3 buckets of equal width, a power of two of them; empty if one is over 255."""
    k = max(8, 1 << max(0, int(len(h) // 4).bit_length()))
    n = np.bincount((h >> U(64 - k.bit_length() + 1)).astype(np.int64), minlength=k)
    return b"" if n.max() > 255 else n.astype(np.uint8).tobytes()


def differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of how many elements two sets differ in, from their sketches."""
    if not a or not b:
        return 0
    a, b = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if len(a) > len(b):
        a = a.reshape(len(b), -1).sum(1)
    elif len(b) > len(a):
        b = b.reshape(len(a), -1).sum(1)
    return int(np.abs(a - b).sum())


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, elements of the classes in wanted (a table of node, doc_id of a document that has the set).

    A bitmap of bounded size says which documents may be wanted; only their sets leave the reading tasks.
    """
    spark = docs.sparkSession
    bits = min(BITMAP, max(1 << 12, 1 << (16 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    lanes = wanted.select(bit.alias("b")).select(F.floor(F.col("b") / 32).cast("int").alias("w"), F.expr("shiftleft(1L, cast(b % 32 AS int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    bitmap = np.zeros(bits // 32, np.int64)
    got = lanes.toPandas()  # at most BITMAP / 32 rows, however many are wanted
    bitmap[got["w"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(bitmap.astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            b = batch.column(1).to_numpy()
            mine = np.flatnonzero(bits[b >> 5] >> (b & 31).astype(np.uint32) & 1)
            if not len(mine):
                continue
            texts = pc.fill_null(batch.column(0).take(pa.array(mine)), "")
            for x, y in slices(texts, SLICE):
                sets = Shingles(texts.slice(x, y - x))
                some = np.flatnonzero(sets.n)
                parts = [sets.h[sets.start[i] : sets.start[i + 1]].astype("<u8").tobytes() for i in some]
                yield pa.RecordBatch.from_arrays([nodes(sets.digests()[some]), pa.array(parts, pa.binary())], ["node", "elements"])
        release()

    found = docs.select(F.col("text").cast("string").alias("text"), bit.cast("long").alias("b")).mapInArrow(run, "node binary, elements binary")
    return found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("elements").alias("elements"))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 400):
    """Fewer rows go to Python at a time, where each holds whole sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _promising(grouped: DataFrame, members: DataFrame, paired: np.ndarray) -> DataFrame:
    """Pairs (u, v) that share as many signatures as similar sets must, given what went to large groups; and those of anchors."""
    lost = members.groupBy("u", "band").agg(F.sum("weight").alias("lost"))
    of = lambda end: lost.select(F.col("u").alias(end), "band", F.col("lost").alias(f"lost_{end}"))
    pairs = grouped.filter("kind = 0").groupBy("u", "v", "band").agg(F.sum("shared").alias("shared"), F.min("slack").alias("slack"))
    pairs = pairs.join(of("u"), ["u", "band"], "left").join(of("v"), ["v", "band"], "left")
    gone = F.least(F.coalesce("lost_u", F.lit(0)), F.coalesce("lost_v", F.lit(0)))
    need = F.col("slack") + 1 - gone
    # a one-deletion neighbourhood stands for two units of weight with a single shared signature
    need = F.when(F.col("band").isin([int(b) for b in np.flatnonzero(paired)]), F.ceil(need / 2)).otherwise(need)
    return pairs.filter(F.col("shared") >= need).select("u", "v").distinct()


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (u, v: digests) that connect what all similar pairs (u, v: short ids) do: of a task's, a spanning forest."""
    spark = docs.sparkSession

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            ok = [differ_at_least(x, y) <= s // 7 for x, y, s in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["u", "v"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grows = Forest().grows
        for b in batches:
            ok = []
            for u, v, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                ok.append(100 * both >= 75 * (len(x) + len(y) - both) and grows(u, v))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["u", "v"])

    end = lambda e: classes.select(F.col("id").alias(e), F.col("node").alias(f"node_{e}"), F.col("n").alias(f"n{e}"), F.col("sketch").alias(f"x{e}"))
    sized = pairs.join(end("u"), "u").join(end("v"), "v").filter(SIMILAR).filter("node_u <> node_v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"), "nu", "nv", "xu", "xv")
    near = written(sized.mapInArrow(prune, "u binary, v binary"), "near")
    ends = near.select(F.col("u").alias("node")).union(near.select(F.col("v").alias("node"))).distinct()
    wanted = written(ends.join(classes, "node").select("node", "doc_id"), "wanted")
    with small_batches(spark, TEXTS):
        sets = written(_sets_of(docs, wanted), "sets")
    with_sets = near.join(sets.select(F.col("node").alias("u"), F.col("elements").alias("xu")), "u").join(sets.select(F.col("node").alias("v"), F.col("elements").alias("xv")), "v")
    with small_batches(spark):
        links = written(with_sets.select("u", "v", "xu", "xv").mapInArrow(verify, "u binary, v binary"), "links")
    forget(spark, wanted, sets, near)
    return links


SIMILAR = "100 * least(nu, nv) >= 75 * greatest(nu, nv)"


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each set of left with each of right."""
    parts = [np.concatenate(x) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right)]
    shared = np.intersect1d(*parts)
    at = [np.minimum(np.searchsorted(shared, p), max(len(shared) - 1, 0)) for p in parts]
    real = [shared[a] == p if len(shared) else np.zeros(len(p), bool) for a, p in zip(at, parts)]
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, len(shared), COLUMNS):
        m = []
        for x, r, a, ok in zip((left, right), rows, at, real):
            mine = ok & (a >= c) & (a < c + COLUMNS)
            dense = np.zeros((len(x), min(COLUMNS, len(shared) - c)), np.float32)
            dense[r[mine], a[mine] - c] = 1
            m.append(dense)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


class Forest:
    """Tells of links, one after the other, which connect what those before did not."""

    def __init__(self):
        self.root: dict = {}

    def _find(self, u):
        root = self.root
        while (v := root.setdefault(u, u)) != u:
            root[u] = u = root[v]
        return u

    def grows(self, u, v) -> bool:
        u, v = self._find(u), self._find(v)
        self.root[u] = v
        return u != v


def _families(beyond: DataFrame) -> DataFrame:
    """beyond with family in place of sigs: sets of it that are tied by signatures they left out (sigs)."""
    spark = beyond.sparkSession

    def connecting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # most signatures of a set tell nothing new
        grows = Forest().grows
        for b in batches:
            ties = [(u, b"signature%d" % s) for u, sigs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in sigs]
            ties = [(u, v) for u, v in ties if grows(u, v)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in ties], pa.binary()), pa.array([v for _, v in ties], pa.binary())], ["u", "v"])

    labels = components(beyond.select("u", "sigs").mapInArrow(connecting, "u binary, v binary"))
    out = written(beyond.drop("sigs").join(labels.select(F.col("node").alias("u"), F.col("label").alias("family")), "u"), "families")
    forget(spark, labels)
    return out


def _blocks(docs: DataFrame, classes: DataFrame, families: DataFrame) -> DataFrame:
    """u, v: links between sets of families (u, n, band, comp, family) of one band and family and different clusters."""
    spark = docs.sparkSession
    sizes = families.groupBy("band", "family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("k"))
    wanted = written(families.select(F.col("u").alias("node")).distinct().join(classes, "node").select("node", "doc_id"), "wanted")
    with small_batches(spark, TEXTS):
        sets = written(_sets_of(docs, wanted).select(F.col("node").alias("u"), "elements"), "sets")
    rows = families.join(sizes, ["band", "family"]).withColumn("own", F.pmod(F.xxhash64("u"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("u", "comp", "own", "band", "family", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).join(sets, "u")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        lo, hi = key[2].as_py(), key[3].as_py()
        own = t.column("own").to_numpy()
        names, comp = np.array(t.column("u").to_pylist(), object), np.unique(np.array(t.column("comp").to_pylist(), object), return_inverse=True)[1]
        x, y = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if not len(x) or not len(y):
            return
        found = [np.frombuffer(e, U) for e in t.column("elements").to_pylist()]
        n = np.array([len(e) for e in found])
        both = _overlaps([found[i] for i in x], [found[i] for i in y])
        near = (100 * both >= 75 * (n[x][:, None] + n[y][None, :] - both)) & (comp[x][:, None] != comp[y][None, :])
        if lo == hi:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        grows = Forest().grows
        tree = [k for k, (u, v) in enumerate(zip(x[i].tolist(), y[j].tolist())) if grows(u, v)]  # links that connect what all of the block's do
        i, j = i[tree], j[tree]
        yield pa.RecordBatch.from_arrays([pa.array(names[x[i]].tolist(), pa.binary()), pa.array(names[y[j]].tolist(), pa.binary())], ["u", "v"])
        del t, found, both, near
        release()

    with small_batches(spark):
        links = written(rows.groupBy("band", "family", "lo", "hi").applyInArrow(run, "u binary, v binary"), "links")
    forget(spark, wanted, sets)
    return links


def jaccard_links(docs: DataFrame, classes: DataFrame, schemes: dict[int, int], shards: int) -> DataFrame:
    """u, v: links between classes that connect all sets of similarity 3/4 or more. classes: id, node, n, sketch, doc_id."""
    spark = docs.sparkSession
    _, paired = cut(schemes)
    with small_batches(spark, TEXTS):
        grouped = written(_group(_emit_signatures(docs, shards, schemes)), "groups")
    # copies of a class in other tasks repeat its memberships
    members = written(grouped.filter("kind = 1").groupBy("u", "sig").agg(*(F.first(c).alias(c) for c in ("band", "weight", "slack"))), "members")
    twins = classes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("u"), F.col("id").alias("v"))
    links = _verified(docs, classes, _promising(grouped, members, paired).union(twins))
    forget(spark, grouped)
    if members.isEmpty():
        return links
    clusters = components(links)
    named = members.join(classes.select(F.col("id").alias("u"), "node", "n"), "u")
    named = named.join(clusters, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    labelled = written(named.select(F.col("u").alias("id"), F.col("node").alias("u"), "n", "sig", "band", "weight", "slack", "comp"), "members")
    forget(spark, members, clusters)
    # clusters per signature; the pairs across clusters bound what comparing them would cost
    by_cluster = labelled.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("c"))
    most = F.max(F.struct("c", "comp"))
    bucket = by_cluster.groupBy("sig").agg(F.sum("c").alias("g"), F.sum(F.col("c") * F.col("c")).alias("g2"), F.count(F.lit(1)).alias("clusters"), most.alias("top")).filter("clusters > 1")
    bucket = written(bucket.select("sig", F.col("top.comp").alias("top"), ((F.col("g") * F.col("g") - F.col("g2")) / 2 > SMALL_GROUP * F.col("g")).alias("skipped")), "buckets")
    open_ = labelled.join(bucket, "sig")
    whole = lambda m: m.select("sig", F.col("id").alias("v"), F.col("n").alias("nv"), F.col("comp").alias("comp_v"))
    few = open_.filter("NOT skipped AND comp <> top").select("sig", F.col("id").alias("u"), F.col("n").alias("nu"), "comp")
    kept = few.join(whole(open_.filter("NOT skipped")), "sig").filter(F.col("comp") != F.col("comp_v")).filter(SIMILAR)
    kept = kept.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    more = _verified(docs, classes, kept)
    # sets that left out more weight than their slack meet each other through what was left out
    skipped = open_.filter("skipped")
    lost = skipped.groupBy("u", "band").agg(F.sum("weight").alias("lost"), F.max("slack").alias("most"), F.first("comp").alias("comp"), F.first("n").alias("n"), F.collect_list("sig").alias("sigs"))  # no more than a set has
    beyond = written(lost.filter("lost > most").select("u", "band", "comp", "n", "sigs"), "beyond")
    out = links.union(more)
    if not beyond.isEmpty():
        families = _families(beyond)
        out = out.union(_blocks(docs, classes, families))
        forget(spark, families)
    out = written(out, "links")
    forget(spark, links, more, labelled, bucket, beyond)
    return out


def _placed(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, h, n_shingles, label (of the component; null without words), component_id per row; see similar_groups."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    with small_batches(spark, TEXTS):
        rows = written(document_sets(docs), "docsets")
    schemes, emitted = least_cost(rows.filter("node IS NULL"))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(12 * emitted / SHARD_BYTES))
    rows = rows.filter("node IS NOT NULL")
    filled = rows.filter("n_shingles > 0").select("doc_id", "h", "n_shingles", "node")
    short = F.conv(F.substring(F.hex("node"), 1, 12), 16, 10).cast("long").alias("id")
    classes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.select(short, "node", "n", "sketch", "doc_id"), "classes")
    links = jaccard_links(docs, classes, schemes, shards)
    repeated = filled.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).filter("u <> v")
    labels = components(links.union(filled.join(repeated.select("doc_id", "u"), "doc_id").select("u", F.col("node").alias("v"))))
    named = classes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = written(named.join(lowest, "label").select("node", "label", "component_id"), "class-components")
    forget(spark, classes, links, labels)
    placed = filled.join(of_class, "node").select("doc_id", "h", "n_shingles", "label", "component_id")
    bare = rows.filter("n_shingles = 0").select("doc_id", "h", "n_shingles", F.lit(None).cast("binary").alias("label"), F.col("doc_id").alias("component_id"))
    return placed.union(bare)


def similar_groups(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs.

    Null and empty texts, and those without words, have no shingles and are linked with nothing: each is its own
    component. Rows that repeat a doc_id each have their row; those with words count as one document, which links
    what each of its texts links. A null doc_id takes part like any other and is never the smallest of a component
    that has another. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    return _placed(docs, shards).select("doc_id", "n_shingles", "component_id")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near duplicates one row, with its own columns: that of the smallest id.

    Texts that are null or without words are in no component and stay. A null id comes after all others; of rows that
    repeat the id, the text with the smallest hash stays, and of wholly repeated rows one. An empty table stays empty.
    """
    mark = "gone"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    d, t, n = (f"{mark}{c}" for c in "dtn")
    groups = written(_placed(docs).filter("label IS NOT NULL").groupBy("label", "doc_id", "h").agg(F.count(F.lit(1)).alias("n")), "groups")
    first = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("first")).select("label", F.col("first.doc_id").alias("d"), F.col("first.h").alias("t"))
    stays = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t"))
    judged = groups.join(first, "label").select(F.col("doc_id").alias(d), F.col("h").alias(t), F.col("n").alias(n), stays.alias("stays"))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t))
    left = docs.join(judged.filter("NOT stays").drop("stays").hint("shuffle_hash"), same, "left_anti")
    twice = written(judged.filter(F.col("stays") & (F.col(n) > 1)).drop("stays"), "twice")
    if twice.isEmpty():
        return left
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = left.join(twice, same, "left_semi").groupBy(F.col("doc_id").alias(d), F.xxhash64("text").alias(t)).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return left.join(twice, same, "left_anti").union(one.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))
