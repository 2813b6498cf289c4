"""Best-fit packing of tokenised documents into sequences of fixed length, by linear grouping.

Documents are tokenised on the executors and only longer ones are cut. The plan is made from the histogram of piece
lengths alone (at most one count per length, however many documents): large lengths are rounded up within groups of
equal cardinality, configurations of these few sizes are chosen one after the other by exact fill of what the
largest remaining size leaves, the actual lengths take the slots of their group, and small pieces go best-fit into
what is left. Runs of equal bins stay one entry throughout, so plan and memory do not grow with the corpus. Every
piece then finds its place by its exact rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexfold.llm.common import table, written

CAPACITY = 4096
END_ID = 1
GROUPS = 96  # sizes that the large lengths are rounded to
SMALL = CAPACITY // 8  # pieces up to here are placed best-fit, after the large ones
BUCKETS = 1024  # parts in which the pieces of one length are counted
SLICE_BYTES = 8 << 20  # of text tokenised at once
CACHED_WORDS = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class _Words:
    """Ids of words split at white space, which no token of this tokenizer spans; each distinct word is encoded once.

    The tokenizer folds case and parts letters and digits from the punctuation after them, so a word is looked up in
    lower case as a body and an ASCII tail. Bodies of letters alone are encoded many at a time, as one text: the
    vocabulary marks where a body ends. Texts that may hold a special token's name keep their case.
    """

    BODY = r"""^(?P<b>.*[\p{L}\p{N}])(?P<t>[!"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+)$"""
    LETTERS = "^[a-zà-öø-ÿ]+$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.marked = bool(self.last.any())
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sizes, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def _known(self, words: pa.Array) -> np.ndarray:
        """Where each of some distinct words is held; new ones are encoded."""
        listed = words.to_pylist()
        if new := [k for k, w in enumerate(listed) if w not in self.at]:
            fresh = words.take(pa.array(new))
            simple = pc.match_substring_regex(fresh, self.LETTERS).to_numpy(zero_copy_only=False) & self.marked
            plain = [listed[k] for k, x in zip(new, simple) if x]
            for k in range(0, len(plain), 1024):
                part = plain[k : k + 1024]
                ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
                self._learn(part, ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))
            if other := [listed[k] for k, x in zip(new, simple) if not x]:
                found = [e.ids for e in self.tokenizer.encode_batch(other, add_special_tokens=False)]
                self._learn(other, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))
        return np.fromiter((self.at[w] for w in listed), np.int64, len(listed))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts one after the other, and the number of ids of each text (without any end id)."""
        if len(self.at) > CACHED_WORDS or len(self.flat) > 16 * CACHED_WORDS:
            self.clear()
        folded = texts if pc.any(pc.match_substring(texts, "<|")).as_py() else pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(folded)
        if not len(split.values):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = split.values.dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, self.BODY)
        cut = pc.fill_null(pc.invert(pc.ends_with(pc.struct_field(parts, "b"), "İ")), False)  # in lower case it ends with a mark, which takes punctuation along
        body = pc.if_else(cut, pc.struct_field(parts, "b"), coded.dictionary).dictionary_encode()
        tail = pc.if_else(cut, pc.struct_field(parts, "t"), "").dictionary_encode()
        both = np.stack([self._known(x.dictionary)[x.indices.to_numpy()] for x in (body, tail)], 1)
        sizes = self.sizes[both].sum(1)
        flat = _gather(self.flat, self.starts[both.ravel()], self.sizes[both.ravel()])
        word = coded.indices.to_numpy()
        ids = _gather(flat, (np.cumsum(sizes) - sizes)[word], sizes[word])
        upto = np.concatenate([[0], np.cumsum(sizes[word])])[split.offsets.to_numpy()]
        return ids, np.diff(upto)


_LOADED: dict[str, _Words] = {}


def _words(path: str) -> _Words:
    if path not in _LOADED:
        _LOADED[path] = _Words(path)
    return _LOADED[path]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian) per piece of every row's text and end id.

    Null text is empty and gives one piece, the end id. Rows are taken one by one, repeated ids too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in slices(texts):
                ids, sizes = words.encode(texts.slice(a, b - a))
                ids = np.insert(ids, np.cumsum(sizes), END_ID).astype("<u4")
                ends = np.cumsum(sizes + 1)
                view = memoryview(ids.view(np.uint8))
                rows = [(i, k, s, min(capacity, n - s), int(e - n + s)) for i, (n, e) in enumerate(zip((sizes + 1).tolist(), ends.tolist())) for k, s in enumerate(range(0, n, capacity))]
                who, piece, start, length, first = (np.array(x, np.int64) for x in zip(*rows))
                parts = [view[4 * f : 4 * (f + n)] for f, n in zip(first.tolist(), length.tolist())]
                out = [batch.column(0).take(pa.array(who + a)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out, names = [*out, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


class Plan:
    """Places (length, rank of the first, count, first bin, offset) for all pieces of a histogram {length: count}."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL):
        self.capacity, self.bins, self.places = capacity, 0, []
        self.used = dict.fromkeys(counts, 0)  # ranks given out so far, by length
        self.open: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of bins (first, count)
        self.gaps: list[int] = []
        self._large({n: c for n, c in counts.items() if n > small}, groups)
        for n in sorted((n for n in counts if n <= small), reverse=True):
            self._small(n, counts[n])

    def _place(self, length: int, count: int, first_bin: int, offset: int) -> None:
        self.places.append((length, self.used[length], count, first_bin, offset))
        self.used[length] += count

    def _free(self, gap: int, first: int, count: int) -> None:
        if count and gap:
            if gap not in self.open:
                self.open[gap] = []
                bisect.insort(self.gaps, gap)
            self.open[gap].append((first, count))

    def _large(self, counts: dict[int, int], groups: int) -> None:
        """Linear grouping, then configurations of the rounded sizes."""
        total = sum(counts.values())
        members: list[list[list[int]]] = []  # per group its [length, count], longest first
        left = 0
        for n in sorted(counts, reverse=True):
            c = counts[n]
            while c:
                if not left:
                    members.append([])
                    left = -(-total // groups)
                take = min(c, left)
                members[-1].append([n, take])
                c, left = c - take, left - take
        by_size: dict[int, list[list[int]]] = {}
        for g in members:  # groups with the same largest length are one size
            by_size.setdefault(g[0][0], []).extend(g)
        sizes = sorted(by_size, reverse=True)
        rest = {s: sum(c for _, c in by_size[s]) for s in sizes}
        while sizes := [s for s in sizes if rest[s]]:
            config = self._fill(sizes, rest)
            times = min(rest[s] // k for s, k in config)
            slots = [s for s, k in config for _ in range(k)]
            for s, k in config:
                rest[s] -= k * times
            self._substitute([self._take(by_size[s], times) for s in slots], times)

    def _fill(self, sizes: list[int], rest: dict[int, int]) -> list[tuple[int, int]]:
        """The largest size and the fullest choice of others beside it, as (size, number); sums as bits of an integer."""
        room = self.capacity - sizes[0]
        mask = (1 << (room + 1)) - 1
        sums, steps = 1, []
        for s in sizes:
            if s > room:
                continue
            for k in range(1, min(rest[s] - (s == sizes[0]), room // s) + 1):
                steps.append((s, sums))
                sums |= (sums << s) & mask
                if sums == steps[-1][1]:
                    steps.pop()
                    break
            if sums >> room:
                break
        at, taken = sums.bit_length() - 1, {sizes[0]: 1}
        for s, before in reversed(steps):
            if not before >> at & 1:
                taken[s] = taken.get(s, 0) + 1
                at -= s
        return list(taken.items())

    @staticmethod
    def _take(runs: list[list[int]], count: int) -> list[list[int]]:
        """The next count members of a group, as [length, count]; runs is shortened."""
        out = []
        while count:
            n, c = runs[0]
            take = min(c, count)
            out.append([n, take])
            runs[0][1] -= take
            if not runs[0][1]:
                runs.pop(0)
            count -= take
        return out

    def _substitute(self, slots: list[list[list[int]]], times: int) -> None:
        """Fill `times` new bins with the actual members of their slots; bins with the same lengths stay one run."""
        while times:
            run = min(s[0][1] for s in slots)
            offset = 0
            for s in slots:
                self._place(s[0][0], run, self.bins, offset)
                offset += s[0][0]
                s[0][1] -= run
                if not s[0][1]:
                    s.pop(0)
            self._free(self.capacity - offset, self.bins, run)
            self.bins += run
            times -= run

    def _small(self, n: int, count: int) -> None:
        """Best fit of count pieces of length n; a bin that got one gets the next while it has room, as it is the tightest."""
        while count:
            k = bisect.bisect_left(self.gaps, n)
            if k < len(self.gaps):
                gap = self.gaps[k]
                first, run = self.open[gap].pop()
                if not self.open[gap]:
                    del self.open[gap]
                    self.gaps.pop(k)
            else:
                gap, first, run = self.capacity, self.bins, -(-count // (self.capacity // n))
                self.bins += run
            each = min(gap // n, count)
            bins = min(run, count // each)
            for j in range(each):
                self._place(n, bins, first, self.capacity - gap + j * n)
            count -= each * bins
            self._free(gap - each * n, first, bins)
            self._free(gap, first + bins, run - bins)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length and any other columns) with sequence_id and offset.

    Pieces of one length are interchangeable: they are ranked in BUCKETS parts that are counted apart, so a length
    that a third of all rows share is not ranked in one task, even where those are one row repeated.
    """
    spark = pieces.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(BUCKETS)).cast("int")
    rows = written(pieces.withColumn("_part", part), "pack-pieces")
    counts = written(rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per length
    places = np.array(sorted(Plan(histogram, capacity).places), np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(places)  # bounded by the lengths there are, not by the documents
    before = counts.select("length", "_part", (F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before.hint("shuffle_hash"), ["length", "_part"]).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long"))
    names = pieces.columns
    schema = pieces.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        keys = p[:, 0] * (1 << 44) + p[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy() for c in (len(names), len(names) + 1))
            k = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            out = [b.column(i) for i in range(len(names))] + [pa.array(p[k, 3] + rank - p[k, 1]), pa.array(p[k, 4])]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    out = T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*names, F.col("length").alias("_length"), "_rank").mapInArrow(run, out)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece of every row of docs.

    Null text counts as empty; rows that repeat a doc_id are packed one by one; null doc_ids are carried; an empty
    table gives no rows; other columns are ignored. Every piece is placed exactly once and sequences have no gaps
    before their last piece ends.
    """
    return pack(tokenised(docs, path or tokenizer_path(), capacity), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents and their places."""
    return pack_documents(docs)
