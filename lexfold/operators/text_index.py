"""A positional inverted index as a Parquet table, and stemmed search, ranking and headlines over it.

A row holds the documents of one term in one block of documents: their numbers, the term's places in each, and the
greatest number of places. Blocks hold about BLOCK documents, dealt by hash, so rows have a bounded size whatever the
term. Rows are in folders by hash of the term and sorted by term and block: a query reads its terms' rows and no others.

Matching is that of PostgreSQL's `english` text search: stems, stop words that leave gaps in phrases, prefixes of stems;
NOT binds closest, then phrases, AND and OR. So is the rank (its ts_rank with equal weights): of one term or alternatives,
the sum of 1 / j^2 over a term's places, per term and by pi^2 / 6; where all must match, the chance that at least one pair
of places of two terms is near. Unlike there, places are never cut off, and a prefix's terms count as one in the latter.

The best k of a query come from two readings: the greatest number of places bounds the ranks in a block, the blocks with
the best bounds are ranked first, and then only blocks that can still beat the k-th rank.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.functions.english import TOKEN, term_of, terms, words
from lexfold.operators.search import parse
from lexfold.storage import fresh_path, written

BLOCK = 1024  # documents, about
SHARDS = 64  # folders
SEED = 32  # blocks that are ranked first
ROWS = "term string, block int, n int, top int, docs array<long>, places array<array<int>>, shard int"
HITS = "term string, block int, n int, top int, docs array<long>, places array<array<int>>"
PART = 64  # blocks, of which a folder's files hold all rows of a term
FLUSH, PLACES = 50_000, 1_000_000  # rows that a task gives at once, and places in them, about
ALL = ""  # in place of a term: all documents of a block
WEIGHT, LIMIT = 0.1, 1.64493406685


@dataclass(frozen=True)
class Operand:
    """Terms at distances from the first; prefix: of the only term's beginning."""

    terms: tuple[tuple[str, int], ...]
    prefix: bool = False
    negated: bool = False

    def keys(self) -> list[tuple[str, bool]]:
        return [(t, self.prefix) for t, _ in self.terms]


def asked(query: str) -> list[list[Operand]]:
    """Alternatives of conjunctions; stop words vanish, and what consists of them."""
    branches: list[list[Operand]] = []
    for op, atom in parse(query):
        if op != "&" or not branches:
            branches.append([])
        found, at = [], 0
        for w in atom.words:
            inside = terms(w)
            found += [(t, at + place) for t, place in inside]
            at += max(1, sum(1 + m.group().count("-") + ("-" in m.group()) for m in TOKEN.finditer(w)))
        if found:  # of a hyphenated prefix the whole, as its last part may go on
            branches[-1].append(Operand(tuple((t, p - found[0][1]) for t, p in (found[:1] if atom.prefix else found)), atom.prefix, atom.negated))
    return [b for b in branches if b]


def _keys(branches: list[list[Operand]]) -> list[tuple[str, bool]]:
    return list(dict.fromkeys(k for b in branches for o in b for k in o.keys()))


def _all_must(branches: list[list[Operand]]) -> bool:
    """Whether the query as a whole is a conjunction or a phrase."""
    return len(branches) == 1 and (len(branches[0]) > 1 or len(branches[0][0].terms) > 1 and not branches[0][0].negated)


def _matches(branches: list[list[Operand]], places: dict[tuple[str, bool], np.ndarray]) -> bool:
    def has(o: Operand) -> bool:
        at = None
        for t, far in o.terms:
            here = places.get((t, o.prefix))
            if here is None:
                at = ()
                break
            at = here - far if at is None else np.intersect1d(at, here - far)
            if not len(at):
                break
        return bool(len(at)) != o.negated

    return any(all(has(o) for o in b) for b in branches)


def _near(distance: np.ndarray) -> np.ndarray:
    d = np.minimum(distance, 101)
    return np.where(d > 100, 1e-30, 1 / (1.005 + 0.05 * np.exp(d / 1.5 - 2)))


def rank(branches: list[list[Operand]], counts: dict[tuple[str, bool], list[int]], places: dict[tuple[str, bool], np.ndarray]) -> float:
    """The rank of a document that matches; counts: of each of the terms with a prefix; places: of all of them."""
    keys = _keys(branches)
    if _all_must(branches) and len(keys) > 1:
        apart, found = 1.0, False
        for i, a in enumerate(keys):
            for b in keys[:i]:
                if a in places and b in places:
                    d = np.abs(places[a][:, None] - places[b][None]).ravel()
                    d = d[d > 0]
                    found |= len(d) > 0
                    apart *= float(np.prod(1 - np.sqrt(WEIGHT * WEIGHT * _near(d))))
        return 1 - apart if found else 1e-20
    total = sum(sum(1 / j**2 for j in range(1, n + 1)) for k in keys for n in counts.get(k, []))
    return WEIGHT * total / LIMIT / len(keys)


def _headline(text: str, keys: list[tuple[str, bool]], fragments: int, least: int, most: int) -> str:
    """Up to `fragments` parts of a text, each of at most `most` words (least, if the text has them), with hits marked.

    Parts begin at a hit; the one with most different terms comes first, then with most hits, then the first; parts do not
    overlap and appear in the text's order.
    """
    words = list(TOKEN.finditer(text))
    of = []
    for m in words:
        inside = {t for t, _ in terms(m.group())}
        of.append({k for k in keys if (k[0] in inside if not k[1] else any(t.startswith(k[0]) for t in inside))})
    hits = [i for i, k in enumerate(of) if k]
    if not hits:
        return text[: words[min(least, len(words)) - 1].end()] if words else ""
    chosen: list[tuple[int, int]] = []
    for _ in range(max(1, fragments)):
        best, begin = None, 0
        for a, i in enumerate(hits):
            if any(x <= i < y for x, y in chosen):
                continue
            stop = min([x for x, _ in chosen if x > i] + [i + most, len(words)])
            inside, kinds, b = 0, set(), a
            while b < len(hits) and hits[b] < stop:
                kinds |= of[hits[b]]
                inside, b = inside + 1, b + 1
            if best is None or (len(kinds), inside) > best[0]:
                best, begin = ((len(kinds), inside), hits[b - 1] + 1, stop), i
        if best is None:
            break
        end = min(max(best[1], begin + least), best[2])
        begin = max(min(begin, end - least), max([y for _, y in chosen if y <= begin], default=0), 0)
        chosen.append((begin, end))
    parts = []
    for a, b in sorted(chosen):
        out, at = [], words[a].start()
        for i in range(a, b):
            out.append(text[at : words[i].start()])
            w = words[i].group()
            out.append(f"<mark>{w}</mark>" if of[i] else w)
            at = words[i].end()
        parts.append("".join(out))
    return " ... ".join(parts)


class _Terms(dict):
    """Numbers of a block's terms by word, -1 of stop words."""

    def __init__(self) -> None:
        super().__init__()
        self.numbers: dict[str, int] = {ALL: 0}

    def __missing__(self, word: str) -> int:
        t = term_of(word)
        self[word] = n = -1 if t is None else self.numbers.setdefault(t, len(self.numbers))
        return n


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index from documents (block, doc_id, text) in order of block and doc_id, which are a whole block's."""
    now, known, docs, codes = None, _Terms(), [], []
    for b in batches:
        for i in range(b.num_rows):
            block = b.column(0)[i].as_py()
            if docs and block != now:
                yield from _block_rows(now, known, docs, codes)
                known, docs, codes = _Terms(), [], []
            now = block
            docs.append(b.column(1)[i].as_py())
            found = words(b.column(2)[i].as_py())
            codes.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
    if docs:
        yield from _block_rows(now, known, docs, codes)


def _block_rows(block: int, known: _Terms, docs: list[int], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    lengths = np.array([len(c) for c in codes])
    code = np.concatenate(codes)
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
    place = (np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1).astype(np.int32)
    order = np.argsort(code, kind="stable")  # by term, then document, then place
    order = order[np.searchsorted(code[order], 0) :]
    code, doc, place = code[order], doc[order], place[order]
    # entries: of a term in a document; of all documents, without places, come first
    begins = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.zeros(0, np.int64)
    sizes = np.r_[np.zeros(len(docs), np.int64), np.diff(np.r_[begins, len(code)])]
    of_term, of_doc = np.r_[np.zeros(len(docs), np.int32), code[begins]], np.r_[np.arange(len(docs)), doc[begins]]
    rows = np.flatnonzero(np.r_[True, of_term[1:] != of_term[:-1]])  # terms are numbered without gaps
    entries = np.r_[rows, len(of_term)]
    places = np.r_[0, np.cumsum(sizes)]
    top = np.maximum.reduceat(sizes, rows)
    names, ids = pa.array(list(known.numbers), pa.string()), np.array(docs, np.int64)[of_doc]
    a = 0
    while a < len(rows):
        z = min(a + FLUSH, len(rows), max(a + 1, int(np.searchsorted(places[entries], places[entries[a]] + PLACES))))
        p, q = entries[a], entries[z]
        at = pa.ListArray.from_arrays(pa.array((places[p : q + 1] - places[p]).astype(np.int32)), pa.array(place[places[p] : places[q]]))
        offsets = pa.array((entries[a : z + 1] - p).astype(np.int32))
        n = np.diff(entries[a : z + 1]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [names.slice(a, z - a), pa.array(np.full(z - a, block, np.int32)), pa.array(n), pa.array(top[a:z].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(ids[p:q])), pa.ListArray.from_arrays(offsets, at)],
            ["term", "block", "n", "top", "docs", "places"],
        )
        a = z


class TextIndex:
    """An index at a path; see the module."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.blocks, self.shards = (int(x) for x in spark.read.json(f"{path}/about").select("blocks", "shards").first())
        self.rows = spark.read.schema(ROWS).parquet(f"{path}/postings")

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, block: int = BLOCK, shards: int = SHARDS) -> TextIndex:
        """Index docs (doc_id, text), each document's whole text; doc_id tells documents apart. Null ids are left out."""
        spark = docs.sparkSession
        path = path or fresh_path(spark, "text-index")
        rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        blocks = max(1, math.ceil(rows.count() / block))
        dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
        dealt = dealt.repartition("block").sortWithinPartitions("block", "doc_id", "text")
        out = dealt.mapInArrow(_inverted, HITS).select(cls._shard(F.col("term"), shards).alias("shard"), "term", "block", "n", "top", "docs", "places")
        part = F.pmod(F.xxhash64("term", F.floor(F.col("block") / PART)), F.lit(math.ceil(blocks / PART)))  # a term of many blocks is in several parts of its folder
        out.repartition("shard", part).sortWithinPartitions("shard", "term", "block").write.option("compression", "zstd").partitionBy("shard").parquet(f"{path}/postings")
        spark.createDataFrame([(blocks, shards)], "blocks int, shards int").coalesce(1).write.json(f"{path}/about")
        return cls(spark, path)

    @staticmethod
    def _shard(term: Column, shards: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")

    def _shards_of(self, names: list[str]) -> list[int]:
        given = self.spark.createDataFrame([(n,) for n in names], "term string").select(self._shard(F.col("term"), self.shards).alias("s"))
        return sorted({r["s"] for r in given.collect()})

    def postings(self, branches: list[list[Operand]]) -> DataFrame:
        """The rows of a query's terms (of all documents too, where they can match without any of its terms)."""
        keys = _keys(branches)
        plain = [t for t, p in keys if not p]
        if any(all(o.negated for o in b) for b in branches):
            plain.append(ALL)
        want = F.lit(False)
        if plain:
            want = F.col("shard").isin(self._shards_of(plain)) & F.col("term").isin(plain)
        for t, p in keys:
            if p:
                want = want | F.col("term").startswith(t)
        return self.rows.filter(want)

    def _ranked(self, branches: list[list[Operand]], rows: DataFrame) -> DataFrame:
        """doc_id, rank of all that match within rows (term, block, docs, places); a block meets in one task."""
        keys = _keys(branches)

        def solve(block: pa.Table) -> pa.Table:
            counts: dict[int, dict] = defaultdict(lambda: defaultdict(list))
            places: dict[int, dict] = defaultdict(lambda: defaultdict(list))
            for term, docs, at in zip(*(block.column(c).to_pylist() for c in ("term", "docs", "places"))):
                mine = [k for k in keys if (term.startswith(k[0]) and term if k[1] else term == k[0])]
                for doc, p in zip(docs, at):
                    counts[doc]  # noqa: B018  a document without any of the terms is there too
                    for k in mine:
                        counts[doc][k].append(len(p))
                        places[doc][k] += p
            out = []
            for doc, c in counts.items():
                here = {k: np.unique(p) for k, p in places[doc].items()}
                if _matches(branches, here):
                    out.append((doc, rank(branches, c, here)))
            return pa.table({"doc_id": pa.array([d for d, _ in out], pa.int64()), "rank": pa.array([r for _, r in out], pa.float64())})

        return rows.select("term", "block", "docs", "places").groupBy("block").applyInArrow(solve, "doc_id long, rank double")

    def _bounds(self, branches: list[list[Operand]], rows: DataFrame) -> DataFrame:
        """block, bound: of the blocks in which all terms of a branch occur, what no rank there can exceed."""
        keys = _keys(branches)
        of = lambda k: F.col("term").startswith(k[0]) if k[1] else F.col("term") == k[0]
        squares = F.aggregate(F.sequence(F.lit(1), F.greatest("top", F.lit(1))), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
        sums = [F.sum(F.when(of(k), F.col("top").cast("double"))).alias(f"n{i}") for i, k in enumerate(keys)] + [F.sum(F.when(of(k), squares)).alias(f"s{i}") for i, k in enumerate(keys)]
        held = rows.groupBy("block").agg(*sums)
        able = F.lit(False)
        for b in branches:
            branch = F.lit(True)
            for o in b:
                if not o.negated:
                    for k in o.keys():
                        branch = branch & F.col(f"n{keys.index(k)}").isNotNull()
            able = able | branch
        if _all_must(branches) and len(keys) > 1:
            pairs = sum((F.coalesce(F.col(f"n{i}") * F.col(f"n{j}"), F.lit(0.0)) for i in range(len(keys)) for j in range(i)), F.lit(0.0))
            bound = 1 - F.pow(F.lit(1 - WEIGHT), pairs)
        else:
            bound = F.lit(WEIGHT / LIMIT / len(keys)) * sum((F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(len(keys))), F.lit(0.0))
        return held.filter(able).select("block", (bound * (1 + 1e-9) + 1e-12).alias("bound"))

    def match(self, query: str) -> DataFrame:
        """doc_id, rank of all documents that match; none for a query of no or only stop words."""
        branches = asked(query)
        if not branches:
            return self.spark.createDataFrame([], "doc_id long, rank double")
        return self._ranked(branches, self.postings(branches))

    def top(self, query: str, k: int = 50, offset: int = 0) -> DataFrame:
        """doc_id, rank: k of the best after the first offset, by rank, then doc_id."""
        branches, want = asked(query), k + offset
        if not branches:
            return self.match(query)
        rows = self.postings(branches)
        bounds = written(self._bounds(branches, rows.select("term", "block", "top")), "bounds")
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(SEED).collect()]
        best = lambda found: found.orderBy(F.desc("rank"), "doc_id").limit(want)
        seed = written(best(self._ranked(branches, rows.filter(F.col("block").isin(first)))), "best")
        least = seed.agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank")).first()
        left = bounds.filter(~F.col("block").isin(first))
        if least["n"] == want:
            left = left.filter(F.col("bound") >= least["rank"])
        if not left.isEmpty():
            more = self._ranked(branches, rows.join(left.select("block"), "block", "left_semi"))
            seed = best(seed.union(best(more)))
        return seed.orderBy(F.desc("rank"), "doc_id").offset(offset).limit(k)

    def headlines(self, found: DataFrame, docs: DataFrame, query: str, fragments: int = 1, least: int = 20, most: int = 50) -> DataFrame:
        """found (doc_id, ...; a page of results) with the headline of each document's text."""
        keys = _keys([[o for o in b if not o.negated] for b in asked(query)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_headline(t.as_py() or "", keys, fragments, least, most) for t in b.column(1)], pa.string())], ["doc_id", "headline"])

        page = written(found, "page")
        text = docs.select("doc_id", "text").join(page.select("doc_id"), "doc_id", "left_semi").mapInArrow(run, "doc_id long, headline string")
        return page.join(text, "doc_id")


def compiled(query: str) -> str:
    """A query as it is asked of the index, in the notation of text search."""
    out = []
    for b in asked(query):
        parts = []
        for o in b:
            body, at = o.terms[0][0] + (":*" if o.prefix else ""), 0
            for t, far in o.terms[1:]:
                body, at = f"{body} <{far - at if far - at > 1 else '-'}> {t}", far
            parts.append(("!" if o.negated else "") + (f"({body})" if len(o.terms) > 1 else body))
        out.append(" & ".join(parts))
    return " | ".join(out)

