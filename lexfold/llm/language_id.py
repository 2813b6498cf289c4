"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built per language. A text is parsed against it from left to right into
longest matches: a phrase ends where the automaton cannot follow, and the next begins there. Phrases times the logarithm
of the labelled text's length, over the length of the text, estimate the cross entropy; the language of the least wins.
As a phrase starts anew at the automaton's root, parsing needs only its forward moves. Each language has the letters of
its own labelled text; what else is a letter is unknown to it and a phrase of its own.

Texts are parsed whole. Long ones are cut into pieces that are parsed in step, each as if a phrase began there; then the
parse of each piece is carried on into the next until the two agree, which they do after a few phrases, and the phrases
up to there are counted by the one that was carried on. So counts are those of one parse from left to right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfold.llm.common import map_arrow, table

PER_LANGUAGE = 200  # labelled documents per language, at most: those with the smallest hash
TRAIN_CHARS = 60_000  # characters that those have together, at most; each is learned from whole (a single one may be longer)
DENSE = 1 << 23  # cells of a table of moves; an automaton that needs more keeps its moves sorted
PIECE = 2048
BATCH_CHARS = 1 << 20
UNKNOWN = "und"


def crc_part() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def training_texts(docs: DataFrame, per_language: int = PER_LANGUAGE, chars: int = TRAIN_CHARS) -> dict[str, str]:
    """Labelled text per language, in a stable order: whole texts of the documents with the smallest hash, per_language
    of them or as many as have at most `chars` characters together, but one at least, whatever its length.

    Only the share of a language's documents whose hash promises some times as many as are needed is ranked, so no
    language's rows meet in one task. Rows that repeat a document count once.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    ids = rows.select("lang", "h", F.char_length("text").alias("size"))
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = ids.join(F.broadcast(counts), "lang").filter(share * F.col("n") <= max(64, 8 * per_language))  # counts: a row a language
    some = some.groupBy("lang", "h").agg(F.first("size").alias("size"))
    order = Window.partitionBy("lang").orderBy("h")
    ranked = some.withColumn("upto", F.sum("size").over(order)).withColumn("rank", F.row_number().over(order))
    chosen = F.broadcast(ranked.filter(((F.col("upto") <= chars) & (F.col("rank") <= per_language)) | (F.col("rank") == 1)).select("lang", "h"))
    got = rows.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("t")).collect()  # chars a language
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["h"])):
        out.setdefault(r["lang"], []).append(r["t"])
    return {k: "\n".join(v) for k, v in out.items()}


def _automaton(codes: list[int]) -> list[dict[int, int]]:
    """Moves of the suffix automaton of codes, by state."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Moves:
    """Moves of a parse: state * 2, plus one where a phrase ended, from a state and a class of character.

    State 0 is before the first character. Where the automaton cannot follow, the next phrase begins with the character
    itself. One table, or, for many states and classes, the moves in order of state and class.
    """

    def __init__(self, moves: list[dict[int, int]], size: int):
        self.size, alone = size, len(moves)  # alone: after a character unknown to the language, a phrase of its own
        self.root = np.full(size, alone, np.int64)
        self.root[list(moves[0])] = list(moves[0].values())
        count = np.array([len(m) for m in moves] + [0])
        state = np.repeat(np.arange(len(count)), count)
        letter = np.fromiter((c for m in moves for c in m), np.int64, len(state))
        to = np.fromiter((t for m in moves for t in m.values()), np.int64, len(state))
        key = state * size + letter
        self.dense = len(count) * size <= DENSE
        if self.dense:
            table = np.tile(self.root * 2 + 1, (len(count), 1)).astype(np.int32)
            table[0] = self.root * 2  # where a text begins, no phrase has ended
            table = table.ravel()
            table[key] = to * 2
            self.table = table
        else:
            order = np.argsort(key)
            self.key, self.to = key[order], to[order]

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        if self.dense:
            return self.table[state * self.size + letter]
        key = state * self.size + letter
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        found = self.key[at] == key
        return np.where(found, self.to[at] * 2, self.root[letter] * 2 + (state > 0))


LETTER = np.zeros(0x110000, bool)


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not LETTER.any():
        LETTER[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
    return LETTER


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def squeezed(code: np.ndarray) -> np.ndarray:
    """Which positions stay when runs of other than letters count as one, at the start not at all."""
    gap = ~letters()[code]
    return ~(gap & np.concatenate([[True], gap[:-1]])) if len(code) else gap


class Language:
    """Classes of characters and moves of one language, made from its labelled text."""

    def __init__(self, text: str):
        seen = sorted({ch for ch in text.lower() if ch.isalpha() and len(ch) == 1})
        self.classes = np.ones(0x110000, np.uint16)  # 0: what parts words, 1: unknown letters
        self.classes[~letters()] = 0
        for k, ch in enumerate(seen, 2):
            self.classes[ord(ch)] = k
            if len(up := ch.upper()) == 1 and up.isalpha():
                self.classes[ord(up)] = k
        code = points(text)
        known = self.classes[code[squeezed(code)]]
        self.moves = Moves(_automaton(known.tolist()), len(seen) + 2)
        self.weight = float(np.log2(len(known) + 2))

    def phrases(self, code: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases of each text; code: code points of the squeezed texts, one after the other."""
        c, step = self.classes[code].astype(np.int64), self.moves.step
        n, begin = len(length), np.cumsum(length) - length
        pieces = -(-length // PIECE)
        owner = np.repeat(np.arange(n), pieces)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size, start = np.minimum(PIECE, length[owner] - index * PIECE), begin[owner] + index * PIECE
        alone, end = self._parse(c, start, size)
        ended, last, entered = alone.copy(), end.copy(), np.full(len(owner), -1, np.int64)
        while True:  # pieces that follow another whose parse was not yet carried on into them, or ends otherwise by now
            now = np.flatnonzero((index > 0) & (entered != np.roll(last, 1)))
            if not len(now):
                break
            entered[now] = last[now - 1]
            own, other = np.zeros(len(now), np.int64), entered[now]
            more, alive = np.zeros(len(now), np.int64), np.arange(len(now))
            for k in range(int(size[now].max())):
                alive = alive[(k < size[now[alive]]) & (own[alive] != other[alive])]
                if not len(alive):
                    break
                letter = c[start[now[alive]] + k]
                x, y = step(own[alive], letter), step(other[alive], letter)
                own[alive], other[alive] = x >> 1, y >> 1
                more[alive] += (y & 1) - (x & 1)
            ended[now] = alone[now] + more
            last[now] = np.where(own == other, end[now], other)
        return np.bincount(owner, ended, n).astype(np.int64) + (length > 0)

    def _parse(self, c: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that ended in each piece, as if a text began with it, and the state at its end."""
        order = np.argsort(-size, kind="stable")
        begin, state, ended = start[order], np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        left = np.searchsorted(-size[order], -np.arange(1, int(size.max()) + 1 if len(size) else 1), side="right")  # pieces of so many characters
        for k, alive in enumerate(left.tolist()):
            got = self.moves.step(state[:alive], c[begin[:alive] + k])
            ended[:alive] += got & 1
            state[:alive] = got >> 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return ended[back], state[back]


class Parser:
    """Parsers of all languages, made from their labelled texts."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self.of = [Language(texts[k]) for k in self.languages]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases per text and language, characters parsed per text, and whether it has a letter."""
        coded = [points(t) for t in texts]
        has = np.array([bool(letters()[x].any()) for x in coded], bool)
        coded = [x[squeezed(x)] for x in coded]
        length = np.array([len(x) for x in coded], np.int64)
        if not len(self.of) or not length.sum():
            return np.zeros((len(texts), len(self.of)), np.int64), length, has
        flat = np.concatenate(coded)
        return np.stack([x.phrases(flat, length) for x in self.of], 1), length, has


_PARSERS: dict[int, Parser] = {}


def predict(docs: DataFrame, texts: dict[str, str], carry: list[str]) -> DataFrame:
    """carry, lang_pred and score per row.

    score is how much less the winner's cross entropy is than the runner-up's, as a share of the latter, from 0 to 1
    (1 with a single language). Null text, text without a letter, and every text when nothing could be learned, is
    'und' with score 0; equal values go to the first language by name. Rows are judged one by one, repeated ones alike;
    an empty table stays empty; columns of other names pass through.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(texts)  # bounded: TRAIN_CHARS a language
    rows = docs.select(*(F.col(f"`{c}`") for c in carry), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(rows.schema[c] for c in carry), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for b in batches:
            if parser is None:
                key = hash(tuple(sorted(held.value.items())))
                parser = _PARSERS.get(key)
                if parser is None:
                    _PARSERS.clear()
                    parser = _PARSERS[key] = Parser(held.value)
            texts_ = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            pred, score, a = [], [], 0
            while a < len(texts_):
                z, chars = a, 0
                while z < len(texts_) and (z == a or chars < BATCH_CHARS):
                    chars += len(texts_[z])
                    z += 1
                total, length, has = parser.phrases(texts_[a:z])
                total = total * np.array([x.weight for x in parser.of]) / np.maximum(length, 1)[:, None]
                for row, ok in zip(total, has):
                    if not ok or not len(row):
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    best = int(np.argmin(row))
                    pred.append(parser.languages[best])
                    score.append(1.0 if len(row) == 1 else float(1 - row[best] / np.partition(row, 1)[1]))
                a = z
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*carry, "lang_pred", "score"])

    return map_arrow(rows, run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows whose crc32(doc_id) mod 3 is not 1 (a null doc_id is not learned from)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    texts = training_texts(docs.filter(crc_part() != 1))
    rows = docs.select("doc_id", "text", F.coalesce(crc_part() == 1, F.lit(False)).alias("held_out"))
    return predict(rows, texts, ["doc_id", "held_out"])
