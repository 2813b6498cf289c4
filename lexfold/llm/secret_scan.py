"""Secret scans: three base patterns, and strings that look random to a pair of character Markov models.

Both models are first-order chains over the characters a candidate may have, its end included. One is trained on random
strings (the values the base patterns flag, and digests in hexadecimal, base 64 and capitals), the other on ordinary identifiers and
words; a candidate of LEAST_CHARS or more is a secret when its log-likelihood ratio is above a threshold in all and per
character, so short strings must look the more random. Digits alone are a number and no candidate. Training uses a bounded, documented number of labelled samples,
chosen by hash; everything is column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.llm.common import let, table

# The base patterns and the least length of what they must match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # as AKIA[A-Z0-9]+ of 18 or more: what is too short has no longer match inside
HEX = r"[0-9a-f]{16,}"  # as [0-9a-f]+ of 16 or more
LEAST_CHARS = 12
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET)
SAMPLES = 20_000  # labelled strings of each class that the models are trained on, at most
DIGESTS = 2_000  # random strings of each of three kinds that are made for training
PLAIN_DOCS = 2_500  # documents, by hash, that ordinary words are taken from, whole texts
SMOOTHING = 0.5
THRESHOLD = 0.2  # nats a character by which random must be likelier
TOTAL = 9.0  # nats in all


def _starts(text: Column, pattern: str, matches: Column) -> Column:
    """Start, in code points, of each of matches: the pieces between them are what split() leaves."""
    pieces = F.transform(F.split(text, pattern), lambda p: F.char_length(p))
    step = lambda acc, z: F.struct(
        F.concat(acc["at"], F.array(acc["end"] + z["piece"])).alias("at"),
        (acc["end"] + z["piece"] + z["size"]).alias("end"),
    )
    both = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("piece"), F.coalesce(F.char_length(m), F.lit(0)).alias("size")))
    empty = F.array().cast("array<int>")
    return F.aggregate(both, F.struct(empty.alias("at"), F.lit(0).alias("end")), step, lambda acc: acc["at"])


def _spans(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """array<struct<start, end, rank, text>> of the leftmost, non-overlapping matches; the body of least characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rank = KINDS.index(kind)
    one = lambda m, at: F.struct(at.alias("start"), (at + F.char_length(m)).alias("end"), F.lit(rank).alias("rank"), m.alias("text"))
    empty = F.array().cast("array<struct<start:int,end:int,rank:int,text:string>>")
    spans = let(found, lambda ms: F.when(F.size(ms) == 0, empty).otherwise(F.zip_with(ms, F.slice(_starts(text, pattern, ms), F.lit(1), F.size(ms)), one)))
    if not least:
        return spans
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return let(values, lambda vs: F.filter(spans, lambda s, i: F.char_length(F.get(vs, i)) >= least))


def base_spans(text: Column) -> Column:
    """All base spans, by start and then kind as listed."""
    assign = F.when(text.rlike("(?i)password|passwd|secret|token|api_?key"), _spans(text, ASSIGN, "assign", ASSIGN_LEAST)).otherwise(F.array().cast("array<struct<start:int,end:int,rank:int,text:string>>"))
    return F.array_sort(
        F.concat(assign, _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]),
    )


def _pairs(s: Column) -> Column:
    """Index of each pair of neighbouring characters, from 0; those with a character outside ALPHABET are left out."""
    code = lambda c: F.position(c, F.lit(ALPHABET)) - 1
    at = F.sequence(F.lit(1), F.char_length(s) - 1)
    pairs = F.transform(at, lambda i: let(F.struct(code(F.substring(s, i, F.lit(1))).alias("a"), code(F.substring(s, i + 1, F.lit(1))).alias("b")), lambda p: F.when((p["a"] >= 0) & (p["b"] >= 0), p["a"] * SIZE + p["b"])))
    return F.when(F.char_length(s) > 1, F.filter(pairs, lambda p: p.isNotNull())).otherwise(F.array().cast("array<int>"))


def labelled_samples(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """word, random (1 or 0): values flagged by the base patterns and digests, and ordinary words of documents without any.

    At most `samples` of each, those of the smallest hash of the string, so the choice does not depend on
    partitioning. Ordinary words have 6 to 40 characters; they come from a bounded number of documents, by hash.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    value = F.regexp_extract("text", ASSIGN, 2)
    flagged = docs.select(F.explode(base_spans(text)).alias("s")).select("s.text").select(F.when(value != "", value).otherwise(F.col("text")).alias("word"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    made = spark.range(DIGESTS).select(F.explode(F.array(digest, base64, F.upper(F.regexp_replace(base64, "[+/]", "")))).alias("word"))
    some_docs = F.broadcast(docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(PLAIN_DOCS))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_-])[A-Za-z_][A-Za-z0-9_-]{5,39}(?![A-Za-z0-9_-])"), F.lit(0)))
    plain = docs.join(some_docs, "doc_id").select(F.explode(found).alias("word"))
    plain = plain.filter(~F.col("word").rlike("[0-9a-f]{16,}|AKIA")).join(F.broadcast(flagged.select("word").distinct().orderBy(F.xxhash64("word"), "word").limit(samples)), "word", "left_anti")
    some = lambda df, label: df.groupBy("word").agg(F.lit(label).alias("random")).orderBy(F.xxhash64("word"), "word").limit(samples)
    return some(flagged.union(made), 1).unionByName(some(plain, 0))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random against ordinary; SIZE * SIZE values."""
    counts = samples.select("random", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {(r["random"], r["pair"]): r["n"] for r in counts}
    table_ = []
    for a in range(SIZE):
        total = [sum(n.get((k, a * SIZE + b), 0) for b in range(SIZE)) + SMOOTHING * SIZE for k in (0, 1)]
        table_ += [math.log((n.get((1, a * SIZE + b), 0) + SMOOTHING) / total[1]) - math.log((n.get((0, a * SIZE + b), 0) + SMOOTHING) / total[0]) for b in range(SIZE)]
    return table_


def ratio(s: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string's character pairs, random against ordinary: a struct of total and mean (null without pairs)."""
    weights = F.array(*(F.lit(round(x, 6)) for x in model))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda acc, i: acc + F.element_at(weights, i + 1))
    return let(_pairs(s), lambda p: let(total(p), lambda t: F.struct(t.alias("total"), (t / F.nullif(F.size(p), F.lit(0))).alias("mean"))))


def looks_random(s: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    return let(ratio(s, model), lambda r: (r["total"] > TOTAL) & (r["mean"] > threshold))


def scan(docs: DataFrame, carry: list[str], model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """carry, base (array of base spans) and spans (those and the Markov ones): start, end, rank of KINDS, text.

    Null text counts as empty and has no span. Rows are judged one by one, repeated ids too; an empty table stays
    empty; other columns are ignored unless carried. Markov spans that a base span covers are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(text)
    random = F.filter(_spans(text, CANDIDATE, "markov"), lambda s: s["text"].rlike("[A-Za-z]") & looks_random(s["text"], model, threshold))
    rows = docs.select(*(F.col(f"`{c}`") for c in carry), base.alias("base"), random.alias("random"))
    new = F.filter("random", lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    every = F.array_sort(F.concat("base", new), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    return rows.select(*(F.col(f"`{c}`") for c in carry), "base", every.alias("spans"))


def digest_string(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scan(docs, ["doc_id"], train(labelled_samples(docs)))
    of = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", of(0), of(1), of(2), F.sha2(digest_string(F.col("base")), 256).alias("base_sha256"), digest_string(F.col("spans")).alias("spans"))
