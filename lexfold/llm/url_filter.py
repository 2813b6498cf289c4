"""URL filters: rules by host and path first, then naive Bayes over segmented hosts and path tokens.

A host's labels and a path's tokens are split into words by the most probable segmentation under a unigram model
(Viterbi), whose counts are those of all words of all pages. No model is gathered: every different token lists the
substrings that may be words (a filter of bounded size spares the others), which are joined with the counts, and is
segmented with what it finds. A multinomial naive Bayes classifier over the resulting words is trained on the urls
that the rules decide and judges the others; its counts are a table of words too.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.llm.common import forget, table, written

#: Verdict, host, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST = 255  # characters of a token that is segmented (a host's label has 63 at most); longer ones are a word each
BITMAP = 1 << 26  # most bits of the filter of words; any number of words is correct
FEW = 200_000  # rows of a table that is broadcast; larger ones are joined by shuffle
SMOOTHING = 0.5
SPLIT = r"[/\-_.~+,;=:%&()\s]+"  # between the tokens of a path


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    of = lambda k: F.coalesce(F.regexp_extract(url, parts, k), F.lit(""))
    return F.translate(of(1), UPPER, LOWER), of(2)


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def unigrams(texts: DataFrame, column: str) -> DataFrame:
    """w, n: how often each word (run of letters, in lower case) stands in a column of HTML or text, over all rows."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " "))
    found = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?<![\p{L}\d])\p{L}+(?![\p{L}\d])"), F.lit(0))).alias("w"))
    return found.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def segmented(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The cheapest split of name into words of the model and single characters; runs of those stay together."""
    unknown, longest = math.log(total + 1) + 1, max(map(len, counts), default=0)  # for each character of no word
    best, back = [0.0], [0]
    for i in range(1, len(name) + 1):
        cost, at = best[i - 1] + unknown, i - 1
        for j in range(max(0, i - longest), i):
            n = counts.get(name[j:i])
            if n is not None and best[j] + math.log(total + 1) - math.log(n) < cost:
                cost, at = best[j] + math.log(total + 1) - math.log(n), j
        best.append(cost)
        back.append(at)
    out, i, odd = [], len(name), ""
    while i:
        word = name[back[i] : i]
        if word in counts:
            out += [odd, word] if odd else [word]
            odd = ""
        else:
            odd = word + odd
        i = back[i]
    return [*out, odd][::-1] if odd else out[::-1]


def _beside(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is known to be small."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def segmentation(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, pieces of each different token. words: w, n, a written table."""
    spark = tokens.sparkSession
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total")).first()
    bits, total = min(BITMAP, max(1 << 10, 1 << (16 * size["n"]).bit_length())), int(size["total"] or 0)
    bit = F.crc32(F.col("w").cast("binary")) % bits
    lanes = words.select(bit.alias("b")).select(F.floor(F.col("b") / 32).cast("int").alias("at"), F.expr("shiftleft(1L, cast(b % 32 AS int))").alias("m")).groupBy("at").agg(F.bit_or("m").alias("m")).toPandas()  # BITMAP / 32 rows at most
    known = np.zeros(bits // 32, np.uint32)
    known[lanes["at"].to_numpy(np.int64)] = lanes["m"].to_numpy(np.int64).astype(np.uint32)
    held = spark.sparkContext.broadcast(known)

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches:
            token, part = [], []
            for t in b.column(0).to_pylist():
                if len(t) > LONGEST:
                    continue
                found = {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
                for x in found:
                    h = zlib.crc32(x.encode("utf-8", "surrogatepass")) % bits
                    if known[h >> 5] >> np.uint32(h & 31) & 1:
                        token.append(t)
                        part.append(x)
                if len(token) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(part, pa.string())], ["token", "w"])
                    token, part = [], []
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(part, pa.string())], ["token", "w"])

    def viterbi(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[t] if len(t) > LONGEST else segmented(t, {x["w"]: x["n"] for x in ws or ()}, total) for t, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["token", "pieces"])

    distinct = written(tokens.select("token").distinct(), "url-tokens")
    inside = distinct.mapInArrow(substrings, "token string, w string").join(words, "w").groupBy("token").agg(F.collect_list(F.struct("w", "n")).alias("ws"))  # a token has LONGEST ** 2 / 2 substrings at most
    return distinct.join(inside, "token", "left").select("token", "ws").mapInArrow(viterbi, "token string, pieces array<string>")


def url_words(urls: DataFrame, words: DataFrame) -> DataFrame:
    """host, path, feature: words of the host's labels but the last, which names a registry (h:), and of the path's tokens
    (p:; a number is #), as often as they occur, of every row of urls."""
    labels = lambda host: F.split(F.translate(host, "-", "."), r"\.")
    at_host = F.filter(F.flatten(F.transform(F.slice(F.split("host", r"\."), F.lit(1), F.greatest(F.size(F.split("host", r"\.")) - 1, F.lit(0))), labels)), lambda x: x != "")
    at_path = F.filter(F.split(F.lower("path"), SPLIT), lambda x: x != "")
    number = lambda t: t.rlike(r"^\d+$")
    kinds = F.concat(F.transform(at_host, lambda t: F.struct(F.lit("h:").alias("kind"), t.alias("token"))), F.transform(at_path, lambda t: F.struct(F.lit("p:").alias("kind"), F.when(number(t), "#").otherwise(t).alias("token"))))
    every = urls.select("host", "path", F.explode(kinds).alias("x")).select("host", "path", "x.kind", "x.token")
    split = written(segmentation(every.filter("token <> '#'"), words), "url-segments")
    pieces = F.coalesce("pieces", F.array("token"))
    return every.join(_beside(split), "token", "left").select("host", "path", F.explode(F.transform(pieces, lambda w: F.concat("kind", w))).alias("feature"))


def judge(pages: DataFrame, carry: list[str], words: DataFrame, rules=RULES) -> DataFrame:
    """carry, host, path, rule, verdict, score (log-odds of block; null where a rule decides) per row of pages. words: w, n.

    A null url, or one without ://, has an empty host and path; the classes' odds alone then decide. A score above
    0 blocks, ties allow; without any labelled url everything undecided is allowed. Rows are judged one by one, repeated
    ones alike; an empty table stays empty; columns of any name can be carried. Very long urls are read whole.
    """
    host, path = host_and_path(F.col("url"))
    mine = "url"
    while any(c.lower().startswith(mine) for c in carry):
        mine += "_"
    h, p, r, v = (f"{mine}_{c}" for c in "hprv")
    parsed = pages.select(*(F.col(f"`{c}`") for c in carry), host.alias(h), path.alias(p))
    rule, verdict = rule_and_verdict(F.col(h), F.col(p), rules)
    ruled = written(parsed.withColumn(r, rule).withColumn(v, verdict), "url-ruled")
    # a url is told by its host and path: equal ones count together
    urls = written(ruled.groupBy(F.col(h).alias("host"), F.col(p).alias("path")).agg(F.first(v).alias("verdict"), F.count(F.lit(1)).alias("pages")), "urls")
    words = written(words, "url-words")
    found = written(url_words(urls.select("host", "path"), words).groupBy("host", "path", "feature").agg(F.count(F.lit(1)).alias("times")), "url-features")
    labelled = urls.filter("verdict IS NOT NULL")
    sided = lambda n: [F.coalesce(F.sum(F.when(F.col("verdict") == k, n)), F.lit(0)).alias(k) for k in ("block", "allow")]
    docs = labelled.agg(*sided(F.col("pages"))).first()
    counts = written(found.join(labelled, ["host", "path"]).groupBy("feature").agg(*sided(F.col("pages") * F.col("times"))), "url-counts")
    sums = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    size = {k: (sums[k] or 0) + SMOOTHING * (sums["n"] + 1) for k in ("block", "allow")}  # one more for words that were never labelled
    prior, unseen = math.log((docs["block"] + SMOOTHING) / (docs["allow"] + SMOOTHING)), math.log(size["allow"] / size["block"])
    odds = counts.select("feature", (F.log((F.col("block") + SMOOTHING) / (F.col("allow") + SMOOTHING)) + F.lit(unseen)).alias("odds"))
    asked = urls.filter("verdict IS NULL").select("host", "path")
    open_ = found.join(asked, ["host", "path"], "left_semi").join(_beside(odds), "feature", "left")
    score = open_.groupBy("host", "path").agg(F.sum(F.col("times") * F.coalesce("odds", F.lit(unseen))).alias("score"))
    score = written(asked.join(score, ["host", "path"], "left").select(F.col("host").alias(f"{mine}_sh"), F.col("path").alias(f"{mine}_sp"), (F.coalesce("score", F.lit(0.0)) + F.lit(prior)).alias(f"{mine}_ss")), "url-scores")
    forget(pages.sparkSession, found, counts, words)
    out = ruled.join(_beside(score), (F.col(h) == F.col(f"{mine}_sh")) & (F.col(p) == F.col(f"{mine}_sp")), "left")
    decided = F.coalesce(F.col(v), F.when(F.col(f"{mine}_ss") > 0, "block").otherwise("allow"))
    return out.select(*(F.col(f"`{c}`") for c in carry), F.col(h).alias("host"), F.col(p).alias("path"), F.col(r).alias("rule"), decided.alias("verdict"), F.col(f"{mine}_ss").alias("score"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), ["page_id"], unigrams(pages.select("html"), "html"))
