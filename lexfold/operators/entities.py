"""Entity names: normal form, similarity, typo classes, mention spans and matching."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfold.operators.patterns import automaton, occurrences
from lexfold.storage import written

# Fixed values.
HONORIFICS = frozenset(("mr", "mrs", "ms", "dr", "prof", "hon", "esq", "jr", "sr", "ii", "iii"))
SUFFIXES = HONORIFICS | {"inc", "llc", "llp", "ltd", "lp", "plc", "pc", "pa", "co", "corp"}
# Words that are no names.
NON_NAME_TOKENS = (
    "he", "him", "his", "she", "her", "hers",
    "they", "them", "their", "theirs", "it", "its",
    "i", "me", "my", "mine", "we", "us", "our", "ours",
    "you", "your", "yours",
    "himself", "herself", "themselves", "myself", "itself", "ourselves",
    "this", "that", "these", "those",
    "who", "whom", "whose", "someone", "anyone", "everyone", "nobody",
    "the", "a", "an", "unknown", "n/a", "none", "various", "other", "others",
)
RATIO, TOKEN_RATIO = 0.85, 0.70
SNIPPET, PER_FORM = 80, 200


def normal_name(name: Column) -> Column:
    """Lower case without punctuation and honorifics; "Last, First" is turned round, suffixes after commas follow.

    Parts between commas are arrays of words. What comes after the last part that is more than suffixes stays behind.
    """
    among = lambda words, known: F.size(F.array_except(words, F.array(*(F.lit(k) for k in sorted(known))))) == 0
    parts = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), ","), lambda p: F.btrim(p) != "")
    words = F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    said = F.array_max(F.transform(words, lambda w, i: F.when((i == 0) | (F.size(w) == 0) | ~among(w, SUFFIXES), i + 1)))
    body, ends = F.slice(words, F.lit(1), F.coalesce(said, F.lit(0))), F.slice(words, F.coalesce(said, F.lit(0)) + 1, F.size(words))
    ordered = F.flatten(F.concat(F.when(said == 2, F.reverse(body)).otherwise(body), ends))
    return F.array_join(F.filter(ordered, lambda w: ~w.isin(*sorted(HONORIFICS))), " ")


def usable_name(name: Column) -> Column:
    """Whether a name has two letters or digits and is, without punctuation around it, no word that names nobody."""
    bare = F.lower(F.btrim(name, F.lit(".,'\"\u201c\u201d\u2018\u2019 ")))
    return name.rlike(r"[\p{L}\p{N}][^\p{L}\p{N}]*+[\p{L}\p{N}]") & ~bare.isin(*NON_NAME_TOKENS)


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def token_ratio(a: str, b: str) -> float:
    """Mean similarity of the shorter name's tokens to their best unused partners, less for what is left over; 0 without a common token."""
    short, long = sorted((a.split(), b.split()), key=len)
    if not short or set(short).isdisjoint(long):
        return 0.0
    free, total = dict(enumerate(long)), 0.0
    for t in short:
        score, j = max(((ratio(t, u), -k) for k, u in free.items()), default=(0.0, None))
        total += score
        if score > 0:
            free.pop(-j)
    return total / len(short) * (1 + (len(long) - len(free)) / len(long)) / 2


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def token_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_ratio(x, y) for x, y in zip(a, b)])


def is_typo(a: Column, b: Column, least: int = 4) -> Column:
    """Names of as many tokens, two or more, of which one differs, by one character more, in a token long enough."""
    x, y = F.split(a, " "), F.split(b, " ")
    odd = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: p["x"] != p["y"])
    p = F.get(odd, F.lit(0))
    lx, ly = F.char_length(p["x"]), F.char_length(p["y"])
    one = (F.abs(lx - ly) == 1) & (F.levenshtein(p["x"], p["y"]) == 1) & (F.greatest(lx, ly) >= least)
    return F.when((F.size(x) < 2) | (F.size(x) != F.size(y)) | (F.size(odd) != 1), False).otherwise(one)


def typo_pairs(left: DataFrame, right: DataFrame, on: list[str] | None = None, least: int = 4) -> DataFrame:
    """Pairs of rows of left (a) and right (b), equal in the columns `on`, whose names are typos of each other: as is_typo
    says, without comparing all: a longer token less one of its characters is the shorter one, and all else is equal.

    Columns of the two sides must have different names but for `on`.
    """
    on = on or []

    def keyed(rows: DataFrame, name: str, longer: bool) -> DataFrame:
        words = F.split(name, " ")
        each = rows.withColumn("_words", words).filter(F.size("_words") >= 2).select("*", F.posexplode("_words").alias("_i", "_t"))
        rest = F.transform("_words", lambda w, i: F.when(i == F.col("_i"), F.lit("")).otherwise(w))
        less = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("_t")), lambda j: F.concat(F.substring("_t", F.lit(1), j - 1), F.substring("_t", j + 1, F.char_length("_t")))))
        form = F.when(F.char_length("_t") >= least, less).otherwise(F.array().cast("array<string>")) if longer else F.array("_t")
        return each.select(*rows.columns, F.array_join(rest, " ").alias("_rest"), "_i", F.explode(form).alias("_form"))

    key = [*on, "_rest", "_i", "_form"]
    out = [keyed(left, "a", longer).join(keyed(right, "b", not longer), key) for longer in (False, True)]
    return out[0].unionByName(out[1]).drop("_rest", "_i", "_form").distinct()


def is_initial(a: Column, b: Column) -> Column:
    """Same last token, and one first token is the other's initial."""
    x, y = F.split(a, " "), F.split(b, " ")
    fx, fy = F.element_at(x, 1), F.element_at(y, 1)
    initial = ((F.char_length(fx) == 1) & fy.startswith(fx)) | ((F.char_length(fy) == 1) & fx.startswith(fy))
    return (F.size(x) >= 2) & (F.size(y) >= 2) & (F.element_at(x, -1) == F.element_at(y, -1)) & (fx != fy) & initial


def alike_names(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """on, a, b: distinct pairs of names that may have a ratio of RATIO or more: all that have, and few others.

    Names of lengths m and n and that ratio have at least `_least` characters in common, in order, so what is left over is
    x = m - _least of the one and y = n - _least of the other at most. Of x + y + 1 pieces of the one at least one is
    left whole and stands in the other, moved by no more than x to the front and y to the back; and the two are no more
    than x + y edits apart. Only lengths that occur are paired.
    """
    sides = [side.select(*on, F.col(c).alias(c)).distinct().withColumn(k, F.char_length(c)) for side, c, k in ((left, "a", "_m"), (right, "b", "_n"))]
    least = F.ceil((F.col("_m") + F.col("_n")) * F.lit(RATIO / 2) - F.lit(1e-9)).cast("int")
    lengths = sides[0].select(*on, "_m").distinct().join(sides[1].select(*on, "_n").distinct(), on).withColumn("_least", least).filter((F.col("_least") <= F.least("_m", "_n")) & (F.least("_m", "_n") > 0))
    lengths = lengths.withColumn("_odd", F.col("_m") + F.col("_n") - 2 * F.col("_least"))
    cut = lambda i: F.floor(i * F.col("_m") / (F.col("_odd") + 1)).cast("int")

    def pieces(name: str, moves: Column) -> Column:
        one = lambda i, by: F.struct(i.alias("i"), (cut(i) + by).alias("at"), (cut(i + 1) - cut(i)).alias("size"))
        every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("_odd")), lambda i: F.transform(moves, lambda by: one(i, by))))
        inside = F.filter(every, lambda p: (p["at"] >= 0) & (p["at"] + p["size"] <= F.char_length(name)))
        return F.explode(F.array_distinct(F.transform(inside, lambda p: F.struct(p["i"].alias("i"), F.substring(F.col(name), p["at"] + 1, p["size"]).alias("text")))))

    key = [*on, "_m", "_n", "_odd", "_piece"]
    moves = F.sequence(F.col("_least") - F.col("_m"), F.col("_n") - F.col("_least"))
    x = sides[0].join(lengths, [*on, "_m"]).select(*on, "_m", "_n", "_odd", "a", pieces("a", F.array(F.lit(0))).alias("_piece"))
    y = sides[1].join(lengths, [*on, "_n"]).select(*on, "_m", "_n", "_odd", "b", pieces("b", moves).alias("_piece"))
    near = F.expr("levenshtein(a, b, _odd) >= 0")
    return x.join(y, key).filter((F.col("a") != F.col("b")) & near).select(*on, "a", "b").distinct()


def similar_names(left: DataFrame, right: DataFrame, on: list[str], also: Column | None = None) -> DataFrame:
    """left and right (with names a and b) joined where the names differ and are similar, with their score.

    Initials with the same last word score 0.9; else the ratio counts from RATIO on; else that of words from TOKEN_RATIO on.
    """
    words = lambda side, c: side.select(*on, c, F.explode(F.array_distinct(F.split(c, " "))).alias("_word")).distinct()
    shared = words(left, "a").join(words(right, "b"), [*on, "_word"]).select(*on, "a", "b").filter("a <> b")
    pairs = written(shared.unionByName(alike_names(left, right, on)).distinct(), "name-pairs")
    scored = pairs.withColumn("r", ratio_udf("a", "b")).withColumn("t", token_ratio_udf("a", "b"))
    score = F.when(is_initial(F.col("a"), F.col("b")), 0.9).when(F.col("r") >= RATIO, F.col("r")).when(F.col("t") >= TOKEN_RATIO, F.col("t"))
    kept = scored.withColumn("score", score).filter("score IS NOT NULL").select(*on, "a", "b", "score")
    out = left.join(kept, [*on, "a"]).join(right, [*on, "b"])
    return out if also is None else out.filter(also)


class Places:
    """Where any of some forms stands in a text, found in one pass by an automaton of all of them."""

    def __init__(self, forms: list[str]):
        self.automaton = automaton([f for f in forms if f])

    def _whole(self, text: str, start: int, form: str) -> bool:
        end, word = start + len(form), re.compile(r"\w").match
        return not (form[0].isalnum() and start and word(text[start - 1])) and not (form[-1].isalnum() and end < len(text) and word(text[end]))

    def of(self, text: str) -> list[tuple[str, int, int, str]]:
        """Form, start, end and what stands around, without overlap: the longest first, then by form and place; PER_FORM of each."""
        found = [(g, s) for g, s in occurrences(self.automaton, text) if self._whole(text, s, g)]
        starts, ends, count, out = [], [], Counter(), []
        for form, s in sorted(found, key=lambda x: (-len(x[0]), x)):
            e = s + len(form)
            k = bisect.bisect_left(starts, e)  # intervals before k begin before e; they are disjoint and in order
            if count[form] < PER_FORM and (k == 0 or ends[k - 1] <= s):
                starts.insert(k, s)
                ends.insert(k, e)
                count[form] += 1
                out.append((form, s, e, text[max(0, s - SNIPPET) : e + SNIPPET]))
        return sorted(out, key=lambda m: m[1])


def mentions(docs: DataFrame, forms: list[str]) -> DataFrame:
    """doc_id, form, start, end, snippet."""

    @F.pandas_udf("array<struct<form:string,start:int,end:int,snippet:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = Places(forms)  # once a task
        for texts in batches:
            yield pd.Series([[{"form": f, "start": s, "end": e, "snippet": c} for f, s, e, c in places.of(t or "")] for t in texts])

    return docs.select("doc_id", F.explode(run("text")).alias("m")).select("doc_id", "m.*")


@F.pandas_udf(T.ArrayType(T.StructType().add("name", "string").add("address", "string")))
def addresses(headers: pd.Series) -> pd.Series:
    return pd.Series([[{"name": n.strip(), "address": a.strip().lower()} for n, a in getaddresses([(h or "").replace(";", ",")]) if "@" in a] for h in headers])


def match(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """candidate_id, entity_id, how, score: the best tier of exact, alias, email, typo or suggest; none is create.

    candidates: candidate_id, norm, kind, emails; entities: entity_id, norm, kind, aliases (normal forms), emails.
    Only names that share a word, a piece or an address are compared, and similar ones only for candidates of no better tier.
    """
    c, e = candidates, entities
    exact = c.join(e, ["norm", "kind"]).select("candidate_id", "entity_id", F.lit(1).alias("tier"), F.lit(1.0).alias("score"))
    alias = c.join(e.select("entity_id", "kind", F.explode("aliases").alias("norm")), ["norm", "kind"]).select("candidate_id", "entity_id", F.lit(2), F.lit(1.0))
    mail = c.select("candidate_id", "kind", F.explode("emails").alias("mail")).join(e.select("entity_id", "kind", F.explode("emails").alias("mail")), ["kind", "mail"]).select("candidate_id", "entity_id", F.lit(3), F.lit(1.0))
    typo = typo_pairs(c.select("candidate_id", "kind", F.col("norm").alias("a")), e.select("entity_id", "kind", F.col("norm").alias("b")), ["kind"]).select("candidate_id", "entity_id", F.lit(4), F.lit(1.0))
    left = c.join(exact.union(alias).union(mail).union(typo), "candidate_id", "left_anti")
    near = similar_names(left.select("candidate_id", "kind", F.col("norm").alias("a")), e.select("entity_id", "kind", F.col("norm").alias("b")), ["kind"])
    suggest = near.select("candidate_id", "entity_id", F.lit(5), "score")
    every = exact.union(alias).union(mail).union(typo).union(suggest)
    best = every.withColumn("k", F.row_number().over(Window.partitionBy("candidate_id").orderBy("tier", F.desc("score"), "entity_id"))).filter("k = 1").drop("k")
    how = F.element_at(F.array(*map(F.lit, ("exact", "alias", "email", "typo", "suggest"))), F.col("tier"))
    return c.select("candidate_id").join(best, "candidate_id", "left").select("candidate_id", "entity_id", F.when(F.col("entity_id").isNull(), "create").otherwise(how).alias("how"), "score")
