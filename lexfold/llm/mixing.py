"""Mixing to target weights with soft membership.

A classifier trained on a labelled table gives every document a posterior over domains: multinomial logistic regression
on the presence of words, and of the marks around them: all those whose presence differs between the domains beyond
chance. Its posteriors are those of maximum likelihood, so they mean what they say (the README has
held-out figures).
Nonnegative rates, one per document, are then fitted so that the expected tokens of each
domain, sum of rate * tokens * posterior, meet the targets in the least-squares sense.

The squared residual of each domain is divided by the domain's expected tokens at rate 1. Proximal steps lead from
rates of 1 to the optimum: each minimises this loss plus PROXIMAL times the squared move of the rates, documents
weighed by their tokens. The minimum is rate - posterior . y, cut at 0, for one vector y of as many numbers as there are
domains, found by Newton's method. A rate is therefore a function of the posterior and of the few steps taken: no state
is kept per document, and a trial of y is one aggregation of the domains' sums and their moments over positive rates.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.llm.common import WS, forget, let, table, written

SAMPLES = 5_000  # labelled rows the classifier is trained on, at most: the smallest hashes of doc_id
AROUND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # what is no part of a word at its ends
TELLING = 9.0  # least likelihood ratio statistic of a word (chi-squared with a degree a domain less one)
PENALTY = 0.001  # of the regression (half of it on absolute, half on squared weights)
STEPS = 60  # of fitting the regression, at most
PROXIMAL = 1e-6
CLOSE = 1e-4  # largest relative residual at which the targets are met
OPTIMAL = 1e-7  # share of the tokens that a gradient step would still move, at which rates are optimal

#: Production targets: shares of expected tokens.
TARGETS = {"good": 0.9, "poor": 0.09, "toxic": 0.01}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain: toxic, else good or poor by quality; rows without both are left out, the largest name wins among repeats."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).dropna().groupBy("doc_id").agg(F.max("domain").alias("domain"))


def _split(text: Column) -> Column:
    """Words of text in lower case; the first and the last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), WS + "+")


def _hashes(words: Column) -> Column:
    """Of each word, without what stands around it, and of what stands around it where anything does: "%%%" of "the%%%"."""
    bare = lambda w: F.btrim(w, F.lit(AROUND))
    of_words = lambda ws: F.transform(ws, lambda w: F.xxhash64(bare(w)))
    of_marks = lambda ws: F.transform(F.filter(ws, lambda w: w != bare(w)), lambda w: F.xxhash64(F.replace(w, bare(w), F.lit(""))))
    return let(words, lambda ws: F.concat(of_words(ws), of_marks(ws)))


def _list(values, kind: str) -> Column:
    """A long constant array, as text that is folded once; never empty."""
    return F.split(F.lit(",".join(values)), ",").cast(f"array<{kind}>")


def perfect_cells(hashes: list[int]) -> tuple[list[int], dict[int, int]]:
    """A cell of its own for each of different 64-bit hashes: shifts by group, and the hash of each used cell.

    The lowest bits of a hash say its group, the group's shift which other bits say the cell. Groups take the first shift
    that leads to free cells, large groups first; should one find none, the table is doubled.
    """
    low = max(1, (len(hashes) // 2).bit_length())
    while True:
        groups: dict[int, list[int]] = {}
        for h in hashes:
            groups.setdefault(h & ((1 << low) - 1), []).append(h)
        shifts, cells, mask = [low] * (1 << low), {}, (1 << (low + 3)) - 1
        for g, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            for shift in range(low, 64 - low - 2):
                at = {(h & ((1 << 64) - 1)) >> shift & mask: h for h in members}
                if len(at) == len(members) and cells.keys().isdisjoint(at):
                    shifts[g] = shift
                    cells |= at
                    break
            else:
                break
        else:
            return shifts, cells
        low += 1


@dataclass
class Classifier:
    """Log-odds of each domain against the first: in itself, and for each word (by hash) that a text has."""

    prior: list[float]
    words: list[tuple[int, list[float]]]

    def logits(self, hashes: Column) -> Column:
        """Of hashed words, the log-odds of each domain: an array."""
        if not self.words:
            return F.array(*(F.lit(p) for p in self.prior))
        shifts, cells = perfect_cells([h for h, _ in self.words])
        odds_of, size = dict(self.words), 8 * len(shifts)
        turn, held = _list(map(str, shifts), "int"), _list((str(cells.get(c, 0)) for c in range(size)), "bigint")
        odds = [_list((repr(round(odds_of[cells[c]][j], 5)) if c in cells else "0" for c in range(size)), "double") for j in range(1, len(self.prior))]
        shift = lambda h: F.get(turn, h.bitwiseAND(F.lit(len(shifts) - 1)).cast("int"))
        cell = lambda h: F.call_function("shiftrightunsigned", h, shift(h)).bitwiseAND(F.lit(size - 1)).cast("int")
        known = lambda hs: F.array_distinct(F.filter(hs, lambda h: F.get(held, cell(h)) == h))
        summed = lambda hits, o: F.aggregate(hits, F.lit(0.0), lambda a, h: a + F.get(o, cell(h)))
        total = lambda hits: F.array(F.lit(self.prior[0]), *(F.lit(p) + summed(hits, o) for p, o in zip(self.prior[1:], odds)))
        return let(known(hashes), total)


def posterior(logits: Column) -> Column:
    return let(let(logits, lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x)))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))


def telling_words(rows: DataFrame, names: list[str]) -> list[int]:
    """Hashes of all words that tell about the domain, of rows (domain, h: hashes); the most telling first. They are bounded
    by the training sample: a telling word stands in three of its rows at least."""
    n = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a domain
    n = [n.get(d, 0) for d in names]
    every = sum(n)
    present = rows.select("domain", F.explode(F.array_distinct("h")).alias("w")).filter(F.col("w") != F.xxhash64(F.lit("")))
    df = present.groupBy("w").agg(*(F.count_if(F.col("domain") == d).alias(f"n{j}") for j, d in enumerate(names)))
    both = sum((F.col(f"n{j}") for j in range(1, len(names))), F.col("n0"))

    def term(j: int, has: bool) -> Column:
        """observed * log(observed / expected) of a cell of the table of presence by domain"""
        seen = F.col(f"n{j}") if has else F.lit(n[j]) - F.col(f"n{j}")
        expected = F.lit(float(n[j])) * (both if has else F.lit(every) - both) / max(every, 1)
        return seen * F.log(F.greatest(seen, F.lit(1e-9)) / F.greatest(expected, F.lit(1e-9)))

    ratio = 2 * sum((term(j, has) for j in range(len(names)) for has in (True, False)), F.lit(0.0))
    told = df.filter(both >= 3).withColumn("ratio", ratio).filter(F.col("ratio") >= TELLING).orderBy(F.desc("ratio"), "w")
    return [r["w"] for r in told.collect()]


def _fitted(rows: DataFrame, names: list[str], known: list[int]) -> Classifier:
    """Logistic regression of rows (domain, h: hashes of words)."""
    place = F.element_at(F.create_map(*(F.lit(x) for j, d in enumerate(names) for x in (d, float(j)))), F.col("domain"))
    data = rows.select(place.alias("label"), F.transform("h", lambda h: h.cast("string")).alias("words"))
    vectors = CountVectorizerModel.from_vocabulary([str(h) for h in known], "words", "features", binary=True)
    fit = LogisticRegression(family="multinomial", regParam=PENALTY, elasticNetParam=0.5, maxIter=STEPS, standardization=False)
    model = fit.fit(vectors.transform(data).select("label", "features"))
    k = model.numClasses  # domains up to the last that occurs
    weight, base = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    prior = [*(float(base[j] - base[0]) for j in range(k)), *(-20.0 for _ in names[k:])]
    odds = weight - weight[:1]
    return Classifier(prior, [(h, [*map(float, odds[:, i]), *(0.0 for _ in names[k:])]) for i, h in enumerate(known) if np.abs(odds[:, i]).max() > 1e-4])


def train(docs: DataFrame, domains: DataFrame, names: list[str], samples: int = SAMPLES) -> Classifier:
    """The classifier of the chosen rows. Where labels are too few to fit anything, the shares of the domains alone; without any, all are equally likely."""
    spark = docs.sparkSession
    chosen = F.broadcast(domains.filter(F.col("domain").isin(names)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(samples))  # samples rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("domain", _hashes(_split(F.col("text"))).alias("h"))
    rows = written(rows, "mixing-train")
    telling = telling_words(rows, names)
    known = _list(map(str, telling), "bigint") if telling else F.array().cast("array<long>")
    small = written(rows.select("domain", F.array_intersect("h", known).alias("h")).coalesce(1), "mixing-train")  # samples rows, each of its telling words
    n = {r["domain"]: r["n"] for r in small.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if telling and len(n) > 1:
        out = _fitted(small, names, telling)
    else:
        out = Classifier([math.log((n.get(d, 0) + 0.5) / (n.get(names[0], 0) + 0.5)) for d in names], [])
    forget(spark, rows, small)
    return out


def scored(docs: DataFrame, carry: list[str], model: Classifier, name: str) -> DataFrame:
    """carry and, under name, t (hash of the text), tokens (words of it) and p (share of each domain), per row: one pass
    over the texts, without a shuffle."""
    body = let(_split(F.col("text")), lambda w: F.struct((F.size(w) - (F.get(w, F.lit(0)) == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")).cast("long").alias("tokens"), model.logits(_hashes(w)).alias("e")))
    found = docs.select(*(F.col(f"`{c}`") for c in carry), F.struct(F.xxhash64("text").alias("t"), body.alias("b")).alias(name))
    return found.withColumn(name, F.struct(F.col(f"{name}.t").alias("t"), F.col(f"{name}.b.tokens").alias("tokens"), posterior(F.col(f"{name}.b.e")).alias("p")))


def _rate(p: Column, steps: list[list[float]]) -> Column:
    if not steps:
        return F.lit(1.0)
    move = lambda s: sum((F.get(s, F.lit(j)) * F.get(p, F.lit(j)) for j in range(1, len(steps[0]))), F.get(s, F.lit(0)) * F.get(p, F.lit(0)))
    return F.aggregate(F.array(*(F.array(*(F.lit(x) for x in s)) for s in steps)), F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - move(s)))


def fit(rows: DataFrame, tokens: Column, p: Column, targets: list[float], budget: float | None = None) -> list[list[float]]:
    """The steps that lead from rates of 1 to the fitted ones. targets: shares, in the order of p.

    budget: expected tokens in all; by default the least for which no domain of a target share of at least a
    tenth has to shrink, so that only rare, unwanted domains are thinned out.

    Ends when the targets are met or, where no nonnegative rates meet them, at the optimum: a step's gradient is
    PROXIMAL times the move that led there, so the tokens moved tell how far the optimality condition is missed.
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def tried(steps: list[list[float]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of rates after steps and then y: expected tokens by domain, moments over positive rates, tokens moved by y."""
        q = [F.col(f"p{j}") for j in range(k)]
        before = rows.select(tokens.cast("double").alias("t"), _rate(p, steps).alias("r0"), *(F.get(p, F.lit(j)).alias(f"p{j}") for j in range(k)))
        free = before.withColumn("r", F.greatest(F.lit(0.0), F.col("r0") - sum((F.lit(float(y[j])) * q[j] for j in range(1, k)), F.lit(float(y[0])) * q[0])))
        sums = [F.sum(F.col("t") * F.col("r") * x) for x in q] + [F.sum(F.when(F.col("r") > 0, F.col("t") * q[i] * q[j])) for i, j in pairs] + [F.sum(F.when(F.col("r") > 0, F.col("t") * F.abs(F.col("r") - F.col("r0"))))]
        got = [float(x or 0) for x in free.agg(*(x.alias(f"s{i}") for i, x in enumerate(sums))).first()]
        moments = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k:-1]):
            moments[i, j] = moments[j, i] = x
        return np.array(got[:k]), moments, got[-1]

    zero = np.zeros(k)
    base, moments, _ = tried([], zero)
    if not base.sum():
        return []
    share = sum(targets)
    if budget is None:
        budget = max(b / (t / share) for b, t in zip(base, targets) if t / share >= 0.1)
    goal = np.array([budget * t / share for t in targets])
    root = np.sqrt(np.maximum(base, 1e-9 * base.sum()))
    relative = lambda off: float(np.max(np.abs(off) / np.maximum(goal, 1.0)))
    steps: list[list[float]] = []
    now = base
    while True:
        y, worst = zero, relative(now - goal)
        if worst <= CLOSE:
            break
        if steps:
            _, moments, _ = tried(steps, zero)
        off, moved = now - goal, 0.0
        while relative(off) > CLOSE / 10:  # off: of the proximal step's own equations
            # scaled by root, the matrix is positive and at most 1 + PROXIMAL
            d = np.linalg.solve(moments / np.outer(root, root) + PROXIMAL * np.eye(k), off / root) / root
            slope, low, high, a = float(off @ d), 0.0, 1.0, 1.0
            while True:  # the slope along d falls: halve until the full step or a point near its zero is found
                at = y + a * d
                now, moments, moved = tried(steps, at)
                off = now - goal - PROXIMAL * root**2 * at
                left = float(off @ d)
                if left < -0.1 * slope:
                    high = a
                elif left > 0.5 * slope and a < 1.0:
                    low = a
                else:
                    break
                if high - low < 1e-12:
                    raise ArithmeticError(f"mixing rates don't converge: relative residual {relative(off):.3g}")
                a = (low + high) / 2
            y = at
        steps.append([float(x) for x in y])
        worst = relative(now - goal)
        if worst <= CLOSE or PROXIMAL * moved <= OPTIMAL * budget:
            break
    log = logging.getLogger(__name__)
    (log.info if worst <= CLOSE else log.warning)("mixing rates fitted in %d proximal steps, largest relative residual %.3g%s", len(steps), worst, "" if worst <= CLOSE else ": no nonnegative rates meet the targets")
    return steps


def mixed(docs: DataFrame, domains: DataFrame, targets: dict[str, float], carry: list[str] | None = None, budget: float | None = None) -> tuple[DataFrame, str]:
    """carry (all columns by default) and a struct (its name is returned) of tokens, p (by name order of targets),
    rate, and copies: the rate rounded to a neighbouring whole number, up as often as its fraction says, by a hash
    of doc_id and text.

    Null text has no tokens and takes the prior. Rows that repeat an id are weighted one by one and get equal
    rates and copies. An empty table stays empty; without labels all domains are equally likely. Columns of
    other names pass through.
    """
    carry = docs.columns if carry is None else carry
    names = sorted(targets)
    name = "mixing"
    while any(c.lower() == name for c in carry):
        name += "_"
    rows = written(scored(docs, carry, train(docs, domains, names), name), "mixing-rows")
    of = lambda c: F.col(f"{name}.{c}")
    steps = fit(rows.select(of("tokens").alias("tokens"), of("p").alias("p")), F.col("tokens"), F.col("p"), [targets[d] for d in names], budget)
    u = F.pmod(F.xxhash64(F.lit("copies"), F.col("doc_id") if "doc_id" in carry else F.lit(0), of("t")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rate = _rate(of("p"), steps)
    rated = let(rate, lambda r: F.struct(of("tokens").alias("tokens"), of("p").alias("p"), r.alias("rate"), F.floor(r + u).cast("int").alias("copies")))
    return rows.select(*(F.col(f"`{c}`") for c in carry), rated.alias(name)), name


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, name = mixed(table(spark, sf_dir, "documents").select("doc_id", "text"), labelled_domains(table(spark, sf_dir, "labels")), TARGETS, ["doc_id"])
    shares = [F.round(F.get(F.col(f"{name}.p"), F.lit(k)), 6).alias(f"p_{d}") for k, d in enumerate(sorted(TARGETS))]
    return rows.select("doc_id", f"{name}.tokens", *shares, F.round(f"{name}.rate", 6).alias("rate"), f"{name}.copies")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as many times as its rate says; those of rate below one may go.

    Null, empty and very long texts, repeated rows, empty tables and other columns (whatever their names) are treated as
    mixed() says; ties do not occur, as every row is judged by itself.
    """
    rows, name = mixed(docs, labelled_domains(table(spark, sf_dir, "labels")), TARGETS)
    times = F.sequence(F.lit(1), F.col(f"{name}.copies"))
    rows = rows.filter(F.col(f"{name}.copies") >= 1)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.when(F.col(f"{name}.copies") >= 1, times).otherwise(F.array().cast("array<int>"))).alias(f"{name}_time")).drop(f"{name}_time")
