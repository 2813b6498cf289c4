"""Quality rules: base counts, then robust multivariate outliers within each language and source.

Four statistics per document, transformed to be roughly bell-shaped, are judged by their Mahalanobis distance from
the minimum-covariance-determinant estimate of the document's (lang, source) group. From three starts (medians with
quartile ranges, means with covariances, means and covariances weighted by the inverse distance from the medians) the
estimate is concentrated, the nearest three quarters of the group giving the next centre and covariance, until the
determinant falls no more; a group keeps the estimate of least determinant. A group too small for an estimate of its own
is judged by that of its language, and a language too small by that of all documents.

A step is one aggregation: documents are counted and their moments summed by bin of distance, map-side first, and the
nearest bins give the next estimate. So groups of any size never meet in one task, and what a step shuffles does not
grow with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexfold.llm.common import let, table, words, written

SHARE = 0.75  # of a group that a concentration step takes
CORRECTION = 1.485  # makes the covariance of the nearest 75 % consistent for four normal variables
SETTLED = 1e-4  # fall of a log determinant that counts as none
MIN_GROUP = 50  # smaller groups are judged by their language, smaller languages by all documents
MIN_ALL = 10  # of fewer documents nothing can be estimated (twice the statistics and one): they are kept
CUTOFF = 28.47  # squared distance from which a document is an outlier: 0.99999 quantile of chi-squared with 4 degrees
FEW = 20_000  # estimates that are broadcast; more are joined by shuffle
FLOORS = (0.05, 0.05, 0.08, 0.08)  # standard deviation added to each statistic, so that constant ones are no trap
X = ("x1", "x2", "x3", "x4")
FINE = 1024  # histogram bins per unit
FACTOR = [f"l{i}{j}" for i in range(1, 5) for j in range(1, i + 1)]


def _repeat_words(w: Column) -> Column:
    """Words covered by windows of eight words that occur at least twice among w (64-bit window hashes)."""
    n = F.size(w)
    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice(h, i, 8))))
    covered = lambda at: F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-8).alias("last")),
        lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(8), i - acc["last"])).alias("sum"), i.alias("last")),
        lambda acc: acc["sum"],
    )
    same = lambda s, e, j: F.coalesce(e["h"] == F.get(s, j)["h"], F.lit(False))
    twice = lambda h: let(
        F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i")))),
        lambda s: F.array_sort(F.transform(F.filter(s, lambda e, j: same(s, e, j - 1) | same(s, e, j + 1)), lambda e: e["i"])),
    )
    return F.when(n < 9, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(twice(h), covered))))


def base_counts(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines (lines with a word) and n_repeat_words, as a struct."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))


def with_counts(docs: DataFrame, carry: list[str], name: str) -> DataFrame:
    """carry, and under name a struct of the base counts, the group key and the four statistics."""
    counted = docs.select(*(F.col(f"`{c}`") for c in carry), base_counts(F.col("text")).alias(name), F.concat(F.coalesce("lang", F.lit("\x00")), F.lit("\x01"), F.coalesce("source", F.lit("\x00"))).alias(f"{name}_group"))
    c = lambda f: F.col(f"{name}.{f}")
    n, chars = c("w.n_words"), F.greatest(c("w.word_chars"), F.lit(1))
    return counted.withColumn(
        name,
        F.struct(
            F.col(f"{name}_group").alias("g"),
            F.split_part(F.col(f"{name}_group"), F.lit("\x01"), F.lit(1)).alias("lang"),
            n.alias("n_words"),
            c("w.word_chars").alias("word_chars"),
            c("n_symbols").alias("n_symbols"),
            c("l.n_dup_lines").alias("n_dup_lines"),
            c("w.n_repeat_words").alias("n_repeat_words"),
            ((n < 20) | (100 * c("w.n_repeat_words") > 30 * n)).alias("base_failed"),
            F.log(1 + chars / F.greatest(n, F.lit(1))).alias("x1"),
            F.sqrt(c("n_symbols") / chars).alias("x2"),
            F.sqrt(c("l.n_dup_lines") / F.greatest(c("l.n_lines"), F.lit(1))).alias("x3"),
            F.sqrt(c("w.n_repeat_words") / F.greatest(n, F.lit(1))).alias("x4"),
        ),
    ).drop(f"{name}_group")


def _distance(x, p) -> Column:
    """Squared Mahalanobis distance by forward substitution with the lower Cholesky factor l11..l44."""
    z: list[Column] = []
    for i in range(1, 5):
        rest = x[f"x{i}"] - p[f"m{i}"]
        for j, zj in enumerate(z, 1):
            rest = rest - p[f"l{i}{j}"] * zj
        z.append(rest / p[f"l{i}{i}"])
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _columns() -> dict[str, Column]:
    return {c: F.col(c) for c in (*X, *(f"m{i}" for i in range(1, 5)), *FACTOR)}


MOMENTS = [(j, i) for i in range(1, 5) for j in range(1, i + 1)]
ESTIMATE = [*(f"m{i}" for i in range(1, 5)), *FACTOR, "det"]


def _beside(estimates: DataFrame) -> DataFrame:
    """A written table of estimates, to be broadcast if it is known to be small."""
    return F.broadcast(estimates) if estimates.limit(FEW + 1).count() <= FEW else estimates


def _sums(weight: Column | None = None) -> list[Column]:
    """Aggregates that give means and covariances: n, s1..s4, s11..s44."""
    of = lambda c: F.sum(c if weight is None else weight * c)
    return [of(F.lit(1.0)).alias("n"), *(of(F.col(x)).alias(f"s{x[1]}") for x in X), *(of(F.col(f"x{j}") * F.col(f"x{i}")).alias(f"s{j}{i}") for j, i in MOMENTS)]


def _estimated(sums: DataFrame, key: list[str], scale: float) -> DataFrame:
    """key, means, the Cholesky factor of scale * covariance + floors, and the logarithm of its determinant."""
    out = sums.select(*key, *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(1, 5)), *((F.col(f"s{j}{i}") / F.col("n")).alias(f"s{j}{i}") for j, i in MOMENTS))
    for i in range(1, 5):
        for j in range(1, i + 1):
            c = F.col(f"s{j}{i}") - F.col(f"m{j}") * F.col(f"m{i}")
            c = scale * (F.greatest(c, F.lit(0.0)) if i == j else c) + (FLOORS[i - 1] ** 2 if i == j else 0.0)
            for k in range(1, j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l{j}{j}"))
    return out.withColumn("det", 2 * sum((F.log(f"l{i}{i}") for i in range(2, 5)), F.log("l11"))).select(*key, *ESTIMATE)


def _medians(stats: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each group, as centre and diagonal factor."""
    bins = stats.select("g", F.posexplode(F.array(*X)).alias("k", "x")).groupBy("g", "k", F.floor(F.col("x") * FINE).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g", "k")
    run = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) / FINE
    flat = run.groupBy("g", "k").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    of = lambda c, k: F.max(F.when(F.col("k") == k - 1, F.col(c)))
    wide = flat.groupBy("g").agg(*(of("mid", k).alias(f"m{k}") for k in range(1, 5)), *(((of("hi", k) - of("lo", k)) / 1.349 + FLOORS[k - 1]).alias(f"l{k}{k}") for k in range(1, 5)))
    off = [F.lit(0.0).alias(c) for c in FACTOR if c[1] != c[2]]
    return wide.select("*", *off, F.lit(None).cast("double").alias("det")).select("g", *ESTIMATE)


def _starts(stats: DataFrame) -> DataFrame:
    """g, start and an estimate of each."""
    medians = written(_medians(stats), "quality-fit")
    means = _estimated(stats.groupBy("g").agg(*_sums()), ["g"], 1.0)
    near = stats.join(_beside(medians), "g").withColumn("w", 1 / (1 + F.sqrt(_distance(_columns(), _columns()))))
    signs = _estimated(near.groupBy("g").agg(*_sums(F.col("w"))), ["g"], 1.0)
    each = [df.select("g", F.lit(k).alias("start"), *ESTIMATE) for k, df in enumerate((medians, means, signs))]
    return written(each[0].union(each[1]).union(each[2]), "quality-fit")


def _concentrated(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step of every estimate (g, start): from the nearest SHARE of the group, in whole bins of the distance."""
    placed = stats.join(_beside(estimates), "g").withColumn("bin", F.floor(F.log(1 + _distance(_columns(), _columns())) * FINE))
    bins = placed.groupBy("g", "start", "bin").agg(*_sums())
    w = Window.partitionBy("g", "start")
    run = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    sums = ["n", *(f"s{i}" for i in range(1, 5)), *(f"s{j}{i}" for j, i in MOMENTS)]
    near = run.filter(F.col("upto") - F.col("n") < SHARE * F.col("all")).groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in sums))
    return _estimated(near, ["g", "start"], CORRECTION)


def _least(stats: DataFrame) -> DataFrame:
    """Of each group the estimate of least determinant, concentrated from all starts until none falls any more."""
    spark = stats.sparkSession
    now, done = written(_concentrated(stats, _starts(stats)), "quality-fit"), []
    while True:
        step = _concentrated(stats, now).select("g", "start", F.struct(*ESTIMATE).alias("new"))
        both = written(now.join(step, ["g", "start"]).withColumn("falls", F.col("new.det") < F.col("det") - SETTLED), "quality-fit")
        done.append(both.select("g", F.when(F.col("new.det") < F.col("det"), F.col("new")).otherwise(F.struct(*ESTIMATE)).alias("e")))
        now = both.filter("falls").select("g", "start", "new.*")
        if now.isEmpty():
            break
    every = done[0]
    for df in done[1:]:
        every = every.union(df)
    return written(every.groupBy("g").agg(F.min_by("e", F.col("e.det")).alias("e")).select("g", "e.*"), "quality-fit")


def fit(stats: DataFrame) -> DataFrame:
    """g, m1..m4, l11..l44 per group; stats: lang, g, x1..x4."""
    counts = written(stats.groupBy("lang", "g").agg(F.count(F.lit(1)).alias("n")), "quality-groups")
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("n_lang"), (F.min("n") < MIN_GROUP).alias("asked"))
    asked = of_lang.agg(F.sum("n_lang").alias("n"), F.max(F.col("asked") & (F.col("n_lang") < MIN_GROUP)).alias("asked")).first()
    lang, every = F.concat(F.lit("\x02"), "lang"), F.lit("\x03")
    large, spoken = F.col("n") >= MIN_GROUP, F.col("n_lang") >= MIN_GROUP
    judge = F.when(large, F.col("g")).when(spoken, lang).otherwise(every)
    gives = F.array_compact(F.array(F.when(large, F.col("g")), F.when(F.col("asked") & spoken, lang), F.when(F.lit(bool(asked["asked"])), every)))
    pools = written(counts.join(of_lang, "lang").select("g", judge.alias("pool"), gives.alias("gives")), "quality-pools")
    pooled = written(stats.join(_beside(pools), "g").select(F.explode("gives").alias("g"), *X), "quality-stats")
    least = _least(pooled)
    if (asked["n"] or 0) < MIN_ALL:
        least = least.filter("false")
    return written(pools.select("g", "pool").join(least.withColumnRenamed("g", "pool"), "pool").drop("pool", "det"), "quality-fit")


def judged(docs: DataFrame, carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """carry (all columns by default) and a struct of counts, d2, base_failed and kept; and the struct's name.

    Null text counts as empty and fails the base rules; null lang or source is a group of its own; rows that
    repeat an id are judged one by one; an empty table stays empty. Documents that fail the base rules take no
    part in the estimates. Ties at a step's limit are all taken. Columns of other names pass through untouched.
    """
    carry = docs.columns if carry is None else carry
    name = "quality"
    while any(c.lower().startswith(name) for c in carry):
        name += "_"
    rows = written(with_counts(docs, carry, name), "quality-rows")
    q = lambda f: F.col(f"{name}.{f}")
    params = fit(rows.filter(~q("base_failed")).select(q("g").alias("g"), q("lang").alias("lang"), *(q(x).alias(x) for x in X)))
    model = params.select("g", F.struct(*(c for c in params.columns if c != "g")).alias(f"{name}_model")).withColumnRenamed("g", f"{name}_g")
    d2 = let(F.struct(F.col(name), F.col(f"{name}_model")), lambda s: _distance(s[name], s[f"{name}_model"]))
    out = rows.join(_beside(model), q("g") == F.col(f"{name}_g"), "left").withColumn(
        name,
        F.struct(
            *(q(f).alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
            d2.alias("d2"),
            (~q("base_failed") & F.coalesce(d2 <= CUTOFF, F.lit(True))).alias("kept"),
        ),
    )
    return out.select(*(F.col(f"`{c}`") for c in carry), name), name


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, name = judged(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", *(f"{name}.{f}" for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, with their own columns; nulls, repeats and other names as in judged()."""
    rows, name = judged(docs)
    return rows.filter(f"{name}.kept").drop(name)
