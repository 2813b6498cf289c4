"""Line dedup over overlapping windows of three consecutive lines.

Lines without a word are carried by the line before them. Each window of three lines with words is hashed (128 bits);
windows that occur more than once in the whole corpus are found by one aggregation, which also gives the first
occurrence, by doc_id and position. Every later occurrence covers its three lines; covered positions are merged per
document and those lines leave the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.llm.common import let, table, written

SPACE = " \t\n\x0b\f\r"


def _with_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _key() -> list[Column]:
    """A row's place in the order of documents: doc_id, then (for rows that repeat it) a hash of the text."""
    return [F.col("doc_id").alias("d"), F.xxhash64(_text()).alias("t")]


def windows(docs: DataFrame) -> DataFrame:
    """h1, h2 (hash), d, t, pos (of the first line, among lines with words) per window."""
    lines = F.transform(F.filter(F.split(_text(), "\n"), _with_word), lambda x: F.xxhash64(F.btrim(x, F.lit(SPACE))))
    lines2 = F.transform(F.filter(F.split(_text(), "\n"), _with_word), lambda x: F.xxhash64(F.lit("second"), F.btrim(x, F.lit(SPACE))))
    three = lambda a, i: [F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)]
    at = let(
        F.struct(lines.alias("a"), lines2.alias("b")),
        lambda s: F.when(
            F.size(s["a"]) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(s["a"]) - 3), lambda i: F.struct(F.xxhash64(*three(s["a"], i)).alias("h1"), F.xxhash64(*three(s["b"], i)).alias("h2"), i.alias("pos"))),
        ),
    )
    # outer, as a plain explode would have its whole expression evaluated a second time in a filter
    return docs.select(*_key(), F.explode_outer(at).alias("w")).filter("w IS NOT NULL").select("w.h1", "w.h2", "d", "t", "w.pos")


def later_windows(docs: DataFrame) -> DataFrame:
    """d, t, pos of every window that is not its content's first occurrence."""
    place = F.struct(F.col("d").isNull().alias("last"), "d", "t", "pos")
    first = windows(docs).groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return windows(docs).join(first.hint("shuffle_hash"), ["h1", "h2"]).filter(place > F.col("first")).select("d", "t", "pos")


def _without(text: Column, covered: Column) -> Column:
    """text without the lines that windows at covered (sorted, distinct positions) span."""
    lines = F.split(text, "\n")

    def cut(s: Column) -> Column:
        n, units = F.size(s["lines"]), F.size(s["at"])
        start = lambda u: F.when(u <= 0, F.lit(0)).when(u >= units, n).otherwise(F.get(s["at"], u))  # noqa: E731  raw line at which a unit begins
        piece = lambda a, b: F.slice(s["lines"], start(a) + 1, F.greatest(start(b) - start(a), F.lit(0)))
        head = piece(F.lit(0), F.get(s["p"], F.lit(0)))
        rest = F.transform(s["p"], lambda q, i: F.when(F.coalesce(F.get(s["p"], i + 1), units) > q + 3, piece(q + 3, F.coalesce(F.get(s["p"], i + 1), units))).otherwise(F.array().cast("array<string>")))
        return F.array_join(F.concat(head, F.flatten(rest)), "\n")

    at = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(_with_word(x), i)), lambda i: i.isNotNull())
    return let(let(lines, lambda ls: F.struct(ls.alias("lines"), at(ls).alias("at"), covered.alias("p"))), cut)


def dedup_lines(docs: DataFrame) -> tuple[DataFrame, str]:
    """All rows and columns of docs with the new text, and a struct column (its name is returned) of
    n_lines and n_removed, which count lines with words.

    Null text stays null; texts of fewer than three lines with words stay as they are. Rows that repeat a doc_id are
    ordered by a hash of their text; wholly equal rows count as one document and lose the same lines. Null doc_ids
    come last. An empty table stays empty; columns of other names pass through untouched.
    """
    name = "line_dedup"
    while any(c.lower() == name for c in docs.columns):
        name += "_"
    covers = later_windows(docs).groupBy("d", "t").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    covers = written(covers.select(F.col("d").alias(f"{name}_d"), F.col("t").alias(f"{name}_t"), F.col("p").alias(f"{name}_p")), "line-covers")
    d, t = _key()
    joined = docs.join(covers.hint("shuffle_hash"), d.eqNullSafe(F.col(f"{name}_d")) & (t == F.col(f"{name}_t")), "left")
    p = F.col(f"{name}_p")
    n_removed = let(p, lambda p: F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, q: F.struct((a["n"] + F.least(F.lit(3), q - a["last"])).alias("n"), q.alias("last")), lambda a: a["n"]))
    info = F.struct(F.size(F.filter(F.split(_text(), "\n"), _with_word)).cast("long").alias("n_lines"), F.coalesce(n_removed, F.lit(0).cast("long")).alias("n_removed"))
    out = [F.when(p.isNotNull(), _without(F.col("text"), p)).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*out, info.alias(name)), name


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, name = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", f"{name}.n_lines", f"{name}.n_removed", "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without repeated lines; those of which no line is left go. n_chars follows the text."""
    rows, name = dedup_lines(docs)
    rows = rows.filter((F.col(f"{name}.n_removed") == 0) | (F.col(f"{name}.n_removed") < F.col(f"{name}.n_lines"))).drop(name)
    return rows.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else rows


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, text, ls, list_filter(range(len(ls)), lambda i: regexp_matches(ls[i + 1], '[^\x20\x09-\x0D]')) AS nb FROM d),
w AS (SELECT doc_id, p, [trim(ls[nb[p + j] + 1], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FOR j IN [1, 2, 3]] AS k
      FROM (SELECT doc_id, ls, nb, unnest(range(len(nb) - 2)) AS p FROM u WHERE len(nb) >= 3)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM w),
c AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS unit FROM f WHERE rn > 1),
g AS (SELECT doc_id, list(unit) AS units FROM c GROUP BY doc_id)
SELECT u.doc_id, len(nb) AS n_lines, coalesce(len(units), 0) AS n_removed,
       CASE WHEN units IS NULL THEN text ELSE coalesce(array_to_string(
            [ls[i + 1] FOR i IN range(len(ls)) IF NOT list_contains(units, greatest(len([x FOR x IN nb IF x <= i]) - 1, 0))], chr(10)), '') END AS text
FROM u LEFT JOIN g USING (doc_id)
"""
