"""Boolean, phrase and prefix search over word postings, and search-term hit reports.

A query is parsed on the driver into alternatives of conjunctions of possibly negated atoms; NOT binds closest, then
phrases, AND (also between bare words) and OR. Texts are tokenised once per report; single words and prefixes are
matched against the words of each text, phrases against consecutive ones. Matching is exact on lower-cased words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfold.batches import mapped
from lexfold.operators.patterns import automaton, occurrences
from lexfold.storage import written

#: Words are runs of letters, digits, _ and -.
WORD = r"[\p{L}\p{N}_-]+"


@dataclass(frozen=True)
class Atom:
    words: tuple[str, ...]
    prefix: bool = False
    negated: bool = False

    def text(self) -> str:
        body = "(" + " <-> ".join(self.words) + ")" if self.quoted else self.words[0] + (":*" if self.prefix else "")
        return "!" + body if self.negated else body

    quoted: bool = False


def lexeme(word: str) -> str:
    kept = "".join(re.findall(r"[\w-]+", word)).lower()
    return kept if any(c.isalnum() or c == "_" for c in kept) else ""


def parse(query: str) -> list[tuple[str, Atom]]:
    """(operator before it, atom) in order; the first operator is empty. Dangling operators vanish."""
    out: list[tuple[str, Atom]] = []
    waiting, negated = None, False
    for quoted, bare in re.findall(r'"([^"]*)"|([^\s"]+)', query):
        upper = bare.upper()
        if not quoted and upper in ("AND", "OR"):
            waiting = ("&" if upper == "AND" else "|") if out else None
            continue
        if not quoted and upper == "NOT":
            negated = True
            continue
        if quoted:
            atom = Atom(tuple(w for w in map(lexeme, quoted.split()) if w), False, negated, True)
        else:
            prefix = bare.endswith("*")
            word = lexeme(bare[:-1] if prefix else bare)
            atom = Atom((word,) if word else (), prefix, negated)
        if atom.words:
            out.append(((waiting or "&") if out else "", atom))
            waiting, negated = None, False
    return out


def compiled(query: str) -> str:
    """The query in normal notation, always well formed; empty when nothing is asked."""
    return " ".join(x for op, atom in parse(query) for x in (op, atom.text()) if x)


def by_mode(semantic: DataFrame | None, full: DataFrame) -> DataFrame:
    """Rows of semantic (None where filters forbid it) with mode, or those of full where it has none."""
    text = full.withColumn("mode", F.lit("full_text"))
    if semantic is None:
        return text
    found = written(semantic, "semantic")  # at most a page
    none = found.agg((F.count(F.lit(1)) == 0).alias("none"))
    return found.withColumn("mode", F.lit("semantic")).union(text.join(F.broadcast(none)).filter("none").drop("none"))  # none: one row


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _has(words: Column, atom: Atom) -> Column:
    if len(atom.words) > 1:
        at = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(" " + " ".join(atom.words) + " ")
    elif atom.prefix:
        at = F.exists(words, lambda w: w.startswith(atom.words[0]))
    else:
        at = F.array_contains(words, atom.words[0])
    return ~at if atom.negated else at


def matches(words: Column, query: str) -> Column:
    """Whether words (of tokens()) satisfy the query; false for an empty one."""
    branches: list[Column] = []
    for op, atom in parse(query):
        m = _has(words, atom)
        if op == "&":
            branches[-1] = branches[-1] & m
        else:
            branches.append(m)
    out = F.lit(False)
    for b in branches:
        out = out | b
    return out


MANY = 24  # words, phrases and prefixes of a report, from which an automaton finds them all in one pass


def _padded(atom: Atom) -> str:
    return f" {' '.join(atom.words)}" + ("" if atom.prefix else " ")


def hits_in_one_pass(words: Column, terms: list[str]) -> Column:
    """The terms that words (of tokens()) satisfy, in order: each text is gone through once for all words of all terms."""
    asked = [(t, [[(_padded(a), a.negated) for a in branch] for branch in _branches(t)]) for t in terms]
    strings = [s for _, branches in asked for b in branches for s, _ in b]

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        every = automaton(strings)  # once a task

        def held(text: str) -> list[str]:
            there = {s for s, _ in occurrences(every, text)}
            return [name for name, branches in asked if any(all((s in there) != no for s, no in b) for b in branches)]

        for texts in batches:
            yield mapped(held, pa.list_(pa.string()), texts)

    return run(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))


def _branches(query: str) -> list[list[Atom]]:
    out: list[list[Atom]] = []
    for op, atom in parse(query):
        if op == "&":
            out[-1].append(atom)
        else:
            out.append([atom])
    return out


def term_report(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Per term: hits, with_families, unique_hits; and on every row total_docs, any_hits and any_with_families.

    docs: doc_id, family_id, text. A family counts when any member is hit, within docs only. A unique hit is a
    document that exactly one distinct term hits; a term listed twice gives two equal rows.
    """
    names = list(dict.fromkeys(terms))
    if sum(len(parse(t)) for t in names) >= MANY:
        hit = hits_in_one_pass(F.col("w"), names)
    else:
        hit = F.filter(F.array(*(F.when(matches(F.col("w"), t), F.lit(t)) for t in names)), lambda x: x.isNotNull())
    tokenised = docs.select("doc_id", "family_id", tokens(F.col("text")).alias("w"))
    # a few names per document: written once, as three aggregates read them
    scored = written(tokenised.select("doc_id", "family_id", hit.alias("terms")), "term-hits")
    by_family = Window.partitionBy(F.coalesce(F.col("family_id").cast("string"), F.concat(F.lit("\x00"), F.col("doc_id").cast("string"))))
    spread = scored.withColumn("family_terms", F.array_distinct(F.flatten(F.collect_set("terms").over(by_family))))
    total = spread.agg(F.count(F.lit(1)).alias("total_docs"), F.count_if(F.size("terms") > 0).alias("any_hits"), F.count_if(F.size("family_terms") > 0).alias("any_with_families"))
    own = spread.select(F.explode("terms").alias("term"), (F.size("terms") == 1).alias("alone")).groupBy("term").agg(F.count(F.lit(1)).alias("hits"), F.count_if("alone").alias("unique_hits"))
    fam = spread.select(F.explode("family_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("with_families"))
    asked = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(terms)], "term_no int, term string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return asked.join(F.broadcast(own), "term", "left").join(F.broadcast(fam), "term", "left").join(F.broadcast(total)).select("term_no", "term", zero("hits"), zero("with_families"), zero("unique_hits"), "total_docs", "any_hits", "any_with_families")


def file_type_filter(path: Column, kind: str | None, groups: dict[str, tuple[str, ...]]) -> Column:
    if kind == "native":
        return path.isNotNull()
    if kind == "images_only":
        return path.isNull()
    if kind in groups:
        out = F.lit(False)
        for ext in groups[kind]:
            out = out | F.lower(path).endswith(ext)
        return F.coalesce(out, F.lit(False))
    return F.lit(True)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic_search(chunks: DataFrame, query: list[float], per_page: int, page: int = 1) -> DataFrame:
    """The best chunk of each document among the nearest per_page * 5 chunks, a page of them by falling rank."""
    q = F.array(*(F.lit(float(x)) for x in query))
    near = chunks.select("document_id", "chunk_index", cosine(F.col("embedding"), q).alias("sim")).orderBy(F.desc("sim"), "document_id", "chunk_index").limit(per_page * 5)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("sim"), "chunk_index"))).filter("r = 1").drop("r")
    return best.orderBy(F.desc("sim"), "document_id").offset((page - 1) * per_page).limit(per_page).select("document_id", "chunk_index", F.round("sim", 4).alias("rank"))
