"""Entities from candidates, document by document: what an earlier document brought in decides on the next.

A candidate is attached to an entity of its production and kind by its normal name, an alias, an address or a safe typo, in
this order and of several to the earliest; else it becomes an entity, with a suggestion where an earlier one is similar.
Attaching brings in aliases and addresses, so the order matters. Candidates that share none of these, over any number of
steps, cannot bear on one another: each such component is folded in order (folds.py).

Candidates that say the same are many (a name in every document), but only change something the first time after another
change. So the fold is given one of each between changes: first the first of each, then the first after each change found,
until no new change is found. What is left takes the decision of the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfold.operators import entities as E
from lexfold.operators.folds import COMPONENT, folded, labelled
from lexfold.storage import forget, written

OUT = "seq bigint, entity_id bigint, how string, changed boolean, aliases array<string>, emails array<string>"


def _typo_keys(name: str, longer: bool, least: int = 4) -> Iterator[tuple[str, int, str]]:
    """Forms in which a name and its safe typo meet: one of them as the longer, the other not."""
    words = name.split()
    for i, w in enumerate(words if len(words) > 1 else ()):
        rest = " ".join(words[:i] + [""] + words[i + 1 :])
        for form in {w[:j] + w[j + 1 :] for j in range(len(w))} if longer and len(w) >= least else () if longer else (w,):
            yield rest, i, form


class Matcher:
    """Entities of one component so far, in order of their ids."""

    def __init__(self) -> None:
        self.known: dict[int, dict] = {}
        self.by: dict[tuple, int] = {}

    def _note(self, key: tuple, entity: int) -> None:
        self.by[key] = min(entity, self.by.get(key, entity))

    def _find(self, c: dict) -> tuple[int | None, str]:
        kind = (c["production_id"], c["kind"])
        tiers = [("exact", [("name", *kind, c["norm"])]), ("alias", [("alias", *kind, c["norm"])])] if c["norm"] else []
        tiers.append(("email", [("email", *kind, e.lower()) for e in c["emails"] if e and "@" in e]))
        if c["norm"]:
            tiers.append(("typo", [("long" if not longer else "short", *kind, *k) for longer in (True, False) for k in _typo_keys(c["norm"], longer)]))
        for how, keys in tiers:
            found = [self.by[k] for k in keys if k in self.by]
            if found:
                return min(found), how
        return None, "create"

    def row(self, c: dict) -> Iterator[tuple]:
        kind = (c["production_id"], c["kind"])
        entity, how = self._find(c)
        changed = entity is None
        if entity is None:
            entity = c["seq"]
            self.known[entity] = {"norm": c["norm"], "aliases": list(c["forms"]), "emails": list(c["emails"])}
            new = list(zip(c["forms"], c["form_norms"]))
            if c["norm"]:
                self._note(("name", *kind, c["norm"]), entity)
                for longer in (True, False):
                    for k in _typo_keys(c["norm"], longer):
                        self._note(("long" if longer else "short", *kind, *k), entity)
        else:
            e = self.known[entity]
            new = [(f, n) for f, n in zip(c["forms"], c["form_norms"]) if n != e["norm"] and f not in e["aliases"]]
            emails = list(dict.fromkeys(e["emails"] + c["emails"])) if c["emails"] else e["emails"]
            changed = bool(new) or emails != e["emails"]
            e["aliases"] += [f for f, _ in new]
            e["emails"] = emails
        for _, n in new:
            if n:
                self._note(("alias", *kind, n), entity)
        for m in c["emails"]:
            if m and "@" in m:
                self._note(("email", *kind, m.lower()), entity)
        yield c["seq"], entity, how, changed, None, None

    def end(self) -> Iterator[tuple]:
        for i, e in self.known.items():
            yield None, i, None, None, e["aliases"], e["emails"]


def _touched() -> Column:
    """What a candidate can meet others through: names and addresses of its production and kind, hashed (equal hashes only join components)."""
    key = lambda what, x: F.xxhash64("production_id", "kind", F.lit(what), x)
    names = F.filter(F.concat(F.array("norm"), "met_forms"), lambda n: n != "")
    mails = F.filter(F.transform("emails", F.lower), lambda m: m.contains("@"))
    return F.concat(F.transform(names, lambda n: key("name", n)), F.transform(mails, lambda m: key("mail", m)), "typos")


def decided(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, entity_id, how) of every candidate, and entities: entity_id, production_id, kind, name, norm, role, aliases, emails.

    candidates: seq (a long that tells them apart and orders them), production_id, kind, name, role, forms, emails (arrays).
    An entity is known by the seq of the candidate that it began with. Nulls in arrays are left out; null names
    and kinds are blank, and candidates without a production belong to one of their own, -1.
    """
    clean = lambda c: F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    c = candidates.select("seq", F.coalesce("production_id", F.lit(-1)).alias("production_id"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("name", F.lit("")).alias("name"), "role", clean(F.col("forms")).alias("forms"), clean(F.col("emails")).alias("emails"))
    says = F.sha2(F.to_json(F.struct("production_id", "kind", "name", "forms", "emails"), {"ignoreNullFields": "false"}), 256).alias("says")
    c = written(c.select("*", says), "candidates")
    kinds = c.groupBy("says").agg(F.first("production_id").alias("production_id"), F.first("kind").alias("kind"), F.first("name").alias("name"), F.first("forms").alias("forms"), F.first("emails").alias("emails"))
    kinds = kinds.select("*", E.normal_name(F.col("name")).alias("norm"), F.transform("forms", E.normal_name).alias("form_norms"))
    kinds = written(kinds, "candidate-kinds")
    norms = kinds.filter("norm <> ''").select("production_id", "kind", "norm").distinct()
    # a form bears on others only where a candidate has it as its name
    met = kinds.select("says", "production_id", "kind", F.explode(F.array_distinct("form_norms")).alias("norm")).join(norms, ["production_id", "kind", "norm"], "left_semi")
    met = met.groupBy("says").agg(F.collect_set("norm").alias("met_forms"))
    pairs = E.typo_pairs(norms.withColumnRenamed("norm", "a"), norms.withColumnRenamed("norm", "b"), ["production_id", "kind"])
    near = pairs.groupBy("production_id", "kind", F.col("a").alias("norm")).agg(F.collect_set("b").alias("near"))
    kinds = kinds.join(met, "says", "left").join(near, ["production_id", "kind", "norm"], "left")
    typos = F.transform(F.coalesce("near", F.array().cast("array<string>")), lambda n: F.xxhash64("production_id", "kind", F.lit("name"), n))
    kinds = kinds.withColumn("typos", typos).withColumn("met_forms", F.coalesce("met_forms", F.array().cast("array<string>")))
    kinds = written(labelled(kinds, _touched(), F.xxhash64("says")).drop("near", "typos", "met_forms"), "candidate-components")

    at = written(c.select("seq", "says").join(kinds.select("says", COMPONENT), "says"), "candidate-places")
    changes, found = None, None
    while True:
        if changes is None:
            held = at.withColumn("after", F.lit(0))
        else:
            times = changes.groupBy(COMPONENT).agg(F.array_sort(F.collect_set("seq")).alias("times"))
            held = at.join(times, COMPONENT, "left").withColumn("after", F.coalesce(F.size(F.filter("times", lambda t: t < F.col("seq"))), F.lit(0))).drop("times")
        chosen = held.groupBy(COMPONENT, "says", "after").agg(F.min("seq").alias("seq")).join(kinds.drop(COMPONENT), "says")
        last, found = found, written(folded(chosen, ["seq"], Matcher, OUT), "persisted")
        new = found.filter("changed").select("seq").join(at.select("seq", COMPONENT), "seq")
        more = new if changes is None else new.join(changes, "seq", "left_anti")
        if last is not None:
            forget(c.sparkSession, last)
        if changes is not None and more.isEmpty():
            break
        changes = written(new if changes is None else changes.unionByName(more.select(*changes.columns)), "changes")
    first = found.filter("seq IS NOT NULL").select(F.col("seq").alias("first"), "entity_id", "how")
    chosen = held.groupBy(COMPONENT, "says", "after").agg(F.min("seq").alias("first")).join(first, "first")
    decisions = written(held.join(chosen, [COMPONENT, "says", "after"]).select("seq", "entity_id", "how"), "decisions")
    began = c.select(F.col("seq").alias("entity_id"), "production_id", "kind", "name", "role").join(found.filter("seq IS NULL").select("entity_id", "aliases", "emails"), "entity_id")
    entities = began.select("entity_id", "production_id", "kind", "name", E.normal_name(F.col("name")).alias("norm"), "role", "aliases", "emails")
    return decisions, written(entities, "entities")


def suggestions(entities: DataFrame) -> DataFrame:
    """entity_a, entity_b, score: of each entity the most similar one that was there before it, of equal ones the first."""
    e = entities.filter("norm <> ''")
    pairs = E.similar_names(e.select("production_id", "kind", F.col("norm").alias("a"), F.col("entity_id").alias("entity_a")), e.select("production_id", "kind", F.col("norm").alias("b"), F.col("entity_id").alias("entity_b")), ["production_id", "kind"], F.col("entity_b") < F.col("entity_a"))
    place = F.row_number().over(Window.partitionBy("entity_a").orderBy(F.desc("score"), "entity_b"))
    return pairs.withColumn("place", place).filter("place = 1").select("entity_a", "entity_b", F.round("score", 3).alias("score"))


def mentions(candidates: DataFrame, decisions: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, entity_id, surface_text, start, end, snippet of every mention, each place of an entity once, the first candidate's.

    candidates: seq, doc_id, forms; docs: doc_id, text. A candidate none of whose forms stands in the text has one
    mention without a place, of which an entity has one a document at most.
    """

    @F.pandas_udf("array<struct<seq:long,form:string,start:int,end:int,snippet:string>>")
    def locate(text: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for t, some in zip(text, asked):
            row = []
            for c in some:
                forms = [f for f in c["forms"] if f is not None]
                found = [{"seq": c["seq"], "form": f, "start": s, "end": e, "snippet": x} for f, s, e, x in E.Places([f for f in forms if f]).of(t or "")]
                row += found or [{"seq": c["seq"], "form": f, "start": None, "end": None, "snippet": None} for f in forms[:1]]
            out.append(row)
        return pd.Series(out)

    asked = candidates.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "forms"))).alias("asked"))  # of a document
    places = asked.join(docs.select("doc_id", "text"), "doc_id", "left").select("doc_id", F.explode(locate("text", "asked")).alias("m")).select("doc_id", "m.*")
    own = Window.partitionBy("doc_id", "entity_id", "start").orderBy("seq", "end")
    of = places.join(decisions.select("seq", "entity_id"), "seq").withColumn("place", F.row_number().over(own)).filter("place = 1")
    return of.select("doc_id", "entity_id", F.col("form").alias("surface_text"), "start", "end", "snippet")


def named(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """doc_id, name (lower case), entity_id: whom a name stands for in its document, of several the last."""
    rows = candidates.select("seq", "doc_id", F.lower("name").alias("name")).join(decisions, "seq")
    return rows.groupBy("doc_id", "name").agg(F.max_by("entity_id", "seq").alias("entity_id"))


def relationships(stated: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, source_id, target_id, type, evidence of stated relationships (doc_id, at, source, target, type, evidence).

    Those between two entities known in the document; of equal ones in a document the first.
    """
    side = lambda c: names.select("doc_id", F.col("name").alias(f"{c}_name"), F.col("entity_id").alias(f"{c}_id"))
    rows = stated.withColumn("source_name", F.lower("source")).withColumn("target_name", F.lower("target"))
    rows = rows.join(side("source"), ["doc_id", "source_name"]).join(side("target"), ["doc_id", "target_name"]).filter("source_id <> target_id")
    return rows.groupBy("doc_id", "source_id", "target_id", "type").agg(F.min_by("evidence", "at").alias("evidence"))
