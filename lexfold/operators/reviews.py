"""Decisions on merges and timelines, applied in order: each sees what the ones before it left.

Merges of two entities make one vanish, so a later decision may find its entity gone, its mentions more or its name new.
Decisions that touch no entity (or event) in common, over any number of steps, do not bear on one another and are
applied side by side (folds.py).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfold.operators import entities as E
from lexfold.operators.folds import COMPONENT, folded, labelled
from lexfold.storage import written

# Fixed values.
MERGE_GATE, TIMELINE_GATE = 0.85, 0.8
EVENT_TYPES = ("meeting", "communication", "payment", "filing", "agreement", "other")


def _entities(entities: DataFrame, places: DataFrame | None) -> DataFrame:
    """entities with shared: the places (document and offset, hashed) that other entities have mentions at too."""
    have = set(entities.columns)
    e = entities.select("entity_id", "production_id", "kind", "name", *([F.col("aliases")] if "aliases" in have else [F.array().cast("array<string>").alias("aliases")]), F.coalesce("mentions", F.lit(0)).cast("bigint").alias("mentions"))
    if places is None:
        return e.withColumn("shared", F.array().cast("array<bigint>"))
    p = places.filter("start_offset IS NOT NULL").select("entity_id", F.xxhash64("doc_id", "start_offset").alias("place")).distinct()
    common = p.groupBy("place").count().filter("count > 1").select("place")
    some = p.join(common, "place").groupBy("entity_id").agg(F.collect_list("place").alias("shared"))
    return e.join(some, "entity_id", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<bigint>")))


class People:
    """Entities of one component as merges and renames leave them."""

    def __init__(self) -> None:
        self.known: dict[int, dict] = {}
        self.gone: dict[int, int] = {}

    def meet(self, things: list[dict] | None) -> None:
        for t in things or ():
            if t is not None and t["entity_id"] not in self.known:
                self.known[t["entity_id"]] = t | {"aliases": list(t["aliases"] or ()), "shared": set(t["shared"] or ()), "from": {t["entity_id"]}}

    def get(self, i: int | None) -> dict | None:
        return None if i in self.gone else self.known.get(i)

    def can_merge(self, a: dict, b: dict) -> str | None:
        if a["entity_id"] == b["entity_id"]:
            return "Cannot merge an entity into itself"
        if a["production_id"] != b["production_id"]:
            return "Entities belong to different productions"
        return "Entities are of different types" if a["kind"] != b["kind"] else None

    def merge(self, winner: dict, loser: dict) -> None:
        winner["mentions"] += loser["mentions"] - len(loser["shared"] & winner["shared"])
        winner["shared"] |= loser["shared"]
        winner["aliases"] += [a for a in dict.fromkeys([loser["name"], *loser["aliases"]]) if a not in winner["aliases"]]
        winner["from"] |= loser["from"]
        self.gone[loser["entity_id"]] = winner["entity_id"]


def _with_things(rows: DataFrame, ids: str, entities: DataFrame) -> DataFrame:
    """rows (at, ids: an array) with things, the entities of these ids."""
    e = entities.select("entity_id", F.struct("entity_id", "production_id", "kind", "name", "aliases", "mentions", "shared").alias("thing"))
    found = rows.select("at", F.explode(F.array_distinct(ids)).alias("entity_id")).join(e, "entity_id").groupBy("at").agg(F.collect_list("thing").alias("things"))
    return rows.join(found, "at", "left")


AUTO = "at bigint, winner bigint, loser bigint"


class _Typos(People):
    def row(self, r: dict) -> Iterator[tuple]:
        self.meet(r["things"])
        a, b = self.get(r["a"]), self.get(r["b"])
        if r["typo"] and a and b and a["kind"] == b["kind"] and not self.can_merge(a, b):
            winner, loser = (a, b) if a["mentions"] >= b["mentions"] else (b, a)
            self.merge(winner, loser)
            yield r["at"], winner["entity_id"], loser["entity_id"]

    def end(self) -> Iterator[tuple]:
        return iter(())


def auto_resolve(suggestions: DataFrame, entities: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """at, a, b, status, winner, loser: pending suggestions (at, a, b), in order of `at`, after all safe typos have merged.

    Of two names the one of more mentions wins, a of equals; who has gone is in no later merge. What is left pending with
    one that has gone is rejected; the same pair again counts as accepted. winner and loser are null where a row merged
    nothing. entities: entity_id, production_id, kind, name, mentions; places: entity_id, doc_id, start_offset of mentions,
    which count once in a merge.
    """
    e = written(_entities(entities, places), "review-entities")
    names = e.select("entity_id", E.normal_name(F.col("name")).alias("norm"))
    side = lambda c: names.select(F.col("entity_id").alias(c), F.col("norm").alias(f"{c}_norm"))
    rows = suggestions.select("at", "a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rows = rows.select("at", "a", "b", F.coalesce(E.is_typo(F.col("a_norm"), F.col("b_norm")), F.lit(False)).alias("typo"), F.array("a", "b").alias("ids"))
    touched = F.filter(F.col("ids"), lambda i: i.isNotNull())
    merges = written(folded(labelled(_with_things(rows, "ids", e).drop("ids").withColumn("ids", F.array("a", "b")), touched, F.xxhash64("at")).drop("ids"), ["at"], _Typos, AUTO), "review-merges")
    gone = lambda c: merges.select(F.col("loser").alias(c), F.col("winner").alias(f"{c}_to"))
    out = suggestions.select("at", "a", "b").join(gone("a"), "a", "left").join(gone("b"), "b", "left").join(merges, "at", "left")
    same = F.coalesce(F.col("a_to") == F.col("b"), F.lit(False)) | F.coalesce(F.col("b_to") == F.col("a"), F.lit(False))
    status = F.when(same, "accepted").when(F.col("a_to").isNotNull() | F.col("b_to").isNotNull(), "rejected").otherwise("pending")
    return out.select("at", "a", "b", status.alias("status"), "winner", "loser")


VERDICTS = ("merge", "distinct", "unclear")  # Fixed values.
ONE = "suggestion_id string, verdict string, keep_id string, reason string, confidence string, corrections array<string>"
FIX = "entity_id string, corrected_name string, reason string, confidence string"


def parse_merge_verdicts(answers: DataFrame) -> DataFrame:
    """id, place, suggestion_id, verdict, keep_id, reason, confidence, corrections of a model's answers (id, raw), in their order.

    What is no JSON object gives none; a verdict needs a known word and two numbers, a correction a name of 1 to 500
    characters, an entity and a number. Reasons are cut at 1,000 and 500 characters.
    """
    number = lambda c: c.try_cast("double")
    text = lambda c: F.coalesce(c, F.lit(""))
    # each element is read by itself: one that is no object spoils no other
    v = answers.select("id", F.posexplode(F.from_json("raw", "verdicts array<string>")["verdicts"]).alias("place", "v")).select("id", "place", F.from_json("v", ONE).alias("v")).select("id", "place", "v.*")
    named = lambda c: (F.char_length(F.btrim(text(c["corrected_name"]))).between(1, 500)) & (F.btrim(text(c["entity_id"])) != "") & number(c["confidence"]).isNotNull()
    shaped = lambda c: F.struct(F.btrim(c["entity_id"]).try_cast("bigint").alias("entity_id"), F.btrim(c["corrected_name"]).alias("corrected_name"), number(c["confidence"]).alias("confidence"), F.substring(text(c["reason"]), 1, 500).alias("reason"))
    kept = v.filter(F.col("verdict").isin(*VERDICTS) & number(F.col("suggestion_id")).isNotNull() & number(F.col("confidence")).isNotNull())
    fixes = F.transform(F.coalesce("corrections", F.array().cast("array<string>")), lambda c: F.from_json(c, FIX))
    corrections = F.transform(F.filter(fixes, named), shaped)
    return kept.select("id", "place", number(F.col("suggestion_id")).cast("bigint").alias("suggestion_id"), "verdict", F.nullif(text(F.col("keep_id")), F.lit("")).try_cast("bigint").alias("keep_id"), F.substring(text(F.col("reason")), 1, 1000).alias("reason"), number(F.col("confidence")).alias("confidence"), corrections.alias("corrections"))


DOCKET = "at bigint, outcome string, keep bigint, drop bigint, renamed int, reasons array<string>, entity_id bigint, name string, aliases array<string>, mentions bigint, merged_into bigint"


class _Docket(People):
    def __init__(self) -> None:
        super().__init__()
        self.resolved: set[int] = set()

    def row(self, r: dict) -> Iterator[tuple]:
        self.meet(r["things"])
        renamed, reasons = 0, []
        out = lambda outcome, keep=None, drop=None: (r["at"], outcome, keep, drop, renamed, reasons, None, None, None, None, None)
        a, b = self.get(r["a"]), self.get(r["b"])
        if r["status"] != "pending" or r["suggestion_id"] in self.resolved or r["a"] in self.gone or r["b"] in self.gone:
            yield out("skipped")
            return
        for c in r["corrections"] or ():
            new = (c["corrected_name"] or "").strip()
            if (c["confidence"] or 0) < MERGE_GATE:
                reasons.append(f"rename {c['corrected_name']!r}: below gate")
                continue
            e = self.get(c["entity_id"])
            if e is None or e["production_id"] != r["production_id"] or not new or new == e["name"]:
                continue
            if not e["from"] & set(c["attested"] or ()):
                reasons.append(f"rename {new!r}: not attested in snippets")
                continue
            if e["name"] and e["name"] not in e["aliases"]:
                e["aliases"].append(e["name"])
            e["name"] = new
            renamed += 1
        if r["verdict"] == "distinct":
            self.resolved.add(r["suggestion_id"])
            yield out("dismissed")
        elif r["verdict"] != "merge" or r["confidence"] < MERGE_GATE:
            if r["verdict"] == "merge":
                reasons.append(f"#{r['suggestion_id']}: merge below {MERGE_GATE} confidence")
            yield out("annotated")
        elif a is None or b is None:
            yield out("skipped")
        elif wrong := self.can_merge(a, b):
            reasons.append(f"#{r['suggestion_id']}: {wrong}")
            yield out("skipped")
        else:
            keep, drop = (a, b) if a["mentions"] >= b["mentions"] else (b, a)
            if r["keep_id"] is not None and r["keep_id"] in (a["entity_id"], b["entity_id"]):
                keep, drop = (a, b) if r["keep_id"] == a["entity_id"] else (b, a)
            self.merge(keep, drop)
            yield out("merged", keep["entity_id"], drop["entity_id"])

    def end(self) -> Iterator[tuple]:
        for i, e in self.known.items():
            yield None, None, None, None, None, None, i, e["name"], e["aliases"], e["mentions"], self.gone.get(i)


def apply_merge_verdicts(verdicts: DataFrame, suggestions: DataFrame, entities: DataFrame, snippets: DataFrame, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(at, outcome, keep, drop, renamed, reasons) of each verdict in order of `at`, and the entities they touch, as they are
    then: entity_id, name, aliases, mentions, merged_into.

    verdicts: at, suggestion_id, verdict (merge, distinct, other), keep_id, confidence, corrections (array of entity_id,
    corrected_name, confidence); suggestions: suggestion_id, production_id, a, b, status; snippets: entity_id, snippet.
    A suggestion that is unknown, not pending or with one merged away is skipped. `distinct` dismisses without a gate, a
    merge needs one; keep_id names whom to keep, else the one of more mentions, a of equals. A new name needs the gate
    too, and a snippet of the entity (or of one merged into it) that holds it, whatever the case and blanks.
    """
    e = written(_entities(entities, places), "review-entities")
    v = verdicts.join(suggestions.select("suggestion_id", "production_id", "a", "b", "status"), "suggestion_id", "left")
    v = v.withColumn("ids", F.filter(F.concat(F.array("a", "b"), F.coalesce("corrections.entity_id", F.array().cast("array<bigint>"))), lambda i: i.isNotNull()))
    rows = written(labelled(v, F.col("ids"), F.xxhash64("at")), "verdicts")
    plain = lambda c: F.btrim(F.regexp_replace(F.lower(c), r"\s+", " "))
    asked = rows.select(COMPONENT, F.explode("corrections.corrected_name").alias("said")).select(COMPONENT, plain(F.col("said")).alias("said")).distinct().filter("said <> ''")
    members = rows.select(COMPONENT, F.explode("ids").alias("entity_id")).distinct()
    held = snippets.filter("snippet IS NOT NULL").select("entity_id", plain(F.col("snippet")).alias("snippet"))
    attested = asked.join(members, COMPONENT).join(held, "entity_id").filter(F.col("snippet").contains(F.col("said")))
    attested = attested.groupBy(COMPONENT, "said").agg(F.collect_set("entity_id").alias("attested"))
    each = rows.select("at", COMPONENT, F.posexplode("corrections").alias("i", "c")).withColumn("said", plain(F.col("c.corrected_name"))).join(attested, [COMPONENT, "said"], "left")
    each = each.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("i", "c.entity_id", "c.corrected_name", "c.confidence", "attested"))).alias("corrections"))
    rows = _with_things(rows.drop("corrections").join(each, "at", "left"), "ids", e)
    found = written(folded(rows, ["at"], _Docket, DOCKET), "docket")
    return found.filter("at IS NOT NULL").select("at", "outcome", "keep", "drop", "renamed", "reasons"), found.filter("at IS NULL").select("entity_id", "name", "aliases", "mentions", "merged_into")


TIMELINE = "at bigint, outcome string, reason string, event_id bigint, event_type string, description string, date date, precision string, significance int, participants array<bigint>, into bigint"


class _Timeline:
    def __init__(self) -> None:
        self.events: dict[int, dict] = {}
        self.gone: dict[int, int | None] = {}

    def row(self, r: dict) -> Iterator[tuple]:
        for t in r["things"] or ():
            if t["event_id"] not in self.events and t["event_id"] not in self.gone:
                self.events[t["event_id"]] = t | {"participants": list(t["participants"] or ())}
        yield r["at"], *self._apply(r), *[None] * 8

    def _apply(self, r: dict) -> tuple[str, str | None]:
        kind, e = r["kind"], self.events.get(r["event_id"])
        if r["confidence"] is None or not r["confidence"] >= TIMELINE_GATE:
            return "skipped", f"{kind}: confidence below threshold"
        if kind == "merge":
            return self._merge(r)
        if kind not in ("delete", "edit", "rerate"):
            return "skipped", f"unknown verdict kind {kind!r}"
        if e is None:
            return "skipped", f"{kind}: unknown event {r['event_id']}"
        if e["human_edited"]:
            return "skipped", f"{kind}: event {e['event_id']} was human-edited"
        if kind == "delete":
            self.gone[e["event_id"]] = None
            del self.events[e["event_id"]]
            return "deleted", None
        if kind == "rerate":
            if r["significance"] is None or not 1 <= r["significance"] <= 5:
                return "skipped", f"rerate: bad significance {r['significance']!r}"
            e["significance"] = r["significance"]
            return "rerated", None
        if r["date"] is not None and r["day"] is None:
            return "skipped", f"edit: bad date {r['date']!r}"
        if r["event_type"] is not None and r["event_type"] not in EVENT_TYPES:
            return "skipped", f"edit: bad event_type {r['event_type']!r}"
        self._correct(e, r)
        e["event_type"] = r["event_type"] or e["event_type"]
        return "edited", None

    @staticmethod
    def _correct(e: dict, r: dict) -> None:
        if r["day"] is not None and r["precision"]:
            e["date"], e["precision"] = r["day"], r["precision"]
        if r["description"]:
            e["description"] = r["description"]

    def _merge(self, r: dict) -> tuple[str, str | None]:
        ids, keep = r["event_ids"] or [], r["keep_id"]
        if len(ids) < 2 or keep not in ids:
            return "skipped", f"merge: bad group {ids} keep={keep}"
        if any(i not in self.events for i in ids):
            return "skipped", f"merge: unknown event in group {ids}"
        absorbed = list(dict.fromkeys(i for i in ids if i != keep))
        if any(self.events[i]["human_edited"] for i in absorbed):
            return "skipped", f"merge: group {ids} contains human-edited event"
        if r["date"] is not None and r["day"] is None:
            return "skipped", f"merge: bad date {r['date']!r}"
        keeper = self.events[keep]
        for i in absorbed:
            keeper["participants"] += [p for p in self.events.pop(i)["participants"] if p not in keeper["participants"]]
            self.gone[i] = keep
        if not keeper["human_edited"]:
            self._correct(keeper, r)
        return "merged", None

    def end(self) -> Iterator[tuple]:
        for i, e in self.events.items():
            yield None, "kept", None, i, e["event_type"], e["description"], e["date"], e["precision"], e["significance"], e["participants"], None
        for i, into in self.gone.items():
            yield None, "gone", None, i, None, None, None, None, None, None, into


def apply_timeline_verdicts(verdicts: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(at, outcome, reason) of each verdict in order of `at`, and the events that verdicts name, as they are then:
    event_id, outcome (kept or gone), event_type, description, date, precision, significance, participants, into.

    verdicts: at, kind (delete, merge, edit, rerate), confidence, event_id, event_ids, keep_id, date (text), precision,
    description, event_type, significance; events: event_id, event_type, description, date, precision, significance,
    human_edited, participants. What a human has edited is not deleted, absorbed, edited or rerated; it may keep others.
    """
    iso = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_cast(date AS date)"))
    named = F.concat(F.array("event_id"), F.coalesce("event_ids", F.array().cast("array<bigint>")), F.array("keep_id"))
    rows = written(labelled(verdicts.withColumn("day", iso).withColumn("ids", F.array_distinct(F.filter(named, lambda i: i.isNotNull()))), F.col("ids"), F.xxhash64("at")), "verdicts")
    things = events.select("event_id", F.struct("event_id", "event_type", "description", "date", "precision", "significance", "human_edited", "participants").alias("thing"))
    things = rows.select("at", F.explode("ids").alias("event_id")).join(things, "event_id").groupBy("at").agg(F.collect_list("thing").alias("things"))
    found = written(folded(rows.drop("ids").join(things, "at", "left"), ["at"], _Timeline, TIMELINE), "timeline")
    return found.filter("at IS NOT NULL").select("at", "outcome", "reason"), found.filter("at IS NULL").drop("at", "reason")
