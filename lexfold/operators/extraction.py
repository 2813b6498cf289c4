"""What a model says it found in slices of documents: answers parsed defensively, slices of a document merged.

Each list and each of its elements is read by itself, so one that is not of the expected shape spoils no other. Caps are
of what one answer may bring in; they come before elements are judged, as a long answer is cut where it is read.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfold.operators.entities import usable_name

# Fixed values.
ENTITY_TYPES = ("person", "org")
EVENT_TYPES = ("meeting", "communication", "payment", "filing", "agreement", "other")
RELATIONSHIP_TYPES = ("employment", "counsel", "correspondent", "party_to_agreement", "family", "other")
MAX_ENTITIES, MAX_EVENTS, MAX_RELATIONSHIPS, MAX_FORMS = 50, 30, 30, 10
# Names of courts, their staff and parties as such, which are part of any proceeding.
PROCESS_NOISE = (
    r"^the court$",
    r"court report(ing|er)",
    r"\b(district|superior|circuit|supreme|county|municipal|appellate|bankruptcy) court\b",
    r"^court of\b",
    r"\b(court clerk|clerk of)\b",
    r"^(plaintiffs?|defendants?|petitioners?|respondents?|appellants?|appellees?)$",
    r"^the (state|people|government)$",
    r"\bnotary\b",
    r"\b(stenograph|certified shorthand)",
)

TEXTS = "array<string>"
SPACES = " \t\n\r"


def _text(c: Column, most: int = 500) -> Column:
    """c without white space around it, cut. White space other than blanks is found only where an answer has escapes."""
    x = F.coalesce(c, F.lit(""))
    bare = F.when(F.col("escapes"), F.btrim(x, F.lit(" \t\n\r\f\x0b"))).otherwise(F.trim(x))
    return F.when(F.octet_length(bare) <= most, bare).otherwise(F.substring(bare, 1, most))


def _kind(c: Column, known: tuple[str, ...], most: int, other: Column) -> Column:
    return F.when(c.isin(*known), c).when(_text(c, most).isin(*known), _text(c, most)).otherwise(other)


def _bare(c: Column) -> Column:
    """c without white space around it; long texts that have none are left alone, as trimming goes through all of them."""
    around = functools.reduce(operator.or_, (test(F.lit(x)) for x in SPACES for test in (c.startswith, c.endswith)))
    return F.when(around, F.btrim(c, F.lit(SPACES))).otherwise(c)


def _list(c: Column, most: int | None = None) -> Column:
    got = F.coalesce(F.from_json(c, TEXTS), F.array().cast(TEXTS))
    return got if most is None else F.slice(got, 1, most)


def _elements(name: str, texts: list[str], arrays: list[str], most: int) -> tuple[Column, Column]:
    """One list of an answer, `bare`: what is to be read first, as a column of that name, and the list's elements then.

    All is read at once where all is of the expected shape, which _odd tells; else each element by itself.
    """
    schema = ", ".join([*(f"{c}: string" for c in texts), *(f"{c}: {TEXTS}" for c in arrays)])
    first = F.from_json("bare", f"{name} array<struct<{schema}>>, _odd string", {"columnNameOfCorruptRecord": "_odd"}).alias(name)
    at_once = F.slice(F.coalesce(F.col(name)[name], F.array().cast(f"array<struct<{schema}>>")), 1, most)
    alone = F.transform(_list(F.from_json("bare", f"{name} string")[name], most), lambda e: F.from_json(e, ", ".join(f"{c} string" for c in (*texts, *arrays))))
    each = F.transform(alone, lambda e: F.struct(*(e[c].alias(c) for c in texts), *(_list(e[c]).alias(c) for c in arrays)))
    return first, F.when(F.col(name)["_odd"].isNull(), at_once).otherwise(each)


def parsed(answers: DataFrame) -> DataFrame:
    """id, slice, entities, events, relationships (arrays of structs) of each answer (id, slice, raw); empty where it is no JSON object.

    Answers may stand in a code fence. Entities need a usable name, which is none of the proceeding, and a known type;
    unknown types of others are `other`, an event's significance is 1 to 5 and 3 where none is given.
    """
    texts = lambda c, keep: F.when(c.isNull(), F.array().cast(TEXTS)).otherwise(F.filter(F.transform(c, lambda x: _text(x)), keep))
    given = lambda c, most=500: F.when(c.isNotNull(), F.nullif(_text(c, most), F.lit("")))
    fine = lambda n: F.coalesce(usable_name(n), F.lit(False)) & (n != "")
    person = lambda e: e["type"].isNotNull() & fine(e["name"]) & ~e["name"].rlike("(?i)" + "|".join(PROCESS_NOISE))
    two = lambda e: (e["source"] != "") & (e["target"] != "") & (e["source"] != e["target"])

    def entity(e: Column) -> Column:
        forms, mails = texts(e["surface_forms"], fine), F.transform(texts(e["emails"], lambda m: m.contains("@")), F.lower)
        return F.struct(_text(e["name"]).alias("name"), _kind(e["type"], ENTITY_TYPES, 10, F.lit(None)).alias("type"), forms.alias("surface_forms"), given(e["role"]).alias("role"), mails.alias("emails"))

    def named(e: Column) -> Column:
        forms = F.slice(F.when(F.size(e["surface_forms"]) > 0, e["surface_forms"]).otherwise(F.array(e["name"])), 1, MAX_FORMS)
        return F.struct(e["name"].alias("name"), e["type"].alias("type"), forms.alias("surface_forms"), e["role"].alias("role"), e["emails"].alias("emails"))

    def event(e: Column) -> Column:
        sure = F.when(e["significance"].isNull(), 3.0).otherwise(F.coalesce(e["significance"].try_cast("double"), F.lit(3.0)))
        return F.struct(_text(e["description"], 2000).alias("description"), _kind(e["type"], EVENT_TYPES, 20, F.lit("other")).alias("type"), given(e["date"], 10).alias("date"), F.coalesce(given(e["date_source"]), F.lit("")).alias("date_source"), F.greatest(F.lit(1.0), F.least(F.lit(5.0), sure)).cast("int").alias("significance"), texts(e["participants"], lambda p: p != "").alias("participants"))

    def relationship(e: Column) -> Column:
        return F.struct(_text(e["source"]).alias("source"), _text(e["target"]).alias("target"), _kind(e["type"], RELATIONSHIP_TYPES, 30, F.lit("other")).alias("type"), given(e["evidence"], 2000).alias("evidence"))

    raw = answers.select("id", "slice", F.coalesce("raw", F.lit("")).alias("raw")).select("id", "slice", _bare(F.col("raw")).alias("raw"))
    inside = F.substr("raw", F.instr("raw", F.lit("\n")) + 1)
    raw = raw.select("id", "slice", F.when(F.col("raw").startswith("```"), _bare(inside)).otherwise(F.col("raw")).alias("raw"))
    bare = F.when(F.col("raw").startswith("{"), F.col("raw"))  # what follows an object is not read
    read = [
        _elements("entities", ["name", "type", "role"], ["surface_forms", "emails"], MAX_ENTITIES),
        _elements("events", ["description", "type", "date", "date_source", "significance"], ["participants"], MAX_EVENTS),
        _elements("relationships", ["source", "target", "type", "evidence"], [], MAX_RELATIONSHIPS),
    ]
    entities, events, relationships = (F.transform(elements, made) for (_, elements), made in zip(read, (entity, event, relationship)))
    return (
        raw.select("id", "slice", bare.alias("bare"))
        .select("id", "slice", "bare", F.coalesce(F.col("bare").contains("\\"), F.lit(False)).alias("escapes"), *(first for first, _ in read))
        .select(
            "id",
            "slice",
            F.transform(F.filter(entities, person), named).alias("entities"),
            F.filter(events, lambda e: e["description"] != "").alias("events"),
            F.filter(relationships, two).alias("relationships"),
        )
    )


def _in_order(answers: DataFrame, column: str, key: Callable[[Column], list[Column]]) -> DataFrame:
    """id, items: of one document's slices, by key, then in the order of slices and places.

    Slices that lie together already are gathered as they pass. Only a document's items are sorted: a sort or map of those of
    all documents would be many times as large.
    """
    item = lambda x, place: F.struct(F.struct(*key(x)).alias("key"), F.col("slice").alias("slice"), place.alias("place"), x.alias("x"))
    document = Window.partitionBy("id").orderBy("slice")
    lists = F.collect_list(F.transform(column, item)).over(document.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = answers.select("id", lists.alias("lists"), F.row_number().over(document).alias("r")).filter("r = 1")
    return d.select("id", F.sort_array(F.flatten("lists")).alias("items"))


def _new(e: Column, i: Column) -> Column:
    """Whether an item is the first of its key."""
    return (i == 0) | ~e["key"].eqNullSafe(F.get("items", i - 1)["key"])


def _firsts(items: DataFrame) -> DataFrame:
    return items.select("id", F.explode_outer(F.filter("items", _new)).alias("first")).filter("first IS NOT NULL")


def _groups(items: DataFrame) -> DataFrame:
    starts = F.filter(F.transform("items", lambda e, i: F.when(_new(e, i), i)), lambda i: i.isNotNull())
    until = lambda j: F.coalesce(F.get("starts", j + 1), F.size("items")) - 1
    groups = F.transform("starts", lambda s, j: F.transform(F.sequence(s, until(j)), lambda i: F.get("items", i)))
    return items.select("id", "items", starts.alias("starts")).select("id", F.explode_outer(groups).alias("all")).filter("all IS NOT NULL")


def merged(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, events and relationships of each document (id), from the answers of parsed() on its slices, in order (slice, place).

    An entity is one for its type and name, whatever the case: forms and addresses of all slices, the first role. Events with
    equal description, type and date are one, and relationships with equal ends and type: the first.
    """
    every = lambda c: F.array_distinct(F.flatten(F.transform("all", lambda a: a["x"][c]))).alias(c)
    role = F.get(F.filter(F.transform("all", lambda a: a["x"]["role"]), lambda r: r.isNotNull()), F.lit(0)).alias("role")
    first = F.col("all")[0]
    e = _groups(_in_order(answers, "entities", lambda x: [x["type"], F.lower(x["name"])]))
    entities = e.select("id", first["slice"].alias("slice"), first["place"].alias("place"), first["x"]["name"].alias("name"), first["x"]["type"].alias("type"), every("surface_forms"), role, every("emails"))
    events = _firsts(_in_order(answers, "events", lambda x: [F.lower(x["description"]), x["type"], x["date"]]))
    relationships = _firsts(_in_order(answers, "relationships", lambda x: [F.lower(x["source"]), F.lower(x["target"]), x["type"]]))
    return entities, *(f.select("id", "first.slice", "first.place", "first.x.*") for f in (events, relationships))
