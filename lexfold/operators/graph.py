"""Entity graph and timeline: co-occurrence, stated relationships, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """a, b, documents: entities that share documents, a < b; each document counts once."""
    m = mentions.select("doc_id", "entity_id").distinct()
    a, b = m.withColumnRenamed("entity_id", "a"), m.withColumnRenamed("entity_id", "b")
    return a.join(b, "doc_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("documents"))


def graph(mentions: DataFrame, stated: DataFrame, nodes: int, least: int) -> DataFrame:
    """a, b, kind, weight among the `nodes` entities of most documents: stated edges, and co-occurrence in `least`
    documents or more of pairs that no stated edge joins."""
    top = mentions.groupBy("entity_id").agg(F.countDistinct("doc_id").alias("n")).orderBy(F.desc("n"), "entity_id").limit(nodes).select("entity_id")
    inside = mentions.join(F.broadcast(top), "entity_id", "left_semi")
    edges = stated.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    for end in ("a", "b"):
        edges = edges.join(F.broadcast(top.withColumnRenamed("entity_id", end)), end, "left_semi")
    co = cooccurrence(inside).filter(F.col("documents") >= least).join(edges, ["a", "b"], "left_anti")
    return edges.select("a", "b", F.lit("stated").alias("kind"), "weight").union(co.select("a", "b", F.lit("cooccurrence"), "documents"))


def _moved(rows: DataFrame, merges: DataFrame, ends: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (id, ends and key) of losers, with their winners in ends; and those of them that stay: no loops, and none whose
    ends and key (without nulls in it) a row of the winner has already."""
    m = merges.select("loser", "winner")
    out = rows
    for e in ends:
        out = out.join(m.select(F.col("loser").alias(e), F.col("winner").alias(f"{e}_winner")), e, "left")
    touched = out.filter(" OR ".join(f"{e}_winner IS NOT NULL" for e in ends))
    moved = touched.select("id", *(F.coalesce(f"{e}_winner", e).alias(e) for e in ends), *key)
    others = rows.join(touched.select("id"), "id", "left_anti")
    loops = moved if len(ends) == 1 else moved.filter(F.col(ends[0]) != F.col(ends[1]))
    taken = others.select(*ends, *key).dropna(subset=key).distinct()
    return moved, loops.join(taken, [*ends, *key], "left_anti").select("id", *ends, *key)


def merge(mentions: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions and edges after each loser has become its winner, and the journal that undo() needs.

    mentions: id, entity_id, doc_id, start_offset; edges: id, source, target, kind, doc_id; merges: loser, winner, with
    each entity in one merge at most. A mention goes where the winner has one of the same document and offset (a
    null offset collides with none), an edge where the winner has an equal one or it would lead to itself; what goes is
    lost for good. journal: what (mention or edge), id, and its ends before (before_1, before_2).
    """
    out, journal = [], []
    for what, rows, ends, key in (("mention", mentions, ["entity_id"], ["doc_id", "start_offset"]), ("edge", edges, ["source", "target"], ["kind", "doc_id"])):
        moved, stays = _moved(rows, merges, ends, key)
        out.append(rows.join(moved.select("id"), "id", "left_anti").select("id", *ends, *key).union(stays))
        before = rows.join(stays.select("id"), "id", "left_semi")
        journal.append(before.select(F.lit(what).alias("what"), "id", F.col(ends[0]).alias("before_1"), F.col(ends[-1]).alias("before_2")))
    return out[0], out[1], journal[0].union(journal[1])


def undo(mentions: DataFrame, edges: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions and edges with what the journal says was moved back at its former ends; rows added since stay as they are."""
    out = []
    for what, rows, ends in (("mention", mentions, ["entity_id"]), ("edge", edges, ["source", "target"])):
        j = journal.filter(F.col("what") == what).select("id", "before_1", "before_2")
        back = [F.coalesce(f"before_{k + 1}" if len(ends) > 1 else "before_1", e).alias(e) for k, e in enumerate(ends)]
        out.append(rows.join(j, "id", "left").select("id", *back, *(c for c in rows.columns if c != "id" and c not in ends)))
    return out[0], out[1]


def aliases_after(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """entity_id, aliases of every entity that is left: a winner has its own, then its loser's name and aliases that are new."""
    lost = entities.join(merges, F.col("entity_id") == F.col("loser")).select(F.col("winner").alias("entity_id"), F.concat(F.array("name"), "aliases").alias("more"))
    left = entities.join(merges.select(F.col("loser").alias("entity_id")), "entity_id", "left_anti").join(lost, "entity_id", "left")
    fresh = F.array_except(F.coalesce("more", F.array().cast("array<string>")), "aliases")
    return left.select("entity_id", F.concat("aliases", fresh).alias("aliases"))


def timeline(events: DataFrame, participants: DataFrame, significance: int) -> DataFrame:
    """event_id, place (from 1, dated ones first) and participants of events that matter at least so much (3 if unsaid)."""
    kept = events.filter(F.coalesce("significance", F.lit(3)) >= significance)
    who = participants.groupBy("event_id").agg(F.sort_array(F.collect_set("name")).alias("participants"))
    w = Window.partitionBy("case_id").orderBy(F.asc_nulls_last("date"), "event_id")
    return kept.join(who, "event_id", "left").select("case_id", "event_id", F.row_number().over(w).alias("place"), F.coalesce("participants", F.array().cast("array<string>")).alias("participants"))
