"""Mail threads from headers, with subjects where there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexfold.functions.normalize import subject_of
from lexfold.operators.components import components
from lexfold.storage import written


def threads(messages: DataFrame, production_id: int = 0) -> DataFrame:
    """doc_id, thread_id, is_inclusive.

    Messages join the ones they reply to or refer to, and others of the same message id. Those without an id and
    without a link that leads anywhere join by subject; a blank subject joins nothing. In a thread with links all that
    nobody replied to are inclusive, in one without only the latest (the smallest doc_id of ties, no date is earliest).
    """
    m = written(messages.select("doc_id", "message_id", F.array_distinct(F.array_compact(F.concat(F.array("in_reply_to"), F.regexp_extract_all(F.coalesce("references", F.lit("")), F.lit(r"<[^<>\s]+>"), F.lit(0))))).alias("targets"), subject_of(F.col("subject")).alias("subject"), "date_sent"), "messages")
    holder = m.filter("message_id IS NOT NULL").groupBy("message_id").agg(F.min("doc_id").alias("holder"))
    links = m.select("doc_id", F.explode_outer("targets").alias("message_id")).filter("message_id IS NOT NULL").join(holder, "message_id").filter("holder <> doc_id").select("doc_id", "message_id", "holder")
    linked = written(links, "links")
    any_target = m.select("doc_id", F.explode_outer("targets").alias("message_id")).join(holder, "message_id").select("doc_id").distinct()
    orphan = m.filter("message_id IS NULL").join(any_target, "doc_id", "left_anti").filter("subject <> ''")
    by_subject = orphan.groupBy("subject").agg(F.min("doc_id").alias("v"))
    edges = (
        linked.select(F.col("doc_id").alias("u"), F.col("holder").alias("v"))
        .union(m.join(holder, "message_id").select(F.col("doc_id").alias("u"), F.col("holder").alias("v")))
        .union(orphan.join(by_subject, "subject").select(F.col("doc_id").alias("u"), "v"))
    )
    root = components(edges).withColumnRenamed("node", "doc_id")
    all_ = m.join(root, "doc_id", "left").withColumn("root", F.coalesce("label", "doc_id"))
    replied = linked.select("message_id").distinct().withColumn("replied", F.lit(True))
    all_ = all_.join(replied, "message_id", "left")
    t = Window.partitionBy("root")
    key = F.coalesce(F.min("message_id").over(t), F.when(F.min("subject").over(t) != "", F.concat(F.lit("subj:"), F.min("subject").over(t))), F.concat(F.lit("doc:"), F.min("doc_id").over(t).cast("string")))
    thread_id = F.concat(F.lit("T-"), F.substring(F.sha1(F.concat(F.lit(f"{production_id}|"), key)), 1, 16))
    latest = F.row_number().over(t.orderBy(F.desc_nulls_last("date_sent"), "doc_id")) == 1
    has_links = F.coalesce(F.max("replied").over(t), F.lit(False))
    return all_.select("doc_id", thread_id.alias("thread_id"), F.when(has_links, F.col("replied").isNull()).otherwise(latest).alias("is_inclusive"))
