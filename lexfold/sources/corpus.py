"""Review-domain views over the test tables: deterministic stand-ins for documents, coding, chunks, mail and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.functions.normalize import bates


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bates_begin, custodian, production_id, family_id, sha256, page_count, source_type, native_path, file_type, text ..."""
    d = read(spark, sf_dir, "documents")
    group = F.floor(F.col("doc_id") / 4)
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "docx", "msg", "png", "mp4"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        "doc_id",
        bates(F.lit("DOC"), F.col("doc_id"), F.lit(6)).alias("bates_begin"),
        F.col("source").alias("custodian"),
        (F.col("doc_id") % 3).alias("production_id"),
        F.when(group % 2 == 1, group).alias("family_id"),
        F.sha2("text", 256).alias("sha256"),
        (F.lit(1) + F.floor(F.col("n_chars") / 2000)).alias("page_count"),
        F.when(F.col("doc_id") % 5 == 0, "received").when(F.col("doc_id") % 5 > 1, "collection").alias("source_type"),
        F.when(F.col("doc_id") % 6 != 0, F.concat(F.lit("NATIVE/"), F.col("doc_id").cast("string"), F.lit("."), F.when(F.col("doc_id") % 2 == 0, F.upper(ext)).otherwise(ext))).alias("native_path"),
        "lang",
        "text",
        "n_chars",
    )


DOCS_SQL = """docs AS (SELECT doc_id, printf('DOC%06d', doc_id) AS bates_begin, source AS custodian,
    doc_id % 3 AS production_id, CASE WHEN (doc_id // 4) % 2 = 1 THEN doc_id // 4 END AS family_id, sha256(text) AS sha256,
    1 + n_chars // 2000 AS page_count, CASE WHEN doc_id % 5 = 0 THEN 'received' WHEN doc_id % 5 > 1 THEN 'collection' END AS source_type,
    CASE WHEN doc_id % 6 <> 0 THEN 'NATIVE/' || doc_id || '.' || CASE WHEN doc_id % 2 = 0 THEN upper(['pdf','docx','msg','png','mp4'][doc_id % 5 + 1]) ELSE ['pdf','docx','msg','png','mp4'][doc_id % 5 + 1] END END AS native_path,
    lang, text, n_chars FROM documents)"""


def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, category, tag, tag_id: responsive and nonresponsive by quality, privilege where toxic."""
    labels = read(spark, sf_dir, "labels")
    kinds = F.array(
        F.struct(F.lit(1).alias("tag_id"), F.lit("responsiveness").alias("category"), F.lit("Responsive").alias("tag"), (F.col("quality") == 1).alias("has")),
        F.struct(F.lit(2).alias("tag_id"), F.lit("responsiveness").alias("category"), F.lit("Non-Responsive").alias("tag"), (F.col("quality") == 0).alias("has")),
        F.struct(F.lit(3).alias("tag_id"), F.lit("privilege").alias("category"), F.lit("Attorney-Client").alias("tag"), (F.col("toxic") == 1).alias("has")),
    )
    return labels.select("doc_id", F.explode(kinds).alias("k")).filter("k.has").select("doc_id", "k.tag_id", "k.category", "k.tag")


TAGS_SQL = """tags AS (SELECT doc_id, 1 AS tag_id, 'responsiveness' AS category, 'Responsive' AS tag FROM labels WHERE quality = 1
    UNION ALL SELECT doc_id, 2, 'responsiveness', 'Non-Responsive' FROM labels WHERE quality = 0
    UNION ALL SELECT doc_id, 3, 'privilege', 'Attorney-Client' FROM labels WHERE toxic = 1)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ai_decision, confidence: three of four documents have a machine decision."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    names = F.element_at(F.array(*map(F.lit, ("relevant", "key_document", "not_relevant"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.filter("doc_id % 4 <> 3").select("doc_id", names.alias("ai_decision"), (F.col("doc_id") * 37 % 101).alias("confidence"))


DECISIONS_SQL = """decisions AS (SELECT doc_id, ['relevant','key_document','not_relevant'][doc_id % 4 + 1] AS ai_decision,
    doc_id * 37 % 101 AS confidence FROM documents WHERE doc_id % 4 <> 3)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.floor(F.col("vec_id") / 3).alias("document_id"), (F.col("vec_id") % 3).alias("chunk_index"), "embedding", "label")


CHUNKS_SQL = """chunks AS (SELECT vec_id, vec_id // 3 AS document_id, vec_id % 3 AS chunk_index, embedding, label FROM embeddings)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, message_id, in_reply_to, references, subject, date_sent; every seventh conversation has no ids."""
    c = read(spark, sf_dir, "conversations")
    no_ids = F.col("conv_id") % 7 == 0
    mid = lambda turn: F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"), F.lit(">"))
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"),
        F.when(~no_ids, mid(F.col("turn"))).alias("message_id"),
        F.when(~no_ids & (F.col("turn") > 0), mid(F.col("turn") - 1)).alias("in_reply_to"),
        F.when(~no_ids & (F.col("turn") > 1), F.concat(mid(F.lit(0)), F.lit(" "), mid(F.col("turn") - 1))).alias("references"),
        F.concat(F.when(F.col("turn") % 3 == 1, "Re: ").when(F.col("turn") % 3 == 2, "FWD:  re: ").otherwise(""), F.when(F.col("conv_id") % 14 != 0, F.concat(F.lit("Matter  "), (F.col("conv_id") % 40).cast("string"))).otherwise("")).alias("subject"),
        F.when(F.col("turn") != 4, F.timestamp_seconds(F.lit(1700000000) + F.col("conv_id") * 3600 + F.col("turn") * 60)).alias("date_sent"),
        "role",
        "text",
    )


MESSAGES_SQL = """messages AS (SELECT conv_id * 100 + turn AS doc_id,
    CASE WHEN conv_id % 7 <> 0 THEN '<' || conv_id || '-' || turn || '>' END AS message_id,
    CASE WHEN conv_id % 7 <> 0 AND turn > 0 THEN '<' || conv_id || '-' || (turn - 1) || '>' END AS in_reply_to,
    CASE WHEN conv_id % 7 <> 0 AND turn > 1 THEN '<' || conv_id || '-0> <' || conv_id || '-' || (turn - 1) || '>' END AS refs,
    CASE turn % 3 WHEN 1 THEN 'Re: ' WHEN 2 THEN 'FWD:  re: ' ELSE '' END || CASE WHEN conv_id % 14 <> 0 THEN 'Matter  ' || (conv_id % 40) ELSE '' END AS subject,
    CASE WHEN turn <> 4 THEN 1700000000 + conv_id * 3600 + turn * 60 END AS sent_s, role, text FROM conversations)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, entity_id: a document mentions the entities (parts of a mod 50 name space) that its order's lines name."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 50).alias("entity_id"), F.col("l_linenumber").alias("start_offset"))


MENTIONS_SQL = """mentions AS (SELECT l_orderkey AS doc_id, l_partkey % 50 AS entity_id, l_linenumber AS start_offset FROM lineitem)"""


def batch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, reviewer, queue_id, position, doc_id, status of documents dealt to review batches."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    status = F.when(F.col("l_returnflag") == "R", "reviewed").when(F.col("l_returnflag") == "A", "skipped").otherwise("pending")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("reviewer"), F.col("o_orderpriority").alias("queue"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("doc_id"), status.alias("status")
    )


BATCHES_SQL = """batch_docs AS (SELECT o_orderkey AS batch_id, o_custkey AS reviewer, o_orderpriority AS queue, l_linenumber AS position, l_partkey AS doc_id,
    CASE l_returnflag WHEN 'R' THEN 'reviewed' WHEN 'A' THEN 'skipped' ELSE 'pending' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
