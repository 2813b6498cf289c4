"""Exact dedup by a streaming job whose keyed state lives on disk.

The stream's state (RocksDB, checkpointed to the shared folder, never expiring) holds for each SHA-256 of a
normalised text: the number of rows, and of the row that stays its code points, identifier and content locator
(file and row). After the stream has caught up, the state is read as a table, and every row whose digest was hit
more than once is compared byte for byte with the content at the locator. Rows that differ in spite of equal
digests are grouped anew by their whole text, so a weak digest costs time and never a wrong group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.llm.common import WS, fresh_path, written

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # each batch is large and rare: keep no store open between tasks
    "spark.sql.streaming.metricsEnabled": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(
        "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).alias("points"),
        digest(normalised(F.col("text"))).alias("digest"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
        "text",
    )


def advance(stream: DataFrame, state_dir: str, digest: Callable[[Column], Column] = sha256_hex) -> None:
    """Fold all that the stream has not yet seen into the state at state_dir; repeat when more files have come."""
    spark = stream.sparkSession
    rank = F.struct("points", F.bitwise_not("doc_id").alias("below"), "at")  # most code points, then smallest id
    state = _rows(stream, digest).groupBy("digest").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    try:
        for k, v in STREAM_CONF.items():
            spark.conf.set(k, v)
        state.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_dir).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_table(spark: SparkSession, state_dir: str) -> DataFrame:
    """digest, n, points, keep_id, at."""
    held = written(spark.read.format("statestore").load(state_dir), "exact-held")
    best, n = (f"value.{c}" for c in held.schema["value"].dataType.names)
    return held.select(
        F.col("key.digest").alias("digest"),
        F.col(n).alias("n"),
        F.bitwise_not(F.col(f"{best}.below")).alias("keep_id"),
        F.col(f"{best}.at").alias("at"),
    )


def resolve(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per row of docs; see streaming_dedup."""
    rows, held = _rows(docs, digest), state.withColumnRenamed("at", "best_at").hint("shuffle_hash")
    hit, there = F.col("n") > 1, F.col("at") == F.col("best_at")
    joined = written(
        rows.join(held, "digest", "left").select(
            "doc_id",
            "digest",
            "points",
            "keep_id",
            "n",
            (hit & there).alias("is_best"),
            (F.col("n").isNull() | ((F.col("n") == 1) & ~there)).alias("odd"),  # not in the state, or not where it was
            F.when(hit, normalised(F.col("text"))).alias("body"),
        ),
        "exact-rows",
    )
    held_rows = joined.filter("n > 1").groupBy("digest").agg(F.max("is_best").alias("there"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"))
    seen, now = state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first(), joined.agg(F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("odd")).first()
    if now["odd"] or seen["n"] != now["n"] or not held_rows.filter("NOT there OR rows <> n").isEmpty():
        raise ValueError("files that the state was made from are gone or were rewritten: begin a new state")
    best = joined.filter("is_best").select("digest", F.col("body").alias("best_body")).hint("shuffle_hash")
    checked = joined.filter("n > 1").join(best, "digest").select("doc_id", "digest", "points", "keep_id", "n", "body", (F.col("body") == F.col("best_body")).alias("same"))
    differ = written(checked.filter(~F.col("same")).select("digest").distinct(), "exact-collisions")
    columns = ["doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), "digest"]
    if differ.isEmpty():
        return _shaped(joined.select(*columns))
    alone = joined.join(differ, "digest", "left_anti").select(*columns)
    mixed = joined.join(differ, "digest", "left_semi")
    groups = mixed.groupBy("digest", "body").agg(F.max(F.struct("points", F.bitwise_not("doc_id").alias("below"))).alias("b"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("digest", "body", F.bitwise_not("b.below").alias("keep_id"), "group_size")
    again = mixed.select("doc_id", "digest", "body").join(groups, ["digest", "body"]).select("doc_id", "keep_id", "group_size", "digest")
    return _shaped(alone.union(again))


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def streaming_dedup(
    spark: SparkSession,
    path: str,
    state_dir: str | None = None,
    max_files_per_trigger: int = 4096,
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of the Parquet table at path.

    Texts are equal when identical without ASCII white space; null counts as empty. The row with the most code
    points stays, then the smallest doc_id (a null doc_id after all others). Rows that repeat a doc_id count one
    by one and all share their kept flag. An empty table gives no rows. Other columns are ignored.
    state_dir, when given, is continued: only files it has not seen are read into the state. The files it has seen must
    still be there as they were, as bytes are compared with them; a ValueError tells when they are not.
    """
    docs = spark.read.parquet(path)
    state_dir = state_dir or fresh_path(spark, "exact-state")
    head, tail = path.rstrip("/")[:-1], path.rstrip("/")[-1]
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(f"{head}[{tail}]")  # a pattern, as the path may be one file
    advance(stream, state_dir, digest)
    return resolve(docs, state_table(spark, state_dir), digest)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming_dedup(spark, f"{sf_dir}/documents.parquet")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
