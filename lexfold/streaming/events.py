"""Windows over an event stream; an extension, nothing the review domain itself asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.storage import fresh_path


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window and type; works on streams, where events later than `late` are dropped, and on tables."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"))


def tumbling_counts(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """start_s, event_type, n: the stream is run to its end, its result written to a table and read from there."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    out = fresh_path(spark, "stream")
    counts = windowed(stream, width, late="3650 days")

    def save(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/result").select(F.unix_timestamp("window.start").alias("start_s"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    s = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_timestamp("s.start").alias("start_s"), F.unix_timestamp("s.end").alias("end_s"), "n")
