"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all is on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = getattr(spark.sparkContext, "_lexfold_dir", None)
        if not held:
            held = spark.sparkContext._lexfold_dir = "file://" + tempfile.mkdtemp(prefix="lexfold-")
        base = held
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexfold-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lexfold-" in root:
                p = jvm.org.apache.hadoop.fs.Path(root)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
