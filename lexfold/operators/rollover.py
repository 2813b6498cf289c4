"""Volumes of bounded size, filled in order: a greedy sequence without going through it row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfold.operators.ranks import running, scan
from lexfold.storage import forget, written


def volumes(docs: DataFrame, by: str, order: str, size: str, cap: int) -> DataFrame:
    """docs with volume, from 1 within each set: a new one begins where the next document would pass the cap.

    A document larger than the cap has a volume of its own; one of no size stays in the volume before it unless that is over
    the cap. order tells the documents of a set apart; null sizes count as zero, sets are not null.

    For each document the running size tells, by a search among all, where the next volume would begin if one began at it.
    These pointers are doubled (to the second, fourth, ... volume from there), and the volumes that really begin are
    reached from the first in as many steps as their number has bits.
    """
    spark = docs.sparkSession
    sizes = docs.select(by, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    held = written(running(sizes, [by], [order], "_c", F.col("_size")), "volume-sizes")
    some = held.filter("_size > 0").select(by, "_c", "_size")  # within a set no two of these have the same _c
    limit = F.greatest(F.col("_c") - F.col("_size") + cap, "_c")
    ends = some.select(by, F.col("_c").alias("_at"), F.lit(0).alias("_ask"), F.col("_c").alias("_own"))
    asks = some.select(by, limit.alias("_at"), F.lit(1).alias("_ask"), F.col("_c").alias("_own"))
    # from the greatest down: the last end seen is the least one over what is asked
    found = scan(ends.union(asks), [by], [F.desc("_at"), F.desc("_ask"), "_own"], "_next", F.when(F.col("_ask") == 0, F.col("_own")), "last")
    jumps = [written(found.filter("_ask = 1 AND _next IS NOT NULL").select(by, F.col("_own").alias("_c"), "_next"), "volume-jumps")]
    while not jumps[-1].isEmpty():
        j = jumps[-1]
        jumps.append(written(j.join(j.select(by, F.col("_c").alias("_next"), F.col("_next").alias("_after")), [by, "_next"]).select(by, "_c", F.col("_after").alias("_next")), "volume-jumps"))
    begun = some.filter("_c = _size").select(by, "_c")
    for j in reversed(jumps):
        begun = written(begun.union(begun.join(j, [by, "_c"]).select(by, F.col("_next").alias("_c"))), "volumes-begun")
    forget(spark, *jumps)
    flagged = held.join(begun.withColumn("_begins", F.lit(1)), [by, "_c"], "left").withColumn("_begins", F.when(F.col("_size") > 0, F.coalesce("_begins", F.lit(0))).otherwise(0))
    counted = running(flagged.select(by, order, "_size", "_begins"), [by], [order], "_volume", F.col("_begins"))
    last = scan(counted, [by], [order], "_last", F.when(F.col("_size") > 0, F.col("_size")), "last")
    over = (F.col("_size") == 0) & (F.coalesce("_last", F.lit(0)) > cap)
    numbers = last.select(by, order, (F.greatest("_volume", F.lit(1)) + over.cast("int")).cast("int").alias("volume"))
    return docs.join(numbers, [by, order])


def manifest(dealt: DataFrame, by: str, size: str) -> DataFrame:
    """by, label, documents, bytes of each volume."""
    out = dealt.groupBy(by, "volume").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    number = F.col("volume").cast("string")
    return out.select(by, F.concat(F.lit("VOL"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("label"), "documents", "bytes")
