"""Row numbers, running sums and other running values within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfold.storage import written

PART, ROW = "_part", "_row"


def scan(rows: DataFrame, within: list[str], order: list[Column | str], name: str, value: Column, how: str = "sum") -> DataFrame:
    """rows with name: the sum, max or last value (not null) up to and with each row, in order within groups.

    Rows are dealt to parts by range of group and order, sorted and written, so that parts stay as they are when tasks are
    repeated; each part is run through by itself and begins with what those before came to. Any associative operation
    can be done so: a part needs no more of the others than one value each. order should tell all rows apart, as a part
    is only as small as its ties allow; the columns of within hold no nulls. All columns of rows are written once: pass
    keys and what is needed, and join the rest.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = rows.withColumn("_value", value)
    dealt = keyed.repartitionByRange(*within, *columns).sortWithinPartitions(*within, *columns)
    held = written(dealt.withColumn(ROW, F.monotonically_increasing_id()), "ranks").withColumn(PART, F.shiftright(ROW, 33))
    v = F.col("_value")
    whole = {"sum": F.sum(v), "max": F.max(v), "last": F.max_by(v, F.when(v.isNotNull(), F.col(ROW)))}[how]
    parts = held.groupBy(*within, PART).agg(whole.alias("_whole"))
    earlier = Window.partitionBy(*within).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    w = F.col("_whole")
    before = parts.select(*within, PART, {"sum": F.sum(w), "max": F.max(w), "last": F.last(w, ignorenulls=True)}[how].over(earlier).alias("_before"))
    inside = {"sum": F.sum(v), "max": F.max(v), "last": F.last(v, ignorenulls=True)}[how].over(Window.partitionBy(*within, PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0))
    both = held.withColumn("_inside", inside).join(before, [*within, PART])
    i, b = F.col("_inside"), F.col("_before")
    joined = {"sum": F.when(i.isNull(), b).otherwise(i + F.coalesce(b, F.lit(0))), "max": F.greatest(i, b), "last": F.coalesce(i, b)}[how]
    return both.withColumn(name, joined).drop(PART, ROW, "_value", "_inside", "_before")


def running(rows: DataFrame, within: list[str], order: list[Column | str], name: str, value: Column | None = None) -> DataFrame:
    """rows with name: the sum of value (by default the number of rows) up to and with each row, in order within groups; see scan."""
    return scan(rows, within, order, name, (F.lit(1) if value is None else value).cast("bigint"))
