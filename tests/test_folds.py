"""Rows reach a fold as they are, whatever their types, and folds are spread over all tasks."""

import datetime as dt

import pyarrow as pa
from pyspark.sql import functions as F

from lexfold.operators.folds import COMPONENT, folded, values


def test_values_are_those_of_the_library():
    big = 2**62 + 1
    thing = pa.struct([("i", pa.int64()), ("d", pa.date32()), ("p", pa.list_(pa.int64())), ("s", pa.string()), ("h", pa.bool_())])
    things = [[{"i": big, "d": dt.date(1999, 1, 2), "p": [1, None], "s": "ä", "h": True}, {"i": None, "d": None, "p": None, "s": None, "h": None}], None, [], [None, {"i": 1, "d": dt.date(2024, 2, 29), "p": [], "s": "", "h": False}]]
    columns = [
        pa.array(things, pa.list_(thing)), pa.array([big, None, -1, 0], pa.int64()), pa.array([1.5, None, float("inf"), 0], pa.float64()), pa.array([None] * 4, pa.int32()), pa.array(["x", None, "", "þ"]),
        pa.array([True, None, False, True]), pa.array([[["a"], None], None, [[]], [["b", None]]]), pa.array([dt.date(1, 1, 1), None, dt.date(9999, 12, 31), dt.date(1970, 1, 1)]), pa.array([b"x", None, b"", b"\xff"]), pa.array([3, None, 1, 2], pa.int16()),
    ]
    for c in columns:
        for part in (c, c[1:], c[:3], c[2:2], c[1:2]):
            got = values(part)
            assert got == part.to_pylist() and [type(v) for v in got] == [type(v) for v in part.to_pylist()]


class Task:
    def row(self, r):
        from pyspark import TaskContext

        yield r[COMPONENT], TaskContext.get().partitionId()

    def end(self):
        yield from ()


def test_folds_are_spread(spark):
    rows = spark.range(200).select(F.col("id").alias(COMPONENT), F.lit(1).alias("at"))
    got = folded(rows, ["at"], Task, "c long, task int").collect()
    assert len(got) == 200 and len({r.task for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
