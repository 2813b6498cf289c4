"""Of a batch, a few rows at a time are Python objects, and what comes of them leaves in pieces."""

import pyarrow as pa

from lexfold import batches
from lexfold.session import importable
from lexfold.sources import files as X


def test_mapped():
    assert batches.mapped(lambda a, b: [a, b], pa.list_(pa.string()), pa.array(["x", None]), pa.array(["y", ""])).to_pylist() == [["x", "y"], [None, ""]]
    assert batches.mapped(str, pa.string(), pa.array([], pa.int64())).to_pylist() == []
    n = 3 * batches.PIECE + 1
    assert batches.mapped(lambda i: i + 1, pa.int64(), pa.array(range(n))).to_pylist() == list(range(1, n + 1))


class Frame:
    """In place of a DataFrame: keeps what is mapped."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_rows_of_containers_leave_in_pieces(spark):
    run = X._expanded(Frame(spark), ["name", "raw"], "container string, no int, message binary", lambda n, r: [(n, i, r) for i in range(3)] if r else 1 / 0)
    b = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1000)]), pa.array([b"x" if i else None for i in range(1000)])], ["name", "raw"])
    out = list(run(iter([b])))
    assert sum(o.num_rows for o in out) == 3 * 999 and max(o.num_rows for o in out) < X.PIECE + 3


def test_extract_of_nulls_and_many(spark):
    rows = [(None, None), ("a.txt", None), ("b.docx", b"no"), *((f"{i}.html", f"<b>{i}</b>".encode()) for i in range(600))]
    got = {r.name: (r.status, r.text) for r in X.extract(importable(spark).createDataFrame(rows, "name string, raw binary").coalesce(1), "name", "raw").collect()}
    assert got[None] == ("unsupported", "") and got["a.txt"] == ("ok", "") and got["b.docx"][0] == "error" and got["599.html"] == ("ok", "599") and len(got) == 603
