"""Load files of each encoding, delimiter and line end, whole and in many byte ranges."""

import csv
import io

import pytest

from lexfold.sources.loadfile import open_load_file

T, D = "þ", "\x14"


def thorn(*values):
    return D.join(f"{T}{v}{T}" for v in values)


def stored(tmp_path, text, encoding="utf-8", name="load.dat"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return f"file://{path}"


@pytest.fixture(params=["128m", "40b"])
def ranges(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def read(spark, path):
    f = open_load_file(spark, path)
    return f.encoding, f.delimiter, f.headers, sorted(tuple(r) for r in f.rows.collect())


def plain(text, delimiter):
    """Rows by definition, for text without its mark."""
    lines = text.strip().split("\r\n")
    if len(lines) == 1:
        lines = text.strip().split("\n")
    cut = lambda s: [f.strip(T).strip() for f in s.split(D)] if delimiter == D else [f.strip() for f in next(csv.reader(io.StringIO(s), delimiter=delimiter), [])]
    head = cut(lines[0])
    return head, sorted(tuple((cut(x) + [""] * len(head))[: len(head)]) for x in lines[1:] if x.strip())


BODY = "\r\n".join([thorn("Begin Bates", "Custodian", "Note")] + [thorn(f"ABC-{i}", "Müller, J", "a\nb" if i % 7 == 0 else " x ") for i in range(40)] + ["", thorn("short"), thorn("Begin Bates", "Custodian", "Note"), "  "]) + "\r\n"


@pytest.mark.parametrize("encoding, told", [("utf-8-sig", "utf-8-sig"), ("utf-8", "utf-8"), ("utf-16", "utf-16"), ("utf-16-be", "utf-16"), ("cp1252", "cp1252")])
def test_encodings_keep_rows_equal_to_the_header(ranges, tmp_path, encoding, told):
    text = ("﻿" if encoding == "utf-16-be" else "") + BODY
    path = stored(tmp_path, text, encoding)
    head, rows = plain(BODY, D)
    assert read(ranges, path) == (told, D, head, rows) and tuple(head) in rows and len(rows) == 42


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("delimiter", ["\t", ",", "|"])
def test_line_ends_and_delimiters(ranges, tmp_path, end, delimiter):
    text = end + end.join(delimiter.join(x) for x in [["BegBates", "Custodian", "N"], ["ABC-1", '"so ""called"""', "1"], ["ABC-2", "€uro", ""], ["ABC-3"]]) + end * 2
    head, rows = plain(text, delimiter)
    assert read(ranges, stored(tmp_path, text)) == ("utf-8", delimiter, head, rows)


def test_many_ranges(ranges, tmp_path):
    path = stored(tmp_path, BODY * 3, "utf-16")
    assert open_load_file(ranges, path).total_rows() == len(plain(BODY * 3, D)[1])
    assert len(open_load_file(ranges, path).sample_rows()) == 20


def test_odd_files(spark, tmp_path):
    assert read(spark, stored(tmp_path, "", name="a")) == ("utf-8", ",", [], [])
    assert read(spark, stored(tmp_path, " \r\n\n", name="b")) == ("utf-8", ",", [], [])
    assert read(spark, stored(tmp_path, "Only", name="c")) == ("utf-8", ",", ["Only"], [])
    assert read(spark, stored(tmp_path, "A,A,B\r\n1,2,3\r\n", name="d")) == ("utf-8", ",", ["A", "A", "B"], [("2", "3")])
    assert read(spark, stored(tmp_path, "A|B\nx\x00y|\x00\n", name="e")) == ("utf-8", "|", ["A", "B"], [("xy", "")])
    (tmp_path / "w").write_bytes(b"A,B\r\n\x93q\x94,\x81\xe9\r\n")
    assert read(spark, f"file://{tmp_path}/w") == ("cp1252", ",", ["A", "B"], [("“q”", "�é")])
