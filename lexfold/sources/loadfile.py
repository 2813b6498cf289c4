"""Load files of any size, encoding and delimiter as tables.

A file is read in byte ranges by Spark's text source, so from any store and by many tasks; only the mark at its beginning
(three bytes), a few facts and the header come to the driver. Records end with CR LF where that occurs within the file, else
with LF, so a lone LF within a CR LF file is part of its field. The header is the first line by its place in the file, not
by its value: a row that says the same is a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.functions import normalize as N

# What bytes 80 to 9F stand for in the Windows code page; the replacement character where they are unused.
WINDOWS = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"
SAMPLE = 20
BLANK = r"^[\s\x1c-\x1f\x85\xa0]*$"


@dataclass(frozen=True)
class LoadFile:
    encoding: str
    delimiter: str
    headers: list[str]
    rows: DataFrame  # a column for each header, strings; of headers that repeat the last

    def total_rows(self) -> int:
        return self.rows.count()

    def sample_rows(self, n: int = SAMPLE) -> list[dict]:
        return [r.asDict() for r in self.rows.limit(n).collect()]


def _mark(spark: SparkSession, path: str) -> bytes:
    """The first three bytes of a file, or of the first file in a folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.getFileStatus(p).isDirectory():
        names = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "_.")
        if not names:
            return b""
        p = jvm.org.apache.hadoop.fs.Path(names[0])
    f = fs.open(p)
    try:
        return bytes(b for b in (f.read() for _ in range(3)) if b >= 0)
    finally:
        f.close()


def _lines(spark: SparkSession, path: str, charset: str, end: str) -> DataFrame:
    """at (place in the file, in order), raw (bytes) of each line."""
    lines = spark.read.option("lineSep", end).option("encoding", charset).text(path)
    # rows of one range are numbered in order by the task that reads it
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("row"))
    return lines.select(at.alias("at"), F.col("value").cast("binary").alias("raw"))


def _text(raw: Column, encoding: str, charset: str) -> Column:
    if encoding == "utf-16":
        return F.regexp_replace(F.decode(raw, charset), "^﻿", "")
    if encoding == "cp1252":
        text = F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), WINDOWS)
    else:
        text = F.regexp_replace(F.decode(raw, "UTF-8"), "^﻿", "")
    return F.replace(text, F.lit("\x00"))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$", "")


def fields(line: Column, delimiter: str) -> Column:
    """Fields of a line without white space around them."""
    if delimiter == N.DC4:
        return F.transform(F.split(line, N.DC4), lambda f: trimmed(F.btrim(f, F.lit(N.THORN))))
    return F.transform(N.csv_fields(line, delimiter), trimmed)


def open_load_file(spark: SparkSession, path: str) -> LoadFile:
    """The load file at path (a file, or a folder whose files follow one another by name); see the module.

    Encodings are UTF-8 and UTF-16 by their marks, else UTF-8 where all of it is valid, else the Windows code page. Null
    characters go but from UTF-16. Blank lines go, short rows are padded, an empty file has no headers and no rows.
    """
    mark = _mark(spark, path)
    encoding = "utf-8-sig" if mark == b"\xef\xbb\xbf" else "utf-16" if mark[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8"
    charset = ("UTF-16LE" if mark[:1] == b"\xff" else "UTF-16BE") if encoding == "utf-16" else "UTF-8"
    wide = encoding == "utf-16"
    lines = _lines(spark, path, charset, "\n")
    if not wide:
        facts = lines.agg(F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("valid")).first()
        if encoding == "utf-8" and facts["valid"] is False:
            encoding = "cp1252"
    text = lambda rows: rows.select("at", _text(F.col("raw"), encoding, charset).alias("line"))
    said = text(lines).withColumn("said", ~F.col("line").rlike(BLANK))
    ends = said.filter("said").agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    if ends["first"] is None:
        return LoadFile(encoding, ",", [], spark.createDataFrame([], "empty string").drop("empty"))
    if wide and not lines.filter(F.length("raw") % 2 == 1).isEmpty():
        raise ValueError("a UTF-16 load file whose lines do not end at whole characters")
    place = lambda at: F.struct(F.lit(at["file"]).alias("file"), F.lit(at["range"]).alias("range"), F.lit(at["row"]).alias("row"))
    inside = text(lines).filter((F.col("at") >= place(ends["first"])) & (F.col("at") < place(ends["last"])) & F.col("line").endswith("\r"))
    if not inside.isEmpty():
        lines = _lines(spark, path, charset, "\r\n")
    kept = text(lines).filter(~F.col("line").rlike(BLANK))
    head = kept.agg(F.min_by("line", "at").alias("line"), F.min("at").alias("at")).first()
    first = F.regexp_replace(F.lit(head["line"]), r"^[\s\x1c-\x1f\x85\xa0]+", "")
    delimiter = spark.range(1).select(N.delimiter_of(first).alias("d")).first()["d"]
    headers = spark.range(1).select(fields(first, delimiter).alias("n")).first()["n"]
    rows = kept.filter(F.col("at") != place(head["at"])).select(fields(F.regexp_replace("line", "\r$", ""), delimiter).alias("f"))
    last = {h: i for i, h in enumerate(headers)}
    return LoadFile(encoding, delimiter, headers, rows.select(*(F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(h) for h, i in last.items())))
