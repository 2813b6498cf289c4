"""Load files, mail, archives and office files: readers, writers and the expansion of one file into many rows."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from email.headerregistry import HeaderRegistry
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexfold.batches import PIECE, mapped
from lexfold.functions import normalize as N
from lexfold.operators.ranks import scan
from lexfold.sources.loadfile import open_load_file
from lexfold.storage import fresh_path

# Bounds of what is unpacked from an archive.
ZIP_DEPTH, ZIP_ENTRIES, ZIP_ENTRY_BYTES, ZIP_BYTES = 2, 500, 200 << 20, 1 << 30
CHUNK_WORDS, CHUNK_STEP = 500, 450
HEADERS, HEADER_CHARS = 1_000, 1_000  # values of headers that a process remembers, and the longest of them


class Headers(HeaderRegistry):
    """Headers of mail, each value parsed once while it is remembered: a part is asked for its type many times, and types repeat."""

    def __init__(self) -> None:
        super().__init__()
        self._known = lru_cache(maxsize=HEADERS)(super().__call__)

    def __call__(self, name, value):
        return self._known(name, value) if type(value) is str and len(value) <= HEADER_CHARS else super().__call__(name, value)


MAIL_POLICY = email.policy.default.clone(header_factory=Headers())


def fresh(name: str, spark: SparkSession) -> str:
    return fresh_path(spark, name)


def encoding_of(raw: Column) -> Column:
    h = F.hex(F.substring(raw, 1, 3))
    return F.when(h == "EFBBBF", "utf-8-sig").when(h.startswith("FFFE") | h.startswith("FEFF"), "utf-16").when(F.is_valid_utf8(raw.cast("string")), "utf-8").otherwise("cp1252")


def write_text(rows: DataFrame, ordered: bool = False) -> str:
    """Write the column value as lines ending with CR LF; ordered keeps the rows' order, in one file."""
    path = fresh("text", rows.sparkSession)
    (rows.coalesce(1) if ordered else rows).write.option("lineSep", "\r\n").text(path)
    return path


def read_load_file(spark: SparkSession, path: str, slashes: bool = False) -> DataFrame:
    """A load file as a table (see loadfile.py), with slashes for backslashes in its values if asked."""
    rows = open_load_file(spark, path).rows
    return rows.select(*(F.replace(f"`{c}`", F.lit("\\"), F.lit("/")).alias(c) for c in rows.columns)) if slashes else rows


def parse_opticon(lines: DataFrame) -> DataFrame:
    """bates, pages (paths in order) from Opticon lines (line_no, value); fewer than four fields and pages before
    the first break are dropped, and of repeated documents the last stays."""
    f = F.split("value", ",")
    rows = lines.select("line_no", f.alias("f")).filter(F.size("f") >= 4).select("line_no", F.btrim(F.get("f", F.lit(0))).alias("bates"), F.replace(F.btrim(F.get("f", F.lit(2))), F.lit("\\"), F.lit("/")).alias("page"), (F.upper(F.btrim(F.get("f", F.lit(3)))) == "Y").alias("brk"))
    rows = scan(rows, [], ["line_no"], "doc", F.when(F.col("brk"), F.col("line_no")), "last").filter("doc IS NOT NULL")
    docs = rows.groupBy("doc").agg(F.max(F.when(F.col("brk"), F.col("bates"))).alias("bates"), F.transform(F.sort_array(F.collect_list(F.struct("line_no", "page"))), lambda x: x["page"]).alias("pages"))
    return docs.groupBy("bates").agg(F.max_by("pages", "doc").alias("pages")).filter("bates <> ''")


def dat_line(values: list[Column]) -> Column:
    return F.concat_ws(N.DC4, *(F.concat(F.lit(N.THORN), N.clean_field(v), F.lit(N.THORN)) for v in values))


def match_headers(asked: DataFrame) -> DataFrame:
    """load, no, header, field of the headers (load, no, header) of load files: in each file a field takes its first header."""
    alias = [(f, a, i) for i, (f, names) in enumerate(N.FIELD_ALIASES.items()) for a in names]
    spark = asked.sparkSession
    known = spark.createDataFrame(alias, "field string, alias string, o int").select("field", N.header_key(F.col("alias")).alias("key"), "o").groupBy("key").agg(F.min_by("field", "o").alias("field"))
    joined = asked.withColumn("key", N.header_key(F.col("header"))).join(F.broadcast(known), "key", "left")  # known: a row for each alias
    first = F.row_number().over(Window.partitionBy("load", "field").orderBy("no")) == 1  # the headers of a file
    return joined.select("load", "no", "header", F.when(first, F.col("field")).alias("field"))


def word_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_index, chunk: windows of 500 words, 50 shared; a short text is one chunk as it is."""
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    d = docs.select("doc_id", "text", w.alias("w")).withColumn("n", F.size("w"))
    last = F.when(F.col("n") <= CHUNK_WORDS, 0).otherwise(F.ceil((F.col("n") - CHUNK_WORDS) / CHUNK_STEP)).cast("int")
    d = d.withColumn("k", F.explode_outer(F.sequence(F.lit(0), last)))
    return d.select("doc_id", F.col("k").cast("bigint").alias("chunk_index"), F.when(F.col("n") <= CHUNK_WORDS, F.col("text")).otherwise(F.array_join(F.slice("w", F.col("k") * CHUNK_STEP + 1, CHUNK_WORDS), " ")).alias("chunk"))


def char_windows(docs: DataFrame, size: int = 140_000, overlap: int = 2_000) -> DataFrame:
    """doc_id, part, piece: windows of size characters that share overlap."""
    step = size - overlap
    last = F.when(F.char_length("text") <= size, 0).otherwise(F.ceil((F.char_length("text") - size) / step)).cast("int")
    d = docs.select("doc_id", "text", F.explode_outer(F.sequence(F.lit(0), F.coalesce(last, F.lit(0)))).alias("k"))
    return d.select("doc_id", F.col("k").cast("bigint").alias("part"), F.substring("text", F.col("k") * step + 1, F.lit(size)).alias("piece"))


# --- bytes to text -------------------------------------------------------------------------------------------------


def _xml_text(raw: bytes, tag: str) -> str:
    found = re.findall(rf"<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>", raw.decode("utf-8", "replace"), re.S)
    plain = (re.sub(r"<[^>]+>", "", x) for x in found)
    return " ".join(x.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&") for x in plain)


def _office(raw: bytes, pattern: str, tag: str) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted(i.filename for i in z.infolist() if re.fullmatch(pattern, i.filename) and i.file_size <= ZIP_ENTRY_BYTES)
        return "\n".join(_xml_text(z.read(n), tag) for n in names)


def _decoded(raw: bytes) -> str:
    for code in ("utf-8-sig", "utf-16") if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig",):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            pass
    return raw.decode("cp1252", "replace")


def _rtf(raw: bytes) -> str:
    s = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), raw.decode("latin-1"))
    s = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", s)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", lambda m: "\n" if m[0].strip() in ("\\par", "\\line") else "", s)).strip()


def _html(raw: bytes) -> str:
    s = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", _decoded(raw))
    return re.sub(r"\s+", " ", re.sub(r"(?s)<[^>]+>", " ", s)).strip()


READERS = {
    "txt": _decoded, "csv": _decoded, "log": _decoded, "md": _decoded, "json": _decoded, "xml": _decoded,
    "html": _html, "htm": _html, "rtf": _rtf,
    "docx": lambda b: _office(b, r"word/document\.xml", "t"),
    "xlsx": lambda b: _office(b, r"xl/(sharedStrings|worksheets/sheet\d+)\.xml", "t"),
    "pptx": lambda b: _office(b, r"ppt/slides/slide\d+\.xml", "t"),
    "odt": lambda b: _office(b, r"content\.xml", "p"),
}


def extract_one(name: str, raw: bytes) -> tuple[str, str]:
    """(status, text): ok, unsupported or error; never raises."""
    reader = READERS.get(name.rpartition(".")[2].lower())
    if reader is None:
        return "unsupported", ""
    try:
        return "ok", reader(raw)
    except Exception as e:  # a broken file is a result, not a failure of the job
        return "error", str(e)[:200]


def extract(files: DataFrame, name: str, raw: str) -> DataFrame:
    """files with status and text of each."""

    kind = pa.struct([("status", pa.string()), ("text", pa.string())])

    @F.arrow_udf("status string, text string")
    def run(names: pa.Array, raws: pa.Array) -> pa.Array:
        return mapped(lambda n, r: dict(zip(("status", "text"), extract_one(n or "", r or b""))), kind, names, raws)

    return files.withColumn("x", run(name, raw)).select("*", "x.status", "x.text").drop("x")


def _expanded(files: DataFrame, columns: list[str], schema: str, one) -> DataFrame:
    """Rows of one(*values) for every row; a file that can't be read gives none."""

    kinds = list(to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(kinds)], names=[t.name for t in kinds])
        for b in batches:
            for i in range(b.num_rows):
                try:
                    rows += one(*(c[i].as_py() for c in b.columns))
                except Exception:  # noqa: S110  broken containers give nothing, by contract
                    pass
                if len(rows) >= PIECE:
                    yield batch()
                    rows.clear()
        yield batch()

    return files.select(*columns).mapInArrow(run, schema)


MAIL = "message_id string, subject string, sender string, recipients string, part string, name string, content string"


def _message_rows(raw: bytes) -> list[tuple]:
    m = email.message_from_bytes(bytes(raw), policy=MAIL_POLICY)
    head = (None if m["message-id"] is None else str(m["message-id"]), str(m["subject"] or ""), str(m["from"] or ""), str(m["to"] or ""))
    body = m.get_body(("plain",)) or m.get_body(("html",))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_subtype() == "html":
        text = _html(text.encode())
    rows = [(*head, "body", None, text.strip())]
    return rows + [(*head, "attachment", a.get_filename(), extract_one(a.get_filename() or "", a.get_payload(decode=True) or b"")[1]) for a in m.iter_attachments()]


def parse_messages(files: DataFrame, raw: str) -> DataFrame:
    return _expanded(files, [raw], MAIL, _message_rows)


def _mailbox_rows(name: str, raw: bytes) -> list[tuple]:
    if name.lower().endswith(".eml"):
        return [(name, 0, bytes(raw))]
    if name.lower().endswith(".mbox"):
        parts = re.split(rb"(?m)^From [^\n]*\n", bytes(raw))[1:]  # a blank line before the next belongs to the format
        return [(name, i, email.message_from_bytes(p[:-1] if p.endswith(b"\n\n") else p).as_bytes()) for i, p in enumerate(parts)]
    return []  # formats that need a tool which isn't there


def expand_mailbox(files: DataFrame, name: str, raw: str) -> DataFrame:
    return _expanded(files, [name, raw], "container string, no int, message binary", _mailbox_rows)


def _zip_rows(name: str, raw: bytes, depth: int = 1, spent: list[int] | None = None) -> list[tuple]:
    spent = [0, 0] if spent is None else spent
    rows = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for i in z.infolist():
            odd = i.is_dir() or i.flag_bits & 1 or i.filename.startswith(("/", "\\")) or ".." in Path(i.filename).parts
            if odd or spent[0] >= ZIP_ENTRIES:
                continue
            with z.open(i) as f:
                data = f.read(ZIP_ENTRY_BYTES + 1)  # what is really there counts, not what the entry says
            if len(data) > ZIP_ENTRY_BYTES or spent[1] + len(data) > ZIP_BYTES:
                continue
            spent[0] += 1
            spent[1] += len(data)
            if i.filename.lower().endswith(".zip") and depth < ZIP_DEPTH:
                rows += _zip_rows(f"{name}/{i.filename}", data, depth + 1, spent)
            else:
                rows.append((name, i.filename, len(data), data))
    return rows


def expand_zip(files: DataFrame, name: str, raw: str) -> DataFrame:
    return _expanded(files, [name, raw], "archive string, entry string, size long, content binary", _zip_rows)


# --- samples for tests and demonstration queries -------------------------------------------------------------------


def sample_zip() -> bytes:
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.txt", "alpha")
        z.writestr("../evil.txt", "no")
        z.writestr("inner.zip", inner.getvalue())
    return outer.getvalue()


def sample_mbox() -> bytes:
    return b"From a@b Thu Jan  1 00:00:00 2024\nSubject: first\n\none\n\nFrom a@b Thu Jan  1 00:00:01 2024\nSubject: second\n\ntwo\n"


def sample_office_files() -> list[tuple[str, bytes]]:
    def zipped(name: str, body: str) -> bytes:
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr(name, body)
        return b.getvalue()

    return [
        ("a.docx", zipped("word/document.xml", "<w:p><w:t>Hello</w:t><w:t xml:space='preserve'>world</w:t></w:p>")),
        ("a.xlsx", zipped("xl/sharedStrings.xml", "<sst><si><t>cell</t></si></sst>")),
        ("a.pptx", zipped("ppt/slides/slide1.xml", "<a:t>slide</a:t>")),
        ("a.odt", zipped("content.xml", "<text:p>para</text:p>")),
        ("a.rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}Plain\par text}"),
        ("a.txt", "déjà".encode("cp1252")),
        ("a.exe", b"MZ"),
    ]


def sample_messages(messages: DataFrame) -> DataFrame:
    body = F.concat(F.lit("Message-ID: "), F.coalesce("message_id", F.lit("<none>")), F.lit("\r\nSubject: "), F.coalesce("subject", F.lit("")), F.lit("\r\nFrom: a@example.com\r\nTo: b@example.com\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"), F.coalesce("text", F.lit("")))
    return messages.select(F.encode(body, "UTF-8").alias("raw"))
