"""Families of documents in mail and archives: one file becomes a parent and its numbered members.

Containers are opened in rounds: each round opens all containers that the one before found, on all executors, so a deep file
is no task of its own. Archives within archives are transparent down to a depth; mail, and archives attached to it, are
members with members of their own. What an archive may bring in is bounded in entries and bytes, shared by all archives
that are transparent in it; what counts is what is really there, in the order of one reading from first to last, and
what is past the bounds, or cannot be read, leaves a note on the archive, which then counts as partial.
"""

from __future__ import annotations

import base64
import email
import hashlib
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexfold.sources.files import MAIL_POLICY, ZIP_BYTES, ZIP_DEPTH, ZIP_ENTRIES, ZIP_ENTRY_BYTES, _html, extract_one
from lexfold.storage import forget, written

NOTE = 500  # characters of notes that are kept
ROWS, BYTES = 1_000, 16 << 20  # of members that a task gives at once, about
NODE = "root string, path string, owner string, visible boolean, name string, kind string, depth int, raw binary, size bigint, status string, note string, text string, sha256 string"
FIELDS = [f.split()[0] for f in NODE.split(", ")]


@dataclass(frozen=True)
class Limits:
    depth: int = ZIP_DEPTH
    entries: int = ZIP_ENTRIES
    entry_bytes: int = ZIP_ENTRY_BYTES
    total_bytes: int = ZIP_BYTES


def kind_of(name: str) -> str:
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    return "zip" if ext == "zip" else "mail" if ext == "eml" else "file"


def _escapes(name: str) -> bool:
    plain = name.replace("\\", "/")
    return plain.startswith("/") or (len(plain) > 1 and plain[1] == ":" and plain[0].isalpha()) or ".." in plain.split("/")


def _member(parent: dict, place: int, owner: str, name: str, data: bytes, limits: Limits, inside_zip: bool) -> dict:
    """The row of one member; containers that are to be opened keep their bytes."""
    kind = kind_of(name)
    depth = parent["depth"] + 1 if inside_zip and kind == "zip" else 1
    row = {"root": parent["root"], "path": f"{parent['path']}/{place:06d}", "owner": owner, "visible": not (inside_zip and kind == "zip"), "name": name, "kind": kind, "depth": depth, "size": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    if kind == "zip" and depth > limits.depth:
        row |= {"kind": "file", "visible": True}
    if row["kind"] == "file":
        row["status"], row["text"] = extract_one(name, data)
        return row
    return row | {"raw": data, "status": "ok"}


def _skip(parent: dict, place: int, owner: str, note: str) -> dict:
    return {"root": parent["root"], "path": f"{parent['path']}/{place:06d}", "owner": owner, "visible": False, "kind": "skip", "depth": 0, "size": 0, "note": note}


def _unzipped(c: dict, owner: str, limits: Limits) -> Iterator[dict]:
    try:
        z = zipfile.ZipFile(io.BytesIO(c["raw"]))
    except Exception as e:  # broken archives are a note, not a failure of the job
        yield _skip(c, 0, owner, f"could not open {c['name']}: {e}")
        return
    taken, used, said = 0, 0, 0
    with z:
        for place, info in enumerate(z.infolist()):
            if info.is_dir():
                continue
            note, data = None, b""
            if _escapes(info.filename):
                note = "path traversal"
            elif info.flag_bits & 1:
                note = "encrypted"
            elif info.file_size > limits.entry_bytes:
                note = "too large"
            else:
                try:
                    with z.open(info) as f:
                        data = f.read(limits.entry_bytes + 1)
                    note = "too large" if len(data) > limits.entry_bytes else None
                except Exception as e:
                    note = f"could not read ({e})"
            if note:
                if said <= NOTE:
                    said += len(note)
                    yield _skip(c, place, owner, f"skipped {info.filename}: {note}")
                continue
            yield _member(c, place, owner, info.filename, data, limits, True)
            taken, used = taken + (kind_of(info.filename) != "zip"), used + len(data)
            if taken > limits.entries or used > limits.total_bytes:
                return  # the bounds of this archive alone are passed; those shared with others are looked at later


def _unfolded(c: dict, limits: Limits) -> Iterator[dict]:
    m = email.message_from_bytes(bytes(c["raw"]), policy=MAIL_POLICY)
    for place, a in enumerate(m.iter_attachments()):
        data = a.get_payload(decode=True)
        yield _member(c, place, c["path"], a.get_filename() or f"attachment {place + 1}", data if data is not None else a.get_payload(0).as_bytes() if a.is_multipart() else b"", limits, False)


def _body(raw: bytes) -> str:
    try:
        m = email.message_from_bytes(bytes(raw), policy=MAIL_POLICY)
        body = m.get_body(("plain",)) or m.get_body(("html",))
        text = body.get_content() if body is not None else ""
        return (_html(text.encode()) if body is not None and body.get_content_subtype() == "html" else text).strip()
    except Exception:  # mail that cannot be read has no text
        return ""


def _opened(nodes: DataFrame, limits: Limits) -> DataFrame:
    kinds = list(to_arrow_schema(nodes.sparkSession.createDataFrame([], NODE).schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(t.name) for r in out], t.type) for t in kinds], names=FIELDS)
        for b in batches:
            for i in range(b.num_rows):
                c = {k: b.column(j)[i].as_py() for j, k in enumerate(FIELDS)}
                try:
                    rows = list(_unzipped(c, c["path"] if c["visible"] else c["owner"], limits) if c["kind"] == "zip" else _unfolded(c, limits))
                except Exception as e:
                    rows = [_skip(c, 0, c["path"] if c["visible"] else c["owner"], f"could not read {c['name']}: {e}")]
                for r in rows:
                    if r["kind"] == "mail":
                        r["text"] = _body(r["raw"])
                out += rows
                held += sum(r["size"] for r in rows)
                if len(out) > ROWS or held > BYTES:
                    yield batch()
                    out, held = [], 0
        yield batch()

    return _dealt(nodes.select(*FIELDS), "root", "path").mapInArrow(run, NODE)


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows over all tasks: opening a container takes far longer than moving it, and a small table is one task's otherwise.

    By a hash of its own: rows that a join by the same columns has dealt would stay in the few tasks that their bytes need.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*by))


def expand(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """control, family_id, parent, name, file_type, size, sha256, status, note, text of every file and all its members.

    files: control (unique), name, raw. Members of a parent are numbered "control .0001" in order; all of a file share its
    control as family_id. status is ok, unsupported or error of what was read, partial of a container with notes (joined,
    500 characters), error of an archive that cannot be opened. Null bytes are an empty file.
    """
    limits = limits or Limits()
    kinds = F.when(F.lower("name").endswith(".zip"), "zip").when(F.lower("name").endswith(".eml"), "mail").otherwise("file")
    raw = F.coalesce("raw", F.lit(b""))
    text = F.udf(lambda n, r, k: ("ok", _body(r)) if k == "mail" else ("ok", None) if k == "zip" else extract_one(n or "", bytes(r)), "status string, text string")
    start = _dealt(files, "control").select(F.col("control").alias("root"), F.lit("").alias("path"), F.lit(None).cast("string").alias("owner"), F.lit(True).alias("visible"), "name", kinds.alias("kind"), F.lit(1).alias("depth"), raw.alias("raw"), F.length(raw).cast("bigint").alias("size"), F.lit(None).cast("string").alias("note"), F.sha2(raw, 256).alias("sha256"))
    start = start.withColumn("_x", text("name", "raw", "kind")).select("*", F.col("_x.status").alias("status"), F.col("_x.text").alias("text")).withColumn("raw", F.when(F.col("kind") != "file", F.col("raw"))).select(*FIELDS)
    held = [written(start, "family")]
    while True:
        found = written(_opened(_kept(held, limits).filter("raw IS NOT NULL AND round = " + str(len(held) - 1)), limits), "family")
        held.append(found)
        if found.filter("raw IS NOT NULL").isEmpty():
            break
    nodes = written(_kept(held, limits).drop("raw"), "family-nodes")
    forget(files.sparkSession, *held)
    return _numbered(nodes, limits)


def _kept(held: list[DataFrame], limits: Limits) -> DataFrame:
    """All nodes so far, but those past the bounds of the archive that they count to; past: the first of these."""
    nodes = reduce(DataFrame.unionByName, (h.withColumn("round", F.lit(i)) for i, h in enumerate(held)))
    archives = nodes.filter("kind = 'zip' AND visible").select("root", F.col("path").alias("owner"), F.lit(True).alias("bounded"))
    so_far = Window.partitionBy("root", "owner").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)  # of one archive, each of whose parts is bounded
    sums = nodes.filter("owner IS NOT NULL").select("root", "owner", "path", "kind", "visible", "size").join(archives, ["root", "owner"])
    sums = sums.withColumn("entries", F.sum(F.when(F.col("visible"), 1).otherwise(0)).over(so_far)).withColumn("bytes", F.sum("size").over(so_far))
    past = sums.filter((F.col("entries") > limits.entries) | (F.col("bytes") > limits.total_bytes))
    return nodes.join(past.select("root", "path"), ["root", "path"], "left_anti").join(past.groupBy(F.col("root"), F.col("owner").alias("path")).agg(F.min_by(F.when(F.col("entries") > limits.entries, f"entry cap ({limits.entries}) reached; remaining entries skipped").otherwise("total size cap reached; remaining entries skipped"), "path").alias("past")), ["root", "path"], "left")


def _numbered(nodes: DataFrame, limits: Limits) -> DataFrame:
    said = nodes.filter("kind = 'skip'").groupBy("root", F.col("owner").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("path").alias("p"), "note"))), lambda x: x["note"]), "; ").alias("notes"), F.max(F.col("note").startswith("could not open") & (F.col("path") == F.concat("owner", F.lit("/000000")))).alias("closed"))
    place = F.row_number().over(Window.partitionBy("root", "owner").orderBy("path"))  # members of one parent
    shown = nodes.filter("visible").withColumn("k", place).join(said, ["root", "path"], "left")
    notes = F.nullif(F.substring(F.concat_ws("; ", "notes", "past"), 1, NOTE), F.lit(""))
    shown = shown.withColumn("all_notes", notes).withColumn("level", F.size(F.split("path", "/")))
    shown = written(shown.select("root", "path", "owner", "k", "name", "kind", "size", "sha256", "text", F.when(F.col("all_notes").isNull(), F.col("status")).when(F.col("closed"), "error").otherwise("partial").alias("status"), F.col("all_notes").alias("note")), "family-shown")
    level = shown.filter("owner IS NULL").select("root", "path", F.col("root").alias("control"), F.lit(None).cast("string").alias("parent"))
    out = [level]
    while True:  # as deep as containers are in one another
        up = level.select("root", F.col("path").alias("owner"), F.col("control").alias("parent"))
        number = F.when(F.col("k") > 9999, F.col("k").cast("string")).otherwise(F.lpad(F.col("k").cast("string"), 4, "0"))
        level = written(shown.join(up, ["root", "owner"]).select("root", "path", F.concat("parent", F.lit(" ."), number).alias("control"), "parent"), "family-level")
        if level.isEmpty():
            break
        out.append(level)
    named = reduce(DataFrame.unionByName, out)
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    kind = F.when(F.col("kind") == "mail", "email").when(F.col("kind") == "zip", "zip").otherwise(F.nullif(ext, F.lit("")))
    return named.join(shown, ["root", "path"]).select("control", F.col("root").alias("family_id"), "parent", "name", kind.alias("file_type"), "size", "sha256", "status", "note", "text")


# --- containers for demonstration queries --------------------------------------------------------------------------


def _mail(subject: str, body: str, *attachments: tuple[str, bytes]) -> bytes:
    """A message of one line of ASCII, written as it is: the library's own classes take a hundred times as long."""
    head, text = f"Subject: {subject}\nMIME-Version: 1.0\n", f"Content-Type: text/plain; charset=utf-8\n\n{body}\n"
    if not attachments:
        return (head + text).encode()
    edge = "=_part"  # no line of base64 and no such body holds it
    parts = [text.encode()] + [f"Content-Type: application/octet-stream\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment; filename={n}\nMIME-Version: 1.0\n\n".encode() + base64.encodebytes(d) for n, d in attachments]
    return f'{head}Content-Type: multipart/mixed; boundary="{edge}"\n\n'.encode() + b"".join(f"--{edge}\n".encode() + p + b"\n" for p in parts) + f"--{edge}--\n".encode()


def _archive(*members: tuple[str, bytes]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, d in members:
            z.writestr(n, d)
    return b.getvalue()


def packed(messages: DataFrame) -> DataFrame:
    """control, name, raw: mail of the messages (doc_id, text), with no attachment, a text, an archive in an archive that
    holds mail and an entry that leads out of it, or as an archive itself, by doc_id."""

    @F.udf("struct<name:string,raw:binary>")
    def pack(doc_id, text):
        mail = partial(_mail, f"message {doc_id}")
        body, way = (text or "").encode(), doc_id % 4
        if way == 0:
            return "m.eml", mail("alone")
        if way == 1:
            return "m.eml", mail("with", ("a.txt", body))
        inner = _archive(("deep.zip", _archive(("in.eml", mail("inside", ("a.txt", body))))), ("../out.txt", b"no"), ("b.txt", body))
        return ("m.eml", mail("pack", ("pack.zip", inner))) if way == 2 else ("pack.zip", inner)

    d = _dealt(messages, "doc_id").select(F.concat(F.lit("M"), F.col("doc_id").cast("string")).alias("control"), pack("doc_id", "text").alias("p"))
    return d.select("control", "p.name", "p.raw")
