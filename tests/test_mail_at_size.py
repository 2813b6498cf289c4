"""Mail and containers of large tables: headers are parsed once, containers spread over all tasks."""

import email
from email.headerregistry import HeaderRegistry

from pyspark.sql import functions as F

from lexfold.sources import families as FA
from lexfold.sources import files as X


def test_headers_are_parsed_once(monkeypatch):
    seen, parse = [], HeaderRegistry.__call__
    monkeypatch.setattr(HeaderRegistry, "__call__", lambda self, name, value: (seen.append((name, value)), parse(self, name, value))[1])
    policy = X.MAIL_POLICY.clone(header_factory=X.Headers())
    raw = FA._mail("s", "body", ("a.txt", b"alpha"), ("b.txt", b"beta"))
    for _ in range(3):
        m = email.message_from_bytes(raw, policy=policy)
        assert [a.get_filename() for a in m.iter_attachments()] == ["a.txt", "b.txt"] and m.get_body(("plain",)).get_content() == "body\n"
    assert len(seen) == len(set(seen)) > 3


def test_mail_is_what_the_library_reads():
    for data in (b"", b"\x00\xff" * 100, b"=_part\n--=_part--\n"):
        m = email.message_from_bytes(FA._mail("s 1", "body", ("a.bin", data)), policy=X.MAIL_POLICY)
        assert m["subject"] == "s 1" and not m.defects and [a.get_payload(decode=True) for a in m.iter_attachments()] == [data]


def test_containers_are_dealt_after_a_join_by_the_same_columns(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("root"), F.lit("").alias("path"))
    joined = rows.join(rows.hint("shuffle_hash"), ["root", "path"])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert FA._dealt(joined, "root", "path").select(F.spark_partition_id().alias("p")).distinct().count() == n
