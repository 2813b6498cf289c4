"""Privilege log, production set and load-file queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexfold.functions.normalize import bates
from lexfold.operators import production as O
from lexfold.operators.ranks import running
from lexfold.plans.registry import query
from lexfold.sources import corpus as C

MEMBERS_SQL = """red AS (SELECT l_partkey AS doc_id, count(*) AS n, CAST(max(l_shipdate) AS DATE) AS changed FROM lineitem WHERE l_linenumber = 6 AND l_returnflag = 'R' GROUP BY l_partkey),
m AS (SELECT docs.*, coalesce(red.n, 0) AS redactions, red.changed, docs.doc_id IN (SELECT doc_id FROM tags WHERE tag_id = 3) AS privileged,
    CASE docs.doc_id % 17 WHEN 0 THEN 'produce' WHEN 1 THEN 'bogus' END AS override_,
    CASE WHEN docs.doc_id % 3 > 0 THEN DATE '1998-06-01' END AS decided, CASE WHEN docs.doc_id % 3 > 0 THEN 'approved' END AS decision, coalesce(red.n, 0) + CASE WHEN docs.doc_id % 7 = 0 THEN 1 ELSE 0 END AS then_n
  FROM docs LEFT JOIN red USING (doc_id)),
e AS (SELECT *, CASE WHEN override_ IN ('withhold','redact_in_part','produce') THEN override_ WHEN redactions > 0 THEN 'redact_in_part' WHEN privileged THEN 'withhold' END AS disposition,
    CASE WHEN redactions = 0 THEN 'not_applicable' WHEN decision IS NULL OR then_n <> redactions OR changed >= decided THEN 'pending' ELSE decision END AS qc FROM m)"""
BASE = C.with_sql(C.DOCS_SQL, C.TAGS_SQL, MEMBERS_SQL)


def members(spark, sf):
    """Documents with redactions, privilege, override, QC decision, and their disposition and QC status."""
    red = C.read(spark, sf, "lineitem").filter("l_linenumber = 6 AND l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").cast("date").alias("changed"))
    priv = C.document_tags(spark, sf).filter("tag_id = 3").select("doc_id").distinct().withColumn("privileged", F.lit(True))
    n = F.coalesce("n", F.lit(0))
    on = F.col("doc_id") % 3 > 0
    m = C.documents(spark, sf).join(red, "doc_id", "left").join(priv, "doc_id", "left").select(
        "*",
        n.alias("redactions"),
        F.coalesce("privileged", F.lit(False)).alias("priv"),
        F.when(F.col("doc_id") % 17 == 0, "produce").when(F.col("doc_id") % 17 == 1, "bogus").alias("override"),
        F.when(on, F.lit("1998-06-01").cast("date")).alias("decided"),
        F.when(on, "approved").alias("decision"),
        (n + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("then_n"),
    ).drop("privileged", "n").withColumnRenamed("priv", "privileged")
    m = m.withColumn("disposition", O.effective_disposition(F.col("privileged"), F.col("redactions") > 0, F.col("override")))
    return m.withColumn("qc", O.qc_status(F.col("redactions"), F.col("decision"), F.col("decided"), F.col("then_n"), F.col("changed")))


@query("v1_disposition", BASE + "SELECT doc_id, disposition FROM e")
def disposition(spark, sf):
    return members(spark, sf).select("doc_id", "disposition")


@query("v2_qc_status", BASE + "SELECT doc_id, qc FROM e")
def qc(spark, sf):
    return members(spark, sf).select("doc_id", "qc")


DESCRIPTION_SQL = """(CASE WHEN doc_id % 4 = 0 THEN 'Email' WHEN doc_id % 6 <> 0 THEN upper(regexp_extract(native_path, '\\.([^.]*)$', 1)) || ' document' ELSE 'Document' END
  || CASE WHEN doc_id % 4 = 0 THEN ' from ' || custodian || '@x.example' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' dated 2024-01-05' ELSE '' END
  || CASE disposition WHEN 'withhold' THEN ' withheld' WHEN 'redact_in_part' THEN ' produced in redacted form' ELSE '' END || CASE WHEN privileged THEN ' on the basis of Attorney-Client' ELSE '' END || '.')"""


def _described(m):
    ext = F.regexp_extract("native_path", r"\.([^.]*)$", 1)
    sender = F.when(F.col("doc_id") % 4 == 0, F.concat("custodian", F.lit("@x.example")))
    date = F.when(F.col("doc_id") % 2 == 0, F.lit("2024-01-05").cast("date"))
    basis = F.when(F.col("privileged"), F.array(F.lit("Attorney-Client"))).otherwise(F.array().cast("array<string>"))
    return m.withColumn("basis", basis).withColumn("description", O.log_description(sender, F.lit(None).cast("string"), date, ext, F.col("basis"), F.col("disposition"), F.lit(None).cast("string")))


@query("v3_log_description", BASE + f"SELECT doc_id, {DESCRIPTION_SQL} AS description FROM e")
def description(spark, sf):
    return _described(members(spark, sf)).select("doc_id", "description")


@query("v4_privilege_log", BASE + f"SELECT bates_begin, disposition, CASE WHEN privileged THEN ['Attorney-Client'] ELSE [] END AS basis, {DESCRIPTION_SQL} AS description, qc FROM e WHERE disposition <> 'produce'")
def privilege_log(spark, sf):
    """Candidates are tagged, redacted or overridden; what is produced whole is not logged."""
    return _described(members(spark, sf).filter("disposition <> 'produce'")).select("bates_begin", "disposition", "basis", "description", "qc")


@query("v5_conflicts", BASE + """SELECT 'qc_pending' AS kind, doc_id FROM e WHERE disposition = 'redact_in_part' AND qc <> 'approved' UNION ALL SELECT 'privilege_produce', doc_id FROM e WHERE privileged AND coalesce(disposition, 'produce') = 'produce'
  UNION ALL SELECT 'no_images', doc_id FROM e WHERE coalesce(disposition, 'produce') <> 'withhold' AND native_path IS NULL UNION ALL SELECT 'received_document', doc_id FROM e WHERE source_type = 'received'""")
def conflicts(spark, sf):
    m = members(spark, sf).withColumn("d", F.coalesce("disposition", F.lit("produce")))
    kinds = F.array(
        F.when((F.col("d") == "redact_in_part") & (F.col("qc") != "approved"), "qc_pending"),
        F.when(F.col("privileged") & (F.col("d") == "produce"), "privilege_produce"),
        F.when((F.col("d") != "withhold") & F.col("native_path").isNull(), "no_images"),
        F.when(F.col("source_type") == "received", "received_document"),
    )
    return m.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), "doc_id")


ORDER_SQL = """o AS (SELECT *, first_value(bates_begin) OVER w AS hc, coalesce(first_value(custodian) OVER w, '') AS hu, first_value(CASE WHEN doc_id % 5 > 0 THEN n_chars END) OVER w AS hd
  FROM e WINDOW w AS (PARTITION BY production_id, CASE WHEN family_id IS NULL THEN 's' || bates_begin ELSE 'f' || family_id END ORDER BY bates_begin)),
s AS (SELECT *, row_number() OVER (PARTITION BY production_id ORDER BY hc, bates_begin) AS sort_order, row_number() OVER (PARTITION BY production_id ORDER BY hu, hd IS NULL, hd, hc, bates_begin) AS by_custodian,
  CASE WHEN disposition = 'withhold' OR (coalesce(disposition, 'produce') = 'produce' AND regexp_matches(lower(native_path), '[.](mp4|msg)$')) THEN 1 ELSE greatest(page_count, 1) END AS pages FROM o),
z AS (SELECT *, sum(pages) OVER (PARTITION BY production_id ORDER BY sort_order ROWS UNBOUNDED PRECEDING) AS last FROM s)"""
ORDERED = C.with_sql(C.DOCS_SQL, C.TAGS_SQL, MEMBERS_SQL, ORDER_SQL)


NATIVE_TYPES = ("mp4", "msg")  # produced as native files


def _set(spark, sf):
    m = members(spark, sf).withColumn("set_id", F.col("production_id")).withColumn("control", F.col("bates_begin")).withColumn("doc_date", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")))
    native = O.produced_as_native(F.col("disposition"), F.col("native_path"), NATIVE_TYPES)
    m = m.withColumn("pages", O.produced_pages(F.col("disposition"), F.col("page_count"), native)).withColumn("has_text", F.char_length("text") > 0)
    return m.select("doc_id", "set_id", "control", "family_id", "custodian", "doc_date", "disposition", "native_path", "has_text", "pages")  # ranked and written: no texts


@query("v6_family_order", ORDERED + "SELECT doc_id, sort_order, by_custodian FROM s")
def family_order(spark, sf):
    m = _set(spark, sf)
    a, b = O.ordered(m).select("doc_id", "sort_order"), O.ordered(m, True).select("doc_id", F.col("sort_order").alias("by_custodian"))
    return a.join(b, "doc_id")


@query("v7_bates_format", "SELECT p_partkey, 'B' || CASE WHEN len(CAST(p_partkey AS VARCHAR)) > 3 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 3, '0') END AS b FROM part")
def bates_format(spark, sf):
    return C.read(spark, sf, "part").select("p_partkey", bates(F.lit("B"), F.col("p_partkey"), F.lit(3)).alias("b"))


@query("v8_set_members", C.with_sql(C.DOCS_SQL, C.TAGS_SQL) + """, w AS (SELECT doc_id FROM docs WHERE doc_id IN (5, 10, 20, 25) UNION SELECT doc_id FROM tags WHERE tag_id = 3),
  a AS (SELECT doc_id FROM w UNION SELECT d.doc_id FROM docs d WHERE family_id IN (SELECT family_id FROM docs JOIN w USING (doc_id))),
  c AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256 ORDER BY bates_begin) AS r FROM docs) WHERE r > 1)
  SELECT doc_id FROM a JOIN docs USING (doc_id) WHERE (doc_id IN (5, 10, 20, 25) OR (source_type IS DISTINCT FROM 'received' AND doc_id NOT IN (SELECT doc_id FROM c))) AND doc_id % 11 <> 3""")
def set_members(spark, sf):
    d = C.documents(spark, sf)
    return O.set_members(d, d.filter(F.col("doc_id").isin(5, 10, 20, 25)), C.document_tags(spark, sf).filter("tag_id = 3"), d.select("doc_id", F.col("sha256").alias("group_id")), d.filter("doc_id % 11 = 3"))


@query("v9_lock", ORDERED + "SELECT doc_id, sort_order, printf('PRE%06d', CAST(last - pages + 100 AS BIGINT)) AS begin, printf('PRE%06d', CAST(last + 99 AS BIGINT)) AS \"end\" FROM z")
def lock(spark, sf):
    return O.numbered(O.ordered(_set(spark, sf)), "PRE", 6, 100).select("doc_id", "sort_order", "begin", "end")


@query("v10_redaction_rectangles", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 1 OR l_linenumber > 5 THEN 'page_num must be between 1 and 5' WHEN l_quantity * 2.2 > 100 THEN 'x_pct must be between 0 and 100' WHEN l_tax <= 0 THEN 'w_pct and h_pct must be greater than 0'
  WHEN l_quantity * 2.2 + l_discount * 100 > 100 THEN 'x_pct + w_pct must not exceed 100' WHEN l_suppkey % 99 + l_tax * 300 > 100 THEN 'y_pct + h_pct must not exceed 100' END AS error FROM lineitem""")
def rectangles(spark, sf):
    e = O.rectangle_error(F.col("l_linenumber"), F.col("l_quantity") * 2.2, F.col("l_suppkey") % 99, F.when(F.col("l_tax") > 0, F.col("l_discount") * 100 + 0.0).otherwise(0.0), F.col("l_tax") * 300, F.lit(5))
    tax = F.when(F.col("l_tax") > 0, F.lit(True))
    li = C.read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.when(tax & (F.col("l_discount") == 0), O.rectangle_error(F.col("l_linenumber"), F.col("l_quantity") * 2.2, F.col("l_suppkey") % 99, F.lit(1e-12), F.col("l_tax") * 300, F.lit(5))).otherwise(e).alias("error"))


@query("v12_page_bates", ORDERED + "SELECT doc_id, p AS page, printf('PRE%06d', CAST(last - pages + p + 99 AS BIGINT)) AS bates FROM (SELECT *, unnest(range(1, pages + 1)) AS p FROM z)")
def page_bates(spark, sf):
    z = O.numbered(O.ordered(_set(spark, sf)), "PRE", 6, 100).withColumn("page", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pages"))))
    first = F.substring("begin", 4, 20).cast("bigint")
    return z.select("doc_id", "page", bates(F.lit("PRE"), first + F.col("page") - 1, F.lit(6)).alias("bates"))


DAT_SQL = """SELECT printf('PRE%06d', CAST(last - pages + 100 AS BIGINT)) AS "BEGBATES", printf('PRE%06d', CAST(min(last - pages + 100) OVER f AS BIGINT)) AS "BEGATTACH", printf('PRE%06d', CAST(max(last + 99) OVER f AS BIGINT)) AS "ENDATTACH",
  CASE WHEN disposition = 'withhold' THEN '' ELSE coalesce(native_path, '') END AS "FILENAME", CASE WHEN disposition = 'redact_in_part' THEN 'Y' ELSE 'N' END AS "REDACTED", CASE WHEN disposition = 'withhold' THEN 'Y' ELSE 'N' END AS "WITHHELD",
  CASE WHEN coalesce(disposition, 'produce') = 'produce' AND len(text) > 0 THEN '.\\TEXT\\PRE' || printf('%06d', CAST(last - pages + 100 AS BIGINT)) || '.txt' ELSE '' END AS "TEXTPATH", pages AS "PAGECOUNT"
  FROM z WINDOW f AS (PARTITION BY production_id, CASE WHEN family_id IS NULL THEN 's' || bates_begin ELSE 'f' || family_id END)""".replace("\\\\", "\\")


@query("v13_dat_rows", ORDERED + DAT_SQL)
def dat_rows(spark, sf):
    z = O.numbered(O.ordered(_set(spark, sf)), "PRE", 6, 100)
    f = Window.partitionBy("set_id", F.coalesce(F.concat(F.lit("f"), F.col("family_id").cast("string")), F.concat(F.lit("s"), "control")))
    withheld = F.coalesce(F.col("disposition") == "withhold", F.lit(False))
    yes = lambda c: F.when(c, "Y").otherwise("N")
    text = (F.coalesce("disposition", F.lit("produce")) == "produce") & F.col("has_text")
    return z.select(
        F.col("begin").alias("BEGBATES"), F.min_by("begin", "sort_order").over(f).alias("BEGATTACH"), F.max_by("end", "sort_order").over(f).alias("ENDATTACH"), F.when(withheld, "").otherwise(F.coalesce("native_path", F.lit(""))).alias("FILENAME"),
        yes(F.col("disposition") == "redact_in_part").alias("REDACTED"), yes(withheld).alias("WITHHELD"), F.when(text, F.concat(F.lit(".\\TEXT\\"), "begin", F.lit(".txt"))).otherwise("").alias("TEXTPATH"), F.col("pages").alias("PAGECOUNT"),
    )


@query("v14_manifest", ORDERED + "SELECT production_id AS set_id, count(*) AS documents, sum(pages) AS pages, count(*) FILTER (disposition = 'withhold') AS withhold, count(*) FILTER (disposition = 'redact_in_part') AS redact_in_part, printf('PRE%06d', CAST(min(last - pages + 100) AS BIGINT)) AS first, printf('PRE%06d', CAST(max(last + 99) AS BIGINT)) AS last, 0 AS gaps FROM z GROUP BY production_id")
def manifest(spark, sf):
    z = O.numbered(O.ordered(_set(spark, sf)), "PRE", 6, 100)
    n = lambda c: F.substring(c, 4, 20).cast("bigint")
    before = z.select("set_id", (F.col("sort_order") + 1).alias("sort_order"), n("end").alias("before"))
    z = z.join(before, ["set_id", "sort_order"], "left").withColumn("gap", F.coalesce(n("begin") - F.col("before") != 1, F.lit(False)))
    return z.groupBy("set_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.count_if(F.col("disposition") == "withhold").alias("withhold"), F.count_if(F.col("disposition") == "redact_in_part").alias("redact_in_part"), F.min_by("begin", "sort_order").alias("first"), F.max_by("end", "sort_order").alias("last"), F.count_if("gap").alias("gaps"))


@query("w5_hash_primary", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, min(bates_begin) OVER (PARTITION BY sha256) AS primary_control FROM docs")
def hash_primary(spark, sf):
    return C.documents(spark, sf).select("doc_id", F.min("bates_begin").over(Window.partitionBy("sha256")).alias("primary_control"))


@query("w6_running_pages", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, coalesce(sum(page_count) OVER (PARTITION BY production_id ORDER BY bates_begin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first_page FROM docs")
def running_pages(spark, sf):
    d = running(C.documents(spark, sf).select("doc_id", "production_id", "bates_begin", "page_count"), ["production_id"], ["bates_begin"], "upto", F.col("page_count"))
    return d.select("doc_id", (F.col("upto") - F.col("page_count") + 1).alias("first_page"))


@query("w7_family_range", C.with_sql(C.DOCS_SQL) + "SELECT family_id, arg_min(bates_begin, doc_id) AS first, arg_max(bates_begin, doc_id) AS last FROM docs WHERE family_id IS NOT NULL GROUP BY family_id")
def family_range(spark, sf):
    return C.documents(spark, sf).filter("family_id IS NOT NULL").groupBy("family_id").agg(F.min_by("bates_begin", "doc_id").alias("first"), F.max_by("bates_begin", "doc_id").alias("last"))


@query("w9_break_groups", "SELECT o_custkey, o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS grp FROM orders")
def break_groups(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return C.read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).over(w).alias("grp"))


@query("w11_previous_next", "SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def previous_next(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return C.read(spark, sf, "events").select("event_id", F.lag("event_id").over(w).alias("previous"), F.lead("event_id").over(w).alias("next"))


@query("w12_first_header", "SELECT l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS first_order FROM lineitem GROUP BY l_partkey")
def first_header(spark, sf):
    return C.read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first_order"))
