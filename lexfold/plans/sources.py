"""Load files, normalisation and other source and sink queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexfold.functions import normalize as N
from lexfold.operators import rollover as R
from lexfold.plans.registry import query
from lexfold.sources import corpus as C
from lexfold.sources import families as FA
from lexfold.sources import files as X
from lexfold.storage import written


def _rows(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


@query("s1_encoding", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'utf-8-sig' WHEN 1 THEN 'utf-16' WHEN 2 THEN 'utf-16' WHEN 3 THEN 'utf-8' ELSE CASE WHEN len(text) = strlen(text) THEN 'utf-8' ELSE 'cp1252' END END AS encoding FROM documents""")
def encoding(spark, sf):
    mark = lambda b, name: F.concat(F.lit(b).cast("binary"), F.encode("text", name))
    raw = F.when(F.col("doc_id") % 5 == 0, mark(bytearray(b"\xef\xbb\xbf"), "UTF-8")).when(F.col("doc_id") % 5 == 1, mark(bytearray(b"\xff\xfe"), "UTF-16LE")).when(F.col("doc_id") % 5 == 2, mark(bytearray(b"\xfe\xff"), "UTF-16BE"))
    raw = raw.when(F.col("doc_id") % 5 == 3, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return C.read(spark, sf, "documents").select("doc_id", raw.alias("raw")).select("doc_id", X.encoding_of(F.col("raw")).alias("encoding"))


@query("s2_delimiter", """SELECT doc_id, CASE WHEN contains(l, chr(20)) THEN chr(20) WHEN t >= c AND t >= p AND t > 0 THEN chr(9) WHEN c >= p AND c > 0 THEN ',' WHEN p > 0 THEN '|' ELSE ',' END AS delimiter FROM (
  SELECT doc_id, l, len(l) - len(replace(l, chr(9), '')) AS t, len(l) - len(replace(l, ',', '')) AS c, len(l) - len(replace(l, '|', '')) AS p FROM (SELECT doc_id, split_part(text, chr(10), 1) AS l FROM documents))""")
def delimiter(spark, sf):
    return C.read(spark, sf, "documents").select("doc_id", N.delimiter_of(F.split_part("text", F.lit("\n"), F.lit(1))).alias("delimiter"))


@query("s3_split", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN [c_name, c_mktsegment, ''] WHEN 1 THEN [c_name || ', Inc', 'so-called "' || c_mktsegment || '"', ''] ELSE [c_name, c_mktsegment] END AS fields FROM customer""")
def split(spark, sf):
    c = C.read(spark, sf, "customer")
    thorn = F.concat(F.lit("þ"), "c_name", F.lit("þ\x14þ "), "c_mktsegment", F.lit(" þ\x14þþ"))
    comma = F.concat(F.lit('"'), "c_name", F.lit(', Inc","so-called ""'), "c_mktsegment", F.lit('""",'))
    pipe = F.concat("c_name", F.lit(" | "), "c_mktsegment")
    of = F.when(F.col("c_custkey") % 3 == 0, N.thorn_fields(thorn)).when(F.col("c_custkey") % 3 == 1, N.csv_fields(comma, ",")).otherwise(N.csv_fields(pipe, "|"))
    return c.select("c_custkey", of.alias("fields"))


@query("s4_load_file", """SELECT n_name AS "NAME", CAST(n_regionkey AS VARCHAR) AS "REGION", CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'note ' || n_nationkey END AS "NOTE" FROM nation""")
def load_file(spark, sf):
    """A DAT load file is written from a table, with some rows cut short, and parsed back."""
    n = C.read(spark, sf, "nation")
    rows = n.select(F.concat(F.lit("þ"), "n_name", F.lit("þ\x14þ"), F.col("n_regionkey").cast("string"), F.lit("þ"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("\x14þnote "), F.col("n_nationkey").cast("string"), F.lit("þ"))).otherwise("")).alias("value"))
    path = X.write_text(_rows(spark, "value string", ("þNAMEþ\x14þREGIONþ\x14þNOTEþ",)).union(rows), ordered=True)
    return X.read_load_file(spark, path)


@query("s5_dat_paths", "SELECT 'VOL/' || c_nationkey || '/' || c_custkey || '.pdf' AS \"PATH\", c_name AS \"BEG\" FROM customer")
def dat_paths(spark, sf):
    rows = C.read(spark, sf, "customer").select(F.concat(F.lit("þ"), "c_name", F.lit("þ\x14þVOL\\"), F.col("c_nationkey").cast("string"), F.lit("\\"), F.col("c_custkey").cast("string"), F.lit(".pdfþ")).alias("value"))
    path = X.write_text(_rows(spark, "value string", ("þBEGþ\x14þPATHþ",)).union(rows), ordered=True)
    return X.read_load_file(spark, path, slashes=True)


@query("s6_opticon", "SELECT l_orderkey AS bates, list('img/' || l_linenumber || '.tif' ORDER BY l_linenumber) AS pages FROM lineitem GROUP BY l_orderkey")
def opticon(spark, sf):
    li = C.read(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    line = F.format_string("%d,VOL1,img\\%d.tif,%s,,,", "l_orderkey", "l_linenumber", F.when(F.row_number().over(w) == 1, "Y").otherwise(""))
    rows = li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_no"), line.alias("value"))
    return X.parse_opticon(rows).select(F.col("bates").cast("bigint").alias("bates"), "pages")


DAT_SQL = "'þ' || c_custkey || 'þ' || chr(20) || 'þ' || c_name || 'þ' || chr(20) || 'þ' || c_mktsegment || 'þ'"


@query("s7_dat_writer", f"SELECT c_custkey AS id, {DAT_SQL} AS line FROM customer")
def dat_writer(spark, sf):
    c = C.read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), X.dat_line([F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")]).alias("line"))


@query("s8_opt_writer", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, p, bates_begin || '.' || lpad(CAST(p AS VARCHAR), 4, '0') || ',VOL001,IMAGES/' || doc_id || '_' || p || '.tif,' || CASE WHEN p = 1 THEN 'Y,,,' || page_count ELSE ',,,' END AS line FROM (SELECT *, unnest(range(1, page_count + 1)) AS p FROM docs)")
def opt_writer(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "bates_begin", "page_count", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("p"))
    return d.select("doc_id", F.col("p").cast("bigint").alias("p"), F.concat(F.format_string("%s.%04d,VOL001,IMAGES/%d_%d.tif,", "bates_begin", "p", "doc_id", "p"), F.when(F.col("p") == 1, F.concat(F.lit("Y,,,"), F.col("page_count").cast("string"))).otherwise(",,,")).alias("line"))


@query("s9_csv_sink", C.with_sql(C.DOCS_SQL, C.TAGS_SQL) + "SELECT bates_begin, custodian, coalesce(string_agg(category || ':' || tag, '; ' ORDER BY category, tag), '') AS tags FROM docs LEFT JOIN tags USING (doc_id) GROUP BY bates_begin, custodian")
def csv_sink(spark, sf):
    """Documents with their tags, through a CSV file and back."""
    t = C.document_tags(spark, sf).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "category", "tag"))), "; ").alias("tags"))
    rows = C.documents(spark, sf).join(t, "doc_id", "left").select("bates_begin", "custodian", F.coalesce("tags", F.lit("")).alias("tags"))
    path = X.fresh("csv", spark)
    rows.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(rows.schema).csv(path).fillna("")


@query("s10_extract_router", "SELECT page_id, 'ok' AS status FROM pages UNION ALL SELECT -1, 'unsupported' UNION ALL SELECT -2, 'error'")
def extract_router(spark, sf):
    p = C.read(spark, sf, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("raw"))
    odd = _rows(spark, "page_id bigint, name string, raw binary", (-1, "x.bin", b"\x00"), (-2, "x.docx", b"not a zip"))
    return X.extract(p.unionByName(odd), "name", "raw").select("page_id", "status")


@query("s11_office_text")
def office(spark, sf):
    """Text of small office files of each kind."""
    return X.extract(_rows(spark, "name string, raw binary", *X.sample_office_files()), "name", "raw").select("name", "status", "text")


STRIP_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gsi'), '<[^>]+>', ' ', 'gs'), '\s+', ' ', 'g'))"


@query("s12_strip_html", f"SELECT page_id, {STRIP_SQL} AS text FROM pages")
def strip_html(spark, sf):
    return C.read(spark, sf, "pages").select("page_id", N.strip_html(F.col("html")).alias("text"))


@query("s13_parse_mail")
def parse_mail(spark, sf):
    """Messages built from the conversations, parsed back: headers, body and attachments, one row each."""
    return X.parse_messages(X.sample_messages(C.messages(spark, sf)), "raw")


@query("s14_containers")
def containers(spark, sf):
    return X.expand_mailbox(_rows(spark, "name string, raw binary", ("a.mbox", X.sample_mbox()), ("b.eml", b"Subject: one\r\n\r\nbody"), ("c.pst", b"?")), "name", "raw")


@query("s14_container_families", """WITH m AS (SELECT 'M' || (conv_id * 100 + turn) AS c, (conv_id * 100 + turn) % 4 AS way FROM conversations),
  f AS (SELECT c, c AS control, CASE WHEN way = 3 THEN 'zip' ELSE 'email' END AS file_type, CASE WHEN way = 3 THEN 'partial' ELSE 'ok' END AS status FROM m
    UNION ALL SELECT c, c || ' .0001', CASE way WHEN 1 THEN 'txt' WHEN 2 THEN 'zip' ELSE 'email' END, CASE WHEN way = 2 THEN 'partial' ELSE 'ok' END FROM m WHERE way > 0
    UNION ALL SELECT c, c || ' .0001 .0001', CASE WHEN way = 2 THEN 'email' ELSE 'txt' END, 'ok' FROM m WHERE way > 1
    UNION ALL SELECT c, c || CASE WHEN way = 2 THEN ' .0001 .0002' ELSE ' .0002' END, 'txt', 'ok' FROM m WHERE way > 1
    UNION ALL SELECT c, c || ' .0001 .0001 .0001', 'txt', 'ok' FROM m WHERE way = 2)
  SELECT control, c AS family_id, file_type, status FROM f""")
def container_families(spark, sf):
    """Mail and archives in one another, made of the messages, become families of numbered documents."""
    made = written(FA.packed(C.messages(spark, sf)), "containers")  # built once
    return FA.expand(made).select("control", "family_id", "file_type", "status")


@query("s15_zip")
def unzip(spark, sf):
    return X.expand_zip(_rows(spark, "name string, raw binary", ("a.zip", X.sample_zip()), ("broken.zip", b"PK")), "name", "raw")


@query("s16_families", "SELECT o_orderkey AS parent, CAST(o_orderkey AS VARCHAR) AS control, 0 AS position, o_orderkey AS family_id FROM orders UNION ALL SELECT l_orderkey, l_orderkey || '.' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0'), l_linenumber, l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def families(spark, sf):
    """Parents and their numbered attachments share a family."""
    o = C.read(spark, sf, "orders").select(F.col("o_orderkey").alias("parent"))
    li = C.read(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("parent")).select("parent", F.format_string("%d.%04d", "l_orderkey", "l_linenumber").alias("control"), F.col("l_linenumber").cast("int").alias("position"))
    return o.select("parent", F.col("parent").cast("string").alias("control"), F.lit(0).alias("position")).union(li).withColumn("family_id", F.col("parent"))


@query("s17_pdf_text_rule", r"SELECT doc_id, page, CASE WHEN len(regexp_replace(substr(text, page * 2000 + 1, 2000), '\s', '', 'g')) >= 10 THEN 'embedded' ELSE 'ocr' END AS way FROM (SELECT doc_id, text, unnest(range(0, 1 + len(text) // 2000)) AS page FROM documents)")
def pdf_rule(spark, sf):
    """A page with at least ten characters of its own needs no OCR; pages are of 2,000 characters."""
    d = C.read(spark, sf, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor(F.char_length("text") / 2000).cast("int"))).alias("page"))
    own = F.length(F.regexp_replace(F.substring("text", F.col("page") * 2000 + 1, F.lit(2000)), r"\s", ""))
    return d.select("doc_id", F.col("page").cast("bigint").alias("page"), F.when(own >= 10, "embedded").otherwise("ocr").alias("way"))


@query("s18_word_boxes", """SELECT l_orderkey, l_linenumber, x0, round_even(least(100.0, greatest(0.0, (l_suppkey + l_quantity) / 10.0)), 2) - x0 AS width FROM (SELECT *, round_even(least(100.0, greatest(0.0, l_suppkey / 10.0)), 2) AS x0 FROM lineitem)""")
def word_boxes(spark, sf):
    """Boxes in percent of a page of 1000 units: both ends clamped and rounded first, then the width."""
    pct = lambda c: F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), c / 10.0)), 2)
    x0, x1 = pct(F.col("l_suppkey")), pct(F.col("l_suppkey") + F.col("l_quantity"))
    return C.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x0.alias("x0"), (x1 - x0).alias("width"))


VOLUMES_SQL = """WITH RECURSIVE d AS (SELECT doc_id % 3 AS production_id, printf('DOC%06d', doc_id) AS bates_begin, n_chars AS bytes, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY printf('DOC%06d', doc_id)) AS r FROM documents),
  v AS (SELECT production_id, bates_begin, bytes, r, 1 AS volume, bytes AS used FROM d WHERE r = 1
    UNION ALL SELECT d.production_id, d.bates_begin, d.bytes, d.r, CASE WHEN v.used > 0 AND v.used + d.bytes > 20000 THEN v.volume + 1 ELSE v.volume END, CASE WHEN v.used > 0 AND v.used + d.bytes > 20000 THEN d.bytes ELSE v.used + d.bytes END
    FROM v JOIN d ON d.production_id = v.production_id AND d.r = v.r + 1) """


def _volumes(spark, sf):
    d = C.documents(spark, sf).select("production_id", "bates_begin", F.col("n_chars").alias("bytes"))
    return R.volumes(d, "production_id", "bates_begin", "bytes", 20_000)


@query("s19_volumes", VOLUMES_SQL + "SELECT production_id, bates_begin, bytes, volume FROM v")
def volumes(spark, sf):
    """Documents of a production set dealt to volumes of a size cap, in order."""
    return _volumes(spark, sf)


@query("s19_volume_manifest", VOLUMES_SQL + "SELECT production_id, printf('VOL%03d', volume) AS label, count(*) AS documents, CAST(sum(bytes) AS BIGINT) AS bytes FROM v GROUP BY production_id, volume")
def volume_manifest(spark, sf):
    """What each volume holds."""
    return R.manifest(_volumes(spark, sf), "production_id", "bytes")


@query("s20_object_store")
def object_store(spark, sf):
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{sf}/nation.parquet").select(F.substring_index("path", "/", -1).alias("name"), "length")


@query("s21_embeddings", "SELECT vec_id, len(embedding) AS width, round(sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])), 5) AS norm FROM embeddings")
def embeddings(spark, sf):
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return C.read(spark, sf, "embeddings").select("vec_id", F.size("embedding").cast("bigint").alias("width"), F.round(F.sqrt(sq), 5).alias("norm"))


LOADS_SQL = """l AS (SELECT c_custkey AS load, unnest([0, 1, 2, 3, 4]) AS no, unnest([['BEGDOC', 'Bates-Begin', 'begin bates'][c_custkey % 3 + 1], CASE WHEN c_custkey % 2 = 0 THEN 'END BATES' ELSE 'EndBates ' END,
  ['cust', 'Custodian  Name', 'Mystery'][c_custkey % 3 + 1], 'custodian', c_mktsegment]) AS header, c_custkey % 3 AS way FROM customer),
f AS (SELECT load, no, header, CASE no WHEN 0 THEN 'bates_begin' WHEN 1 THEN 'bates_end' WHEN 2 THEN CASE WHEN way < 2 THEN 'custodian' END WHEN 3 THEN CASE WHEN way = 2 THEN 'custodian' END END AS field FROM l)"""


def _headers(spark, sf):
    """The headers of a load file for each customer: spellings of known fields, one of them twice, and unknown ones."""
    c = C.read(spark, sf, "customer")
    of = lambda *names: F.get(F.array(*map(F.lit, names)), (F.col("c_custkey") % 3).cast("int"))
    names = F.array(of("BEGDOC", "Bates-Begin", "begin bates"), F.when(F.col("c_custkey") % 2 == 0, "END BATES").otherwise("EndBates "), of("cust", "Custodian  Name", "Mystery"), F.lit("custodian"), F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("load"), F.posexplode(names).alias("no", "header"))


@query("n1_header_aliases", "WITH " + LOADS_SQL + " SELECT load, field, header FROM f WHERE field IS NOT NULL")
def header_aliases(spark, sf):
    return X.match_headers(_headers(spark, sf)).filter("field IS NOT NULL").select("load", "field", "header")


@query("n2_proposed_mapping", "WITH " + LOADS_SQL + " SELECT load, no, coalesce(field, CASE WHEN header = 'Mystery' THEN 'source_path' END) AS field, CASE WHEN field IS NOT NULL THEN 1.0 WHEN header = 'Mystery' THEN 0.6 ELSE 0.0 END AS confidence FROM f")
def proposed_mapping(spark, sf):
    """Aliases count 1.0, a suggester (here a stand-in for a model) 0.6, the rest 0.0."""
    suggested = F.when(F.col("header") == "Mystery", "source_path")
    m = X.match_headers(_headers(spark, sf))
    return m.select("load", "no", F.coalesce("field", suggested).alias("field"), F.when(F.col("field").isNotNull(), 1.0).when(suggested.isNotNull(), 0.6).otherwise(0.0).alias("confidence"))


@query("n3_normalize_bool", "SELECT o_orderkey, CASE WHEN v IN ('yes','y','true','t','1') THEN true WHEN v IN ('no','n','false','f','0') THEN false END AS value FROM (SELECT o_orderkey, trim(lower(['YES ',' n','True','f','1','0','maybe',''][CAST(o_orderkey % 8 AS INT) + 1])) AS v FROM orders)")
def bools(spark, sf):
    w = F.element_at(F.array(*map(F.lit, ("YES ", " n", "True", "f", "1", "0", "maybe", ""))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return C.read(spark, sf, "orders").select("o_orderkey", N.bool_of(w).alias("value"))


@query("n4_normalize_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 18 IN (10, 11) THEN NULL ELSE CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + [s, s, s, 0, s, s // 60 * 60, s, s // 60 * 60, 0, s - 7200, 0, 0, s, s, s - 7200, s + 18000, s // 60 * 60, s][o_orderkey % 18 + 1] END AS utc_s FROM (SELECT *, o_orderkey * 7919 % 86400 AS s FROM orders)""")
def dates(spark, sf):
    """Every format, with days that are none and words beside them."""
    at = F.timestamp_seconds(F.unix_timestamp(F.date_trunc("day", "o_orderdate")) + F.col("o_orderkey") * 7919 % 86400)
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy h:mm:ss a", "MM/dd/yyyy h:mm a", "M/d/yyyy HH:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "EEE, dd MMM yyyy HH:mm:ss' +0200'", "yyyy-'02-30'", "'soon'", "EEE, dd MMM yyyy HH:mm:ss' GMT'", "EEE, d MMM yyyy HH:mm:ss' +0000 (UTC)'", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "d MMM yy HH:mm:ss' EST'", "EEE d MMM yyyy HH:mm' -0000'", "dd-MMM-yyyy HH:mm:ss"]
    v = F.coalesce(*(F.when(F.col("o_orderkey") % 18 == k, F.date_format("at", f)) for k, f in enumerate(forms)))  # one form a row
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: reading a date takes longer than its bytes tell
    o = C.read(spark, sf, "orders").select("o_orderkey", at.alias("at")).repartition(tasks, "o_orderkey").select("o_orderkey", v.alias("v"))
    return o.select("o_orderkey", F.unix_timestamp(N.utc_of(F.col("v"))).alias("utc_s"))


@query("n5_file_type", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, lower(nullif(regexp_extract(native_path, '\\.([^./]*)$', 1), '')) AS file_type FROM docs UNION ALL SELECT * FROM (VALUES (-1, NULL), (-2, 'gz'), (-3, NULL)) v(a, b)")
def file_types(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "native_path").union(_rows(spark, "a bigint, b string", (-1, "x/.bashrc"), (-2, "a.tar.GZ"), (-3, "a.b/none")))
    return d.select("doc_id", N.file_type_of(F.col("native_path")).alias("file_type"))


@query("n6_promote", "SELECT o_orderkey, 'src' || o_custkey AS custodian, CAST(epoch(o_orderdate) AS BIGINT) AS sent_s, len(CASE WHEN o_orderkey % 2 = 0 THEN ['Cust','Sent Date','Odd'] ELSE ['Cust','Sent Date'] END) AS leftover FROM orders")
def promote(spark, sf):
    """Typed fields from a record's map of strings; what is left are the non-empty columns that are not structural."""
    o = C.read(spark, sf, "orders")
    record = F.create_map(F.lit("BEGDOC"), F.col("o_orderkey").cast("string"), F.lit("Cust"), F.concat(F.lit("src"), F.col("o_custkey").cast("string")), F.lit("Sent Date"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("Odd"), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise(" "))
    left = F.map_filter("r", lambda k, v: ~k.isin("BEGDOC") & (F.btrim(v) != ""))
    return o.select("o_orderkey", record.alias("r")).select("o_orderkey", F.element_at("r", "Cust").alias("custodian"), F.unix_timestamp(N.utc_of(F.element_at("r", "Sent Date"))).alias("sent_s"), F.size(left).cast("bigint").alias("leftover"))


@query("n7_control_offset", C.with_sql(C.DOCS_SQL) + "SELECT max(CAST(regexp_extract(bates_begin, '^DOC(\\d+)$', 1) AS BIGINT)) AS last FROM docs")
def control_offset(spark, sf):
    return C.documents(spark, sf).agg(F.max(F.expr("try_cast(regexp_extract(bates_begin, '^DOC([0-9]+)$', 1) AS bigint)")).alias("last"))


@query("n8_prefix", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(split_part(p_name, ' ', 1)) WHEN 1 THEN 'ACMECORPORAT' ELSE 'DOC' END AS prefix FROM part""")
def prefix(spark, sf):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), "p_name", F.lit(".pdf"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("acme-corporation-ltd "), "p_name")).otherwise("   ")
    return C.read(spark, sf, "part").select("p_partkey", N.bates_prefix(name).alias("prefix"))


@query("n9_stub_title", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, regexp_matches(CASE WHEN doc_id % 3 = 0 THEN bates_begin ELSE 'Note ' || bates_begin END, '^[A-Z]{2,12}[-_ ]?[0-9]{4,}$') AS stub FROM docs")
def stub_title(spark, sf):
    title = F.when(F.col("doc_id") % 3 == 0, F.col("bates_begin")).otherwise(F.concat(F.lit("Note "), "bates_begin"))
    return C.documents(spark, sf).select("doc_id", title.rlike("^[A-Z]{2,12}[-_ ]?[0-9]{4,}$").alias("stub"))


@query("n10_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def hashes(spark, sf):
    return C.documents(spark, sf).select("doc_id", "sha256")


@query("n11_source_stamp", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, coalesce(source_type, 'job default') AS source_type FROM docs")
def source_stamp(spark, sf):
    return C.documents(spark, sf).select("doc_id", F.coalesce("source_type", F.lit("job default")).alias("source_type"))


@query("n12_idempotent_append", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def append(spark, sf):
    return C.read(spark, sf, "documents").select("doc_id").join(C.read(spark, sf, "labels"), "doc_id", "left_anti")


@query("n13_skip_counter", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS skipped FROM lineitem GROUP BY l_returnflag")
def skips(spark, sf):
    return C.read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("skipped"))


@query("n14_word_chunks", r"""SELECT doc_id, k AS chunk_index, CASE WHEN n <= 500 THEN text ELSE array_to_string(w[k * 450 + 1 : k * 450 + 500], ' ') END AS chunk
  FROM (SELECT doc_id, text, w, len(w) AS n, unnest(range(CASE WHEN len(w) <= 500 THEN 1 ELSE CAST(ceil((len(w) - 500) / 450.0) AS INT) + 1 END)) AS k FROM (SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents))""")
def word_chunks(spark, sf):
    return X.word_chunks(C.read(spark, sf, "documents").select("doc_id", "text"))


@query("n15_char_windows", "SELECT doc_id, k AS part, substr(text, CAST(k * 13000 + 1 AS BIGINT), 14000) AS piece FROM (SELECT doc_id, text, unnest(range(CASE WHEN len(text) <= 14000 THEN 1 ELSE CAST(ceil((len(text) - 14000) / 13000.0) AS INT) + 1 END)) AS k FROM documents)")
def char_windows(spark, sf):
    return X.char_windows(C.read(spark, sf, "documents").select("doc_id", "text"), 14_000, 1_000)


@query("n16_bulk_designation", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, CASE WHEN source_type IS NULL AND production_id = 1 THEN 'collection' ELSE source_type END AS source_type FROM docs")
def designation(spark, sf):
    return C.documents(spark, sf).select("doc_id", F.when(F.col("source_type").isNull() & (F.col("production_id") == 1), "collection").otherwise(F.col("source_type")).alias("source_type"))
