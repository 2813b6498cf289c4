"""Search, filter and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexfold.functions import normalize as N
from lexfold.operators import search as S
from lexfold.operators.ranks import running
from lexfold.plans.registry import query
from lexfold.sources import corpus as C
from lexfold.storage import written

TERMS = ["the", "que", '"of the"', "th* AND NOT in", "der OR les", "password", "the"]
WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_-]+')"
TOKENS_SQL = f"toks AS (SELECT doc_id, family_id, {WORDS_SQL} AS w FROM docs)"
HIT_SQL = """hits AS (SELECT 'the' AS term, doc_id, family_id FROM toks WHERE list_contains(w, 'the')
    UNION ALL SELECT 'que', doc_id, family_id FROM toks WHERE list_contains(w, 'que')
    UNION ALL SELECT '"of the"', doc_id, family_id FROM toks WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')
    UNION ALL SELECT 'th* AND NOT in', doc_id, family_id FROM toks WHERE len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0 AND NOT list_contains(w, 'in')
    UNION ALL SELECT 'der OR les', doc_id, family_id FROM toks WHERE list_contains(w, 'der') OR list_contains(w, 'les')
    UNION ALL SELECT 'password', doc_id, family_id FROM toks WHERE list_contains(w, 'password'))"""


@query(
    "r1_term_report",
    C.with_sql(C.DOCS_SQL, TOKENS_SQL, HIT_SQL)
    + """, terms(term_no, term) AS (VALUES (0,'the'),(1,'que'),(2,'"of the"'),(3,'th* AND NOT in'),(4,'der OR les'),(5,'password'),(6,'the')),
  n AS (SELECT doc_id, count(*) AS k FROM hits GROUP BY doc_id),
  ex AS (SELECT DISTINCT term, d.doc_id FROM hits h JOIN docs d ON d.doc_id = h.doc_id OR d.family_id = h.family_id)
SELECT term_no, t.term, (SELECT count(*) FROM hits h WHERE h.term = t.term) AS hits, (SELECT count(*) FROM ex WHERE ex.term = t.term) AS with_families,
  (SELECT count(*) FROM hits h JOIN n USING (doc_id) WHERE h.term = t.term AND k = 1) AS unique_hits,
  (SELECT count(*) FROM docs) AS total_docs, (SELECT count(*) FROM n) AS any_hits, (SELECT count(DISTINCT doc_id) FROM ex) AS any_with_families FROM terms t""",
)
def term_report(spark: SparkSession, sf: str) -> DataFrame:
    return S.term_report(C.documents(spark, sf).select("doc_id", "family_id", "text"), TERMS)


def many_terms(spark: SparkSession, sf: str) -> list[str]:
    """Two hundred search terms: frequent words of the benchmark passages, alone and combined."""
    words = C.read(spark, sf, "benchmark").select(F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("w")).filter("length(w) > 2")
    top = [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(100).collect()]
    return [*top, *(f"{a} AND {b}*" for a, b in zip(top, top[1:])), *(f'"{a} {b}" OR NOT {a}' for a, b in zip(top[::2], top[1::2]))][:200]


@query("r1_many_terms")
def many_term_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report on two hundred terms, found in one pass over each text."""
    return S.term_report(C.documents(spark, sf).select("doc_id", "family_id", "text"), many_terms(spark, sf))


@query(
    "q1_query_compiler",
    """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN w[1] || ' & ' || w[2] WHEN 1 THEN w[1] || ' | ' || w[2] WHEN 2 THEN '(' || w[1] || ' <-> ' || w[2] || ')' WHEN 3 THEN '!' || w[1] WHEN 4 THEN w[1] || ':*' WHEN 5 THEN w[1] WHEN 6 THEN w[1] || ' & (' || w[2] || ' <-> x) & !d:*' ELSE '' END AS compiled
  FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""",
)
def compiler(spark: SparkSession, sf: str) -> DataFrame:
    """Search strings of two words of each part: bare, OR, phrase, NOT, prefix, dangling and stray operators."""
    w = F.split("p_name", " ")
    a, b = F.upper(w[0]), w[1]
    asked = F.array(F.concat_ws(" ", a, b), F.concat_ws(" OR ", a, b), F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('"')), F.concat(F.lit("NOT "), a), F.concat(a, F.lit("*")), F.concat(F.lit("AND OR ("), a, F.lit(") AND")), F.concat(a, F.lit(' AND "'), b, F.lit(' x" NOT D*')), F.lit("- -- OR"))
    compiled = F.udf(lambda q: S.compiled(q), "string")  # one short string at a time: what a user typed
    return C.read(spark, sf, "part").select("p_partkey", compiled(F.get(asked, (F.col("p_partkey") % 8).cast("int"))).alias("compiled"))


@query("q2_full_text_match", C.with_sql(C.DOCS_SQL, TOKENS_SQL) + "SELECT doc_id FROM toks WHERE (list_contains(w, 'of') AND list_contains(w, 'the')) OR len(list_filter(w, lambda x: starts_with(x, 'cio'))) > 0")
def match(spark, sf):
    d = C.documents(spark, sf).select("doc_id", S.tokens(F.col("text")).alias("w"))
    return d.filter(S.matches(F.col("w"), "of the OR cio*")).select("doc_id")


@query(
    "q3_ranked_results",
    C.with_sql(C.DOCS_SQL, TOKENS_SQL)
    + """SELECT doc_id, round(len(list_filter(w, lambda x: x = 'the')) / (1.0 + ln(len(w))), 6) AS rank FROM toks WHERE list_contains(w, 'the') ORDER BY rank DESC, doc_id LIMIT 50""",
)
def ranked(spark, sf):
    """Rank: occurrences of the word over 1 + ln(words); ties by document."""
    d = C.documents(spark, sf).select("doc_id", S.tokens(F.col("text")).alias("w")).filter(F.array_contains("w", "the"))
    n = F.size(F.filter("w", lambda x: x == "the"))
    return d.select("doc_id", F.round(n / (1.0 + F.log(F.size("w"))), 6).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(50)


@query(
    "q4_headline",
    C.with_sql(C.DOCS_SQL)
    + r"""SELECT doc_id, array_to_string(list_transform(ws[greatest(1, p - 10) : p + 24], lambda x: CASE WHEN regexp_replace(lower(x), '[^\p{L}\p{N}_-]', '', 'g') = 'the' THEN '<mark>' || x || '</mark>' ELSE x END), ' ') AS headline
  FROM (SELECT doc_id, ws, list_position(list_transform(ws, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}_-]', '', 'g')), 'the') AS p
        FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n]+') AS ws FROM docs)) WHERE p > 0""",
)
def headline(spark, sf):
    """Ten words before the first hit to 24 after it, hits marked."""
    bare = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_-]", "")
    d = C.documents(spark, sf).select("doc_id", F.regexp_extract_all("text", F.lit("[^ \\t\\n]+"), F.lit(0)).alias("ws"))
    d = d.withColumn("p", F.array_position(F.transform("ws", bare), "the").cast("int")).filter("p > 0")
    lo = F.greatest(F.lit(1), F.col("p") - 10)
    part = F.slice("ws", lo, F.col("p") + 24 - lo + 1)
    return d.select("doc_id", F.array_join(F.transform(part, lambda x: F.when(bare(x) == "the", F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(x)), " ").alias("headline"))


@query("q5_no_text_fallback", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, 0.0 AS rank, substr(text, 1, 200) AS snippet FROM docs WHERE lower(native_path) LIKE '%.pdf'")
def fallback(spark, sf):
    d = C.documents(spark, sf)
    return d.filter(S.file_type_filter(F.col("native_path"), "pdf", N.FILE_GROUPS)).select("doc_id", F.lit(0.0).alias("rank"), F.substring("text", 1, 200).alias("snippet"))


@query("q6_empty_query", "SELECT doc_id FROM documents WHERE false")
def empty(spark, sf):
    """No text query and no filter gives nothing."""
    d = C.documents(spark, sf).select("doc_id", S.tokens(F.col("text")).alias("w"))
    return d.filter(S.matches(F.col("w"), "  ")).select("doc_id")


@query("q7_metadata_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.' || json_keys(props)[1]) ILIKE '%1%'")
def metadata(spark, sf):
    e = C.read(spark, sf, "events")
    key = F.element_at(F.json_object_keys("props"), 1)
    value = F.element_at(F.from_json("props", "map<string,string>"), key)
    return e.filter(value.ilike("%1%")).select("event_id")


@query("q8_file_type_filter", C.with_sql(C.DOCS_SQL) + """SELECT 'native' AS kind, count(*) FILTER (native_path IS NOT NULL) AS n FROM docs UNION ALL SELECT 'images_only', count(*) FILTER (native_path IS NULL) FROM docs
  UNION ALL SELECT 'office', count(*) FILTER (lower(native_path) LIKE '%.docx') FROM docs UNION ALL SELECT 'video', count(*) FILTER (lower(native_path) LIKE '%.mp4') FROM docs
  UNION ALL SELECT 'email', count(*) FILTER (lower(native_path) LIKE '%.msg') FROM docs UNION ALL SELECT 'audio', 0 FROM (SELECT 1) UNION ALL SELECT 'no such kind', count(*) FROM docs""")
def file_types(spark, sf):
    d = C.documents(spark, sf)
    kinds = ("native", "images_only", "office", "video", "email", "audio", "no such kind")
    row = d.agg(*(F.count_if(S.file_type_filter(F.col("native_path"), k, N.FILE_GROUPS)).alias(k) for k in kinds))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("n")) for k in kinds))).alias("x")).select("x.*")


@query("q9_source_filter", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, source_type IS DISTINCT FROM 'received' AS ours FROM docs")
def source_filter(spark, sf):
    return C.documents(spark, sf).select("doc_id", (~F.col("source_type").eqNullSafe("received")).alias("ours"))


@query("q10_pagination", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, bates_begin, total FROM (SELECT doc_id, bates_begin, count(*) OVER () AS total FROM docs WHERE lang = 'fr') ORDER BY bates_begin LIMIT 25 OFFSET 25")
def pagination(spark, sf):
    d = C.documents(spark, sf).filter("lang = 'fr'").select("doc_id", "bates_begin")
    return d.orderBy("bates_begin").offset(25).limit(25).join(F.broadcast(d.agg(F.count(F.lit(1)).alias("total"))))


QVEC_SQL = "q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 7)"
SIM_SQL = "near AS (SELECT document_id, chunk_index, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS sim FROM chunks, q ORDER BY sim DESC, document_id, chunk_index LIMIT 50)"


def _query_vector(spark, sf):
    return list(C.read(spark, sf, "embeddings").filter("vec_id = 7").first()["embedding"])


@query("q11_semantic_search", C.with_sql(C.CHUNKS_SQL, QVEC_SQL, SIM_SQL) + "SELECT document_id, chunk_index, round(sim, 4) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY sim DESC, chunk_index) AS r FROM near) WHERE r = 1 ORDER BY sim DESC, document_id LIMIT 10")
def semantic(spark, sf):
    return S.semantic_search(C.chunks(spark, sf), _query_vector(spark, sf), 10)


@query("q12_scoped_semantic_search", C.with_sql(C.CHUNKS_SQL, QVEC_SQL, C.TAGS_SQL) + """SELECT document_id, chunk_index, round(sim, 4) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY sim DESC, chunk_index) AS r FROM (
  SELECT document_id, chunk_index, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS sim FROM chunks, q WHERE document_id IN (SELECT doc_id FROM tags WHERE tag_id = 1) ORDER BY sim DESC, document_id, chunk_index LIMIT 50)) WHERE r = 1 ORDER BY sim DESC, document_id LIMIT 10""")
def scoped_semantic(spark, sf):
    tagged = C.document_tags(spark, sf).filter("tag_id = 1").select(F.col("doc_id").alias("document_id"))
    return S.semantic_search(C.chunks(spark, sf).join(tagged, "document_id", "left_semi"), _query_vector(spark, sf), 10)


@query("q13_grounding", C.with_sql(C.CHUNKS_SQL, QVEC_SQL) + "SELECT document_id, chunk_index, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 4) AS rank FROM chunks, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) DESC, document_id, chunk_index LIMIT 8")
def grounding(spark, sf):
    q = F.array(*(F.lit(float(x)) for x in _query_vector(spark, sf)))
    return C.chunks(spark, sf).select("document_id", "chunk_index", S.cosine(F.col("embedding"), q).alias("sim")).orderBy(F.desc("sim"), "document_id", "chunk_index").limit(8).select("document_id", "chunk_index", F.round("sim", 4).alias("rank"))


@query("q14_mode_switch", C.with_sql(C.DOCS_SQL, TOKENS_SQL, C.CHUNKS_SQL, QVEC_SQL, SIM_SQL) + """, sem AS (SELECT document_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY sim DESC, chunk_index) AS r FROM near) WHERE r = 1 ORDER BY sim DESC, document_id LIMIT 10)
  SELECT 'no filter' AS asked, document_id AS doc_id, 'semantic' AS mode FROM sem UNION ALL SELECT 'no chunks', doc_id, 'full_text' FROM toks WHERE list_contains(w, 'secret') UNION ALL SELECT 'a filter', doc_id, 'full_text' FROM toks WHERE list_contains(w, 'secret') AND doc_id % 2 = 0""")
def mode_switch(spark, sf):
    """Semantic results when no filter is set and there are any, else full text."""
    q, chunks = _query_vector(spark, sf), C.chunks(spark, sf)
    d = C.documents(spark, sf).select("doc_id", S.tokens(F.col("text")).alias("w")).filter(S.matches(F.col("w"), "secret")).select("doc_id")
    near = lambda c: S.semantic_search(c, q, 10).select(F.col("document_id").alias("doc_id"))
    cases = {"no filter": S.by_mode(near(chunks), d), "no chunks": S.by_mode(near(chunks.filter("label < 0")), d), "a filter": S.by_mode(None, d.filter("doc_id % 2 = 0"))}
    first, *others = (df.select(F.lit(name).alias("asked"), "doc_id", "mode") for name, df in cases.items())
    return first.union(others[0]).union(others[1])


@query("q15_document_list", C.with_sql(C.DOCS_SQL, C.TAGS_SQL) + """SELECT doc_id, bates_begin, page_count FROM docs WHERE production_id = 1 AND custodian IN ('src1', 'src2', 'src3') AND lang = 'en' AND page_count >= 1
  AND source_type IS DISTINCT FROM 'received' AND doc_id IN (SELECT doc_id FROM tags WHERE tag_id = 1) ORDER BY page_count DESC, bates_begin LIMIT 100""")
def document_list(spark, sf):
    d = C.documents(spark, sf).filter((F.col("production_id") == 1) & F.col("custodian").isin("src1", "src2", "src3") & (F.col("lang") == "en") & (F.col("page_count") >= 1) & ~F.col("source_type").eqNullSafe("received"))
    return d.join(C.document_tags(spark, sf).filter("tag_id = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "bates_begin", "page_count").orderBy(F.desc("page_count"), "bates_begin").limit(100)


@query("q16_annotated_or_not", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, doc_id IN (SELECT user_id FROM events) AS has_annotations FROM docs")
def annotated(spark, sf):
    d, a = C.documents(spark, sf).select("doc_id"), C.read(spark, sf, "events").select(F.col("user_id").alias("doc_id"))
    return d.join(a, "doc_id", "left_semi").withColumn("has_annotations", F.lit(True)).union(d.join(a, "doc_id", "left_anti").withColumn("has_annotations", F.lit(False)))


@query("q17_recent_sort", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, last_s FROM docs LEFT JOIN (SELECT user_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s FROM events GROUP BY user_id) ON user_id = doc_id ORDER BY last_s DESC NULLS LAST, bates_begin LIMIT 50")
def recent(spark, sf):
    last = C.read(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.unix_timestamp(F.max("ts")).alias("last_s"))
    return C.documents(spark, sf).select("doc_id", "bates_begin").join(last, "doc_id", "left").orderBy(F.desc_nulls_last("last_s"), "bates_begin").limit(50).select("doc_id", "last_s")


@query("q18_ai_decision_filter", C.with_sql(C.DOCS_SQL, C.DECISIONS_SQL) + "SELECT doc_id FROM docs WHERE doc_id IN (SELECT doc_id FROM decisions WHERE ai_decision = 'key_document' AND confidence >= 50)")
def decision_filter(spark, sf):
    return C.documents(spark, sf).join(C.decisions(spark, sf).filter("ai_decision = 'key_document' AND confidence >= 50"), "doc_id", "left_semi").select("doc_id")


@query("q19_random_document")
def random_document(spark, sf):
    """One document, by the smallest hash with a seed, so that a draw can be repeated."""
    return C.documents(spark, sf).select("doc_id", "bates_begin").orderBy(F.xxhash64(F.lit(42), "doc_id"), "doc_id").limit(1)


@query("q20_metadata_keys", "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def metadata_keys(spark, sf):
    return C.read(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("key")).distinct()


@query("q21_source_parties", C.with_sql(C.DOCS_SQL) + "SELECT custodian AS party, count(*) FILTER (source_type IS NULL) AS undesignated FROM docs GROUP BY custodian")
def source_parties(spark, sf):
    return C.documents(spark, sf).groupBy(F.col("custodian").alias("party")).agg(F.count_if(F.col("source_type").isNull()).alias("undesignated"))


BATES_NORM_SQL = "regexp_replace(upper(bates_begin), '[^A-Z0-9]', '', 'g')"


@query("q22_bates_candidates", C.with_sql(C.DOCS_SQL) + f"SELECT doc_id, bates_begin FROM docs WHERE bates_begin = 'doc-000042' OR {BATES_NORM_SQL} = 'DOC000042' OR regexp_matches(bates_begin, '(^|[^0-9])0*42$')")
def bates_candidates(spark, sf):
    norm = F.regexp_replace(F.upper("bates_begin"), "[^A-Z0-9]", "")
    asked = "doc-000042"
    return C.documents(spark, sf).filter((F.col("bates_begin") == asked) | (norm == "DOC000042") | F.col("bates_begin").rlike("(^|[^0-9])0*42$")).select("doc_id", "bates_begin")


@query("q23_bates_resolve", C.with_sql(C.DOCS_SQL) + """, asked(a) AS (VALUES ('DOC000007'), ('doc-000008'), ('PROD000012'), ('NONE1')),
  prod AS (SELECT doc_id, sum(page_count) OVER (ORDER BY bates_begin ROWS UNBOUNDED PRECEDING) AS e, page_count FROM docs ),
  c AS (SELECT a, doc_id, 1 AS p FROM asked, docs WHERE bates_begin = a UNION ALL SELECT a, doc_id, 2 FROM asked, docs WHERE regexp_replace(upper(a), '[^A-Z0-9]', '', 'g') = bates_begin
    UNION ALL SELECT a, doc_id, 3 FROM asked, prod WHERE a LIKE 'PROD%' AND CAST(substr(a, 5) AS BIGINT) BETWEEN e - page_count + 1 AND e)
  SELECT a AS asked, doc_id, p AS how FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p, doc_id) AS r FROM c) WHERE r = 1""")
def bates_resolve(spark, sf):
    """Exact, else without punctuation, else within the range of pages a produced document holds."""
    d = C.documents(spark, sf).select("doc_id", "bates_begin", "page_count")
    asked = spark.createDataFrame([(a,) for a in ("DOC000007", "doc-000008", "PROD000012", "NONE1")], "asked string").withColumn("norm", F.regexp_replace(F.upper("asked"), "[^A-Z0-9]", ""))
    number = F.when(F.col("asked").startswith("PROD"), F.expr("try_cast(substring(asked, 5) AS bigint)"))
    produced = running(d, [], ["bates_begin"], "e", F.col("page_count"))
    asked_ = F.broadcast(asked)
    found = (
        d.join(asked_, F.col("asked") == F.col("bates_begin")).select("asked", "doc_id", F.lit(1).alias("how"))
        .union(d.join(asked_, F.col("norm") == F.col("bates_begin")).select("asked", "doc_id", F.lit(2)))
        .union(produced.join(F.broadcast(asked.withColumn("number", number)), (F.col("number") <= F.col("e")) & (F.col("number") > F.col("e") - F.col("page_count"))).select("asked", "doc_id", F.lit(3)))
    )
    return found.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy("how", "doc_id"))).filter("r = 1").drop("r")


@query("q24_produced_range", C.with_sql(C.DOCS_SQL) + """, prod AS (SELECT production_id, doc_id, sum(page_count) OVER (PARTITION BY production_id ORDER BY bates_begin ROWS UNBOUNDED PRECEDING) AS e, page_count FROM docs)
  SELECT l_orderkey, l_linenumber, doc_id FROM lineitem JOIN prod ON production_id = l_linenumber % 3 AND l_partkey BETWEEN e - page_count + 1 AND e""")
def produced_range(spark, sf):
    """Which document holds a produced page: page numbers of a production are cut in ranges of 256, and each document is in every range it reaches."""
    d = C.documents(spark, sf).select("production_id", "doc_id", "bates_begin", "page_count")
    p = running(d, ["production_id"], ["bates_begin"], "e", F.col("page_count")).drop("bates_begin").withColumn("b", F.col("e") - F.col("page_count") + 1)
    p = p.withColumn("bin", F.explode(F.sequence(F.floor(F.col("b") / 256), F.floor(F.col("e") / 256))))
    asked = C.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("page"), (F.col("l_linenumber") % 3).cast("bigint").alias("production_id"), F.floor(F.col("l_partkey") / 256).alias("bin"))
    return asked.join(p, ["production_id", "bin"]).filter("page BETWEEN b AND e").select("l_orderkey", "l_linenumber", "doc_id")


@query("q25_neighbours", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS next FROM docs WINDOW w AS (PARTITION BY production_id ORDER BY bates_begin)")
def neighbours(spark, sf):
    d = written(running(C.documents(spark, sf).select("doc_id", "production_id", "bates_begin"), ["production_id"], ["bates_begin"], "place"), "places")
    at = lambda by, name: d.select("production_id", (F.col("place") + by).alias("place"), F.col("doc_id").alias(name))
    return d.join(at(1, "previous"), ["production_id", "place"], "left").join(at(-1, "next"), ["production_id", "place"], "left").select("doc_id", "previous", "next")


@query("q26_find_similar", C.with_sql(C.DOCS_SQL, TOKENS_SQL) + "SELECT doc_id FROM toks WHERE list_contains(w, 'thing') AND len(list_filter(w, lambda x: starts_with(x, 'ere'))) > 0")
def find_similar(spark, sf):
    """A rewriter (here a stand-in for a model) turns a question into a query, which then runs as any other."""
    rewriter = {"anything like it": "thing ere*"}.get
    d = C.documents(spark, sf).select("doc_id", S.tokens(F.col("text")).alias("w"))
    return d.filter(S.matches(F.col("w"), rewriter("anything like it"))).select("doc_id")
