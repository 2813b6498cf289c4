"""Review workflow: dashboards, queues, access, audit and sampling statistics."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexfold.functions import normalize as N
from lexfold.functions import stats as P
from lexfold.plans.registry import query
from lexfold.sources import corpus as C


def _first(df, by, *order):
    """The first row of each group in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def _percent(part, whole, digits=2):
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(0.0)


@query("a1_totals", C.with_sql(C.DOCS_SQL, C.TAGS_SQL) + "SELECT production_id, count(DISTINCT doc_id) AS total, count(DISTINCT t.doc_id) AS reviewed, round(100.0 * count(DISTINCT t.doc_id) / count(DISTINCT docs.doc_id), 2) AS percent FROM docs LEFT JOIN tags t USING (doc_id) GROUP BY production_id".replace("count(DISTINCT doc_id) AS total", "count(DISTINCT docs.doc_id) AS total"))
def totals(spark, sf):
    tagged = C.document_tags(spark, sf).select("doc_id").distinct().withColumn("hit", F.lit(1))
    d = C.documents(spark, sf).join(tagged, "doc_id", "left").groupBy("production_id").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("reviewed"))
    return d.withColumn("percent", _percent(F.col("reviewed"), F.col("total")))


@query("a2_tag_breakdown", C.with_sql(C.TAGS_SQL) + "SELECT category, tag, count(*) AS n FROM tags GROUP BY category, tag")
def tag_breakdown(spark, sf):
    return C.document_tags(spark, sf).groupBy("category", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("a3_throughput", C.with_sql(C.BATCHES_SQL) + "SELECT reviewer, count(*) FILTER (status = 'reviewed') AS reviewed, count(*) FILTER (status = 'skipped') AS skipped FROM batch_docs GROUP BY reviewer ORDER BY reviewed DESC, reviewer LIMIT 100")
def throughput(spark, sf):
    b = C.batch_documents(spark, sf).groupBy("reviewer").agg(F.count_if(F.col("status") == "reviewed").alias("reviewed"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    return b.orderBy(F.desc("reviewed"), "reviewer").limit(100)


@query("a4_queue_totals", C.with_sql(C.BATCHES_SQL) + "SELECT n_name AS queue_owner, coalesce(sum(k), 0) AS documents FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM batch_docs JOIN customer ON c_custkey = reviewer WHERE status = 'pending' GROUP BY c_nationkey) ON c_nationkey = n_nationkey GROUP BY n_name")
def queue_totals(spark, sf):
    b = C.batch_documents(spark, sf).filter("status = 'pending'").groupBy("reviewer").agg(F.count(F.lit(1)).alias("k"))
    c = C.read(spark, sf, "customer").join(b, F.col("c_custkey") == F.col("reviewer")).groupBy("c_nationkey").agg(F.sum("k").alias("k"))
    return C.read(spark, sf, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("queue_owner"), F.coalesce("k", F.lit(0)).alias("documents"))


@query("a5_qc_rates", C.with_sql(C.BATCHES_SQL) + "SELECT queue, count(*) AS n, sum(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) AS overturned, round(100.0 * sum(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) / count(*), 2) AS rate FROM batch_docs WHERE status <> 'pending' GROUP BY queue UNION ALL SELECT 'all', count(*), count(*) FILTER (status = 'skipped'), round(100.0 * count(*) FILTER (status = 'skipped') / count(*), 2) FROM batch_docs WHERE status <> 'pending'")
def qc_rates(spark, sf):
    b = C.batch_documents(spark, sf).filter("status <> 'pending'").rollup("queue").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "skipped").alias("overturned"))
    return b.select(F.coalesce("queue", F.lit("all")).alias("queue"), "n", "overturned", _percent(F.col("overturned"), F.col("n")).alias("rate"))


@query("a6_agreement", """WITH s AS (SELECT l_partkey AS doc_id, l_suppkey % 4 AS reviewer, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS tags FROM lineitem GROUP BY ALL)
  SELECT a.reviewer AS r1, b.reviewer AS r2, count(*) AS overlap, count(*) FILTER (a.tags = b.tags) AS agreed, round(100.0 * count(*) FILTER (a.tags = b.tags) / count(*), 2) AS rate FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.reviewer < b.reviewer GROUP BY 1, 2""")
def agreement(spark, sf):
    """Reviewers agree on a document when their tag sets are equal."""
    s = C.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("doc_id"), (F.col("l_suppkey") % 4).alias("reviewer")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("tags"))
    a, b = s.select("doc_id", F.col("reviewer").alias("r1"), F.col("tags").alias("t1")), s.select("doc_id", F.col("reviewer").alias("r2"), F.col("tags").alias("t2"))
    g = a.join(b, "doc_id").filter("r1 < r2").groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("overlap"), F.count_if(F.col("t1") == F.col("t2")).alias("agreed"))
    return g.withColumn("rate", _percent(F.col("agreed"), F.col("overlap")))


@query("a7_cluster_list", C.with_sql(C.CHUNKS_SQL, C.DOCS_SQL) + "SELECT label, count(DISTINCT document_id) AS documents, coalesce(sum(page_count), 0) AS pages FROM (SELECT DISTINCT label, document_id FROM chunks WHERE chunk_index = 0) LEFT JOIN docs ON doc_id = document_id GROUP BY label")
def cluster_list(spark, sf):
    m = C.chunks(spark, sf).filter("chunk_index = 0").select("label", F.col("document_id").alias("doc_id")).distinct()
    return m.join(C.documents(spark, sf).select("doc_id", "page_count"), "doc_id", "left").groupBy("label").agg(F.count("doc_id").alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))


@query("a8_intake_summary", C.with_sql(C.DOCS_SQL) + "SELECT production_id, count(*) AS documents, count(DISTINCT custodian) AS custodians, count(DISTINCT lang) AS languages, count(DISTINCT family_id) AS families, count(*) FILTER (source_type IS NULL) AS undesignated FROM docs GROUP BY production_id")
def intake(spark, sf):
    return C.documents(spark, sf).groupBy("production_id").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("custodian").alias("custodians"), F.countDistinct("lang").alias("languages"), F.countDistinct("family_id").alias("families"), F.count_if(F.col("source_type").isNull()).alias("undesignated"))


@query("a9_progress", C.with_sql(C.DOCS_SQL) + "SELECT count(*) AS documents, count(source_type) AS designated FROM docs")
def progress(spark, sf):
    return C.documents(spark, sf).agg(F.count("doc_id").alias("documents"), F.count("source_type").alias("designated"))


@query("a10_corpus_stats", C.with_sql(C.DOCS_SQL) + "SELECT count(*) AS documents, sum(page_count) AS pages, sum(n_chars) AS chars, count(DISTINCT custodian) AS custodians FROM docs")
def corpus_stats(spark, sf):
    return C.documents(spark, sf).agg(F.count(F.lit(1)).alias("documents"), F.sum("page_count").alias("pages"), F.sum("n_chars").alias("chars"), F.countDistinct("custodian").alias("custodians"))


@query("a11_cost_estimate", "SELECT n, round(n * ((least(a, 12000) / 4 + 800) * 3 + 300 * 15) / 1e6, 2) AS usd FROM (SELECT count(*) AS n, avg(length(text)) AS a FROM documents)")
def cost(spark, sf):
    """Input tokens: a quarter of the mean length, at most 12000 characters, and 800; output 300; 3 and 15 dollars a million."""
    d = C.read(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.avg(F.char_length("text")).alias("a"))
    return d.select("n", F.round(F.col("n") * ((F.least("a", F.lit(12000.0)) / 4 + 800) * 3 + 300 * 15) / 1e6, 2).alias("usd"))


@query("a12_decisions", C.with_sql(C.DECISIONS_SQL, C.TAGS_SQL) + """SELECT ai_decision, count(*) AS n, round(avg(CASE WHEN tag_id IS NULL THEN NULL WHEN (ai_decision <> 'not_relevant') = (tag_id = 1) THEN 1.0 ELSE 0.0 END), 4) AS agreement
  FROM decisions LEFT JOIN (SELECT doc_id, tag_id FROM tags WHERE tag_id < 3) USING (doc_id) GROUP BY ai_decision""")
def decision_breakdown(spark, sf):
    t = C.document_tags(spark, sf).filter("tag_id < 3").select("doc_id", "tag_id")
    same = F.when(F.col("tag_id").isNotNull(), F.when((F.col("ai_decision") != "not_relevant") == (F.col("tag_id") == 1), 1.0).otherwise(0.0))
    return C.decisions(spark, sf).join(t, "doc_id", "left").groupBy("ai_decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 4).alias("agreement"))


@query("a13_custody", C.with_sql(C.DOCS_SQL) + "SELECT coalesce(source_type, 'unknown') AS source_type, count(*) AS n, count(sha256) AS hashed, max(doc_id) AS latest FROM docs GROUP BY 1")
def custody(spark, sf):
    return C.documents(spark, sf).groupBy(F.coalesce("source_type", F.lit("unknown")).alias("source_type")).agg(F.count(F.lit(1)).alias("n"), F.count("sha256").alias("hashed"), F.max("doc_id").alias("latest"))


@query("a14_exceptions", "SELECT CASE WHEN n_chars < 50 THEN 'nearly empty' WHEN n_chars > 20000 THEN 'very long' END AS exception, count(*) AS n FROM documents WHERE n_chars < 50 OR n_chars > 20000 GROUP BY 1")
def exceptions(spark, sf):
    kind = F.when(F.col("n_chars") < 50, "nearly empty").when(F.col("n_chars") > 20000, "very long")
    return C.read(spark, sf, "documents").select(kind.alias("exception")).filter("exception IS NOT NULL").groupBy("exception").agg(F.count(F.lit(1)).alias("n"))


@query("a15_mean_vectors", C.with_sql(C.CHUNKS_SQL) + ", p AS (SELECT document_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM chunks) SELECT document_id, list(round(a, 5) ORDER BY i) AS vector FROM (SELECT document_id, i, avg(CAST(x AS DOUBLE)) AS a FROM p GROUP BY document_id, i) GROUP BY document_id")
def mean_vectors(spark, sf):
    """Means are rounded as numbers: scaled, to the nearest whole, halves away from zero, whatever their shortest decimals say."""
    near = lambda a: F.signum(a) * F.round(F.abs(a) * 1e5) / 1e5
    p = C.chunks(spark, sf).select("document_id", F.posexplode("embedding").alias("i", "x")).groupBy("document_id", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    return p.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "a"))), lambda s: near(s["a"])).alias("vector"))


MENTIONS = 1_000_000  # that a task tells apart, about


@query("a16_entities", C.with_sql(C.MENTIONS_SQL) + "SELECT entity_id, count(DISTINCT doc_id) AS documents, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date FROM mentions JOIN orders ON o_orderkey = doc_id GROUP BY entity_id")
def entities(spark, sf):
    """Mentions are dealt by document before pairs are told apart, a bounded number to a task: pairs are nearly as many as mentions."""
    m = C.mentions(spark, sf).select("doc_id", "entity_id")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(m.count() / MENTIONS))
    dated = C.read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("d"))
    pairs = m.repartition(tasks, "doc_id").join(dated, "doc_id").groupBy("entity_id", "doc_id").agg(F.min("d").alias("a"), F.max("d").alias("z"))
    return pairs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("documents"), F.min("a").cast("date").alias("first_date"), F.max("z").cast("date").alias("last_date"))


@query("a17_redaction_queue", "SELECT l_partkey AS doc_id, count(*) AS redactions, CAST(max(coalesce(l_shipdate, DATE '1900-01-01')) AS DATE) AS changed FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey")
def redaction_queue(spark, sf):
    return C.read(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("redactions"), F.max("l_shipdate").cast("date").alias("changed"))


@query("a18_brief_inputs", C.with_sql(C.CHUNKS_SQL, C.DOCS_SQL) + """, c AS (SELECT label, document_id, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY document_id) AS r FROM (SELECT DISTINCT label, document_id FROM chunks)),
  top AS (SELECT label FROM (SELECT DISTINCT label, n FROM c) ORDER BY n DESC, label LIMIT 8) SELECT label, n, document_id, bates_begin FROM c LEFT JOIN docs ON doc_id = document_id WHERE r <= 2 AND label IN (SELECT label FROM top)""")
def brief(spark, sf):
    """Two documents of each of the eight largest themes."""
    m = C.chunks(spark, sf).select("label", "document_id").distinct()
    top = m.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(8)
    two = m.join(F.broadcast(top), "label").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("document_id"))).filter("r <= 2")
    return two.join(C.documents(spark, sf).select(F.col("doc_id").alias("document_id"), "bates_begin"), "document_id", "left").select("label", "n", "document_id", "bates_begin")


@query("a19_child_counts", "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id")
def children(spark, sf):
    return C.read(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("asked"))


@query("a20_next_batch", C.with_sql(C.BATCHES_SQL) + "SELECT queue, min(batch_id) AS next_batch FROM (SELECT queue, batch_id, bool_and(status = 'pending') AS open FROM batch_docs GROUP BY ALL) WHERE open GROUP BY queue")
def next_batch(spark, sf):
    b = C.batch_documents(spark, sf).groupBy("queue", "batch_id").agg(F.bool_and(F.col("status") == "pending").alias("open"))
    return b.filter("open").groupBy("queue").agg(F.min("batch_id").alias("next_batch"))


# --- windows -------------------------------------------------------------------------------------------------------


@query("w1_top_entities", C.with_sql(C.MENTIONS_SQL) + "SELECT doc_id, entity_id, n FROM (SELECT doc_id, entity_id, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, entity_id) AS r FROM mentions GROUP BY doc_id, entity_id) WHERE r <= 3")
def top_entities(spark, sf):
    m = C.mentions(spark, sf).groupBy("doc_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "entity_id"))).filter("r <= 3").drop("r")


@query("w2_latest_decision", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest(spark, sf):
    return _first(C.read(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], F.desc("ts"), F.desc("event_id")).drop("ts")


@query("w3_best_chunk", C.with_sql(C.CHUNKS_SQL) + "SELECT document_id, arg_min(chunk_index, (label, chunk_index)) AS chunk_index FROM chunks GROUP BY document_id")
def best_chunk(spark, sf):
    return C.chunks(spark, sf).groupBy("document_id").agg(F.min_by("chunk_index", F.struct("label", "chunk_index")).alias("chunk_index"))


@query("w4_two_snippets", C.with_sql(C.MENTIONS_SQL) + "SELECT entity_id, doc_id, start_offset FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY doc_id, start_offset) AS r FROM mentions) WHERE r <= 2")
def snippets(spark, sf):
    return C.mentions(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy("doc_id", "start_offset"))).filter("r <= 2").select("entity_id", "doc_id", "start_offset")


@query("w8_continuity", "SELECT o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders")
def continuity(spark, sf):
    return C.read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") - F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).alias("gap"))


@query("w10_batch_slices", "SELECT o_orderkey, (r - 1) // 50 AS batch, (r - 1) % 50 AS position FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders)")
def batch_slices(spark, sf):
    from lexfold.operators.ranks import running

    r = F.col("_r") - 1
    return running(C.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], ["o_orderkey"], "_r").select("o_orderkey", F.floor(r / 50).alias("batch"), (r % 50).cast("bigint").alias("position"))


# --- sampling and validation ---------------------------------------------------------------------------------------


def _fpc(n0: str, n: str) -> str:
    return f"least({n}, CAST(ceil({n0} / (1 + ({n0} - 1) / {n})) AS BIGINT))"


@query("p1_sample_size", "SELECT o_custkey, n, " + _fpc(repr(1.9599**2 * 0.25 / 0.0025), "n") + " AS size95, " + _fpc(repr(2.5758**2 * 0.1 * 0.9 / 0.02**2), "n") + " AS size99 FROM (SELECT o_custkey, count(*) * 977 AS n FROM orders GROUP BY o_custkey)")
def sample_size(spark, sf):
    d = C.read(spark, sf, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) * 977).alias("n"))
    return d.select("o_custkey", "n", P.sample_size(F.col("n")).cast("bigint").alias("size95"), P.sample_size(F.col("n"), 99, 0.02, 0.1).cast("bigint").alias("size99"))


_W = P.wilson_sql("k", "n")


@query("p2_wilson", f"SELECT l_suppkey, round({_W[0]}, 6) AS rate, round({_W[1]}, 6) AS low, round({_W[2]}, 6) AS high FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey UNION ALL SELECT -1, 0, 0)")
def wilson(spark, sf):
    d = C.read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count(F.lit(1)).alias("n"))
    d = d.union(spark.sql("SELECT -1L, 0L, 0L"))
    return d.select("l_suppkey", *(F.round(c, 6).alias(a) for c, a in zip(P.wilson(F.col("k"), F.col("n")), ("rate", "low", "high"))))


@query("p3_acceptance", f"SELECT l_suppkey, n > 0 AND {_W[2]} <= 0.28 AS accept FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey)")
def acceptance(spark, sf):
    d = C.read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count(F.lit(1)).alias("n"))
    return d.select("l_suppkey", P.accepted(F.col("k"), F.col("n"), F.lit(0.28)).alias("accept"))


@query("p4_frozen_draw", C.with_sql(C.DOCS_SQL, C.DECISIONS_SQL) + "SELECT doc_id FROM docs WHERE doc_id IN (SELECT doc_id FROM decisions WHERE ai_decision = 'not_relevant') ORDER BY md5('seed-1|' || doc_id), doc_id LIMIT 60")
def draw(spark, sf):
    """A draw of 60 from the null set that anyone with the seed can repeat."""
    null_set = C.decisions(spark, sf).filter("ai_decision = 'not_relevant'")
    return C.documents(spark, sf).join(null_set, "doc_id", "left_semi").select("doc_id").orderBy(F.md5(F.concat(F.lit("seed-1|"), F.col("doc_id").cast("string"))), "doc_id").limit(60)


@query("p5_estimate", f"SELECT l_suppkey, CAST(floor({_W[1]} * 10000) AS BIGINT) AS missed_low, CAST(floor({_W[2]} * 10000) AS BIGINT) AS missed_high FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey)")
def estimate(spark, sf):
    d = C.read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("k"), F.count(F.lit(1)).alias("n"))
    _, low, high = P.wilson(F.col("k"), F.col("n"))
    return d.select("l_suppkey", F.floor(low * 10000).alias("missed_low"), F.floor(high * 10000).alias("missed_high"))


_R, _PR = P.wilson_sql("tp", "(tp + fn)"), P.wilson_sql("tp", "(tp + fp)")


@query("p6_validation", C.with_sql(C.DECISIONS_SQL) + f""", h AS (SELECT doc_id, max(quality) = 1 AS pos, min(quality) = 0 AS neg FROM labels GROUP BY doc_id),
  c AS (SELECT d.doc_id, pos, neg, ai_decision FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d LEFT JOIN h USING (doc_id) LEFT JOIN decisions USING (doc_id)),
  m AS (SELECT count(*) AS n, count(*) FILTER (pos AND NOT neg OR neg AND NOT pos) AS coded, count(*) FILTER (pos AND neg) AS conflicted, count(*) FILTER (pos IS NULL) AS uncoded,
    count(*) FILTER (pos <> neg AND ai_decision IS NULL) AS undecided, count(*) FILTER (pos AND NOT neg AND ai_decision <> 'not_relevant') AS tp, count(*) FILTER (neg AND NOT pos AND ai_decision <> 'not_relevant') AS fp,
    count(*) FILTER (pos AND NOT neg AND ai_decision = 'not_relevant') AS fn, count(*) FILTER (neg AND NOT pos AND ai_decision = 'not_relevant') AS tn FROM c)
  SELECT *, round({_R[0]}, 6) AS recall, round({_R[1]}, 6) AS recall_low, round({_R[2]}, 6) AS recall_high, round({_PR[0]}, 6) AS "precision" FROM m""")
def validation(spark, sf):
    """Confusion of machine against human coding on a control set; conflicted, uncoded and undecided are counted apart."""
    h = C.read(spark, sf, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("pos"), (F.min("quality") == 0).alias("neg"))
    control = C.read(spark, sf, "documents").select("doc_id").filter("doc_id % 2 = 0")
    c = control.join(h, "doc_id", "left").join(C.decisions(spark, sf), "doc_id", "left")
    pos, neg, machine = F.col("pos") & ~F.col("neg"), F.col("neg") & ~F.col("pos"), F.col("ai_decision") != "not_relevant"
    cells = {"n": F.lit(True), "coded": pos | neg, "conflicted": F.col("pos") & F.col("neg"), "uncoded": F.col("pos").isNull(), "undecided": (pos | neg) & F.col("ai_decision").isNull(), "tp": pos & machine, "fp": neg & machine, "fn": pos & ~machine, "tn": neg & ~machine}
    m = c.agg(*(F.count_if(v).alias(k) for k, v in cells.items()))
    recall, precision = P.wilson(F.col("tp"), F.col("tp") + F.col("fn")), P.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    return m.select("*", *(F.round(x, 6).alias(a) for x, a in zip(recall, ("recall", "recall_low", "recall_high"))), F.round(precision[0], 6).alias("precision"))


@query("p7_qc_sample", C.with_sql(C.BATCHES_SQL) + "SELECT queue, greatest(1, CAST(round_even(count(*) * 0.125, 0) AS BIGINT)) AS draw FROM batch_docs WHERE status = 'reviewed' AND batch_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY queue")
def qc_sample(spark, sf):
    done = C.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("batch_id"))
    b = C.batch_documents(spark, sf).filter("status = 'reviewed'").join(done, "batch_id", "left_anti")
    return b.groupBy("queue").agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * 0.125, 0).cast("bigint")).alias("draw"))


# --- access, audit, workflow ---------------------------------------------------------------------------------------

ACCESS_SQL = """paths AS (SELECT c_custkey AS user_id, c_nationkey % 3 AS production_id, 3 AS rank FROM customer WHERE c_acctbal > 9000
  UNION ALL SELECT o_custkey, o_orderkey % 3, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END FROM orders UNION ALL SELECT c_custkey, 2, 1 FROM customer WHERE c_mktsegment = 'BUILDING')"""


def _paths(spark, sf):
    """Owned, granted and by-domain access: user_id, production_id, rank (3 admin, 2 manager, 1 reviewer)."""
    c, o = C.read(spark, sf, "customer"), C.read(spark, sf, "orders")
    owned = c.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 3).cast("bigint").alias("production_id"), F.lit(3).alias("rank"))
    granted = o.select("o_custkey", (F.col("o_orderkey") % 3).cast("bigint"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2))
    domain = c.filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(2).cast("bigint"), F.lit(1))
    return owned.union(granted).union(domain)


@query("x1_accessible", "WITH " + ACCESS_SQL + " SELECT DISTINCT user_id, production_id FROM paths")
def accessible(spark, sf):
    return _paths(spark, sf).select("user_id", "production_id").distinct()


@query("x2_effective_role", "WITH " + ACCESS_SQL + " SELECT user_id, production_id, ['reviewer','manager','admin'][max(rank)] AS role FROM paths GROUP BY ALL")
def role(spark, sf):
    return _paths(spark, sf).groupBy("user_id", "production_id").agg(F.element_at(F.array(*map(F.lit, ("reviewer", "manager", "admin"))), F.max("rank")).alias("role"))


@query("x3_email_domain", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'firm' || (c_custkey % 7) || '.example.com' END AS domain FROM customer")
def domain(spark, sf):
    mail = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("u@FIRM"), (F.col("c_custkey") % 7).cast("string"), F.lit(".Example.com"))).otherwise("nobody")
    return C.read(spark, sf, "customer").select("c_custkey", N.email_domain(mail).alias("domain"))


@query("x4_auditable", "WITH " + ACCESS_SQL + " SELECT DISTINCT user_id, production_id FROM paths WHERE rank >= 2")
def auditable(spark, sf):
    return _paths(spark, sf).filter("rank >= 2").select("user_id", "production_id").distinct()


@query("x5_audit_page", "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21' AND (user_id % 4 = 0 OR user_id % 3 = 1) ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit(spark, sf):
    """Days are inclusive; rows of no production (every fourth user here) show to every manager."""
    e = C.read(spark, sf, "events").filter((F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-21").cast("timestamp")))
    return e.filter("user_id % 4 = 0 OR user_id % 3 = 1").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "user_id", "event_type")


@query("x6_queue_source", C.with_sql(C.DOCS_SQL, C.DECISIONS_SQL) + "SELECT doc_id FROM docs WHERE doc_id IN (SELECT doc_id FROM decisions WHERE ai_decision = 'key_document') AND lang = 'en'")
def queue_source(spark, sf):
    """A slice of machine decisions goes before a query, a query before all documents."""
    from lexfold.operators.workflow import queue_documents

    d = C.documents(spark, sf).filter("lang = 'en'")
    return queue_documents(d, d.filter("page_count > 3"), C.decisions(spark, sf).filter("ai_decision = 'key_document'")).select("doc_id")


@query("x7_batch_creation", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, (r - 1) // 40 AS batch, (r - 1) % 40 AS position FROM (SELECT doc_id, row_number() OVER (PARTITION BY production_id ORDER BY bates_begin) AS r FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def batch_creation(spark, sf):
    from lexfold.operators.workflow import new_batches

    return new_batches(C.documents(spark, sf), C.read(spark, sf, "labels"), 40).select("doc_id", "batch", "position")


@query("x8_bulk_accept", C.with_sql(C.DECISIONS_SQL) + "SELECT doc_id, ai_decision FROM decisions WHERE confidence >= 70 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def bulk_accept(spark, sf):
    return C.decisions(spark, sf).filter("confidence >= 70").join(C.read(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "ai_decision")


@query("x9_decision_tags", C.with_sql(C.DECISIONS_SQL) + "SELECT doc_id, CASE replace(d, 'override_', '') WHEN 'relevant' THEN 'Responsive' WHEN 'key_document' THEN 'Hot' ELSE 'Non-Responsive' END AS tag FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'override_' || ai_decision ELSE ai_decision END AS d FROM decisions)")
def decision_tags(spark, sf):
    d = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("override_"), "ai_decision")).otherwise(F.col("ai_decision"))
    plain = F.regexp_replace(d, "^override_", "")
    return C.decisions(spark, sf).select("doc_id", F.when(plain == "relevant", "Responsive").when(plain == "key_document", "Hot").otherwise("Non-Responsive").alias("tag"))


@query("x10_cascade", C.with_sql(C.DECISIONS_SQL) + "SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'failed' WHEN ai_decision = 'not_relevant' AND confidence >= 80 THEN 'screened_out' ELSE 'confirm' END AS step FROM decisions")
def cascade(spark, sf):
    """Screen out what the first model rejects with confidence of 80 or more; a call without tokens has failed."""
    tokens = F.when(F.col("doc_id") % 50 == 0, 0).otherwise(10)
    return C.decisions(spark, sf).select("doc_id", F.when(tokens == 0, "failed").when((F.col("ai_decision") == "not_relevant") & (F.col("confidence") >= 80), "screened_out").otherwise("confirm").alias("step"))


@query("x11_classification_parse", "SELECT event_id, greatest(0, least(100, CAST(round(value * 3 - 50) AS INT))) AS confidence, event_type AS decision FROM events")
def classification(spark, sf):
    from pyspark.sql import types as T

    made = F.to_json(F.struct(F.col("event_type").alias("decision"), F.round(F.col("value") * 3 - 50).cast("int").alias("confidence")))
    parsed = F.from_json(made, T.StructType([T.StructField("decision", T.StringType()), T.StructField("confidence", T.IntegerType())]))
    e = C.read(spark, sf, "events").select("event_id", parsed.alias("p"))
    return e.select("event_id", F.greatest(F.lit(0), F.least(F.lit(100), F.col("p.confidence"))).alias("confidence"), F.coalesce("p.decision", F.lit("needs_review")).alias("decision"))


@query("x12_lineage", C.with_sql(C.DOCS_SQL, C.TAGS_SQL, C.DECISIONS_SQL) + "SELECT doc_id, sha256, (SELECT coalesce(list(tag ORDER BY tag), []) FROM tags WHERE tags.doc_id = docs.doc_id) AS tags, ai_decision FROM docs LEFT JOIN decisions USING (doc_id)")
def lineage(spark, sf):
    t = C.document_tags(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    d = C.documents(spark, sf).select("doc_id", "sha256").join(t, "doc_id", "left").join(C.decisions(spark, sf).select("doc_id", "ai_decision"), "doc_id", "left")
    return d.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


@query("x13_sso_org", "SELECT c_custkey, n_name AS org FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def sso(spark, sf):
    orgs = C.read(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("org"))
    return C.read(spark, sf, "customer").join(orgs, "c_nationkey", "left").select("c_custkey", "org")


@query("x14_chat_title", r"SELECT conv_id, turn, CASE WHEN len(t) <= 60 THEN t ELSE trim(regexp_replace(substr(t, 1, 60), '\s+\S*$', '')) || '…' END AS title FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)")
def chat_title(spark, sf):
    return C.read(spark, sf, "conversations").select("conv_id", "turn", N.title_clip(F.col("text")).alias("title"))


@query("x15_agent_tools", C.with_sql(C.DOCS_SQL, C.TAGS_SQL) + "SELECT 'documents' AS tool, count(*) AS rows FROM docs UNION ALL SELECT 'tags', count(*) FROM tags UNION ALL SELECT 'page', 25")
def agent_tools(spark, sf):
    """A facade of read-only tools with pages of 25."""
    from lexfold.operators.workflow import Tools

    t = Tools(spark, sf)
    one = lambda name, df: df.agg(F.lit(name).alias("tool"), F.count(F.lit(1)).alias("rows"))
    return one("documents", t.documents()).union(one("tags", t.tags())).union(one("page", t.page(t.documents(), "doc_id", 2)))


def assistant(spark, sf, accessible=(0, 2)):
    """The tools over the views: productions 0 and 2 of three are accessible; suppliers are the entities."""
    from lexfold.functions.normalize import FILE_GROUPS
    from lexfold.operators.tools import AgentTools

    docs = C.documents(spark, sf).withColumn("title", F.concat(F.lit("Title "), F.col("doc_id").cast("string")))
    hashes = docs.select("doc_id", F.col("sha256").alias("group_id"))
    common = hashes.groupBy("group_id").count().filter("count > 1").select("group_id")
    entities = C.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), (F.col("s_suppkey") % 3).alias("production_id"), F.lit("org").alias("kind"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("aliases"))
    li = C.read(spark, sf, "lineitem")
    counts = li.groupBy(F.col("l_suppkey").alias("entity_id")).agg(F.count(F.lit(1)).alias("mentions"))
    tables = {
        "documents": docs,
        "chunks": C.chunks(spark, sf),
        "duplicates": hashes.join(common, "group_id").select("doc_id", "group_id", F.lit("hash").alias("type"), F.lit(1.0).alias("similarity")),
        "tags": C.document_tags(spark, sf),
        "productions": spark.range(4).select(F.col("id").alias("production_id"), F.concat(F.lit("Matter "), F.col("id").cast("string")).alias("name")),
        "entities": entities.join(counts, "entity_id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0))),
        "mentions": li.select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("line "), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit(" of "), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("snippet")),
        "related": li.select(F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") % 10).alias("target_id"), F.col("l_returnflag").alias("type")),
    }
    vector = lambda text: [float(len(text) % 7 + i % 5) for i in range(64)]  # noqa: E731  a stand-in for a model
    return AgentTools(list(accessible), tables, vector, FILE_GROUPS)


@query("x15_get_document", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, bates_begin, 'Title ' || doc_id AS title, page_count, CASE WHEN len(t) > 12000 THEN left(t, 12000) || chr(10) || '…[truncated]' ELSE t END AS text FROM (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM docs WHERE bates_begin = 'DOC000012')")
def tool_document(spark, sf):
    return assistant(spark, sf).get_document(" DOC000012 ")


@query("x15_list_productions", C.with_sql(C.DOCS_SQL) + "SELECT production_id, 'Matter ' || production_id AS name, count(*) AS documents FROM docs WHERE production_id IN (0, 2) GROUP BY production_id")
def tool_productions(spark, sf):
    return assistant(spark, sf).list_productions()


@query("x15_corpus_stats", C.with_sql(C.DOCS_SQL, C.TAGS_SQL) + """, d AS (SELECT * FROM docs WHERE production_id = 2) SELECT 'documents' AS what, NULL AS category, NULL AS tag, count(*) AS n FROM d UNION ALL SELECT 'pages', NULL, NULL, CAST(sum(page_count) AS BIGINT) FROM d
  UNION ALL SELECT 'tag', category, tag, count(*) FROM tags WHERE doc_id IN (SELECT doc_id FROM d) GROUP BY category, tag""")
def tool_stats(spark, sf):
    return assistant(spark, sf).get_corpus_stats(2)


@query("x15_duplicates", C.with_sql(C.DOCS_SQL) + """, g AS (SELECT sha256 FROM docs GROUP BY sha256 HAVING count(*) > 1), one AS (SELECT doc_id, sha256 FROM docs WHERE production_id <> 1 AND bates_begin = (SELECT min(bates_begin) FROM docs JOIN g USING (sha256) WHERE production_id <> 1))
  SELECT d.doc_id, bates_begin, 'Title ' || d.doc_id AS title, 1.0 AS similarity, 'hash' AS type FROM docs d JOIN one ON d.sha256 = one.sha256 AND d.doc_id <> one.doc_id WHERE production_id <> 1""")
def tool_duplicates(spark, sf):
    """Of the first accessible document that has copies: those in accessible productions."""
    t = assistant(spark, sf)
    first = t.docs.join(t.t["duplicates"], "doc_id", "left_semi").agg(F.min("bates_begin").alias("b")).first()["b"]
    return t.get_duplicates(first or "none")


@query("x15_lookup_entity", """WITH e AS (SELECT s_suppkey AS id, s_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n FROM supplier WHERE s_suppkey % 3 <> 1 AND contains(lower(s_name), 'supplier#0000000')),
  top AS (SELECT * FROM e ORDER BY n DESC, id LIMIT 5)
  SELECT id AS entity_id, s_name AS name, n AS mentions, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = id) AS documents,
    (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT l_returnflag || ' -> ' || t.s_name AS x FROM lineitem JOIN supplier t ON t.s_suppkey = l_partkey % 10 WHERE l_suppkey = id ORDER BY x LIMIT 10)) AS related FROM top""")
def tool_entity(spark, sf):
    found = assistant(spark, sf).lookup_entity("supplier#0000000")
    return found.select("entity_id", "name", "mentions", "documents", F.array_join("related", "|").alias("related"))


@query("x15_search_documents")
def tool_search(spark, sf):
    """A page of the best by stems, with headlines and the total."""
    return assistant(spark, sf).search_documents("other things", file_type="native")


@query("x15_semantic_search")
def tool_semantic(spark, sf):
    return assistant(spark, sf).semantic_search("anything like it").union(assistant(spark, sf).find_similar_documents("DOC000002"))
