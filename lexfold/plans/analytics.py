"""Duplicates, threads, clusters, entities, graph, model wrappers and join shapes."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfold.functions import normalize as N
from lexfold.operators import clustering as K
from lexfold.operators import dedup as D
from lexfold.operators import entities as E
from lexfold.operators import extraction as EX
from lexfold.operators import graph as G
from lexfold.operators import persistence as PE
from lexfold.operators import reviews as RV
from lexfold.operators import rewriting as W
from lexfold.operators import threads as TH
from lexfold.plans.registry import query
from lexfold.sources import corpus as C
from lexfold.streaming import events as ST

# What in a label or a title tells that a model declined to give one, and how file types are shown.
LABEL_REFUSALS = (
    "i cannot", "i can't", "i am unable", "i'm unable", "unable to",
    "sorry", "illegible", "not legible", "no legible", "cannot determine",
)
TITLE_REFUSALS = ("i don't have enough", "i cannot", "insufficient", "not enough context", "unable to")
DISPLAY_TYPES = {"pdf": "pdf", "doc": "document", "docx": "document", "xls": "spreadsheet", "xlsx": "spreadsheet", "csv": "spreadsheet", "ppt": "presentation", "pptx": "presentation", "potx": "presentation", "msg": "email", "eml": "email", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "mp4": "video", "mov": "video", "wmv": "video", "mp3": "audio", "wav": "audio"}

HASH_SQL = "hg AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256) AS group_id, count(*) OVER (PARTITION BY sha256) AS n FROM docs WHERE sha256 <> '')"


@query("d1_hash_groups", C.with_sql(C.DOCS_SQL, HASH_SQL) + "SELECT doc_id, group_id FROM hg WHERE n > 1")
def hash_groups(spark, sf):
    return D.hash_groups(C.documents(spark, sf))


TRI_SQL = r"""ws AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM docs),
t AS (SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS s FROM ws WHERE len(w) >= 5),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM t),
jp AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 0.95 * (any_value(a.n) + any_value(b.n) - count(*)))"""


@query("d2_near_pairs", C.with_sql(C.DOCS_SQL, TRI_SQL) + """, cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM t)
  SELECT a, b, round(similarity, 6) AS similarity FROM jp JOIN cls x ON x.doc_id = a JOIN cls y ON y.doc_id = b WHERE a = x.rep AND (b = y.rep OR y.rep = a)""")
def near_pairs(spark, sf):
    return D.near_pairs(C.documents(spark, sf)).select("a", "b", F.round("similarity", 6).alias("similarity"))


COS_SQL = """em AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), two AS (SELECT * FROM em UNION ALL SELECT vec_id + 1000000, list_transform(v, lambda x, i: CASE WHEN i = 1 THEN x + sqrt(list_sum(list_transform(v, lambda y: y * y))) / 2 ELSE x END) FROM em),
cp AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.v, y.v) AS s FROM two x JOIN two y ON x.vec_id < y.vec_id)"""


@query("d3_similar_pairs", C.with_sql(COS_SQL) + "SELECT a, b, round(s, 5) AS similarity FROM cp WHERE s >= 0.8 AND s < 0.95")
def similar_pairs(spark, sf):
    """The test vectors have no pairs in the band, so each has a partner that is turned a little by its first number."""
    e = C.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    turned = F.transform("v", lambda x, i: F.when(i == 0, x + length / 2).otherwise(x))
    return D.similar_pairs(e.union(e.select(F.col("id") + 1_000_000, turned)), 0.8, 0.95).select("a", "b", F.round("similarity", 5).alias("similarity"))


@query("d4_components", C.with_sql(C.DOCS_SQL, TRI_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT a AS x, b AS y FROM jp UNION SELECT b, a FROM jp), r AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y) SELECT x AS doc_id, min(y) AS group_id FROM r GROUP BY x""")
def components(spark, sf):
    return D.grouped(D.near_pairs(C.documents(spark, sf))).select("doc_id", "group_id")


@query("d5_duplicate_lookup", C.with_sql(C.DOCS_SQL, HASH_SQL) + "SELECT h.doc_id AS duplicate_of, o.doc_id FROM hg h JOIN hg o ON o.group_id = h.group_id AND o.doc_id <> h.doc_id")
def duplicate_lookup(spark, sf):
    g = D.hash_groups(C.documents(spark, sf))
    return g.select(F.col("doc_id").alias("duplicate_of"), "group_id").join(g, "group_id").filter("doc_id <> duplicate_of").select("duplicate_of", "doc_id")


@query("d6_tag_propagation", C.with_sql(C.DOCS_SQL, C.TAGS_SQL, HASH_SQL) + "SELECT DISTINCT o.doc_id, tag_id FROM tags JOIN hg h USING (doc_id) JOIN hg o ON o.group_id = h.group_id WHERE h.n > 1 AND (o.doc_id, tag_id) NOT IN (SELECT (doc_id, tag_id) FROM tags)")
def tag_propagation(spark, sf):
    return D.propagate(C.document_tags(spark, sf), D.hash_groups(C.documents(spark, sf)))


@query("d7_family_members", C.with_sql(C.DOCS_SQL) + "SELECT a.doc_id, b.doc_id AS member FROM docs a JOIN docs b ON a.family_id = b.family_id AND a.doc_id <> b.doc_id")
def family_members(spark, sf):
    d = C.documents(spark, sf).filter("family_id IS NOT NULL").select("doc_id", "family_id")
    return d.join(d.withColumnRenamed("doc_id", "member"), "family_id").filter("doc_id <> member").select("doc_id", "member")


# --- clusters ------------------------------------------------------------------------------------------------------


def _vectors(spark, sf):
    return C.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query("c1_kmeans")
def kmeans(spark, sf):
    v = _vectors(spark, sf)
    return K.assign(v, K.kmeans(v, 10, 5)).select("id", "cluster")


@query("c2_silhouette", """WITH p AS (SELECT x.vec_id AS a, x.label AS la, y.label AS lb, avg(list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))) AS d FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id GROUP BY ALL),
  s AS (SELECT a, min(d) FILTER (la = lb) AS own, min(d) FILTER (la <> lb) AS other FROM p GROUP BY a) SELECT a AS id, round((other - own) / greatest(own, other), 4) AS silhouette FROM s WHERE own IS NOT NULL""")
def silhouette(spark, sf):
    """Of given labels, over all vectors. Singletons are left out."""
    return K.silhouettes(_vectors(spark, sf)).select("id", F.round("silhouette", 4).alias("silhouette"))


@query("c3_choose_k")
def choose_k(spark, sf):
    """Mean silhouettes of all numbers of clusters that are tried on the vectors, and which is best."""
    best, scores = K.choose_k(_vectors(spark, sf))
    return spark.createDataFrame([(k, round(s, 6), k == best) for k, s in scores.items()], "k int, silhouette double, best boolean")


@query("c3_tried", """SELECT o_custkey, n, CASE WHEN n < 50 THEN range(2, greatest(2, least(6, n))) ELSE range(5, greatest(5, least(31, n // 10 + 1))) END AS tried FROM (SELECT o_custkey, count(*) * (o_custkey % 40) AS n FROM orders GROUP BY o_custkey)""")
def tried(spark, sf):
    """Which numbers of clusters are tried for collections of many sizes."""
    n = F.count(F.lit(1)) * F.first(F.col("o_custkey") % 40)
    ks = F.udf(lambda m: K.candidates_of_k(m), "array<bigint>")
    d = C.read(spark, sf, "orders").groupBy("o_custkey").agg(n.alias("n"))
    known = d.select("n").distinct().withColumn("tried", ks("n"))
    return d.join(known, "n").select("o_custkey", "n", "tried")


RAW_LABEL_SQL = """r AS (SELECT p_partkey, ['"' || p_name || '" ', 'I cannot read ' || p_name, repeat(p_name, 5), 'a b c d e ' || p_name, p_name || '.', p_name, ' ', 'Sorry, ' || p_name][p_partkey % 8 + 1] AS raw FROM part)"""


@query("c4_label_sanitise", "WITH " + RAW_LABEL_SQL + """ SELECT p_partkey, CASE WHEN x <> '' AND len(x) <= 40 AND len(regexp_split_to_array(x, '\\s+')) <= 6 AND right(x, 1) <> '.' AND NOT contains(lower(x), 'i cannot') AND NOT contains(lower(x), 'sorry') THEN x END AS label FROM (SELECT p_partkey, trim(trim(trim(raw), '"')) AS x FROM r)""")
def labels(spark, sf):
    """Labels in quotes, refusals, too long ones and sentences, made from the parts' names."""
    name = F.col("p_name")
    raw = F.array(F.concat(F.lit('"'), name, F.lit('" ')), F.concat(F.lit("I cannot read "), name), F.repeat(name, F.lit(5)), F.concat(F.lit("a b c d e "), name), F.concat(name, F.lit(".")), name, F.lit(" "), F.concat(F.lit("Sorry, "), name))
    d = C.read(spark, sf, "part").select("p_partkey", F.get(raw, (F.col("p_partkey") % 8).cast("int")).alias("raw"))
    x = F.btrim(F.btrim(F.btrim("raw"), F.lit('"')))
    refusal = F.lower(x).rlike("|".join(LABEL_REFUSALS))
    bad = (x == "") | (F.char_length(x) > 40) | (F.size(F.split(x, r"\s+")) > 6) | x.endswith(".") | refusal
    return d.select("p_partkey", F.when(~bad, x).alias("label"))


@query("c5_spread_sample", """SELECT p_partkey, n, k, CASE WHEN n <= k THEN range(0, n) WHEN k = 1 THEN [0] ELSE list_sort(list_distinct([CAST(round_even(CAST(i * (n - 1) AS DOUBLE) / (k - 1), 0) AS BIGINT) FOR i IN range(0, k)])) END AS positions
  FROM (SELECT p_partkey, CAST(p_size * 3 + 1 AS BIGINT) AS n, CAST(p_partkey % 9 + 1 AS BIGINT) AS k FROM part)""")
def spread(spark, sf):
    """Half-way positions round to even."""
    d = C.read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 3 + 1).cast("bigint").alias("n"), (F.col("p_partkey") % 9 + 1).alias("k"))
    step = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1), lambda i: F.bround(i * (F.col("n") - 1) / F.greatest(F.col("k") - 1, F.lit(1)), 0).cast("bigint"))))
    return d.select("p_partkey", "n", "k", F.when(F.col("n") <= F.col("k"), F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).when(F.col("k") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(step).alias("positions"))


@query("c6_diverse_sample")
def diverse(spark, sf):
    return K.diverse(_vectors(spark, sf), 8)


# --- threads -------------------------------------------------------------------------------------------------------

SUBJECT_SQL = r"lower(trim(regexp_replace(regexp_replace(subject, '^(\s*(re|fwd|fw)\s*:\s*)+', '', 'i'), '\s+', ' ', 'g')))"
THREAD_SQL = f"""m AS (SELECT *, {SUBJECT_SQL} AS subj, list_distinct(list_filter([in_reply_to] || regexp_extract_all(coalesce(refs, ''), '<[^<>\\s]+>'), lambda x: x IS NOT NULL)) AS targets FROM messages),
h AS (SELECT message_id, min(doc_id) AS holder FROM m WHERE message_id IS NOT NULL GROUP BY message_id),
l AS (SELECT doc_id, t AS message_id, holder FROM (SELECT doc_id, unnest(targets) AS t FROM m) JOIN h ON h.message_id = t),
o AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY subj) AS v FROM m WHERE message_id IS NULL AND subj <> '' AND doc_id NOT IN (SELECT doc_id FROM l)),
e0 AS (SELECT doc_id AS x, holder AS y FROM l UNION SELECT doc_id, v FROM o UNION SELECT doc_id, doc_id FROM m), e AS (SELECT x, y FROM e0 UNION SELECT y, x FROM e0),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y), root AS (SELECT x AS doc_id, min(y) AS root FROM r GROUP BY x),
a AS (SELECT m.*, root, m.message_id IN (SELECT message_id FROM l WHERE l.holder <> l.doc_id) AS replied FROM m JOIN root USING (doc_id)),
th AS (SELECT doc_id, 'T-' || substr(sha1('0|' || coalesce(min(message_id) OVER w, CASE WHEN min(subj) OVER w <> '' THEN 'subj:' || min(subj) OVER w END, 'doc:' || min(doc_id) OVER w)), 1, 16) AS thread_id,
  CASE WHEN bool_or(coalesce(replied, false)) OVER w THEN NOT coalesce(replied, false) ELSE row_number() OVER (PARTITION BY root ORDER BY sent_s DESC NULLS LAST, doc_id) = 1 END AS is_inclusive FROM a WINDOW w AS (PARTITION BY root))"""
THREADS = C.with_sql(C.MESSAGES_SQL, THREAD_SQL).replace("WITH ", "WITH RECURSIVE ", 1)


@query("t1_subject", C.with_sql(C.MESSAGES_SQL) + f"SELECT doc_id, {SUBJECT_SQL} AS subject FROM messages")
def subject(spark, sf):
    return C.messages(spark, sf).select("doc_id", N.subject_of(F.col("subject")).alias("subject"))


@query("t2_threads", THREADS + "SELECT doc_id, min(doc_id) OVER (PARTITION BY thread_id) AS first FROM th")
def threads(spark, sf):
    t = TH.threads(C.messages(spark, sf))
    return t.select("doc_id", F.min("doc_id").over(Window.partitionBy("thread_id")).alias("first"))


@query("t3_thread_ids", THREADS + "SELECT doc_id, thread_id FROM th")
def thread_ids(spark, sf):
    return TH.threads(C.messages(spark, sf)).select("doc_id", "thread_id")


@query("t4_inclusive", THREADS + "SELECT doc_id, is_inclusive FROM th")
def inclusive(spark, sf):
    return TH.threads(C.messages(spark, sf)).select("doc_id", "is_inclusive")


@query("t5_scope_guard", C.with_sql(C.DOCS_SQL) + "SELECT doc_id FROM docs WHERE lower(native_path) LIKE '%.msg' AND (doc_id % 3 = 0 OR doc_id % 3 = 1)")
def scope(spark, sf):
    """Only mail without a thread, or with one of ours, is threaded."""
    thread = F.when(F.col("doc_id") % 3 == 1, "T-1").when(F.col("doc_id") % 3 == 2, "LOAD-1")
    d = C.documents(spark, sf).withColumn("thread", thread)
    return d.filter((N.file_type_of(F.col("native_path")) == "msg") & (F.col("thread").isNull() | F.col("thread").startswith("T-"))).select("doc_id")


# --- entities ------------------------------------------------------------------------------------------------------

# People and companies made from the customers' keys.
FIRST, LAST = ["Jorge", "Maria", "Ann", "Li", "Michele"], ["Rivera", "Stone", "Smith", "Okafor", "Ng"]
PERSON_SQL = "p AS (SELECT c_custkey AS id, ['Jorge','Maria','Ann','Li','Michele'][c_custkey % 5 + 1] AS f, ['Rivera','Stone','Smith','Okafor','Ng'][c_custkey // 5 % 5 + 1] AS l FROM customer)"


def _people(spark, sf):
    pick = lambda names, at: F.element_at(F.array(*(F.lit(n) for n in names)), (at % 5 + 1).cast("int"))
    return C.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), pick(FIRST, F.col("c_custkey")).alias("f"), pick(LAST, F.floor(F.col("c_custkey") / 5)).alias("l"))


@query("e1_normal_names", "WITH " + PERSON_SQL + """ SELECT id, CASE id % 8 WHEN 3 THEN lower(l) || ' corp inc' WHEN 4 THEN lower(l) WHEN 5 THEN 'o ' || lower(l) || ' ' || lower(f) WHEN 6 THEN '' WHEN 7 THEN lower(l) || ' ' || lower(f) || ' llc' ELSE lower(f) || ' ' || lower(l) END AS norm FROM p""")
def normal_names(spark, sf):
    written = F.array(
        F.concat("l", F.lit(", "), "f"), F.concat(F.lit("Dr. "), "f", F.lit(" "), "l", F.lit(", Jr.")), F.concat("l", F.lit(", "), "f", F.lit(" , Esq.")), F.concat(F.upper("l"), F.lit(" Corp., Inc.")),
        F.concat(F.lit("  Mr. "), "l", F.lit(" ")), F.concat(F.lit("O'"), "l", F.lit("-"), "f"), F.lit(" , "), F.concat("l", F.lit(" "), "f", F.lit(",LLC")),
    )
    p = _people(spark, sf).select("id", F.get(written, (F.col("id") % 8).cast("int")).alias("name"))
    return p.select("id", E.normal_name(F.col("name")).alias("norm"))


@query("e2_token_similarity", "SELECT s_suppkey, s_suppkey % 3 <> 1 AS suggested FROM supplier")
def token_similarity(spark, sf):
    """A school misheard, two firms without a common word, and a letter more in a first name, each numbered."""
    n = F.col("s_suppkey").cast("string")
    of = lambda *names: F.get(F.array(*(F.concat(F.lit(x + " "), n) for x in names)), (F.col("s_suppkey") % 3).cast("int"))
    d = C.read(spark, sf, "supplier").select("s_suppkey", of("smyrna park elementary", "meridian holdings", "jon smith").alias("a"), F.when(F.col("s_suppkey") % 3 == 1, "acme corporation").otherwise(of("severna park elementary school", "", "john smith")).alias("b"))
    return d.select("s_suppkey", (E.token_ratio_udf("a", "b") >= E.TOKEN_RATIO).alias("suggested"))


@query("e3_typo", "WITH " + PERSON_SQL + " SELECT id, CASE id % 4 WHEN 0 THEN len(f) > 2 WHEN 3 THEN len(l) > 2 ELSE false END AS typo FROM p")
def typo(spark, sf):
    """A doubled last letter of the first name, equal names, a single name, and a letter more in the last name."""
    p = _people(spark, sf)
    first, last, both = F.lower("f"), F.lower("l"), F.concat_ws(" ", F.lower("f"), F.lower("l"))
    other = F.when(F.col("id") % 4 == 0, F.concat(first, F.substring(first, -1, 1), F.lit(" "), last)).when(F.col("id") % 4 == 1, both).when(F.col("id") % 4 == 2, first).otherwise(F.concat(both, F.lit("s")))
    return p.select("id", E.is_typo(both, other).alias("typo"))


@query("e4_initials", "WITH " + PERSON_SQL + " SELECT id, id % 3 < 2 AS same FROM p")
def initials(spark, sf):
    p = _people(spark, sf)
    initial = F.concat(F.substring(F.lower("f"), 1, 1), F.lit(" "), F.lower("l"))
    whole = F.concat_ws(" ", F.lower("f"), F.lower("l"))
    return p.select("id", E.is_initial(F.when(F.col("id") % 3 == 0, initial).otherwise(whole), F.when(F.col("id") % 3 == 1, initial).when(F.col("id") % 3 == 2, F.concat(F.lit("x "), F.lower("l"))).otherwise(whole)).alias("same"))


ENTITY_SQL = """e AS (SELECT s_suppkey AS id, 'a' || substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 7) AS f, 'b' || substr(md5(CAST(s_suppkey AS VARCHAR)), 8, 7) AS l FROM supplier)"""


def _match_tables(spark, sf):
    """Suppliers as entities of two words that resemble no other's, and customers as candidates that name one in six ways."""
    s = C.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.md5(F.col("s_suppkey").cast("string").cast("binary")).alias("h"))
    s = s.select("entity_id", F.concat(F.lit("a"), F.substring("h", 1, 7)).alias("f"), F.concat(F.lit("b"), F.substring("h", 8, 7)).alias("l"), F.when(F.col("entity_id") % 2 == 1, "person").otherwise("org").alias("kind"), F.col("entity_id").cast("string").alias("n"))
    e = s.select("entity_id", F.concat_ws(" ", "f", "l").alias("norm"), "kind", F.array(F.concat(F.lit("alias "), "n")).alias("aliases"), F.array(F.concat(F.lit("m"), "n", F.lit("@x.com"))).alias("emails"))
    count = s.agg(F.count(F.lit(1)).alias("suppliers"))
    c = C.read(spark, sf, "customer").crossJoin(F.broadcast(count)).select(F.col("c_custkey").alias("candidate_id"), (F.col("c_custkey") % F.col("suppliers")).alias("entity_id"))  # count: one row
    c = c.join(s, "entity_id").withColumn("way", (F.col("candidate_id") % 6).cast("int"))
    other = F.concat(F.lit("zz"), F.substring(F.md5(F.concat(F.lit("c"), F.col("candidate_id").cast("string")).cast("binary")), 1, 12))
    names = F.array(F.concat_ws(" ", "f", "l"), F.concat(F.lit("alias "), "n"), other, F.concat("f", F.lit("x "), "l"), F.concat(F.lit("a "), "l"), other)
    return c.select("candidate_id", F.get(names, F.col("way")).alias("norm"), "kind", F.when(F.col("way") == 2, F.array(F.concat(F.lit("m"), "n", F.lit("@x.com")))).otherwise(F.array().cast("array<string>")).alias("emails")), e


@query("e5_match", "SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 6 < 5 THEN c_custkey % (SELECT count(*) FROM supplier) END AS entity_id, ['exact', 'alias', 'email', 'typo', 'suggest', 'create'][c_custkey % 6 + 1] AS how FROM customer")
def match(spark, sf):
    return E.match(*_match_tables(spark, sf)).select("candidate_id", "entity_id", "how")


@query("e6_persist_entities")
def persist(spark, sf):
    """Names of mail authors become entities: equal normal forms are one, typo variants join (components, whatever the order)."""
    from lexfold.operators.components import components as cc

    raw = C.read(spark, sf, "supplier").select(F.concat(F.lit("Mr. Agent "), F.regexp_replace("s_name", "#0*", " no")).alias("name"))
    n = raw.select(E.normal_name(F.col("name")).alias("norm")).distinct()
    pairs = E.typo_pairs(n.select(F.col("norm").alias("a")), n.select(F.col("norm").alias("b")))
    labels = cc(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return n.select("norm").distinct().join(labels.withColumnRenamed("node", "norm"), "norm", "left").select("norm", F.coalesce("label", "norm").alias("entity"))


def document_candidates(spark, sf):
    """Candidates of documents in order: each customer's name in one of several spellings, with forms and addresses."""
    c = C.read(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("seq"), (F.col("c_custkey") % 3).cast("int").alias("production_id"), "c_nationkey", (F.col("c_custkey") * 7 % 11).alias("way"))
    last = F.concat(F.element_at(F.array(*map(F.lit, LAST)), (F.col("c_nationkey") % 5 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("", "ton", "son", "berg", "s"))), (F.floor(F.col("c_nationkey") / 5) % 5 + 1).cast("int")))
    first = F.element_at(F.array(*map(F.lit, FIRST)), (F.col("seq") % 5 + 1).cast("int"))
    name = F.when(F.col("way") < 4, F.concat(first, F.lit(" "), last)).when(F.col("way") < 6, F.concat(last, F.lit(", "), first)).when(F.col("way") == 6, F.concat(F.lit("Dr. "), first, F.lit(" "), last, F.lit("s"))).when(F.col("way") == 7, F.concat(F.substring(first, 1, 1), F.lit(". "), last)).when(F.col("way") == 8, last).otherwise(F.concat(first, F.lit("e "), last))
    mail = F.concat(F.lower(first), F.lit("@"), F.lower(last), F.lit(".com"))
    return c.select("seq", "production_id", F.when(F.col("seq") % 13 == 0, "org").otherwise("person").alias("kind"), name.alias("name"), F.when(F.col("seq") % 4 == 0, "counsel").alias("role"), F.array(name, F.concat(F.lit("Mr. "), last)).alias("forms"), F.when(F.col("way") > 8, F.array(mail)).otherwise(F.array().cast("array<string>")).alias("emails"))


@query("e6_persisted_decisions")
def persisted_decisions(spark, sf):
    """Which entity each candidate went to, document by document, and how."""
    return PE.decided(document_candidates(spark, sf))[0]


@query("e6_persisted_entities")
def persisted_entities(spark, sf):
    """The entities then, with aliases and addresses, and the earlier one each is most like."""
    _, entities = PE.decided(document_candidates(spark, sf))
    hints = PE.suggestions(entities).select(F.col("entity_a").alias("entity_id"), F.col("entity_b").alias("suggested"), "score")
    return entities.join(hints, "entity_id", "left").select("entity_id", "production_id", "kind", "name", "role", F.array_join("aliases", "|").alias("aliases"), F.array_join("emails", "|").alias("emails"), "suggested", "score")


EXTRACTION = T.StructType().add("entities", T.ArrayType(T.StructType().add("name", "string").add("type", "string").add("surface_forms", T.ArrayType(T.StringType()))))


@query("e7_extraction_parse", "WITH " + PERSON_SQL + " SELECT id, CASE id % 4 WHEN 3 THEN [] ELSE list_filter([f || ' ' || l, 'Acme'], lambda x: id % 4 <> 2 OR x <> 'Acme') END AS names FROM p")
def extraction(spark, sf):
    """At most 50 entities, of known types, with usable names; answers that are no JSON have none."""
    p = _people(spark, sf)
    people = F.format_string('{"name": " %s %s ", "type": "person"}, {"name": "Robot", "type": "robot"}, {"name": "\\"Them.\\"", "type": "person"}, {"name": "C.", "type": "person"}', "f", "l")
    company = F.when(F.col("id") % 4 == 2, F.lit('{"name": "others", "type": "org"}')).otherwise(F.lit('{"name": "Acme", "type": "org"}'))
    body = F.concat(F.lit('{"entities": ['), people, F.lit(", "), company, F.lit("]}"))
    raw = F.when(F.col("id") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("id") % 4 == 3, "no entities here").otherwise(body)
    bare = F.regexp_replace(F.regexp_replace("raw", r"^```[^\n]*\n", ""), r"\n?```$", "")
    ok = lambda e: e["type"].isin("person", "org") & E.usable_name(F.btrim(e["name"]))
    kept = F.transform(F.filter(F.slice(F.coalesce(F.from_json(bare, EXTRACTION)["entities"], F.array().cast(EXTRACTION["entities"].dataType)), 1, 50), ok), lambda e: F.btrim(e["name"]))
    return p.select("id", raw.alias("raw")).select("id", kept.alias("names"))


@query("e8_slice_merge", "SELECT l_suppkey AS entity, list(DISTINCT l_shipmode ORDER BY l_shipmode) AS forms FROM (SELECT l_suppkey, l_linestatus || l_returnflag AS l_shipmode FROM lineitem) GROUP BY l_suppkey")
def slice_merge(spark, sf):
    li = C.read(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.collect_set(F.concat("l_linestatus", "l_returnflag")).alias("forms"))
    return li.groupBy(F.col("l_suppkey").alias("entity")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("forms")))).alias("forms"))


def model_answers(spark, sf):
    """Answers on two slices of each order: people, events and relationships, more of them than one answer may bring in.

    Slices of an order come one after the other: what is merged needs no other shuffle, and no sort of whole answers.
    """
    o = C.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("slice"))
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", "slice")  # a small table is one task's otherwise
    each = lambda form: F.array_join(F.slice(F.array(*(F.lit(form(k)) for k in range(45))), 1, (F.col("id") % 45 + 1).cast("int")), ",")
    people = [each(lambda k, s=s, role=role: f'{{"name": "Person {k * 2 + s}", "type": "person", "surface_forms": ["P {k}", "She"], "role": "{role}"}}') for s, role in enumerate(("", "clerk"))]
    events = each(lambda k: f'{{"description": "Event {k}", "type": "{"party" if k % 2 else "filing"}", "date": "2020-01-01", "significance": {k % 9}}}')
    related = each(lambda k: f'{{"source": "Person {k}", "target": "Person {k % 3}", "type": "family"}}')
    raw = F.concat(F.lit('{"entities": ['), F.when(F.col("slice") == 0, people[0]).otherwise(people[1]), F.lit('], "events": ['), events, F.lit('], "relationships": ['), related, F.lit("]}"))
    return o.select("id", "slice", F.when(F.col("id") % 7 == 0, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).when(F.col("id") % 7 == 1, "none").otherwise(raw).alias("raw"))


ANSWERS_SQL = "o AS (SELECT o_orderkey AS id, o_orderkey % 45 AS n FROM orders WHERE o_orderkey % 7 <> 1), k AS (SELECT id, n, unnest(range(0, n + 1)) AS k FROM o)"


@query("e8_merged_entities", "WITH " + ANSWERS_SQL + """ SELECT id, 'Person ' || (2 * k + s) AS name, 'P ' || k AS forms, CASE WHEN s = 1 THEN 'clerk' END AS role FROM k, (VALUES (0), (1)) v(s)""")
def merged_entities(spark, sf):
    entities, _, _ = EX.merged(EX.parsed(model_answers(spark, sf)))
    return entities.select("id", "name", F.array_join("surface_forms", "|").alias("forms"), "role")


@query("e8_merged_events", "WITH " + ANSWERS_SQL + " SELECT id, 'Event ' || k AS description, CASE WHEN k % 2 = 0 THEN 'filing' ELSE 'other' END AS type, greatest(1, least(5, k % 9)) AS significance FROM k WHERE k < 30")
def merged_events(spark, sf):
    """Thirty an answer at most; both slices say the same."""
    _, events, _ = EX.merged(EX.parsed(model_answers(spark, sf)))
    return events.select("id", "description", "type", F.col("significance").cast("bigint").alias("significance"))


@query("e8_merged_relationships", "WITH " + ANSWERS_SQL + " SELECT id, 'Person ' || k AS source, 'Person ' || (k % 3) AS target FROM k WHERE k < 30 AND k <> k % 3")
def merged_relationships(spark, sf):
    _, _, related = EX.merged(EX.parsed(model_answers(spark, sf)))
    return related.select("id", "source", "target")


@query("e9_mentions")
def mentions(spark, sf):
    return E.mentions(C.read(spark, sf, "documents").select("doc_id", "text"), ["the", "thing", "in the", "que la"])


@query("e10_event_date", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 2 THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS date,
  ['day','month','year','unknown','unknown','unknown'][o_orderkey % 6 + 1] AS precision_ FROM orders""")
def event_date(spark, sf):
    """Days, months and years are dates; days that are none, words and nothing are not."""
    forms = F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM"), F.date_format("o_orderdate", "' 'yyyy' '"), F.date_format("o_orderdate", "yyyy-'02-30'"), F.date_format("o_orderdate", "MMMM d"), F.lit(None).cast("string"))
    date, precision = N.event_date(F.col("raw"))
    return C.read(spark, sf, "orders").select("o_orderkey", F.get(forms, (F.col("o_orderkey") % 6).cast("int")).alias("raw")).select("o_orderkey", date.alias("date"), precision.alias("precision_"))


@query("e11_human_date", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') END AS iso FROM orders")
def human_date(spark, sf):
    """1/2/2019-like edits: month, day and year in order, loosely written."""
    forms = F.array(F.date_format("o_orderdate", "M/d/yyyy"), F.date_format("o_orderdate", "yyyy-M"), F.date_format("o_orderdate", "yyyy"), F.lit("soon"))
    d = C.read(spark, sf, "orders").select("o_orderkey", F.get(forms, (F.col("o_orderkey") % 4).cast("int")).alias("raw"))
    m, ym, y = (F.regexp_extract("raw", p, 0) != "" for p in (r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{4}-\d{1,2}$", r"^\d{4}$"))
    part = lambda sep, i: F.lpad(F.split_part("raw", F.lit(sep), F.lit(i)), 2, "0")
    return d.select("o_orderkey", F.when(m, F.concat_ws("-", F.split_part("raw", F.lit("/"), F.lit(3)), part("/", 1), part("/", 2))).when(ym, F.concat_ws("-", F.substring("raw", 1, 4), part("-", 2))).when(y, F.col("raw")).alias("iso"))


@query("e12_addresses", "SELECT c_custkey, c_name AS name, lower(c_mktsegment) || '@x.com' AS address FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, '', 'c' || c_custkey || '@y.org' FROM customer WHERE c_custkey % 5 > 0")
def addresses(spark, sf):
    """Names with addresses, bare addresses after a semicolon, and what is no address."""
    header = F.concat(F.lit('"'), "c_name", F.lit('" <'), "c_mktsegment", F.lit("@X.com>; C"), F.col("c_custkey").cast("string"), F.lit("@Y.org, nobody"))
    d = C.read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, header).alias("header"))
    return d.select("c_custkey", F.explode(E.addresses("header")).alias("a")).select("c_custkey", "a.name", "a.address")


EDGES_SQL = "edges AS (SELECT DISTINCT l_partkey % 50 AS source, l_suppkey % 50 AS target FROM lineitem)"


def _edges(spark, sf):
    return C.read(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("source"), (F.col("l_suppkey") % 50).alias("target")).distinct()


# Merges of entity k + 25 into k, for every third k. Offsets repeat or are null, so that some mentions collide and some do not.
MERGE_SQL = """mm AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 50 AS entity_id, CASE WHEN l_linenumber % 4 <> 0 THEN l_linenumber % 2 END AS start_offset FROM lineitem),
ee AS (SELECT DISTINCT l_partkey % 50 AS source, l_suppkey % 50 AS target, l_returnflag AS kind, l_orderkey % 100 AS doc_id FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50),
mv AS (SELECT k + 25 AS loser, k AS winner FROM (SELECT unnest(range(0, 25, 3)) AS k)),
m2 AS (SELECT doc_id, start_offset, coalesce(winner, entity_id) AS entity_id, winner IS NOT NULL AS moved, entity_id AS old FROM mm LEFT JOIN mv ON loser = entity_id),
m3 AS (SELECT * FROM m2 WHERE NOT moved OR NOT EXISTS (SELECT 1 FROM mm o WHERE o.entity_id = m2.entity_id AND o.doc_id = m2.doc_id AND o.start_offset = m2.start_offset)),
e2 AS (SELECT kind, doc_id, coalesce(a.winner, source) AS source, coalesce(b.winner, target) AS target, a.winner IS NOT NULL OR b.winner IS NOT NULL AS moved, source AS old_source, target AS old_target FROM ee LEFT JOIN mv a ON a.loser = source LEFT JOIN mv b ON b.loser = target),
e3 AS (SELECT * FROM e2 WHERE NOT moved OR (source <> target AND NOT EXISTS (SELECT 1 FROM e2 o WHERE NOT o.moved AND o.source = e2.source AND o.target = e2.target AND o.kind = e2.kind AND o.doc_id = e2.doc_id)))"""


def _merge_tables(spark, sf):
    li = C.read(spark, sf, "lineitem")
    row_id = lambda *columns: F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    m = li.select((F.col("l_partkey") % 50).alias("entity_id"), F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber") % 2).cast("bigint").alias("start_offset")).distinct()
    m = m.select(row_id("entity_id", "doc_id", "start_offset").alias("id"), "*")
    e = li.select((F.col("l_partkey") % 50).alias("source"), (F.col("l_suppkey") % 50).alias("target"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") % 100).alias("doc_id")).filter("source <> target").distinct()
    e = e.select(row_id("source", "target", "kind", "doc_id").alias("id"), "*")
    merges = spark.range(0, 25, 3).select((F.col("id") + 25).alias("loser"), F.col("id").alias("winner"))
    return m, e, merges


def _entity_counts(m, e):
    mentions = m.groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"))
    ends = e.select(F.col("source").alias("entity_id")).union(e.select("target")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("edges"))
    return mentions.join(ends, "entity_id", "full").select("entity_id", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("edges", F.lit(0)).alias("edges"))


COUNT_SQL = """SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, coalesce(mentions, 0) AS mentions, coalesce(edges, 0) AS edges FROM (SELECT {m} AS entity_id, count(*) AS mentions FROM m3 GROUP BY 1) a
  FULL JOIN (SELECT entity_id, count(*) AS edges FROM (SELECT {s} AS entity_id FROM e3 UNION ALL SELECT {t} FROM e3) GROUP BY 1) b ON a.entity_id = b.entity_id"""


@query("e13_merge", "WITH " + MERGE_SQL + COUNT_SQL.format(m="entity_id", s="source", t="target"))
def merge(spark, sf):
    m, e, _ = G.merge(*_merge_tables(spark, sf))
    return _entity_counts(m, e)


@query("e14_undo", "WITH " + MERGE_SQL + """, m4 AS (SELECT old AS entity_id FROM m3 UNION ALL SELECT coalesce(winner, entity_id) FROM mm LEFT JOIN mv ON loser = entity_id WHERE doc_id % 10 = 0)
  """ + COUNT_SQL.format(m="entity_id", s="old_source", t="old_target").replace("FROM m3", "FROM m4"))
def undo(spark, sf):
    """After a merge new mentions come in, those of the merged entity under its winner; the undo leaves them there."""
    m, e, merges = _merge_tables(spark, sf)
    merged, edges, journal = G.merge(m, e, merges)
    later = m.filter("doc_id % 10 = 0").join(merges, F.col("entity_id") == F.col("loser"), "left").select(F.concat(F.lit("later/"), "id").alias("id"), F.coalesce("winner", "entity_id").alias("entity_id"), "doc_id", "start_offset")
    return _entity_counts(*G.undo(merged.unionByName(later), edges, journal))


@query("e13_aliases", """WITH n AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN ['alias ' || s_suppkey % 7, s_name] ELSE ['alias ' || s_suppkey % 5] END AS al FROM supplier)
  SELECT w.id AS entity_id, CASE WHEN l.id IS NULL THEN w.al ELSE w.al || list_filter([l.name] || l.al, lambda x, i: NOT list_contains(w.al, x) AND list_position([l.name] || l.al, x) = i) END AS aliases
  FROM n w LEFT JOIN n l ON w.id % 2 = 1 AND l.id = w.id + 1 WHERE NOT (w.id % 2 = 0)""")
def merge_aliases(spark, sf):
    s = C.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    alias = lambda n: F.concat(F.lit("alias "), (F.col("entity_id") % n).cast("string"))
    s = s.withColumn("aliases", F.when(F.col("entity_id") % 2 == 0, F.array(alias(7), F.col("name"))).otherwise(F.array(alias(5))))
    return G.aliases_after(s, s.filter("entity_id % 2 = 0").select(F.col("entity_id").alias("loser"), (F.col("entity_id") - 1).alias("winner")))


TYPO_ENTITIES_SQL = "e AS (SELECT s_suppkey AS id, s_suppkey // 4 AS g, s_suppkey % 4 AS k, s_nationkey + 1 AS n, s_nationkey % 7 = 0 AS org FROM supplier)"


def _typo_entities(spark, sf):
    """Companies whose names grow by a letter within groups of four, and suggestions to merge each with the next two."""
    s = C.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_suppkey") / 4).alias("g"), (F.col("s_suppkey") % 4).alias("k"), (F.col("s_nationkey") + 1).alias("n"), (F.col("s_nationkey") % 7 == 0).alias("org"))
    name = F.concat(F.lit("Stone"), F.expr("repeat('e', cast(k as int))"), F.lit(" No"), F.col("g").cast("string"))
    e = s.select(F.col("id").alias("entity_id"), F.lit(1).alias("production_id"), F.when(F.col("org"), "org").otherwise("person").alias("kind"), name.alias("name"), F.col("n").alias("mentions"))
    pairs = s.select(F.col("id").alias("a"), "g").join(s.select(F.col("id").alias("b"), "g"), "g").filter("b > a AND b - a <= 2")
    return e, pairs.select(((F.col("a") * 7 + F.col("b")) % 11 * 1_000_000_000 + F.col("a") * 4 + F.col("b") - F.col("a")).alias("at"), "a", "b")


@query("e15_auto_typos", "WITH RECURSIVE " + TYPO_ENTITIES_SQL + """,
  s AS (SELECT a.id AS a, b.id AS b, b.k - a.k = 1 AND a.org = b.org AS typo, row_number() OVER (ORDER BY (a.id * 7 + b.id) % 11, a.id, b.id) AS no FROM e a JOIN e b ON a.g = b.g AND b.id > a.id AND b.id - a.id <= 2),
  fold(no, gone, n) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(w BIGINT, l BIGINT)[]), (SELECT list(CAST(n AS BIGINT) ORDER BY id) FROM e)
    UNION ALL SELECT f.no + 1, CASE WHEN hit THEN list_append(gone, {'w': w, 'l': l}) ELSE gone END, CASE WHEN hit THEN list_transform(n, lambda x, i: CASE WHEN i = w + 1 THEN x + n[l + 1] ELSE x END) ELSE n END
    FROM (SELECT f.no, gone, n, CASE WHEN n[a + 1] >= n[b + 1] THEN a ELSE b END AS w, CASE WHEN n[a + 1] >= n[b + 1] THEN b ELSE a END AS l,
          typo AND len(list_filter(gone, lambda x: x.l = a OR x.l = b)) = 0 AS hit FROM fold f JOIN s ON s.no = f.no + 1) f),
  merged AS (SELECT unnest(gone, recursive := true) FROM (SELECT gone FROM fold ORDER BY no DESC LIMIT 1))
  SELECT a, b, CASE WHEN EXISTS (SELECT 1 FROM merged WHERE (w = a AND l = b) OR (w = b AND l = a)) THEN 'accepted' WHEN a IN (SELECT l FROM merged) OR b IN (SELECT l FROM merged) THEN 'rejected' ELSE 'pending' END AS status FROM s""")
def auto_typos(spark, sf):
    """Safe typos merge in order, into the one of more mentions; who has gone merges no more."""
    e, suggestions = _typo_entities(spark, sf)
    return RV.auto_resolve(suggestions, e).select("a", "b", "status")


CO_SQL = "dm AS (SELECT DISTINCT doc_id, entity_id FROM mentions), co AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS documents FROM dm a JOIN dm b ON a.doc_id = b.doc_id AND a.entity_id < b.entity_id GROUP BY 1, 2)"


@query("e16_cooccurrence", C.with_sql(C.MENTIONS_SQL, CO_SQL) + "SELECT CASE WHEN a = 7 THEN b ELSE a END AS entity_id, documents FROM co WHERE a = 7 OR b = 7 ORDER BY documents DESC, entity_id LIMIT 10")
def cooccurrence(spark, sf):
    c = G.cooccurrence(C.mentions(spark, sf)).filter("a = 7 OR b = 7")
    return c.select(F.when(F.col("a") == 7, F.col("b")).otherwise(F.col("a")).alias("entity_id"), "documents").orderBy(F.desc("documents"), "entity_id").limit(10)


@query("e17_graph", C.with_sql(C.MENTIONS_SQL, EDGES_SQL, CO_SQL) + """, top AS (SELECT entity_id FROM mentions GROUP BY entity_id ORDER BY count(DISTINCT doc_id) DESC, entity_id LIMIT 30),
  st AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS weight FROM edges WHERE source <> target AND source IN (SELECT entity_id FROM top) AND target IN (SELECT entity_id FROM top) GROUP BY 1, 2)
  SELECT a, b, 'stated' AS kind, weight FROM st UNION ALL SELECT a, b, 'cooccurrence', documents FROM co WHERE documents >= 60 AND a IN (SELECT entity_id FROM top) AND b IN (SELECT entity_id FROM top) AND (a, b) NOT IN (SELECT (a, b) FROM st)""")
def graph(spark, sf):
    return G.graph(C.mentions(spark, sf), _edges(spark, sf), 30, 60)


@query("e18_timeline", """SELECT o_custkey AS case_id, o_orderkey AS event_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END NULLS LAST, o_orderkey) AS place,
  coalesce((SELECT list(DISTINCT l_returnflag ORDER BY l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey), []) AS participants FROM orders WHERE coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 6 END, 3) >= 3""")
def timeline(spark, sf):
    o = C.read(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("date"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 6).alias("significance"))
    return G.timeline(o, C.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("name")), 3)


@query("e19_entity_list", C.with_sql(C.MENTIONS_SQL) + "SELECT entity_id, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM mentions GROUP BY entity_id ORDER BY documents DESC, entity_id LIMIT 20 OFFSET 10")
def entity_list(spark, sf):
    m = C.mentions(spark, sf).groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("documents"))
    return m.orderBy(F.desc("documents"), "entity_id").offset(10).limit(20)


@query("e20_key_players", "WITH " + ENTITY_SQL + " SELECT id AS asked, CASE WHEN id % 3 < 2 THEN id END AS entity_id FROM e")
def key_players(spark, sf):
    """Names in capitals, aliases and strangers, looked up among normal names and aliases of all entities."""
    _, e = _match_tables(spark, sf)
    known = e.select("entity_id", F.explode(F.concat(F.array("norm"), "aliases")).alias("norm")).groupBy("norm").agg(F.min("entity_id").alias("entity_id"))
    name = F.get(F.array(F.concat(F.lit("Mr. "), F.upper("norm")), F.concat(F.lit("ALIAS, "), F.element_at(F.split(F.element_at("aliases", 1), " "), 2)), F.concat(F.lit("Nobody "), "norm")), (F.col("entity_id") % 3).cast("int"))
    swapped = F.when(F.col("entity_id") % 3 == 1, F.concat(F.element_at(F.split(F.element_at("aliases", 1), " "), 2), F.lit(", Alias"))).otherwise(name)
    asked = e.select(F.col("entity_id").alias("asked"), E.normal_name(swapped).alias("norm"))
    return asked.join(known, "norm", "left").select("asked", "entity_id")


@query("e21_staleness", "SELECT o_custkey, n, CASE WHEN o_custkey % 3 = 0 THEN true ELSE n >= 1.5 * (o_custkey % 20) OR n >= o_custkey % 20 + 10 END AS stale FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def staleness(spark, sf):
    """An overview is missing, or now there is half as much again, or ten more."""
    seen = F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 20)
    d = C.read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return d.select("o_custkey", "n", (seen.isNull() | (F.col("n") >= 1.5 * seen) | (F.col("n") >= seen + 10)).alias("stale"))


@query("e22_merge_evidence", C.with_sql(C.MENTIONS_SQL, CO_SQL) + "SELECT a, b, documents AS shared, (SELECT count(*) FROM dm WHERE entity_id = a) AS of_a, (SELECT count(*) FROM dm WHERE entity_id = b) AS of_b FROM co")
def evidence(spark, sf):
    m = C.mentions(spark, sf)
    n = m.groupBy("entity_id").agg(F.countDistinct("doc_id").alias("n"))
    c = G.cooccurrence(m)
    return c.join(n.select(F.col("entity_id").alias("a"), F.col("n").alias("of_a")), "a").join(n.select(F.col("entity_id").alias("b"), F.col("n").alias("of_b")), "b").select("a", "b", F.col("documents").alias("shared"), "of_a", "of_b")


def merge_docket(spark, sf):
    """verdicts, suggestions, entities and snippets: companies in groups of four, reviewed twice, some to be renamed."""
    e, pairs = _typo_entities(spark, sf)
    suggestions = pairs.select(F.col("at").alias("suggestion_id"), F.lit(1).alias("production_id"), "a", "b", F.when(F.col("a") % 9 == 0, "accepted").otherwise("pending").alias("status"))
    twice = suggestions.select("suggestion_id", "a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    correction = F.struct(F.col("b").alias("entity_id"), F.when(F.col("a") % 2 == 0, F.concat(F.lit("stone no"), F.floor(F.col("b") / 4).cast("string"))).otherwise("Nowhere Ltd").alias("corrected_name"), F.lit(0.9).alias("confidence"))
    verdict = F.when((F.col("a") + F.col("again")) % 5 == 0, "distinct").when((F.col("b") + F.col("again")) % 7 == 0, "unsure").otherwise("merge")
    v = twice.select((F.col("again") * 10**11 + F.col("suggestion_id")).alias("at"), "suggestion_id", verdict.alias("verdict"), F.when(F.col("a") % 3 == 0, F.col("b")).alias("keep_id"), (F.lit(0.8) + F.col("b") % 4 * 0.05).alias("confidence"), F.when(F.col("b") % 3 == 0, F.array(correction)).otherwise(F.array().cast("array<struct<entity_id:bigint,corrected_name:string,confidence:double>>")).alias("corrections"))
    snippets = e.filter("entity_id % 4 < 3").select("entity_id", F.concat(F.lit("signed for  STONE\nno"), F.floor(F.col("entity_id") / 4).cast("string"), F.lit(" today")).alias("snippet"))
    return v, suggestions, e.withColumn("aliases", F.array(F.lit("the company"))), snippets


@query("e23_merge_verdicts")
def verdicts(spark, sf):
    """What becomes of each verdict, in order: merges past the gate, dismissals without one, names that snippets attest."""
    done, _ = RV.apply_merge_verdicts(*merge_docket(spark, sf))
    return done.select("at", "outcome", "keep", "drop", "renamed", F.size("reasons").alias("reasons"))


@query("e23_reviewed_entities")
def reviewed(spark, sf):
    """The entities after all verdicts, with their aliases and where they went."""
    _, after = RV.apply_merge_verdicts(*merge_docket(spark, sf))
    return after.select("entity_id", "name", F.array_join("aliases", "|").alias("aliases"), "mentions", "merged_into")


@query("e24_timeline_verdicts", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'kept' WHEN c < 0.8 THEN 'kept' WHEN o_orderkey % 3 = 0 THEN 'deleted' WHEN o_orderkey % 3 = 1 THEN 'rerated' ELSE 'edited' END AS outcome FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0 AS c FROM orders)")
def timeline_verdicts(spark, sf):
    """Verdicts below 0.8, and any on what a human has edited (every tenth), change nothing."""
    c, k = (F.col("o_orderkey") % 100) / 100.0, F.col("o_orderkey") % 3
    human = F.col("o_orderkey") % 10 == 0
    return C.read(spark, sf, "orders").select("o_orderkey", F.when(human | (c < 0.8), "kept").when(k == 0, "deleted").when(k == 1, "rerated").otherwise("edited").alias("outcome"))


# --- model wrappers ------------------------------------------------------------------------------------------------


def timeline_docket(spark, sf):
    """verdicts and events: orders as events, of which five in a row get three verdicts that build on one another."""
    o = C.read(spark, sf, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"), "o_custkey", F.col("o_orderdate").cast("date").alias("date"))
    events = o.select(F.col("id").alias("event_id"), F.lit("meeting").alias("event_type"), F.concat(F.lit("event "), F.col("id").cast("string")).alias("description"), "date", F.lit("day").alias("precision"), F.lit(3).alias("significance"), (F.col("id") % 17 == 0).alias("human_edited"), F.array((F.col("o_custkey") % 5).cast("bigint")).alias("participants"))
    kind = F.element_at(F.array(*map(F.lit, ("merge", "delete", "edit", "rerate", "merge"))), ((F.col("id") + F.col("turn")) % 5 + 1).cast("int"))
    v = o.filter("id % 5 < 3").select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    v = v.select((F.col("id") * 7 % 1013 * 10**10 + F.col("id") * 2 + F.col("turn")).alias("at"), kind.alias("kind"), (F.lit(0.75) + F.col("id") % 6 * 0.05).alias("confidence"), F.col("id").alias("event_id"), F.array("id", F.col("id") + 1).alias("event_ids"), (F.col("id") + F.col("turn")).alias("keep_id"), F.when(F.col("id") % 4 == 0, "1999-01-02").when(F.col("id") % 4 == 1, "soon").alias("date"), F.lit("month").alias("precision"), F.when(F.col("id") % 3 == 0, "corrected").alias("description"), F.when(F.col("id") % 11 == 0, "party").when(F.col("id") % 2 == 0, "payment").alias("event_type"), (F.col("id") % 7).cast("int").alias("significance"))
    return v, events


@query("e24_timeline_fold")
def timeline_fold(spark, sf):
    """What becomes of each verdict on events that other verdicts merge, delete, edit and rerate."""
    done, _ = RV.apply_timeline_verdicts(*timeline_docket(spark, sf))
    return done


@query("e24_reviewed_timeline")
def reviewed_timeline(spark, sf):
    """The events that verdicts name, after all of them."""
    _, after = RV.apply_timeline_verdicts(*timeline_docket(spark, sf))
    return after.withColumn("participants", F.array_join(F.transform("participants", lambda p: p.cast("string")), ","))


@query("m1_truncation", "SELECT doc_id, len(substr(text, 1, 12000)) AS summary, len(substr(text, 1, 8000)) AS similar_terms, len(substr(text, 1, 4000)) AS title FROM documents")
def truncation(spark, sf):
    n = lambda k: F.char_length(F.substring("text", 1, k)).cast("bigint")
    return C.read(spark, sf, "documents").select("doc_id", n(12000).alias("summary"), n(8000).alias("similar_terms"), n(4000).alias("title"))


@query("m2_title_filter", """SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 2) THEN NULL WHEN len(t) > 200 THEN left(t, 197) || '...' ELSE t END AS title FROM (SELECT doc_id, trim(text, chr(34) || chr(39)) AS t FROM documents)""")
def title_filter(spark, sf):
    """Quotes around a title go, refusals and empty ones too; long ones are cut."""
    raw = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("I cannot tell from "), "text")).when(F.col("doc_id") % 5 == 2, F.lit("''")).when(F.col("doc_id") % 5 == 3, F.concat(F.lit('"'), "text", F.lit("'"))).otherwise(F.col("text"))
    t = F.btrim(raw, F.lit("\"'"))
    refusal = F.lower(t).rlike("|".join(TITLE_REFUSALS))
    return C.read(spark, sf, "documents").select("doc_id", F.when((t == "") | refusal, None).when(F.char_length(t) > 200, F.concat(F.substring(t, 1, 197), F.lit("..."))).otherwise(t).alias("title"))


@query("m3_summaries", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, 'summary of ' || len(text) AS summary FROM docs WHERE len(trim(text)) > 0")
def summaries(spark, sf):
    """Blank texts are skipped; the model is a stand-in."""
    d = C.documents(spark, sf).filter(F.btrim("text") != "").select("doc_id", "text")

    def model(frames):
        for f in frames:
            yield f.assign(summary=[f"summary of {len(t)}" for t in f["text"]])[["doc_id", "summary"]]

    return d.mapInPandas(model, "doc_id long, summary string")


@query("m4_search_string", r"""SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 4 = 3 OR trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN NULL ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')[:5])), ' AND ') END AS query FROM conversations""")
def search_string(spark, sf):
    """The model is a stand-in that joins the first long words; it fails for every fourth turn."""

    def model(text):
        turn, _, said = text.partition(" ")
        if int(turn) % 4 == 3:
            raise TimeoutError
        return " AND ".join(sorted(set(re.findall("[a-z]{4,}", said.lower())[:5])))

    c = C.read(spark, sf, "conversations")
    q = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.btrim("text") != "", F.concat_ws(" ", "turn", "text")).otherwise("").alias("text"))
    out = W.search_strings(q, model)
    return out.select("id", "query")


@query("m4_similar_terms", r"""SELECT doc_id AS id, nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(left(text, 8000)), '[a-z]{7,}')[-6:])), ' OR '), '') AS terms FROM documents""")
def similar_terms(spark, sf):
    """A stand-in model names the last long words of what it reads."""
    return W.similar_terms(C.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), lambda t: " OR ".join(sorted(set(re.findall("[a-z]{7,}", t.lower())[-6:]))))


@query("m5_title_fallback", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN 'Given ' || doc_id END, regexp_extract(native_path, '([^/]*)\\.[^.]*$', 1), left(text, 200)) AS title FROM docs")
def title_fallback(spark, sf):
    stem = F.regexp_extract("native_path", r"([^/]*)\.[^.]*$", 1)
    return C.documents(spark, sf).select("doc_id", F.coalesce(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Given "), F.col("doc_id").cast("string"))), stem, F.substring("text", 1, 200)).alias("title"))


@query("m6_brief_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 1 THEN 'about ' || o_orderkey END AS overview, CASE WHEN o_orderkey % 4 > 1 THEN least(6, o_orderkey % 9) ELSE 0 END AS players FROM orders")
def brief_parse(spark, sf):
    """Answers with too many players, without an overview, and that are no JSON."""
    many = F.array_join(F.transform(F.when(F.col("o_orderkey") % 9 > 0, F.sequence(F.lit(1).cast("bigint"), F.col("o_orderkey") % 9)).otherwise(F.array().cast("array<bigint>")), lambda i: F.concat(F.lit('"p'), i.cast("string"), F.lit('"'))), ", ")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('{"players": ['), many, F.lit("]}"))).when(F.col("o_orderkey") % 4 == 1, "no answer").otherwise(F.concat(F.lit('{"overview": "about '), F.col("o_orderkey").cast("string"), F.lit('", "players": ['), many, F.lit("]}")))
    d = C.read(spark, sf, "orders").select("o_orderkey", F.from_json(raw, "overview string, players array<string>").alias("p"))
    return d.select("o_orderkey", "p.overview", F.when(F.col("p.overview").isNotNull(), F.size(F.slice("p.players", 1, 6))).otherwise(0).cast("bigint").alias("players"))


@query("m7_pending_stages", "SELECT o_orderkey, list_filter(['clustering','summaries','entities','timeline_review','brief'], lambda x, i: (o_custkey // CAST(pow(2, i - 1) AS BIGINT)) % 2 = 0 OR (i = 2 AND o_orderkey % 2 = 0)) AS pending FROM orders")
def pending(spark, sf):
    """Stages that are not done: each is done by a bit of the customer's key; summaries of even orders have failed."""
    names = ("clustering", "summaries", "entities", "timeline_review", "brief")
    done = lambda i: F.shiftright("o_custkey", i).bitwiseAND(F.lit(1)) == 1
    state = F.map_from_entries(F.filter(F.array(*(F.when(done(i), F.struct(F.lit(n).alias("k"), F.when(F.lit(i == 1) & (F.col("o_orderkey") % 2 == 0), "failed").otherwise("done").alias("v"))) for i, n in enumerate(names))), lambda e: e.isNotNull()))
    d = C.read(spark, sf, "orders").select("o_orderkey", state.alias("state"))
    return d.select("o_orderkey", F.filter(F.array(*map(F.lit, names)), lambda s: F.coalesce(F.try_element_at("state", s), F.lit("")) != "done").alias("pending"))


@query("m8_ocr_complete", "SELECT l_orderkey, count(*) = max(l_linenumber) AND bool_and(l_discount > 0) AS complete FROM lineitem GROUP BY l_orderkey")
def ocr_complete(spark, sf):
    """As many pages in the sidecar as the document has, none of them empty."""
    li = C.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("pages"), F.max("l_linenumber").alias("n"))
    return li.select("l_orderkey", ((F.size("pages") == F.col("n")) & F.forall("pages", lambda p: p > 0)).alias("complete"))


@query("m9_verdict_parse", """SELECT o_orderkey AS id, 0 AS place, o_custkey AS suggestion_id, ['merge', 'distinct', 'unclear'][o_orderkey % 3 + 1] AS verdict, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 END AS keep_id, (o_orderkey % 100) / 100.0 AS confidence, CASE WHEN o_orderkey % 5 = 1 THEN 1 ELSE 0 END AS corrections
  FROM orders WHERE o_orderkey % 5 < 3""")
def verdict_parse(spark, sf):
    """Answers with numbers as text, with unknown words, without a number, with bad corrections, and that are no JSON."""
    n = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit('{"verdicts": [{"suggestion_id": "'), n("o_custkey"), F.lit('", "verdict": "'))
    keep = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(', "keep_id": '), (F.col("o_custkey") + 1).cast("string"))).otherwise(', "keep_id": ""')
    sure = F.concat(F.lit('", "reason": "r", "confidence": '), F.format_string("%.2f", (F.col("o_orderkey") % 100) / 100.0))
    fixes = F.when(F.col("o_orderkey") % 5 == 1, ', "corrections": [{"entity_id": "7", "corrected_name": " Ann ", "confidence": 1}, {"entity_id": "", "corrected_name": "x", "confidence": 1}, {"entity_id": "7", "corrected_name": "y", "confidence": "high"}]').otherwise("")
    word = F.element_at(F.array(*map(F.lit, RV.VERDICTS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    raw = F.when(F.col("o_orderkey") % 5 == 3, F.concat(head, F.lit("maybe"), sure, F.lit("}]}"))).when(F.col("o_orderkey") % 5 == 4, "[not an object").otherwise(F.concat(head, word, sure, keep, fixes, F.lit("}, 7]}")))
    d = C.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderkey", raw.alias("raw"))
    return RV.parse_merge_verdicts(d).select("id", "place", "suggestion_id", "verdict", "keep_id", "confidence", F.size("corrections").alias("corrections"))


@query("m10_timeline_json", "SELECT o_custkey, '[' || string_agg('{\"id\":' || o_orderkey || '}', ',' ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END NULLS LAST, o_orderkey) || ']' AS events FROM orders GROUP BY o_custkey")
def timeline_json(spark, sf):
    date = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate"))
    item = F.struct(date.isNull().alias("undated"), date.alias("date"), F.col("o_orderkey").alias("id"))
    o = C.read(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(item)).alias("e"))
    return o.select("o_custkey", F.to_json(F.transform("e", lambda x: F.struct(x["id"].alias("id")))).alias("events"))


@query("m11_display_type", C.with_sql(C.DOCS_SQL) + "SELECT doc_id, CASE lower(regexp_extract(native_path, '\\.([^.]*)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'document' WHEN 'msg' THEN 'email' WHEN 'png' THEN 'image' WHEN 'mp4' THEN 'video' ELSE 'unknown' END AS kind FROM docs")
def display_type(spark, sf):
    table = F.create_map(*(F.lit(x) for kv in DISPLAY_TYPES.items() for x in kv))
    return C.documents(spark, sf).select("doc_id", F.coalesce(F.element_at(table, N.file_type_of(F.col("native_path"))), F.lit("unknown")).alias("kind"))


@query("m12_cluster_members", C.with_sql(C.CHUNKS_SQL) + "SELECT label, document_id FROM (SELECT label, document_id, row_number() OVER (PARTITION BY label ORDER BY document_id) AS r FROM (SELECT DISTINCT label, document_id FROM chunks)) WHERE r <= least(20, greatest(1, 50))")
def cluster_members(spark, sf):
    limit = max(1, min(20, 50))
    m = C.chunks(spark, sf).select("label", "document_id").distinct()
    return m.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("document_id"))).filter(F.col("r") <= limit).drop("r")


@query("m13_entity_delete", C.with_sql(C.MENTIONS_SQL) + "SELECT entity_id, count(*) AS n FROM mentions WHERE entity_id NOT IN (3, 4) GROUP BY entity_id")
def entity_delete(spark, sf):
    gone = spark.createDataFrame([(3,), (4,)], "entity_id long")
    return C.mentions(spark, sf).join(F.broadcast(gone), "entity_id", "left_anti").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("m14_qc_replacement", C.with_sql(C.TAGS_SQL) + "SELECT doc_id, tag_id FROM tags WHERE doc_id % 20 <> 0 UNION ALL SELECT doc_id, 2 FROM labels WHERE doc_id % 20 = 0")
def qc_replacement(spark, sf):
    """A QC decision replaces the tags of the documents it overturns."""
    over = C.read(spark, sf, "labels").filter("doc_id % 20 = 0").select("doc_id")
    return C.document_tags(spark, sf).join(over, "doc_id", "left_anti").select("doc_id", "tag_id").union(over.select("doc_id", F.lit(2)))


@query("m15_redaction_list", "SELECT l_partkey AS doc_id, l_linenumber AS page, l_orderkey AS redaction_id FROM lineitem WHERE l_returnflag = 'R' ORDER BY doc_id, page, redaction_id")
def redaction_list(spark, sf):
    return C.read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("redaction_id")).orderBy("doc_id", "page", "redaction_id")


@query("m16_saved_searches", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type IN (SELECT min(event_type) FROM events)")
def saved_searches(spark, sf):
    """Of one kind of event, as saved searches: each user's own, the newest first."""
    e = C.read(spark, sf, "events")
    kind = e.agg(F.min("event_type").alias("event_type"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.join(F.broadcast(kind), "event_type").select("user_id", "event_id", F.row_number().over(w).alias("place"))  # kind: one row


@query("m16_notes", """SELECT l_partkey AS doc_id, l_linenumber AS page, count(*) AS notes, count(*) FILTER (l_returnflag = 'N') AS open, max(l_shipdate) AS last FROM lineitem GROUP BY ALL""")
def notes(spark, sf):
    """Notes and annotations of documents by page, how many are open, and the last one's time."""
    li = C.read(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("page")).agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("l_returnflag") == "N").alias("open"), F.max("l_shipdate").alias("last"))


# --- set operations and streams ------------------------------------------------------------------------------------


@query("set_union_intersect_except", "SELECT 'union' AS op, count(*) AS n FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)")
def set_operations(spark, sf):
    la = C.read(spark, sf, "labels")
    a, b = la.filter("quality = 1").select("doc_id"), la.filter("toxic = 1").select("doc_id")
    n = lambda op, d: d.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return n("union", a.union(b).distinct()).union(n("intersect", a.intersect(b))).union(n("except", a.subtract(b)))


@query("stream_tumbling_counts", "SELECT CAST(epoch(time_bucket(INTERVAL 1 hour, ts)) AS BIGINT) AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, sf):
    """Extension: events per hour and type, by a stream that runs until it has read all there is."""
    return ST.tumbling_counts(spark, sf)


@query("stream_sessions")
def sessions(spark, sf):
    """Extension: sessions of a user with gaps below 30 minutes."""
    return ST.sessions(C.read(spark, sf, "events"))
