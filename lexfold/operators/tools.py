"""The eight read-only tools of an assistant, each bound to the productions that its user may see.

Every tool gives a DataFrame of at most a page, but for the breakdown of tags; what is not accessible is as if it were not
there, and a reference that names nothing gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexfold.operators.search import file_type_filter, semantic_search
from lexfold.operators.text_index import TextIndex

# Fixed values.
PAGE, TEXT_CHARS, SIMILAR_CHARS = 25, 12_000, 2_000
ENTITIES, RELATED, SAMPLES, ALIASES, SAMPLE_CHARS = 5, 10, 3, 10, 200
CUT = "\n…[truncated]"


class AgentTools:
    """documents: doc_id, bates_begin, title, production_id, page_count, native_path, text; chunks: document_id, chunk_index,
    embedding; duplicates: doc_id, group_id, type, similarity; tags: doc_id, category, tag; productions: production_id, name;
    entities: entity_id, production_id, kind, name, aliases, mentions; mentions: entity_id, doc_id, snippet; related:
    source_id, target_id, type. embed turns a text into a vector; groups are the file types' extensions."""

    def __init__(self, accessible: list[int], tables: dict[str, DataFrame], embed: Callable[[str], list[float]], groups: dict[str, tuple[str, ...]], index: TextIndex | None = None):
        self.accessible, self.t, self.embed, self.groups = accessible, tables, embed, groups
        self.docs = tables["documents"].filter(F.col("production_id").isin(*accessible) if accessible else F.lit(False))
        self._index = index

    @property
    def index(self) -> TextIndex:
        self._index = self._index or TextIndex.build(self.t["documents"])
        return self._index

    def _in(self, production: int | None) -> DataFrame:
        """A production that is not accessible restricts nothing, as an unknown one does."""
        return self.docs.filter(F.col("production_id") == production) if production in self.accessible else self.docs

    def _one(self, ref: str) -> DataFrame:
        """The document that a number or a Bates number names."""
        return self.docs.filter((F.col("bates_begin") == ref.strip()) | (F.col("doc_id").cast("string") == ref.strip())).orderBy("doc_id").limit(1)

    def search_documents(self, query: str, production: int | None = None, file_type: str | None = None, page: int = 1) -> DataFrame:
        """doc_id, bates_begin, title, rank, headline, total: a page of the best."""
        scope = self._in(production).filter(file_type_filter(F.col("native_path"), file_type, self.groups))
        hits = self.index.match(query).join(scope.select("doc_id", "bates_begin", "title"), "doc_id")
        found = hits.orderBy(F.desc("rank"), "bates_begin").offset((page - 1) * PAGE).limit(PAGE)
        total = hits.agg(F.count(F.lit(1)).alias("total"))
        return self.index.headlines(found, scope, query).join(F.broadcast(total))  # one row

    def _near(self, text: str, scope: DataFrame) -> DataFrame:
        chunks = self.t["chunks"].join(scope.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
        near = semantic_search(chunks, self.embed(text), PAGE).select(F.col("document_id").alias("doc_id"), F.col("rank").alias("similarity"))
        return near.join(scope.select("doc_id", "bates_begin", "title"), "doc_id")

    def semantic_search(self, query: str, production: int | None = None) -> DataFrame:
        """doc_id, similarity, bates_begin, title of the nearest."""
        return self._near(query, self._in(production))

    def get_document(self, ref: str) -> DataFrame:
        """doc_id, bates_begin, title, page_count, text (cut where it is long)."""
        text = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r"))
        shown = F.when(F.char_length(text) > TEXT_CHARS, F.concat(F.substring(text, 1, TEXT_CHARS), F.lit(CUT))).otherwise(text)
        return self._one(ref).select("doc_id", "bates_begin", "title", "page_count", shown.alias("text"))

    def list_productions(self) -> DataFrame:
        """production_id, name, documents."""
        mine = self.t["productions"].filter(F.col("production_id").isin(*self.accessible) if self.accessible else F.lit(False))
        counts = self.docs.groupBy("production_id").agg(F.count(F.lit(1)).alias("documents"))
        return mine.join(counts, "production_id", "left").select("production_id", "name", F.coalesce("documents", F.lit(0)).alias("documents"))

    def find_similar_documents(self, ref: str) -> DataFrame:
        """doc_id, similarity, bates_begin, title of others near a document's beginning; none for one without text."""
        doc = self._one(ref).select("doc_id", F.substring("text", 1, SIMILAR_CHARS).alias("text"), F.btrim(F.coalesce("text", F.lit(""))).alias("whole")).first()
        if doc is None or not doc["whole"]:
            return self._near("", self.docs.limit(0))
        return self._near(doc["text"], self.docs).filter(F.col("doc_id") != doc["doc_id"])

    def get_duplicates(self, ref: str) -> DataFrame:
        """doc_id, bates_begin, title, similarity, type of the others in the groups of a document."""
        d, one = self.t["duplicates"], self._one(ref).select("doc_id")
        groups = d.join(one, "doc_id", "left_semi").select("group_id", "type").distinct()
        others = d.join(groups, ["group_id", "type"], "left_semi").join(one, "doc_id", "left_anti")
        return others.join(self.docs.select("doc_id", "bates_begin", "title"), "doc_id").select("doc_id", "bates_begin", "title", "similarity", "type")

    def get_corpus_stats(self, production: int) -> DataFrame:
        """what, category, tag, n: documents, pages and documents of each tag; nothing for one that is not accessible."""
        docs = self.docs.filter(F.col("production_id") == production)
        none = F.lit(None).cast("string")
        count = lambda what, n: docs.groupBy().agg(n.alias("n")).select(F.lit(what).alias("what"), none.alias("category"), none.alias("tag"), "n")
        tags = self.t["tags"].join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("category", "tag").agg(F.count(F.lit(1)).alias("n"))
        out = count("documents", F.count(F.lit(1))).union(count("pages", F.coalesce(F.sum("page_count"), F.lit(0)))).union(tags.select(F.lit("tag"), "category", "tag", "n"))
        return out if production in self.accessible else out.limit(0)

    def lookup_entity(self, name: str, production: int | None = None) -> DataFrame:
        """entity_id, production_id, kind, name, aliases, mentions, documents, related, samples of the most mentioned whose names hold `name`."""
        scope = self.accessible if production is None else [production] if production in self.accessible else []
        like = "%" + name.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        e = self.t["entities"].filter(F.col("production_id").isin(*scope) if scope and name.strip() else F.lit(False)).filter(F.col("name").ilike(like))
        e = e.orderBy(F.desc("mentions"), "entity_id").limit(ENTITIES)
        m = self.t["mentions"].join(e.select("entity_id"), "entity_id", "left_semi")
        docs = m.groupBy("entity_id").agg(F.countDistinct("doc_id").alias("documents"))
        first = Window.partitionBy("entity_id").orderBy("doc_id", "snippet")  # Spark keeps a few of each before the shuffle
        samples = m.filter("snippet IS NOT NULL").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= SAMPLES).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "snippet"))), lambda s: F.substring(s["snippet"], 1, SAMPLE_CHARS)).alias("samples"))
        ends = self.t["related"].select(F.col("source_id").alias("entity_id"), "target_id", "type").join(e.select("entity_id"), "entity_id", "left_semi").distinct()
        told = ends.join(self.t["entities"].select(F.col("entity_id").alias("target_id"), F.col("name").alias("to")), "target_id").select("entity_id", F.concat_ws(" -> ", "type", "to").alias("said")).distinct()
        told = told.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy("said"))).filter(F.col("r") <= RELATED).groupBy("entity_id").agg(F.array_sort(F.collect_list("said")).alias("related"))
        some = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
        out = e.join(docs, "entity_id", "left").join(samples, "entity_id", "left").join(told, "entity_id", "left")
        return out.select("entity_id", "production_id", "kind", "name", F.slice("aliases", 1, ALIASES).alias("aliases"), "mentions", F.coalesce("documents", F.lit(0)).alias("documents"), some("related"), some("samples"))
