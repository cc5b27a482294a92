"""The engine: a store, its indexes, and the searches over them, for batches of queries."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.operators import chunking, context, fusion, graph, segments, store
from sparkquill.operators.embed import Embedder, embedded

#: Cores that a level of use takes, as a share of all.
LEVELS = {"low": 0.2, "medium": 0.4, "high": 0.8}


def threads(cores: int, level: str | None = None, count: int | None = None) -> int:
    """Worker threads by level or by number, not both; half of the cores where neither is given."""
    if level is not None and count is not None:
        raise ValueError("level and count exclude one another")
    return max(1, count if count is not None else int(cores * (LEVELS[level] if level is not None else 0.5)))


#: Manifests of tables and words whose files stay for readers.
READERS = 12
#: In place of a version: there is no graph.
NO_GRAPH = "none"


@dataclass(frozen=True)
class Config:
    max_chunk_chars: int = 500
    overlap_chars: int = 50
    top_k: int = 10
    #: Vectors from which on a search asks the approximate index; fewer are scanned.
    approximate_from: int = 10_000
    #: Share of the indexed vectors from which on, when so many have come or gone, the graph is built anew.
    stale: float = 0.1
    token_budget: int = 2000
    fusion: fusion.Fusion = fusion.SERVICE


class Engine:
    def __init__(self, spark: SparkSession, root: str, embed: Embedder, config: Config = Config()):
        self.spark, self.embed, self.config = spark, embed, config
        self.store = store.Store(spark, root)
        self.store.init()
        for name in ("sources", "chunks"):
            # A store of whole snapshots, as older versions wrote it, is taken over once.
            if not self._table(name).manifest.number and not (old := self.store.get(name)).isEmpty():
                self._table(name).add(old)
        if self.store.dirty or not self._words().manifest.number:
            self.rebuild()

    def _table(self, name: str) -> segments.KeyedTable:
        schema, key = {"sources": (store.SOURCES, "source_id"), "chunks": (store.CHUNKS, "chunk_id")}[name]
        return segments.KeyedTable(self.spark, f"{self.store.root}/changes/{name}", schema, key)

    @property
    def sources(self) -> DataFrame:
        return self._table("sources").read()

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks").read()

    def add(self, incoming: DataFrame) -> DataFrame:
        """incoming (seq, content, name, metadata): chunked, embedded and stored; repeats are found before any of that.

        What is written is the new sources, their chunks, and the new sources' status once more. Sources stay pending until
        their chunks are stored, and pending sources are chunked anew: a call that was stopped anywhere is made good by the
        next, without a chunk twice. Returns seq, source_id, is_duplicate, message, chunk_count."""
        known = self.sources
        every, results = store.add_sources(known, incoming)
        self.store.put("results", results)
        self.store.mark_dirty()
        self._table("sources").add(every.join(known.select("source_id"), "source_id", "left_anti"))
        results = self.store.get("results")
        fresh = self.sources.filter(F.col("status") == store.PENDING)
        left = self.chunks.join(fresh.select("source_id"), "source_id", "left_semi").select("chunk_id")
        if not left.isEmpty():
            self._table("chunks").remove(left)
        new = embedded(chunking.chunked(fresh, self.config.max_chunk_chars, self.config.overlap_chars), self.embed)
        self._table("chunks").add(store.new_chunks(self.chunks, new))
        self._table("sources").upsert(fresh.withColumn("status", F.lit(store.COMPLETED)))
        counts = store.chunk_counts(self.chunks.join(results.select("source_id").distinct(), "source_id", "left_semi"))
        return results.join(counts, "source_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))

    def rebuild(self) -> None:
        """Brings the indexes up to the chunks by what has changed: the keyword index by a segment and a list of removed
        ids; vectors by a level of recent ones beside the graph, which is built anew only when a tenth of it has changed."""
        self._words().reconcile(self.chunks, "chunk_id", "content").expire(READERS)
        for name in ("sources", "chunks"):
            self._table(name).expire(READERS)
        vectors, built = self._vectors(), self._graph_path()
        if built is not None:
            known = self.spark.read.parquet(f"{built}/ids")
            self.store.put("recent", vectors.join(known, "id", "left_anti"))
            self.store.put("gone", known.join(vectors, "id", "left_anti").select(F.col("id").alias("doc_id")))
            if self.store.get("recent").count() + self.store.get("gone").count() <= self.config.stale * known.count():
                self.store.clean()
                return
        found = graph.GraphIndex.build(vectors) if vectors.count() >= self.config.approximate_from else None
        version = uuid.uuid4().hex if found is not None else NO_GRAPH
        if found is not None:
            found.save(f"{self.store.root}/vectors/{version}")
            vectors.select("id").write.parquet(f"{self.store.root}/vectors/{version}/ids")
            self.store.put("recent", vectors.limit(0))
            self.store.put("gone", vectors.limit(0).select(F.col("id").alias("doc_id")))
        if found is not None or built is not None:
            self.store.point("vectors", version)
        self.store.clean()

    def _words(self) -> segments.SegmentIndex:
        return segments.SegmentIndex(self.spark, f"{self.store.root}/words")

    def _graph_path(self) -> str | None:
        version = self.store.version("vectors") if self.store.exists("vectors") else NO_GRAPH
        return None if version == NO_GRAPH else f"{self.store.root}/vectors/{version}"

    def _vectors(self) -> DataFrame:
        return self.chunks.select(F.col("chunk_id").alias("id"), "embedding").filter(F.size("embedding") > 0)

    def vector_index(self) -> graph.Layers | None:
        """The saved vector index with what has changed since, or None where vectors are few and scanned."""
        if self.store.dirty:
            self.rebuild()
        path = self._graph_path()
        found = graph.GraphIndex.load(self.spark, path) if path is not None else None
        return None if found is None else graph.Layers(found, self.store.get("recent"), self.store.get("gone"))

    def index(self) -> segments.SegmentIndex:
        if self.store.dirty:
            self.rebuild()
        return self._words()

    def regenerate_embeddings(self) -> None:
        """All vectors anew. The graph is let go first: one of old vectors is never asked."""
        self.store.mark_dirty()
        if self._graph_path() is not None:
            self.store.point("vectors", NO_GRAPH)
        self._table("chunks").upsert(embedded(self.chunks, self.embed))
        self.rebuild()

    def delete(self, ids: DataFrame) -> None:
        """Without these sources (source_id) and their chunks: chunks first, so none is ever without its source."""
        gone = self.chunks.join(ids.select("source_id").distinct(), "source_id", "left_semi").select("chunk_id")
        self.store.mark_dirty()
        self._table("chunks").remove(gone)
        self._table("sources").remove(ids)

    def _embedded(self, queries: DataFrame) -> DataFrame:
        return queries if "embedding" in queries.columns else queries.withColumn("embedding", self.embed(F.col("query")))

    def search(self, queries: DataFrame, k: int | None = None, source_ids: list[int] | None = None, exact: bool = False) -> DataFrame:
        """Vector search: qid, rank, chunk_id, source_id, chunk_index, content, similarity, metadata. Many vectors are
        searched through the approximate index unless exact.

        In named sources it is the hybrid search with all weight on vectors, and similarity is the fused score."""
        if source_ids:
            hits = self.search_hybrid(queries, k, fusion.Filter(source_ids), fusion.Fusion(60, 1.0, 0.0))
            return hits.withColumn("similarity", F.col("score"))
        index = None if exact else self.vector_index()
        hits = graph.nearest(self._vectors(), index, self._embedded(queries), k or self.config.top_k)
        return fusion.with_content(hits, self.chunks, self.sources).withColumnRenamed("doc_id", "chunk_id")

    def search_hybrid(self, queries: DataFrame, k: int | None = None, chosen: fusion.Filter | None = None, config: fusion.Fusion | None = None) -> DataFrame:
        k = k or self.config.top_k
        many = fusion.service_candidates(k) if chosen is not None and chosen.source_ids is not None else k
        hits = fusion.hybrid(self.chunks, self._embedded(queries), many, config or self.config.fusion, chosen, self.sources, self.index(), self.vector_index())
        hits = hits.filter(F.col("rank") <= k)
        return fusion.with_content(hits, self.chunks, self.sources).withColumnRenamed("doc_id", "chunk_id")

    def answer_context(self, queries: DataFrame, k: int | None = None, adjacent: int = 0, single_source: bool = False, strict: bool = True) -> DataFrame:
        """qid, text, prompt and the budget's figures, from hybrid search."""
        hits = self.search_hybrid(queries, k).withColumn("similarity", F.col("score"))
        if single_source:
            hits = context.single_source_by_text(hits, queries)
        if adjacent > 0:
            meta = self.sources.select("source_id", "metadata")
            hits = context.expand_adjacent(hits, self.chunks, adjacent).join(meta, "source_id", "left")
        out = context.assembled(hits, queries, self.config.token_budget, single=single_source)
        return out.join(queries.select("qid", "query"), "qid").withColumn("prompt", context.prompt(F.col("query"), F.col("text"), strict))
