"""Weighted reciprocal rank fusion of vector and keyword search, with filters on sources and metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.operators import bm25, graph, segments, vector


@dataclass(frozen=True)
class Fusion:
    """k and the weights of the two branches."""

    k: int = 60
    vector_weight: float = 0.5
    bm25_weight: float = 0.5

    @classmethod
    def weighted(cls, vector_weight: float, bm25_weight: float) -> Fusion:
        """Weights clamped to [0, 1]."""
        return cls(60, min(max(vector_weight, 0.0), 1.0), min(max(bm25_weight, 0.0), 1.0))


#: What the service level uses where nothing else is asked for.
SERVICE = Fusion(60, 0.2, 0.8)


@dataclass(frozen=True)
class Filter:
    """source_ids: only these sources; an empty list filters nothing but leaves out rows without a source.
    metadata_like: SQL LIKE on the source's metadata, without regard to the case of A-Z, without an escape character."""

    source_ids: list[int] | None = field(default=None)
    metadata_like: str | None = None


def rrf_score(rank: Column, k: int) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def fuse(vector_ranks: DataFrame, bm25_ranks: DataFrame, k: int, config: Fusion = Fusion()) -> DataFrame:
    """Two tables (qid, doc_id, rank) -> qid, doc_id, score, vector_rank, bm25_rank (0: absent), rank: the k best."""
    v = vector_ranks.select("qid", "doc_id", F.col("rank").alias("vector_rank"))
    b = bm25_ranks.select("qid", "doc_id", F.col("rank").alias("bm25_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) * rrf_score(F.col(c), config.k), F.lit(0.0))
    both = v.join(b, ["qid", "doc_id"], "full_outer")
    both = both.withColumn("score", part("vector_rank", config.vector_weight) + part("bm25_rank", config.bm25_weight))
    both = both.fillna(0, ["vector_rank", "bm25_rank"])
    return bm25.ranked(both, k)


def candidates(k: int, filtered: bool) -> int:
    return k * (4 if filtered else 2)


def fold_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def metadata_like(c: Column, pattern: str) -> Column:
    """LIKE with % and _ only, A-Z and a-z alike."""
    lowered = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in pattern)
    regex = "".join(".*" if ch == "%" else "." if ch == "_" else "\\x{%x}" % ord(ch) for ch in lowered)
    return fold_ascii(c).rlike(f"^(?s:{regex})\\z")


def _matching(chunks: DataFrame, sources: DataFrame | None, chosen: Filter) -> DataFrame:
    """The chunks that a filter admits."""
    out = chunks
    if chosen.source_ids:
        out = out.filter(F.col("source_id").isin([int(i) for i in chosen.source_ids]))
    if chosen.metadata_like is not None and sources is not None:
        named = sources.filter(metadata_like(F.col("metadata"), chosen.metadata_like)).select("source_id")
        out = out.join(named, "source_id", "left_semi")
    return out


def _again(ranks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates among `allowed`, ranked anew without gaps."""
    w = Window.partitionBy("qid").orderBy("rank")
    kept = ranks.join(allowed.select(F.col("chunk_id").alias("doc_id")), "doc_id", "left_semi")
    return kept.withColumn("rank", F.row_number().over(w))


def hybrid(chunks: DataFrame, queries: DataFrame, k: int, config: Fusion = Fusion(), chosen: Filter | None = None, sources: DataFrame | None = None, index: bm25.Index | segments.SegmentIndex | None = None, nearest: graph.GraphIndex | graph.Layers | None = None) -> DataFrame:
    """chunks (chunk_id, content, embedding, source_id), queries (qid, query, embedding) -> qid, doc_id, score, ranks.

    With source ids, both branches see only chunks of these sources, and statistics are theirs alone; a pattern on
    metadata holds there too. Any other filter is applied to candidates, which are then ranked anew. Candidates come from
    `index` and `nearest` where they are given, from all texts and vectors otherwise; sources are always scanned."""
    exact = chosen is not None and bool(chosen.source_ids)
    many = candidates(k, chosen is not None)
    scope = _matching(chunks, sources, chosen) if exact else chunks
    vectors = scope.select(F.col("chunk_id").alias("id"), "embedding").filter(F.col("embedding").isNotNull())
    by_vector = vector.topk(vectors, queries, None) if exact else graph.nearest(vectors, nearest, queries, many)
    by_vector = by_vector.select("qid", "doc_id", "rank")
    if index is not None and not exact:
        by_words = index.search(queries, many)
    else:
        found = bm25.scan(scope, queries, None if exact else many, floor=exact, ident="chunk_id", text="content")
        by_words = bm25.ranked(found, None) if exact else found
    by_words = by_words.select("qid", "doc_id", "rank")
    if chosen is not None and not exact:
        allowed = _matching(chunks.filter(F.col("source_id").isNotNull()), sources, chosen)
        by_vector, by_words = _again(by_vector, allowed), _again(by_words, allowed)
    return fuse(by_vector, by_words, k, config)


def with_content(hits: DataFrame, chunks: DataFrame, sources: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Hits with content, source_id, chunk_index and metadata. Flat documents (doc_id, content) come before chunks of the
    same id: their source is themselves, index 0, no metadata. Hits without a row are left out."""
    c = chunks.join(sources.select("source_id", "metadata"), "source_id", "left")
    c = c.select(F.col("chunk_id").alias("doc_id"), "content", "source_id", F.col("chunk_index").cast("int").alias("chunk_index"), "metadata", F.lit(1).alias("__place"))
    if docs is not None:
        flat = docs.select("doc_id", "content", F.col("doc_id").alias("source_id"), F.lit(0).alias("chunk_index"), F.lit(None).cast("string").alias("metadata"), F.lit(0).alias("__place"))
        c = c.join(flat.select("doc_id"), "doc_id", "left_anti").unionByName(flat)
    return hits.join(c.drop("__place"), "doc_id")


def service_candidates(k: int) -> int:
    """Results asked for where a service call names sources."""
    return min(max(10 * k, 50), 200)
