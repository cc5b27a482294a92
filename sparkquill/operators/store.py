"""Sources, chunks and flat documents as tables: ingest without repeats, changes, the recent buffer and its merge.

Tables are values: an operation takes DataFrames and returns new ones. `Store` keeps them in a folder as snapshots; a
snapshot counts once its folder is complete and a pointer of a higher number names it, so readers see old or new."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquill.files import Files
from sparkquill.functions.text import content_hash
from sparkquill.skew import dealt_join, share
from sparkquill.tables import written

_L, _S, _I, _V = T.LongType(), T.StringType(), T.IntegerType(), T.ArrayType(T.FloatType())


def _shape(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SOURCES = _shape(source_id=_L, content=_S, content_hash=_S, metadata=_S, created_at=T.TimestampType(), name=_S, status=_S)
CHUNKS = _shape(chunk_id=_L, source_id=_L, chunk_index=_I, content=_S, start_pos=_I, end_pos=_I, chunk_type=_S, embedding=_V)
DOCS = _shape(doc_id=_L, content=_S, content_hash=_S, embedding=_V)
PENDING, COMPLETED = "pending", "completed"
#: Rows of the recent buffer from which on a merge is due.
MERGE_AT = 100


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def migrated(df: DataFrame, schema: T.StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    """`df` in the shape of `schema`: missing columns come as their default or null; hashes are filled in."""
    defaults = {"status": F.lit(COMPLETED), "chunk_type": F.lit("general")} | (defaults or {})
    if "content" in df.columns:
        defaults = {"content_hash": content_hash(F.col("content"))} | defaults
    cols = []
    for f in schema:
        fallback = defaults.get(f.name, F.lit(None))
        value = F.coalesce(F.col(f.name), fallback) if f.name in df.columns and f.name == "content_hash" else F.col(f.name) if f.name in df.columns else fallback
        cols.append(value.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def numbered(rows: DataFrame, order: list[str], name: str, first: int) -> DataFrame:
    """Consecutive ids from `first` on in the given order, without a task that sees all rows.

    Rows are sorted into ranges and written once with their range's number, so that no second evaluation can deal them
    otherwise; the ranges' sizes give each its first id."""
    ranged = written(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    w = Window.partitionBy("__p").orderBy(*order)
    here = ranged.withColumn("__n", F.row_number().over(w))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__size"))
    # One row per range: a window over them sees as many rows as there are partitions.
    before = sizes.withColumn("__before", F.sum("__size").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    joined = here.join(before.select("__p", F.coalesce("__before", F.lit(0)).alias("__before")), "__p")
    return joined.withColumn(name, (F.col("__before") + F.col("__n") + F.lit(first - 1)).cast("long")).drop("__p", "__n", "__before")


def _texts(incoming: DataFrame, seq: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows seq, content_hash; texts content_hash, first_seq, n and the columns of `known` by hash). No text moves: hashes
    are grouped with partial minima, so a text that a third of the rows share is no large group."""
    rows = written(incoming.select(seq, content_hash(F.col("content")).alias("content_hash")), "hashes")
    firsts = rows.groupBy("content_hash").agg(F.min(seq).alias("first_seq"), F.count("*").alias("n"))
    return rows, firsts.join(known, "content_hash", "left")


def _answers(rows: DataFrame, texts: DataFrame, seq: str) -> DataFrame:
    """Every row with what its text has; a text of many rows is dealt over several tasks."""
    return dealt_join(rows, texts, "content_hash", "n", share(rows, rows.count()), [seq])


def add_sources(sources: DataFrame, incoming: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """incoming (seq, content, and if there are any metadata, name) -> (sources with the new ones, results).

    A text that is stored, or came before in the batch, is a duplicate of it. Results: seq, source_id, is_duplicate,
    message. New ids follow the largest, in order of seq; new sources are pending. Only new texts move, once."""
    for c in ("metadata", "name"):
        if c not in incoming.columns:
            incoming = incoming.withColumn(c, F.lit(None).cast("string"))
    known = sources.groupBy("content_hash").agg(F.min("source_id").alias("known_id"))
    rows, texts = _texts(incoming, seq, known)
    top = sources.agg(F.max("source_id")).first()[0] or 0
    fresh = numbered(texts.filter(F.col("known_id").isNull()).select("content_hash", "first_seq"), ["first_seq"], "new_id", top + 1)
    new = incoming.join(fresh, F.col(seq) == F.col("first_seq"))
    new = new.select(F.col("new_id").alias("source_id"), "content", "content_hash", "metadata", F.current_timestamp().alias("created_at"), "name", F.lit(PENDING).alias("status"))
    texts = texts.join(fresh.select("content_hash", "new_id"), "content_hash", "left")
    results = _answers(rows, texts, seq)
    source_id = F.coalesce("known_id", "new_id")
    dup = F.col("known_id").isNotNull() | (F.col(seq) != F.col("first_seq"))
    message = F.when(dup, F.concat(F.lit("Source already exists (id="), source_id.cast("string"), F.lit(")"))).otherwise(F.lit("Source added"))
    results = results.select(seq, source_id.alias("source_id"), dup.alias("is_duplicate"), message.alias("message"))
    return sources.unionByName(new), results


def new_chunks(chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunks (source_id, chunk_index, content, ...) with ids after the largest, in order of source and index."""
    top = chunks.agg(F.max("chunk_id")).first()[0] or 0
    return migrated(numbered(incoming, ["source_id", "chunk_index"], "chunk_id", top + 1), CHUNKS)


def add_chunks(chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """The chunks and the new ones."""
    return chunks.unionByName(new_chunks(chunks, incoming))


def add_documents(docs: DataFrame, incoming: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """incoming (seq, content, embedding) -> (docs, results seq, success, is_duplicate). A row without an embedding fails."""
    usable = F.coalesce(F.size("embedding"), F.lit(0)) > 0
    known = docs.select("content_hash").distinct().withColumn("__known", F.lit(True))
    rows, texts = _texts(incoming.filter(usable), seq, known)
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    fresh = numbered(texts.filter(F.col("__known").isNull()).select("content_hash", "first_seq"), ["first_seq"], "doc_id", top + 1)
    new = incoming.join(fresh, F.col(seq) == F.col("first_seq"))
    new = new.select("doc_id", "content", "content_hash", F.col("embedding").cast("array<float>").alias("embedding"))
    dup = F.col("__known").isNotNull() | (F.col(seq) != F.col("first_seq"))
    good = _answers(rows, texts, seq).select(seq, F.lit(True).alias("success"), dup.alias("is_duplicate"))
    bad = incoming.filter(~usable).select(seq, F.lit(False).alias("success"), F.lit(False).alias("is_duplicate"))
    return docs.unionByName(new), good.unionByName(bad)


def update_status(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (source_id, status, seq): the last change of each source counts."""
    last = changes.groupBy("source_id").agg(F.max_by("status", "seq").alias("__status"))
    return sources.join(last, "source_id", "left").withColumn("status", F.coalesce("__status", "status")).select(sources.columns)


def update_embeddings(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (chunk_id, embedding): new vectors in place of old."""
    new = changes.select("chunk_id", F.col("embedding").cast("array<float>").alias("__new"))
    return chunks.join(new, "chunk_id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).select(chunks.columns)


def delete_sources(sources: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the sources of `ids` (source_id) and their chunks."""
    gone = ids.select("source_id").distinct()
    return sources.join(gone, "source_id", "left_anti"), chunks.join(gone, "source_id", "left_anti")


# Reading


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.select("source_id", "name", "created_at", "status", "metadata").orderBy(F.desc("source_id"))


def get_source(sources: DataFrame, source_id: int) -> DataFrame:
    return sources.filter(F.col("source_id") == source_id).select("content")


def get_source_chunks(chunks: DataFrame, source_id: int) -> DataFrame:
    return chunks.filter(F.col("source_id") == source_id).orderBy("chunk_index").select("chunk_index", "content")


def get_all_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "content").orderBy("chunk_id")


def get_adjacent_chunks(chunks: DataFrame, sources: DataFrame, source_id: int, low: int, high: int) -> DataFrame:
    """A source's chunks from index low to high, in order, with the source's metadata and similarity 0."""
    rows = chunks.filter((F.col("source_id") == source_id) & F.col("chunk_index").between(low, high))
    return with_source(rows, sources).withColumn("similarity", F.lit(0.0)).orderBy("chunk_index")


def with_source(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """chunk_id, source_id, chunk_index, content, chunk_type and metadata, null where the source is missing."""
    rows = chunks.join(sources.select("source_id", "metadata"), "source_id", "left")
    return rows.select("chunk_id", "source_id", "chunk_index", "content", F.coalesce("chunk_type", F.lit("general")).alias("chunk_type"), "metadata")


def source_stats(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    return sources.agg(F.count("*").alias("source_count")).crossJoin(chunks.agg(F.count("*").alias("chunk_count")))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"))


# Recent buffer


def buffer_add(buffer: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows (doc_id, embedding) appended, repeats of an id included."""
    return buffer.unionByName(incoming.select("doc_id", "embedding"))


def buffer_remove(buffer: DataFrame, ids: DataFrame) -> DataFrame:
    return buffer.join(ids.select("doc_id"), "doc_id", "left_anti")


def buffer_stats(buffer: DataFrame, index_loaded: bool) -> DataFrame:
    size = F.count("*").alias("buffer_size")
    return buffer.agg(size).select("buffer_size", F.lit(MERGE_AT).alias("threshold"), F.lit(index_loaded).alias("index_loaded"), (F.col("buffer_size") >= MERGE_AT).alias("needs_merge"))


def incremental_search(buffer: DataFrame, index, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of buffer and index together: qid, doc_id, distance, origin. The index, a table or one of the approximate indexes, gives
    its 2k best, and so does the buffer; an id in both counts once, by its smaller distance, the buffer's first."""
    from sparkquill.operators.graph import GraphIndex
    from sparkquill.operators.vector import CellIndex, topk

    as_rows = lambda df: df.select(F.col("doc_id").alias("id"), "embedding")
    # Of repeats of an id in the buffer the nearest counts, so k others can't be hidden by them.
    once = buffer.select("doc_id", "embedding").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    recent = topk(as_rows(buffer), queries, 2 * k * once).withColumn("origin", F.lit("buffer"))
    stored = index.search(queries, 2 * k).drop("compared") if isinstance(index, (CellIndex, GraphIndex)) else topk(as_rows(index), queries, 2 * k)
    both = recent.unionByName(stored.withColumn("origin", F.lit("hnsw"))).withColumn("distance", 1 - F.col("similarity"))
    near = Window.partitionBy("qid", "doc_id").orderBy(F.round("distance", 12), "origin")
    once = both.withColumn("__n", F.row_number().over(near)).filter("__n = 1")
    order = Window.partitionBy("qid").orderBy(F.round("distance", 12), "origin", "doc_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "doc_id", "distance", "origin", "rank")


def merged(index: DataFrame, buffer: DataFrame) -> DataFrame:
    """The index with the buffer's rows in place of its own of the same id. Of repeats in the buffer the last stays: that
    of the greatest `seq`, the order of arrival. A buffer without `seq` has no order; its greatest vector stays."""
    last = F.max_by("embedding", "seq") if "seq" in buffer.columns else F.max(F.struct("embedding"))["embedding"]
    fresh = buffer.groupBy("doc_id").agg(last.alias("embedding"))
    return index.join(fresh.select("doc_id"), "doc_id", "left_anti").select("doc_id", "embedding").unionByName(fresh)


#: Snapshots of a table that stay beside the newest.
KEPT = 3


class Store:
    """Named tables in a folder that driver and executors share.

    A table's pointers are numbered files that are made whole and never replaced; the highest counts. A put writes its
    snapshot, then the next pointer, then takes the oldest away: whenever it ends, the old or the new table is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)

    def _pointers(self, name: str) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self.root}/current/{name}") if n.isdigit())

    def exists(self, name: str) -> bool:
        return bool(self._pointers(name))

    def version(self, name: str) -> str:
        return self.files.text(f"{self.root}/current/{name}/{self._pointers(name)[-1]}")

    def put(self, name: str, df: DataFrame, by: list[str] | None = None) -> None:
        """A new snapshot: complete before a pointer names it. by: columns that rows are clustered by."""
        version = uuid.uuid4().hex
        out = df.repartition(*by).sortWithinPartitions(*by) if by else df
        out.write.parquet(f"{self.root}/tables/{name}/{version}")
        self.point(name, version)

    def point(self, name: str, version: str) -> None:
        """Makes a complete snapshot the newest. The `KEPT` before it stay for readers that have opened them; older ones go
        with their files, pointer last, so whoever stops in between leaves it to the next."""
        before = self._pointers(name)
        number = before[-1] + 1 if before else 1
        while not self.files.put_once(f"{self.root}/current/{name}/{number}", version):
            number += 1
        held = {self.files.text(f"{self.root}/current/{name}/{p}") for p in self._pointers(name)[-1 - KEPT :]}
        for old in self._pointers(name)[: -1 - KEPT]:
            gone = self.files.text(f"{self.root}/current/{name}/{old}")
            if gone not in held:
                for folder in (f"{self.root}/tables/{name}/{gone}", f"{self.root}/{name}/{gone}"):
                    if self.files.exists(folder):
                        self.files.delete(folder)
            self.files.delete(f"{self.root}/current/{name}/{old}")

    def get(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        if not self.exists(name):
            if schema is None:
                raise KeyError(name)
            return empty(self.spark, schema)
        df = self.spark.read.parquet(f"{self.root}/tables/{name}/{self.version(name)}")
        return migrated(df, schema) if schema is not None else df

    def init(self) -> None:
        """Creates what is missing and brings old tables into shape. A table without a pointer but with a snapshot was
        stopped in its first put: nothing had been stored in it."""
        for name, schema in (("sources", SOURCES), ("chunks", CHUNKS), ("docs", DOCS)):
            if not self.exists(name) or set(self.get(name).columns) != set(schema.names):
                self.put(name, self.get(name, schema))

    def clear(self) -> None:
        """All tables and indexes go; then the empty tables are made anew."""
        self.files.delete(self.root)
        self.init()

    def mark_dirty(self) -> None:
        """Says that indexes lag behind the tables; a rebuild takes the mark away."""
        self.files.put_once(f"{self.root}/dirty", "1")

    @property
    def dirty(self) -> bool:
        return self.files.exists(f"{self.root}/dirty")

    def clean(self) -> None:
        self.files.delete(f"{self.root}/dirty")
