"""Streaming ingest: new documents land in the recent buffer, batch by batch, and are merged when it is full.

A micro-batch is applied once: its id is part of its folder's name, and a folder that is there has been applied. Nothing
here has event times or windows; `counted_by_window` is an extra for streams that do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkquill.operators.store import MERGE_AT, Store, merged

BUFFER = "doc_id long, embedding array<float>"
#: The buffer's share of the index from which on a merge pays: the index is rewritten once for so many new rows.
GROWTH = 0.1


class Buffer:
    """The recent buffer as one folder per micro-batch, beside the index table of a store.

    Rows keep the order in which they came: by batch, then as written. merge_at: rows from which on a merge is due; beside
    an index of many rows it waits for a tenth of them, so that rewriting it stays in proportion to what came in."""

    def __init__(self, spark: SparkSession, store: Store, merge_at: int = MERGE_AT, name: str = "index"):
        self.spark, self.store, self.merge_at, self.name = spark, store, merge_at, name
        self.path = f"{store.root}/buffer"

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Applies a micro-batch; a second time it is written over by the same rows."""
        rows = rows.selectExpr("cast(doc_id as long) doc_id", "cast(embedding as array<float>) embedding", "monotonically_increasing_id() at")
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        self.store.mark_dirty()

    def rows(self) -> DataFrame:
        """doc_id, embedding, seq (batch, at): the order of arrival."""
        if not self.store.files.names(self.path):
            df = self.spark.createDataFrame([], BUFFER + ", at long, batch long")
        else:
            df = self.spark.read.schema(BUFFER + ", at long, batch long").parquet(self.path)
        return df.select("doc_id", "embedding", F.struct("batch", "at").alias("seq"))

    def _index(self) -> DataFrame:
        return self.store.get(self.name) if self.store.exists(self.name) else self.spark.createDataFrame([], BUFFER)

    def due(self) -> bool:
        waiting = self.rows().count()
        return waiting >= self.merge_at and waiting >= GROWTH * self._index().count()

    def merge(self) -> None:
        """Puts the buffer into the index table and empties it. If it fails between the two, merging again gives the same."""
        self.store.put(self.name, merged(self._index(), self.rows()))
        self.store.files.delete(self.path)
        self.store.clean()


def start(stream: DataFrame, buffer: Buffer, checkpoint: str, every: str | None = None, auto_merge: bool = True) -> StreamingQuery:
    """Runs a stream of (doc_id, embedding) into the buffer: at an interval, or over what is there and then ends."""

    def apply(rows: DataFrame, batch_id: int) -> None:
        buffer.add(rows, batch_id)
        if auto_merge and buffer.due():
            buffer.merge()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def counted_by_window(events: DataFrame, ts: str, late: str, width: str, by: list[str]) -> DataFrame:
    """Counts by window of event time; rows later than allowed are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))
