"""Delta-maintained rollups of token counts by source, language and tokenizer version.

A change is an insert (+tokens), a delete (-tokens) or a revised count (+new -old); its sign makes totals additive, so a
batch of changes, whatever its size, becomes one small table of sums: partial sums in every task, then one row a group.
No total is read to apply a batch.

Commits. A batch has an id. Its sums are written to a folder of this attempt; then a marker named by the batch id, whose
content names the attempt, is put in place in one step that fails if there is one. Totals add up marked attempts alone.
Applying a batch again, after a lost driver or twice at a time, changes nothing.
`compact` writes the sums of all batches committed so far and the list of their attempts as tables, then puts a numbered
fold in place, again in one step that fails if another was first. Totals are the newest fold's sums and those of marked
attempts that it doesn't list: before that step nothing has changed, after it the same totals come from fewer files.
Files that a fold replaced go with the next fold, so readers that have begun can end.

Markers and lists are read as tables, not by the driver. All paths go through the Hadoop file system, so the store can
stand wherever executors can write and a rename doesn't replace, as on HDFS; on a local file system a hard link is made.

Counts. `words` and `pieces` count by pattern, in the scan; `model_tokens` counts by a SentencePiece model, exactly as the
encoder does.

Defined results. A null text counts 0 tokens, a null source or language is a group of its own, repeated rows count as
often as they occur, groups whose documents and tokens are both 0 are absent. A batch without changes is committed too.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquill.files import Files
from sparkquill.llm.quality import WHITE
from sparkquill.tables import scratch_dir, written

GROUP = ["source", "lang", "version"]
SUMS = "source string, lang string, version string, n_docs long, n_tokens long"
#: Tokenizer versions that are counted by a pattern: pieces are runs of letters and digits, and other signs one by one.
PIECES = "[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]"


def words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")).cast("long")


def pieces(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PIECES)).cast("long")


def inserts(counts: DataFrame, version: str, tokens: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(version).alias("version"), F.lit(1).alias("docs"), F.col(tokens).alias("tokens"))


def deletes(counts: DataFrame, version: str, tokens: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(version).alias("version"), F.lit(-1).alias("docs"), (-F.col(tokens)).alias("tokens"))


def revisions(counts: DataFrame, version: str, old: str, new: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(version).alias("version"), F.lit(0).alias("docs"), (F.col(new) - F.col(old)).alias("tokens"))


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*GROUP).agg(F.sum("docs").cast("long").alias("n_docs"), F.sum("tokens").cast("long").alias("n_tokens"))


def model_tokens(docs: DataFrame, path: str, name: str = "tokens") -> DataFrame:
    """`docs` with the number of tokens that the SentencePiece model at `path` makes of the whole text."""
    from sparkquill.llm.arrowio import in_pieces, lean, sized
    from sparkquill.llm.piece_codec import Encoder

    def run(batches):
        encoder = Encoder(path)
        for batch in in_pieces(batches, "text", 2 << 20):
            counts = [len(ids) for ids in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, name])

    rows = docs.drop(name)
    return sized(rows).mapInArrow(lean(run), T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


class Rollup:
    """A store of totals under `root`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)

    def committed(self, batch: str) -> bool:
        return self.files.exists(f"{self.root}/_commits/{batch}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch; False, without doing anything, if it was applied before."""
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        summed(changes).write.parquet(f"{self.root}/sums/attempt={attempt}")
        if self.files.put_once(f"{self.root}/_commits/{batch}", attempt):
            return True
        self.files.delete(f"{self.root}/sums/attempt={attempt}")
        return False

    def _fold(self) -> tuple[int, str | None]:
        """Number and folder of the newest fold; 0 and None without one."""
        newest = max(map(int, self.files.names(f"{self.root}/_folds")), default=0)
        return (newest, f"{self.root}/folds/{self.files.text(f'{self.root}/_folds/{newest}')}") if newest else (0, None)

    def _marked(self, fold: str | None) -> DataFrame:
        """attempt: those of all markers that `fold` doesn't list."""
        if not self.files.exists(f"{self.root}/_commits"):
            return self.spark.createDataFrame([], "attempt string")
        marked = self.spark.read.text(f"{self.root}/_commits", wholetext=True).select(F.col("value").alias("attempt"))
        return marked.join(self.spark.read.schema("attempt string").parquet(f"{fold}/attempts"), "attempt", "left_anti") if fold else marked

    def _sums(self, fold: str | None, attempts: DataFrame) -> DataFrame:
        """The totals of a fold and of attempts that it doesn't list."""
        rows = self.spark.createDataFrame([], SUMS)
        if self.files.exists(f"{self.root}/sums"):
            all_rows = self.spark.read.schema(SUMS + ", attempt string").parquet(f"{self.root}/sums")
            rows = rows.unionByName(all_rows.join(attempts, "attempt", "left_semi").drop("attempt"))
        if fold:
            rows = rows.unionByName(self.spark.read.schema(SUMS).parquet(f"{fold}/sums"))
        out = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.filter("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens over all committed batches."""
        _, fold = self._fold()
        return self._sums(fold, self._marked(fold))

    def compact(self) -> bool:
        """Folds all batches committed so far; their ids stay committed. False if there is nothing to fold, or another
        fold was first. If it ends early, totals are what they were and left-over files count for nothing."""
        number, old = self._fold()
        if self._marked(old).isEmpty():
            return False
        folder = f"{self.root}/folds/{uuid.uuid4().hex}"
        # The attempts to fold are fixed before they are summed up: batches committed meanwhile stay for the next fold.
        self._marked(old).write.parquet(f"{folder}/new")
        new = self.spark.read.schema("attempt string").parquet(f"{folder}/new")
        listed = new.unionByName(self.spark.read.schema("attempt string").parquet(f"{old}/attempts")) if old else new
        listed.write.parquet(f"{folder}/attempts")
        self._sums(old, new).write.parquet(f"{folder}/sums")
        if not self.files.put_once(f"{self.root}/_folds/{number + 1}", folder.rsplit("/", 1)[1]):
            self.files.delete(folder)
            return False
        if old:
            # What the fold before this one replaced: no reader that began since needs it.
            for r in self.spark.read.schema("attempt string").parquet(f"{old}/new").toLocalIterator():
                self.files.delete(f"{self.root}/sums/attempt={r['attempt']}")
            for f in range(1, number):
                self.files.delete(f"{self.root}/_folds/{f}")
        return True


def maintained(docs: DataFrame, takedowns: DataFrame, root: str | None = None) -> DataFrame:
    """Totals after a run of batches over `docs`: all rows inserted under two tokenizer versions; the first one's counts
    revised to leave out lines that a text repeats; the batches so far folded; the documents of `takedowns` (doc_id)
    deleted; the first batch delivered once more, which changes nothing. Without `root` the store is for this run alone."""
    spark = docs.sparkSession
    lines = F.array_join(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n")), "\n")
    counts = docs.select("doc_id", "source", "lang", words(F.col("text")).alias("words"), pieces(F.col("text")).alias("pieces"), words(lines).alias("revised"))
    counts = written(counts, "counts")
    store = Rollup(spark, root or scratch_dir(spark, "rollup"))
    store.commit("load-words-1", inserts(counts, "words-1", "words"))
    store.commit("load-pieces-1", inserts(counts, "pieces-1", "pieces"))
    store.commit("revise-words-1", revisions(counts.filter("revised <> words"), "words-1", "words", "revised"))
    store.compact()
    gone = counts.join(takedowns.select("doc_id").distinct(), "doc_id", "left_semi")
    store.commit("takedowns", deletes(gone, "words-1", "revised").unionByName(deletes(gone, "pieces-1", "pieces")))
    store.commit("load-words-1", inserts(counts, "words-1", "words"))
    return store.totals()
