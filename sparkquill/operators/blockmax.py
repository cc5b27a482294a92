"""Keyword search that skips what can't rank: postings in blocks with upper bounds.

A block holds a term's postings of `SPAN` neighbouring ids as one row, with their greatest frequency and least length. The
blocks of all terms cover the same ids, so for a query the sum of its terms' bounds in a block bounds the score of every
document there. A search

1. adds up the bounds of each query's blocks, from the small columns alone;
2. scores the `SEEDS` blocks of the greatest bounds: the k-th best score there is one that the k-th best of all reaches;
3. scores the other blocks whose bound reaches it, and skips the rest.

Nothing that could enter the k best is left out, ties included, so ranks are those of scoring every posting. Scored
postings are all that is unpacked and shuffled. A common term is as many rows as its ids have blocks, dealt over files and
tasks by term and block."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.operators import bm25
from sparkquill.operators.bm25 import K1, MOST_BROADCAST, PAIRS, B
from sparkquill.tables import written

#: Ids of a block, and blocks that a query's threshold comes from.
SPAN, SEEDS = 256, 4
#: A bound counts as reached from this much below on: sums of equal scores may differ in their last digits.
SLACK = 1e-9


def _part(tf: Column, dl: Column) -> Column:
    return F.col("weight") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def _terms(weights: DataFrame) -> DataFrame:
    return F.broadcast(weights.select("term").distinct())


@dataclass
class BlockIndex:
    """blocks(term, block, n, max_tf, min_dl, docs: array of doc_id, tf, dl), stats(n, total, avgdl)."""

    blocks: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, index: bm25.Index) -> BlockIndex:
        """From an index's postings: one exchange by term and block."""
        return cls._packed(index.postings)

    @classmethod
    def of(cls, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> BlockIndex:
        """From texts: their postings go into blocks as they are found and are no table of their own."""
        return cls._packed(bm25.posted(bm25.tokenized(docs, ident, text)))

    @classmethod
    def _packed(cls, postings: DataFrame) -> BlockIndex:
        rows = postings.groupBy("term", F.floor(F.col("doc_id") / SPAN).alias("block"))
        # One posting of a document leads, so a block's rows also tell how many documents there are and how long.
        lead = [F.sum(F.when(F.col("lead"), x).otherwise(0)).alias(name) for name, x in (("leads", F.lit(1)), ("lengths", F.col("dl")))]
        packed = rows.agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(F.struct("doc_id", "tf", "dl")).alias("docs"), *lead)
        blocks = written(packed, "blocks")
        stats = blocks.agg(F.coalesce(F.sum("leads"), F.lit(0)).alias("n"), F.coalesce(F.sum("lengths"), F.lit(0)).alias("total"))
        return cls(blocks.drop("leads", "lengths"), written(stats.withColumn("avgdl", F.try_divide(F.col("total").cast("double"), F.col("n"))), "block-stats"))

    def save(self, path: str) -> None:
        """Sorted by term and block over files of about even size, so a common term is in many of them."""
        self.blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockIndex:
        return cls(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/stats"))

    def _bounds(self, queries: DataFrame) -> tuple[DataFrame, bool, DataFrame]:
        """The queries' weights by term, whether they are few enough to be sent out, and qid, block, bound, postings."""
        terms = bm25.query_terms(queries)
        df = self.blocks.select("term", "n").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
        weights = terms.join(df, "term").crossJoin(F.broadcast(self.stats.select(F.col("n").alias("all"), "avgdl")))
        idf = F.log((F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weights = written(weights.select("qid", "term", (F.col("qtf") * idf).alias("weight"), "avgdl"), "weights")
        few = weights.count() <= MOST_BROADCAST
        each = self.blocks.select("term", "block", "n", "max_tf", "min_dl")
        if few:
            # A block's few numbers meet the queries in one task, so pairs of a query and a block aren't shuffled.
            each = each.join(_terms(weights), "term", "left_semi").repartition("block").join(F.broadcast(weights), "term")
        else:
            each = each.join(weights, "term")
        bounds = each.groupBy("qid", "block").agg(F.sum(_part(F.col("max_tf"), F.col("min_dl"))).alias("bound"), F.sum("n").alias("postings"))
        return weights, few, written(bounds, "bounds")

    def _scores(self, weights: DataFrame, few: bool, chosen: DataFrame) -> DataFrame:
        """qid, doc_id, score in the chosen blocks (qid, block).

        Of a batch that is sent out, the chosen blocks of its terms are dealt by block, once for all queries: a task sums the
        scores of its blocks' documents, a bounded number, and neither other blocks nor pairs of a query and a document are
        shuffled."""
        if few:
            by_block = chosen.groupBy("block").agg(F.collect_set("qid").alias("qids"))
            tasks = max(1, -(-chosen.count() * SPAN // PAIRS))
            rows = self.blocks.select("term", "block", "docs").join(_terms(weights), "term", "left_semi")
            rows = rows.repartition(tasks, "block").join(by_block, "block").join(F.broadcast(weights), "term").filter(F.array_contains("qids", F.col("qid")))
        else:
            rows = self.blocks.select("term", "block", "docs").join(weights.join(chosen.select("qid", "block"), "qid"), ["term", "block"])
        rows = rows.select("block", "qid", "weight", "avgdl", F.explode("docs").alias("x"))
        sums = rows.groupBy("block", "qid", F.col("x.doc_id").alias("doc_id")).agg(bm25.exact_sum(_part(F.col("x.tf"), F.col("x.dl"))).alias("score"))
        return sums.select("qid", "doc_id", "score")

    def _chosen(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Scores of all documents that may be among the k best, and the bounds with what has been scored."""
        weights, few, bounds = self._bounds(queries)
        seeds = bm25.ranked(bounds.withColumnRenamed("block", "doc_id"), SEEDS, "bound").select("qid", F.col("doc_id").alias("block"))
        seeds = written(seeds, "seeds")
        first = written(self._scores(weights, few, seeds), "seed-scores")
        least = bm25.ranked(first, k).filter(F.col("rank") == k).select("qid", F.col("score").alias("least"))
        marked = bounds.join(seeds.withColumn("seed", F.lit(True)), ["qid", "block"], "left").join(least, "qid", "left")
        marked = marked.withColumn("seed", F.coalesce("seed", F.lit(False)))
        reached = F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)
        marked = written(marked.withColumn("scored", F.col("seed") | reached), "marked")
        return first.unionByName(self._scores(weights, few, marked.filter("scored AND NOT seed"))), marked

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, doc_id, score, rank: the rows of bm25.search."""
        return bm25.ranked(self._chosen(queries, k)[0], k)

    def skipped(self, queries: DataFrame, k: int) -> DataFrame:
        """What a search leaves out: qid, postings of its terms, postings scored."""
        marked = self._chosen(queries, k)[1]
        return marked.groupBy("qid").agg(F.sum("postings").alias("postings"), F.sum(F.when(F.col("scored"), F.col("postings")).otherwise(0)).alias("scored"))
