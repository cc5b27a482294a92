"""Retrieval quality: recall and precision by text, rank metrics by source, weight sweeps, query synthesis."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions.text import collapse, utf16_length
from sparkquill.operators.fusion import rrf_score

#: Fixed values: (vector weight, keyword weight) of a sweep, in order; of equal summaries the first is the best.
WEIGHTS = [(0.0, 1.0), (0.2, 0.8), (0.4, 0.6), (0.5, 0.5), (0.6, 0.4), (0.8, 0.2), (1.0, 0.0)]


def recall_precision(results: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """results (qid, rank, content), cases (qid, relevant: array of strings): qid, recall, precision, passed.

    A result is relevant if it holds one of the strings, whatever the case."""
    rows = cases.join(results.filter(F.col("rank") <= k), "qid", "left")
    hit = F.exists("relevant", lambda r: F.contains(F.lower("content"), F.lower(r)))
    out = rows.groupBy("qid").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("hits"), F.first(F.size("relevant")).alias("expected"))
    bound = F.least(F.greatest(F.col("expected"), F.lit(1)), F.lit(k))
    return out.select("qid", (F.col("hits") / bound).alias("recall"), (F.col("hits") / F.lit(k)).alias("precision"), (F.col("hits") > 0).alias("passed"))


def quality_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("total"), F.sum(F.col("passed").cast("int")).alias("passed"), F.avg("recall").alias("avg_recall"),
        F.avg("precision").alias("avg_precision"), F.avg(F.col("passed").cast("double")).alias("pass_rate"),
    )


def first_ranks(results: DataFrame, cases: DataFrame) -> DataFrame:
    """cases with `rank`, the first place of the expected source among the results (qid, rank, source_id); 0: absent."""
    found = results.join(cases.select("qid", F.col("expected_source").alias("source_id")), ["qid", "source_id"])
    best = found.groupBy("qid").agg(F.min("rank").alias("rank"))
    return cases.join(best, "qid", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def _metrics(recall_k: int, rank_k: int) -> list[Column]:
    r = F.col("rank")
    inside = lambda k: (r > 0) & (r <= k)
    return [
        F.count("*").alias("n"),
        F.avg(F.when(inside(recall_k), 1.0).otherwise(0.0)).alias("recall"),
        F.avg(F.when(inside(rank_k), 1.0 / r).otherwise(0.0)).alias("mrr"),
        F.avg(F.when(inside(rank_k), 1.0 / F.log2(r + 1)).otherwise(0.0)).alias("ndcg"),
    ]


def rank_metrics(ranks: DataFrame, recall_k: int = 5, rank_k: int = 10) -> DataFrame:
    """ranks (qid, query_type, language, rank): scope, n, recall, mrr, ndcg, overall, by type and by language, in one pass
    of grouping sets. Every type but hard_negative is positive."""
    kind = F.when(F.col("query_type") == "hard_negative", "hard_negative").otherwise("positive")
    rows = ranks.select(kind.alias("kind"), "language", "rank")
    out = rows.groupingSets([[], ["kind"], ["language"]], "kind", "language").agg(F.grouping_id().alias("__set"), *_metrics(recall_k, rank_k))
    scope = F.when(F.col("__set") == 3, "overall").when(F.col("__set") == 1, F.col("kind")).otherwise(F.col("language"))
    return out.withColumn("scope", scope).filter(F.col("scope").isNotNull()).select("scope", "n", "recall", "mrr", "ndcg")


def hit_metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    """hit1, hit3 and mrr3 of the groups."""
    r = F.col("rank")
    return ranks.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.when(r == 1, 1.0).otherwise(0.0)).alias("hit1"),
        F.avg(F.when((r > 0) & (r <= 3), 1.0).otherwise(0.0)).alias("hit3"),
        F.avg(F.when((r > 0) & (r <= 3), 1.0 / r).otherwise(0.0)).alias("mrr3"),
    )


def weight_sweep(vector_ranks: DataFrame, bm25_ranks: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """Hit metrics of every pair of weights, over candidates that are joined once: setting, weights, figures, is_best.

    expected (qid, doc_id). The best has the most at 1000 x hit1 + 10 x mrr3, of equal ones the first."""
    v = vector_ranks.select("qid", "doc_id", F.col("rank").alias("vector_rank"))
    b = bm25_ranks.select("qid", "doc_id", F.col("rank").alias("bm25_rank"))
    both = v.join(b, ["qid", "doc_id"], "full_outer")
    part = lambda c, w: F.coalesce(F.lit(w) * rrf_score(F.col(c), 60), F.lit(0.0))
    settings = F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(x).alias("vector_weight"), F.lit(y).alias("bm25_weight"), (part("vector_rank", x) + part("bm25_rank", y)).alias("score")) for i, (x, y) in enumerate(WEIGHTS)])
    order = Window.partitionBy("qid", "setting").orderBy(F.desc(F.round("score", 12)), F.asc("doc_id"))
    top = both.select("qid", "doc_id", F.inline(settings)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    weights = F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(x).alias("vector_weight"), F.lit(y).alias("bm25_weight")) for i, (x, y) in enumerate(WEIGHTS)])
    own = expected.select("qid", "doc_id", F.inline(weights)).join(top.select("qid", "doc_id", "setting", "rank"), ["qid", "doc_id", "setting"], "left")
    out = hit_metrics(own.withColumn("rank", F.coalesce("rank", F.lit(0))), ["setting", "vector_weight", "bm25_weight"])
    # One row per setting.
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(1000 * F.col("hit1") + 10 * F.col("mrr3"), 9)), "setting")
    return out.withColumn("is_best", F.row_number().over(w) == 1)


def synthesized_queries(docs: DataFrame, words: int = 7, most: int = 10) -> DataFrame:
    """(source_id, content) -> source_id, pos, query: first words of sentences of 24 characters or more, distinct, of 12
    characters or more, in order, at most so many of a source."""
    parts = F.filter(F.transform(F.split(collapse(F.coalesce("content", F.lit(""))), "[.!?。]"), lambda s: F.trim(s)), lambda s: utf16_length(s) >= 24)

    def query(s):
        found = F.filter(F.split(s, " "), lambda w: w != "")
        return F.when(F.size(found) >= words, F.array_join(F.slice(found, 1, words), " ")).when(F.length(s) > 48, F.substring(s, 1, 48)).otherwise(s)

    made = F.slice(F.array_distinct(F.filter(F.transform(parts, query), lambda q: utf16_length(q) >= 12)), 1, most)
    return docs.select("source_id", F.posexplode(made).alias("pos", "query"))


def hard_negatives(queries: DataFrame, distractors: DataFrame, words: int = 7) -> DataFrame:
    """Each query (source_id, pos, query) with two words of the distractor (pos, query) of the same place, going round."""
    n = distractors.agg(F.count("*").alias("__n"))
    w = Window.orderBy("pos", "query")
    ring = distractors.withColumn("__at", F.row_number().over(w) - 1).select("__at", F.col("query").alias("__other"))
    rows = queries.crossJoin(F.broadcast(n)).withColumn("__at", F.pmod(F.col("pos"), F.col("__n")).cast("int"))
    head = lambda c, k: F.array_join(F.slice(F.filter(F.split(c, " "), lambda x: x != ""), 1, k), " ")
    mixed = F.trim(F.concat_ws(" ", head("query", words), head("__other", 2)))
    return rows.join(ring, "__at").select("source_id", "pos", mixed.alias("query")).filter(utf16_length(F.col("query")) >= 12)


def latency(run: Callable[[], object], times: int) -> dict[str, float]:
    """Milliseconds of a call: avg, min, max of so many after one that doesn't count."""
    run()
    took = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        took.append((time.perf_counter() - began) * 1000)
    return {"avg_ms": sum(took) / len(took), "min_ms": min(took), "max_ms": max(took), "iterations": float(times)}
