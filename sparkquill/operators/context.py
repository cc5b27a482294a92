"""From search hits to a prompt: one source, neighbours, order, budget, rendering, compression.

Hits are a table (qid, rank, chunk_id, source_id, chunk_index, content, similarity, metadata); a batch of queries is
assembled in one job, by windows over each query's hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions.text import compressed, significant_terms, utf16_length

TOKEN_BUDGET, SEPARATOR = 2000, "\n\n---\n\n"
#: The prompt's parts.
STRICT = 'Answer the question based ONLY on the documents below. If the information is not in the documents, say "I could not find the information in the provided documents".'
PLAIN = "Answer based on the following documents:"


def _only(hits: DataFrame, best: DataFrame) -> DataFrame:
    return hits.join(best.select("qid", "source_id"), ["qid", "source_id"], "left_semi")


def _best(scores: DataFrame, column: str) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc(F.round(column, 12)), F.asc("first_rank"))
    return scores.withColumn("__n", F.row_number().over(w)).filter("__n = 1")


def single_source_by_score(hits: DataFrame) -> DataFrame:
    """The hits of the source with the largest sum of similarities; of equal ones, of that seen first."""
    scores = hits.groupBy("qid", "source_id").agg(F.sum("similarity").alias("score"), F.min("rank").alias("first_rank"))
    return _only(hits, _best(scores.filter("score > -1"), "score"))


def single_source_by_text(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """The hits of the source whose chunks hold most terms of the query (qid, query), the whole query counting 100; where
    none holds any, of the source with the largest sum of similarities."""
    q = queries.select("qid", F.lower("query").alias("__low"), F.col("query").alias("__query"), significant_terms(F.col("query")).alias("__terms"))
    rows = hits.join(q, "qid").withColumn("__content", F.lower("content"))
    points = F.size(F.filter("__terms", lambda t: F.contains(F.col("__content"), t)))
    whole = F.contains(F.col("__content"), F.col("__low")) | F.contains(F.col("content"), F.col("__query"))
    rows = rows.withColumn("__points", points + F.when(whole, 100).otherwise(0))
    scores = rows.groupBy("qid", "source_id").agg(F.sum("__points").alias("points"), F.sum("similarity").alias("score"), F.min("rank").alias("first_rank"))
    by_text = _best(scores.filter("points > 0"), "points")
    by_score = _best(scores.filter("score > -1"), "score").join(by_text.select("qid"), "qid", "left_anti")
    return _only(hits, by_text.select("qid", "source_id").unionByName(by_score.select("qid", "source_id")))


def expand_adjacent(hits: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Hits and up to n chunks before and after each, by source and index; a chunk that is a hit stays the hit.

    Wanted indexes are made first, so the join is on equal source and index."""
    wanted = hits.select("qid", "source_id", F.explode(F.sequence(F.greatest(F.col("chunk_index") - n, F.lit(0)), F.col("chunk_index") + n)).alias("chunk_index")).distinct()
    wanted = wanted.join(hits.select("qid", "source_id", "chunk_index"), ["qid", "source_id", "chunk_index"], "left_anti")
    near = wanted.join(chunks.select("source_id", "chunk_index", "chunk_id", "content"), ["source_id", "chunk_index"])
    near = near.withColumn("similarity", F.lit(0.0)).withColumn("is_hit", F.lit(False))
    own = hits.withColumn("is_hit", F.lit(True))
    cols = ["qid", "source_id", "chunk_index", "chunk_id", "content", "similarity", "is_hit"]
    rows = own.select(cols).unionByName(near.select(cols))
    w = Window.partitionBy("qid").orderBy("source_id", "chunk_index", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w))


def chronological(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("source_id", "chunk_index", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w))


def by_relevance(hits: DataFrame) -> DataFrame:
    return hits


def _diverse(pdf):
    rest = pdf.sort_values("rank").to_dict("records")
    out, last = [], object()
    while rest:
        at = next((i for i, r in enumerate(rest) if r["source_id"] != last), None)
        if at is None:
            out += rest
            break
        last = rest[at]["source_id"]
        out.append(rest.pop(at))
    return type(pdf)([{"qid": r["qid"], "chunk_id": r["chunk_id"], "rank": i + 1} for i, r in enumerate(out)], columns=["qid", "chunk_id", "rank"])


def diverse(hits: DataFrame) -> DataFrame:
    """Each next hit is the first that is left of another source than the last; once there is none, the rest in order.

    The choice depends on all before it, so a query's hits (top-k many) are walked in one group; contents stay behind."""
    order = hits.select("qid", "chunk_id", "source_id", "rank").groupBy("qid").applyInPandas(_diverse, "qid long, chunk_id long, rank int")
    return hits.drop("rank").join(order, ["qid", "chunk_id"])


def _cost(separator: str, single: bool) -> Column:
    """UTF-16 length that a chunk adds to the rendered text, given whether its source, and any, came before it."""
    n = utf16_length(F.col("content"))
    if single:
        return n + F.when(F.col("rank_in") > 1, len(separator.encode("utf-16-le")) // 2).otherwise(0)
    digits = F.length(F.col("source_id").cast("string"))
    meta = F.when(F.col("metadata").isNotNull(), 24 + utf16_length(F.col("metadata"))).otherwise(0)
    return F.when(F.col("in_source") > 1, n + 2).otherwise(n + 55 + digits + meta + F.when(F.col("rank_in") > 1, 1).otherwise(0))


def within_budget(hits: DataFrame, budget: int = TOKEN_BUDGET, separator: str = SEPARATOR, single: bool = False) -> DataFrame:
    """The longest run of hits from the first on whose rendered text has at most four characters a token, with `used`,
    the characters so far. The first hit that is too much ends it."""
    if "metadata" not in hits.columns:
        hits = hits.withColumn("metadata", F.lit(None).cast("string"))
    order = Window.partitionBy("qid").orderBy("rank")
    in_source = Window.partitionBy("qid", "source_id").orderBy("rank")
    rows = hits.withColumn("rank_in", F.row_number().over(order)).withColumn("in_source", F.row_number().over(in_source))
    rows = rows.withColumn("used", F.sum(_cost(separator, single)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Costs are positive: what is over the budget stays over it.
    return rows.filter(F.col("used") <= 4 * budget).drop("in_source")


def render(hits: DataFrame, separator: str = SEPARATOR, single: bool = False) -> DataFrame:
    """qid, text, included: contents joined by the separator, or documents in order of their first hit, each with its
    chunks in order of their index."""
    if single:
        whole = F.sort_array(F.collect_list(F.struct("rank", "content")))
        return hits.groupBy("qid").agg(F.array_join(F.transform(whole, lambda x: x["content"]), separator).alias("text"), F.count("*").alias("included"))
    if "metadata" not in hits.columns:
        hits = hits.withColumn("metadata", F.lit(None).cast("string"))
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "rank", "content")))
    docs = hits.groupBy("qid", "source_id").agg(
        F.min("rank").alias("first"), F.min_by("metadata", "rank").alias("metadata"), F.count("*").alias("n"),
        F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("content"),
    )
    meta = F.when(F.col("metadata").isNotNull(), F.concat(F.lit("  <metadata>"), "metadata", F.lit("</metadata>\n"))).otherwise(F.lit(""))
    block = F.concat(F.lit('<document id="'), F.col("source_id").cast("string"), F.lit('">\n'), meta, F.lit("  <content>\n"), "content", F.lit("\n  </content>\n</document>\n"))
    docs = docs.withColumn("block", block)
    blocks = F.sort_array(F.collect_list(F.struct("first", "block")))
    return docs.groupBy("qid").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n").alias("text"), F.sum("n").alias("included"))


def assembled(hits: DataFrame, queries: DataFrame, budget: int = TOKEN_BUDGET, separator: str = SEPARATOR, single: bool = False) -> DataFrame:
    """Of every query: text, included, estimated_tokens, remaining_budget. Without hits text is empty and both are 0."""
    if single:
        hits = single_source_by_score(hits)
    chosen = within_budget(hits, budget, separator, single)
    used = chosen.groupBy("qid").agg(F.ceil(F.max("used") / 4).cast("long").alias("estimated_tokens"))
    any_hits = hits.select("qid").distinct().withColumn("__any", F.lit(True))
    out = queries.select("qid").join(any_hits, "qid", "left").join(render(chosen, separator, single), "qid", "left").join(used, "qid", "left")
    tokens = F.coalesce("estimated_tokens", F.lit(0))
    return out.select(
        "qid",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("included", F.lit(0)).alias("included"),
        tokens.alias("estimated_tokens"),
        F.when(F.col("__any"), F.lit(budget) - tokens).otherwise(F.lit(0)).alias("remaining_budget"),
    )


def prompt(query: Column, context: Column, strict: bool = True) -> Column:
    """The instruction, the documents and the question; an empty context gives the query alone."""
    head = STRICT if strict else PLAIN
    whole = F.concat(F.lit(f"{head}\n\n--- Reference Documents ---\n"), context, F.lit("\n--- End of Documents ---\n\nQuestion: "), query, F.lit("\n\nAnswer:"))
    return F.when(F.coalesce(context, F.lit("")) == "", query).otherwise(whole)


def joined_contents(hits: DataFrame) -> DataFrame:
    """qid, text: contents in order, parted by a blank line."""
    whole = F.sort_array(F.collect_list(F.struct("rank", "content")))
    return hits.groupBy("qid").agg(F.array_join(F.transform(whole, lambda x: x["content"]), "\n\n").alias("text"), F.count("*").alias("included"))


def compressed_context(hits: DataFrame, budget: int = TOKEN_BUDGET) -> DataFrame:
    """All hits' contents, compressed to four characters a token."""
    df = joined_contents(hits).withColumn("c", compressed(F.col("text"), 4 * budget))
    n = F.ceil(utf16_length(F.col("c.text")) / 4).cast("long")
    return df.select("qid", F.col("c.text").alias("text"), "included", n.alias("estimated_tokens"), (F.lit(budget) - n).alias("remaining_budget"))


def prompt_compressed(hits: DataFrame, max_tokens: int = TOKEN_BUDGET) -> DataFrame:
    """The same with the figures of the compression and the tokens it saves."""
    df = joined_contents(hits).withColumn("c", compressed(F.col("text"), 4 * max_tokens))
    saved = F.ceil(F.col("c.original_chars") / 4) - F.ceil(F.col("c.compressed_chars") / 4)
    return df.select("qid", F.col("c.text").alias("text"), F.col("c.original_chars"), F.col("c.compressed_chars"), F.col("c.ratio"), saved.cast("long").alias("tokens_saved"), "included")


def scored_sentences(sentences: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.2) -> DataFrame:
    """sentences (qid, pos, sentence, embedding), queries (qid, embedding): the k most similar of each query's own that
    reach `least`, with their similarity; equal ones in order of place."""
    from sparkquill.functions.vectors import cosine

    q = queries.select("qid", F.col("embedding").alias("__q"))
    rows = sentences.join(q, "qid").withColumn("similarity", cosine(F.col("embedding"), F.col("__q"))).filter(F.col("similarity") >= least)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("similarity", 12)), F.asc("pos"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "pos", "sentence", "similarity", "rank")


def compressed_by_similarity(hits: DataFrame, queries: DataFrame, embed, k: int = 15, least: float = 0.2) -> DataFrame:
    """Each query's most similar sentences in their order, without repeats. embed: a column of texts to one of vectors."""
    from sparkquill.functions.text import sentences as split

    parts = joined_contents(hits).select("qid", F.posexplode(split(F.col("text"))).alias("pos", "sentence"))
    best = scored_sentences(parts.withColumn("embedding", embed(F.col("sentence"))), queries, k, least)
    text = best.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    return text.withColumn("text", compressed(F.col("text"))["text"])
