"""BM25 over an inverted index of three tables: postings, document lengths, corpus statistics.

The index is built in one pass over the texts. Terms are counted in each document first, so repeats never reach the
shuffle; a query touches only postings of its own terms. Queries are a table, and a batch of them is one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquill.functions.text import tokens
from sparkquill.tables import written

K1, B = 1.2, 0.75


def tokenized(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tokens, dl. There is no filter on dl here: it would be pushed below and tokenize every text once more."""
    df = docs.select(F.col(ident).cast("long").alias("doc_id"), tokens(F.col(text)).alias("tokens"))
    return df.withColumn("dl", F.size("tokens").cast("long"))


def query_terms(queries: DataFrame, ident: str = "qid", text: str = "query") -> DataFrame:
    """qid, term, qtf: how often a query has a term, for each time counts."""
    df = queries.select(F.col(ident).cast("long").alias("qid"), F.explode(tokens(F.col(text))).alias("term"))
    return df.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


@dataclass
class Index:
    """postings(term, doc_id, tf, dl, lead: one of a document's), stats(n, total, avgdl)."""

    postings: DataFrame
    stats: DataFrame

    def save(self, path: str, files: int = 64) -> None:
        """Postings sorted by term within files dealt by term, so that a term's rows are one range of one file."""
        self.postings.repartition(files, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, doc_id, score, rank."""
        return ranked(scored(self.postings, self.stats, query_terms(queries)), k)

    @property
    def n_docs(self) -> int:
        return int(self.stats.first()["n"])


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """n, total, avgdl of a table with a column dl. Documents without a token don't count."""
    dl = F.when(F.col("dl") > 0, F.col("dl"))
    return lengths.agg(F.count(dl).alias("n"), F.coalesce(F.sum(dl), F.lit(0)).alias("total"), F.avg(dl).alias("avgdl"))


def posted(found: DataFrame) -> DataFrame:
    """Terms counted within their row: sorted, each run of equal ones is a posting. Nothing is shuffled."""
    rows = found.select("doc_id", "dl", F.sort_array("tokens").alias("t"))
    starts = F.filter(F.transform("t", lambda x, i: F.when((i == 0) | (F.get("t", i - 1) != x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("s", starts)
    end = lambda j: F.coalesce(F.get("s", j + 1), F.size("t"))
    runs = F.transform("s", lambda i, j: F.struct(F.get("t", i).alias("term"), (end(j) - i).cast("long").alias("tf"), (j == 0).alias("lead")))
    return rows.select("doc_id", "dl", F.inline(runs)).select("term", "doc_id", "tf", "dl", "lead")


def _index(postings: DataFrame) -> Index:
    kept = written(postings, "postings")
    return Index(kept, corpus_stats(kept.filter("lead")))


def build(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> Index:
    """An index of all texts, written to the shared folder: texts are tokenized once. Ids are expected to be unique."""
    return _index(posted(tokenized(docs, ident, text)))


def add(index: Index, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> Index:
    """The index with more documents; those whose id is present, and those without a token, are left out."""
    known = index.postings.filter("lead").select("doc_id")
    return _index(index.postings.unionByName(posted(tokenized(docs, ident, text).join(known, "doc_id", "left_anti"))))


def remove(index: Index, ids: DataFrame) -> Index:
    """The index without the documents of `ids` (doc_id)."""
    return _index(index.postings.join(ids.select("doc_id"), "doc_id", "left_anti"))


def scored(postings: DataFrame, stats: DataFrame, terms: DataFrame, floor: bool = False) -> DataFrame:
    """qid, doc_id, score from postings that may hold other terms too. floor: no average length under 1.

    Everything that is the same for all documents is worked out on the side of the query terms, a table of the batch's
    size. Postings of its terms are dealt by document before they meet the queries, so a task sums the scores of its own
    documents, pairs of a query and a document aren't shuffled, and how many a task holds doesn't grow with the input."""
    df = postings.select("term").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("df"))
    avgdl = F.greatest(F.col("avgdl"), F.lit(1.0)) if floor else F.col("avgdl")
    weights = terms.join(df, "term").crossJoin(F.broadcast(stats.select("n", "avgdl")))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = written(weights.select("qid", "term", (F.col("qtf") * idf).alias("weight"), avgdl.alias("avgdl"), "df", "n"), "weights")
    rows, met, asked, n = weights.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0)), F.countDistinct("qid"), F.coalesce(F.max("n"), F.lit(0))).first()
    tasks = max(1, -(-min(met, asked * n) // PAIRS))
    weights = weights.drop("df", "n")
    # A batch of counted size goes to the postings; a larger one meets them by term.
    if rows <= MOST_BROADCAST:
        some = postings.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi")
        found = some.repartition(tasks, "doc_id").join(F.broadcast(weights), "term")
    else:
        found = postings.join(weights, "term").repartition(tasks, "qid", "doc_id")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.groupBy("qid", "doc_id").agg(exact_sum(part).alias("score"))


def exact_sum(part: Column) -> Column:
    """The sum of numbers below 2 ** 42 or so, the same in whatever order they come.

    Sums of doubles depend on the order, so equal documents could differ in the twelfth digit and miss their place by id.
    Each number is two whole ones here, of steps 2 ** -20 and 2 ** -60, whose sums are exact."""
    high = F.floor(part * 2.0**20)
    low = F.floor((part * 2.0**20 - high) * 2.0**40)
    return F.sum(high) / F.lit(2.0**20) + F.sum(low) / F.lit(2.0**60)


def ranked(scores: DataFrame, k: int | None, column: str = "score") -> DataFrame:
    """The k best of each query (None: all) with their rank; equal scores, to twelve digits, in order of ids."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round(column, 12)), F.asc("doc_id"))
    ranks = scores.withColumn("rank", F.row_number().over(w))
    return ranks if k is None else ranks.filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score, rank."""
    return index.search(queries, k)


def scan(docs: DataFrame, queries: DataFrame, k: int | None, floor: bool = False, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Without an index: the texts are read once, and only hits of query terms leave their task.

    Lengths and hits are written to the shared folder, since statistics are needed before scores."""
    terms = query_terms(queries)
    words = [r["term"] for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(words) > MOST_TERMS:
        index = build(docs, ident, text)
        scores = scored(index.postings, index.stats, terms, floor)
    else:
        found = tokenized(docs, ident, text)
        wanted = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
        hits = written(found.select("doc_id", "dl", F.filter("tokens", lambda t: F.array_contains(wanted, t)).alias("tokens")), "hits")
        scores = scored(posted(hits.filter(F.size("tokens") > 0)), corpus_stats(hits), terms, floor)
    if floor:
        scores = scores.filter("score > 0")
    return scores if k is None else ranked(scores, k)


#: Rows of query terms, some 60 bytes each, that are sent to every executor at most.
MOST_BROADCAST = 200_000
#: Pairs of a query and a document whose scores a task sums, some 100 bytes each.
PAIRS = 1_000_000
#: A batch with more terms than this is answered from an index, where each token meets its term by hash.
MOST_TERMS = 64
