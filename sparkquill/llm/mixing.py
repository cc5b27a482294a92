"""Mixing sources to target weights: temperature, then budgeted block permutations.

A source's weight is its share of tokens to the power of an exponent, normalised. The exponent is found by bisection in
[0, 1]: the entropy of the weights falls as it grows, and so does the repetition of the rarest source; it is the least
exponent that keeps to the limit of repeats and brings the entropy down to the target at most. A budget of tokens makes
weights into tokens a source; without one it is the least at which every source is used up once, so nothing is left out.

Each source is read in epochs, every one a permutation of its documents by hash, until its tokens are reached; the last
epoch is broken off after the document that reaches them. A draw's place among its source's tokens gives its block, so
that each block holds every source in proportion to its weight, and the hash orders the block.

Running sums need no task that sees a source: documents are dealt into 4,096 ranges of the hash per source and epoch,
the ranges' totals are summed up first (sources x epochs x 4,096 rows), then each range on its own.

`mixed` realises the draws: it gives every draw the columns of its own row, brings each block's rows together and puts
them in the order of the block's permutation. A row is known by a hash of its id, source and text; rows that share all
three are numbered, so each has its own draws, and none is lost or drawn for another source.

Defined results. A null text has no tokens. A null source is a source. Documents without tokens, and sources of these
only, are not drawn. Null and repeated ids are drawn like others, each row for itself; rows that are repeated as a whole
are drawn as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.llm.quality import WHITE
from sparkquill.tables import written

ROUNDS, RANGES, DIGITS = 60, 3, 12
BLOCK_TOKENS = 1 << 16


def _key() -> Column:
    """A row's identity: equal for rows that share id, source and text. Nulls differ from any value."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), "text")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens (words of the whole text), __key."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), WHITE), ""))
    return docs.select("doc_id", "source", words.cast("long").alias("n_tokens"), _key().alias("__key"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _weights(shares: Column, exponent: Column) -> Column:
    raw = F.transform(shares, lambda p: F.pow(p, exponent))
    return F.transform(raw, lambda x: x / _sum(F.transform(shares, lambda p: F.pow(p, exponent))))


def _entropy(w: Column) -> Column:
    return -_sum(F.transform(w, lambda x: x * F.log(x)))


def _repeats(shares: Column, w: Column, budget: float | None, total: Column) -> Column:
    """How often the most repeated source is read."""
    ratio = F.zip_with(w, shares, lambda x, p: x / p)
    if budget is not None:
        return F.array_max(ratio) * F.lit(float(budget)) / total
    return F.array_max(ratio) / F.array_min(ratio)


def weights(totals: DataFrame, entropy: float, max_repeats: float, budget: int | None = None) -> DataFrame:
    """Of (source, tokens): source, tokens, exponent, weight, target (tokens to draw), all_tokens (their sum's budget).

    The sources' totals are gathered in one row, sorted, and solved there; there are as many as sources."""
    one = totals.filter("tokens > 0").agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("s"), F.sum("tokens").alias("total"))
    one = one.filter(F.size("s") > 0)
    shares = F.transform("s", lambda x: x["tokens"] / F.col("total"))
    one = one.withColumn("shares", shares).withColumn("goal", F.lit(float(entropy)) * F.log(F.size("shares").cast("double")))

    def search(too_low) -> Column:
        first = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def narrow(a, _):
            mid = (a["lo"] + a["hi"]) / 2
            low = too_low(mid)
            return F.struct(F.when(low, mid).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, narrow)["hi"]

    s = F.col("shares")
    one = one.withColumn("by_entropy", search(lambda e: _entropy(_weights(s, e)) > F.col("goal")))
    one = one.withColumn("by_repeats", search(lambda e: _repeats(s, _weights(s, e), budget, F.col("total")) > F.lit(float(max_repeats))))
    one = one.withColumn("exponent", F.round(F.greatest("by_entropy", "by_repeats"), DIGITS))
    one = one.withColumn("w", F.transform(_weights(s, F.col("exponent")), lambda x: F.round(x, DIGITS)))
    cover = F.ceil(F.array_max(F.zip_with("s", "w", lambda x, w: x["tokens"] / w)))
    one = one.withColumn("all_tokens", cover if budget is None else F.lit(int(budget)).cast("long"))
    rows = one.select("exponent", "all_tokens", F.inline(F.zip_with("s", "w", lambda x, w: F.struct(x["source"].alias("source"), x["tokens"].alias("tokens"), w.alias("weight")))))
    return rows.withColumn("target", F.greatest(F.floor(F.col("weight") * F.col("all_tokens")), F.lit(1)).cast("long"))


def _drawn(tokens: DataFrame, entropy: float, max_repeats: float, budget: int | None, block_tokens: int, seed: int) -> DataFrame:
    """`draws` of rows as `counted` gives them, with their __key."""
    plan = weights(tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), entropy, max_repeats, budget)
    plan = plan.withColumn("blocks", F.ceil(F.col("all_tokens") / F.lit(block_tokens)))
    plan = plan.select(F.col("source").alias("__source"), "tokens", "target", "blocks")
    rows = tokens.filter("n_tokens > 0").join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    last = F.floor((F.col("target") - 1) / F.col("tokens")).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = rows.withColumn("sort_key", key).withColumn("range", F.substring("sort_key", 1, RANGES))
    group = ["source", "epoch", "range"]
    sums = rows.groupBy(*group).agg(F.sum("n_tokens").alias("here"))
    running = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("before", F.sum("here").over(running) - F.col("here")).drop("here")
    sums = sums.select(*[F.col(g).alias(f"__{g}") for g in group], "before")
    rows = rows.join(sums, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]).drop(*[f"__{g}" for g in group])
    inside = Window.partitionBy(*group).orderBy("sort_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("epoch") * F.col("tokens") + F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    rows = rows.withColumn("start", start).filter(F.col("start") < F.col("target"))
    block = F.floor(F.col("start").cast("double") / F.col("target").cast("double") * F.col("blocks").cast("double"))
    return rows.select(block.cast("long").alias("block"), "sort_key", "doc_id", "source", F.col("epoch").cast("long").alias("epoch"), "n_tokens", "__key")


def draws(docs: DataFrame, entropy: float = 0.92, max_repeats: float = 4.0, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """One row per draw: block, sort_key (orders the block), doc_id, source, epoch, n_tokens."""
    return _drawn(written(counted(docs), "tokens"), entropy, max_repeats, budget, block_tokens, seed).drop("__key")


def mixed(docs: DataFrame, entropy: float = 0.92, max_repeats: float = 4.0, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """The columns of `docs`, each row as often as it is drawn, with its draws' blocks whole and in the order of their permutations.

    Draws move without texts; texts move to their draws and then to their blocks."""
    tokens = written(counted(docs), "tokens")
    drawn = _drawn(tokens, entropy, max_repeats, budget, block_tokens, seed).select("block", "sort_key", "epoch", "__key")
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), _key().alias("__key"))
    on = ["__key"]
    if not tokens.filter("n_tokens > 0").groupBy("__key").count().filter("count > 1").isEmpty():
        # Rows that share id, source and text: the n-th of them takes the n-th draw of every epoch.
        drawn = drawn.withColumn("__n", F.row_number().over(Window.partitionBy("__key", "epoch").orderBy("sort_key")))
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("__key")))
        on = ["__key", "__n"]
    placed = rows.join(drawn, on).select("__doc", "block", "sort_key")
    return placed.repartition("block").sortWithinPartitions("block", "sort_key").select("__doc.*")
