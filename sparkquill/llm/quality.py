"""Quality rules: base statistics of whole texts, and robust outliers by minimum covariance determinant.

Every document becomes a vector of transformed statistics. Per language and source the estimate looks for the half of
the documents whose covariance has the smallest determinant: from several deterministic starts, concentration steps take
the half that is nearest under the estimate so far, until the determinant falls no more (or after STEPS); the start that
ends with the smallest determinant wins. A document goes when its squared Mahalanobis distance from the winner is over
the cutoff. One step is one aggregation for all groups and starts: rows are counted and their moments summed by group
and by bin of squared distance, so a group of any size shrinks to some hundred rows before the shuffle, and the half is
the run of lowest bins that holds it. No row is sorted, sampled or collected; estimates, a row a group and start, are
written after every step, and starts that have settled take no part in the next.

Repeats and symbols are 0 in most documents, so the half has no variance there; a statistic's variance is its floor at
least. Groups of few rows estimate poorly: a prior spread is added, weighed as PRIOR_ROWS rows against those of the half,
so it fades as the group grows.

Defined results. A null text has no words: base_failed. A null language or source is a group of its own. Repeated rows
count as often as they occur, and each gets its row. An empty table gives an empty result. Extra columns are ignored.
Statistics that are constant or depend on one another leave no covariance singular; equal vectors have distance 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.tables import written

WHITE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Names of the vector's dimensions with the least standard deviation of each, and the spread that small groups are lent.
DIMS: dict[str, float] = {"x_len": 0.4, "x_word": 0.05, "x_sym": 0.3, "x_dup": 0.3, "x_rep": 0.7}
PRIOR: dict[str, float] = {"x_len": 2.0, "x_word": 0.25, "x_sym": 0.5, "x_dup": 0.8, "x_rep": 0.8}
PRIOR_ROWS = 4.0
#: Share of the squared floor that is always added, against statistics that depend on one another.
RIDGE = 0.01
#: Bins of a statistic for the starting quartiles, and bins of ln(1 + squared distance) for the half: both per unit.
STAT_BINS, DIST_BINS = 32, 64
#: Steps at most, starts, and by how much a log determinant must fall to count.
STEPS, STARTS, FALL = 10, 4, 1e-9
#: The variance of the nearest half understates that of the whole; this factor makes up for it in five normal dimensions.
CONSISTENCY = 1.9
#: Cutoff on the squared distance: 99.99 % of a five-dimensional normal population lie
#: under it: a clean document lost costs more than a poor one kept.
CUTOFF = 25.74


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__t", t).withColumn("__w", F.array_remove(F.split("__t", WHITE), ""))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("__l", lines).withColumn("__n", F.size("__w"))
    df = df.withColumn(
        "__tri",
        F.when(
            F.col("__n") >= 3,
            F.transform(
                F.slice("__w", F.lit(1), F.greatest(F.col("__n") - 2, F.lit(0))),
                lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)),
            ),
        ),
    )
    df = df.withColumn(
        "__s",
        F.when(
            F.size(F.array_distinct("__tri")) < F.size("__tri"),
            F.sort_array(F.transform("__tri", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    twice = F.filter(
        F.col("__s"),
        lambda x, k: (F.get("__s", k - 1)["h"] == x["h"]) | (F.get("__s", k + 1)["h"] == x["h"]),
    )
    df = df.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(F.slice("__p", 2, 1_000_000_000), lambda p, k: F.least(F.lit(3), p - F.get("__p", k))),
        F.lit(3).cast("long"),
        lambda a, x: a + x,
    )
    df = (
        df.withColumn("n_words", F.col("__n").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
        .withColumn("n_symbols", (F.length("__t") - F.length(F.regexp_replace("__t", SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.col("__s").isNotNull(), covered).otherwise(F.lit(0)).cast("long"))
        .drop("__t", "__w", "__l", "__n", "__tri", "__s", "__p")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def vector(df: DataFrame) -> DataFrame:
    """The transformed statistics: logarithms of length, mean word length and of rates per hundred."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda c, by: F.log1p(100.0 * F.col(c) / by)
    return (
        df.withColumn("x_len", F.log(n))
        .withColumn("x_word", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n))
        .withColumn("x_sym", rate("n_symbols", F.greatest(F.col("word_chars"), F.lit(1)).cast("double")))
        .withColumn("x_dup", rate("n_dup_lines", n))
        .withColumn("x_rep", rate("n_repeat_words", n))
    )


def _cumulated(counted: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows (keys, order, n) with __before, the count before a row, and __all, that of the whole group."""
    w = Window.partitionBy(*keys)
    run = F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("__before", run - F.col("n")).withColumn("__all", F.sum("n").over(w))


def _cholesky(dims: list[str]) -> list[tuple[str, Column]]:
    """Columns l_i_j of the lower factor of the covariance, in the order in which they need one another."""
    out = []
    for i in range(len(dims)):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out.append((f"l_{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"l_{j}_{j}")))
    return out


def _distance(df: DataFrame, dims: list[str]) -> DataFrame:
    """d2: squared Mahalanobis distance, by forward substitution."""
    for i, c in enumerate(dims):
        rest = F.col(c) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        df = df.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(dims))), F.lit(0.0))
    return df.withColumn("d2", d2)


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _with(rows: DataFrame, params: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Rows with their group's estimate. Groups are few, and Spark picks the join by the measured size."""
    p = params.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in params.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(p, on, how).drop(*[f"__{k}" for k in keys])


def _pairs(dims: dict[str, float]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(dims)) for j in range(i + 1)]


def _estimates(dims: dict[str, float]) -> list[str]:
    return [*[f"m_{i}" for i in range(len(dims))], *[f"l_{i}_{j}" for i, j in _pairs(dims)], "logdet"]


def start(vec: DataFrame, keys: list[str], dims: dict[str, float] = DIMS, prior: dict[str, float] = PRIOR) -> DataFrame:
    """First estimates of each group, a row a start: the median with the prior's spread, the median with that of the
    quartiles, the lower and the upper quartile. Quartiles are by bins. No determinant counts before the first step."""
    names, d = list(dims), range(len(dims))
    each = F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(c) * STAT_BINS).alias("bin")) for i, c in enumerate(names)])
    binned = vec.select(*keys, F.inline(each)).groupBy(*keys, "dim", "bin").agg(F.count("*").alias("n"))
    below = lambda q: 4 * F.col("__before") < q * F.col("__all")
    at = _cumulated(binned, [*keys, "dim"], "bin").groupBy(*keys, "dim")
    at = at.agg(*[F.max(F.when(below(q), (F.col("bin") + 0.5) / STAT_BINS)).alias(f"q{q}") for q in (1, 2, 3)])
    wide = at.groupBy(*keys).agg(*[F.max(F.when(F.col("dim") == i, F.col(f"q{q}"))).alias(f"q{q}_{i}") for q in (1, 2, 3) for i in d])
    spread = [F.lit(prior[c]) for c in names]
    inner = [F.greatest(F.lit(dims[c]), (F.col(f"q3_{i}") - F.col(f"q1_{i}")) / F.lit(1.35)) for i, c in enumerate(names)]

    def one(k: int, q: int, scale: list[Column]) -> Column:
        lower = [(scale[i] if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, j in _pairs(dims)]
        return F.struct(F.lit(k).alias("start"), *[F.col(f"q{q}_{i}").alias(f"m_{i}") for i in d], *lower, F.lit(float("inf")).alias("logdet"))

    return wide.select(*keys, F.inline(F.array(one(0, 2, spread), one(1, 2, inner), one(2, 1, spread), one(3, 3, spread))))


def step(vec: DataFrame, params: DataFrame, keys: list[str], dims: dict[str, float] = DIMS, prior: dict[str, float] = PRIOR) -> DataFrame:
    """One concentration step of every group and start: mean, factored covariance and log determinant of the half that is
    nearest under `params`."""
    names, d, pairs = list(dims), range(len(dims)), _pairs(dims)
    rows = _distance(_with(vec, params, keys, "inner"), names).withColumn("bin", F.floor(F.log1p("d2") * DIST_BINS))
    # Moments about the old centre keep digits that sums of raw squares would lose.
    gap = [F.col(c) - F.col(f"m_{i}") for i, c in enumerate(names)]
    sums = [F.sum(gap[i]).alias(f"s_{i}") for i in d]
    squares = [F.sum(gap[i] * gap[j]).alias(f"q_{i}_{j}") for i, j in pairs]
    old = [F.first(f"m_{i}").alias(f"o_{i}") for i in d]
    group = [*keys, "start"]
    binned = rows.groupBy(*group, "bin").agg(F.count("*").alias("n"), *sums, *squares, *old)
    near = _cumulated(binned, group, "bin").filter(2 * F.col("__before") < F.col("__all")).groupBy(*group)
    near = near.agg(
        F.sum("n").cast("double").alias("h"),
        *[F.sum(f"s_{i}").alias(f"s_{i}") for i in d],
        *[F.sum(f"q_{i}_{j}").alias(f"q_{i}_{j}") for i, j in pairs],
        *[F.first(f"o_{i}").alias(f"o_{i}") for i in d],
    )
    for i in d:
        near = near.withColumn(f"m_{i}", F.col(f"o_{i}") + F.col(f"s_{i}") / F.col("h"))
    for i, j in pairs:
        inner = F.lit(CONSISTENCY) * (F.col(f"q_{i}_{j}") / F.col("h") - (F.col(f"s_{i}") / F.col("h")) * (F.col(f"s_{j}") / F.col("h")))
        if i == j:
            least = dims[names[i]] ** 2
            inner = F.greatest(inner, F.lit(least)) + F.lit(RIDGE * least) + F.lit(prior[names[i]] ** 2 * PRIOR_ROWS) / F.col("h")
        near = near.withColumn(f"c_{i}_{j}", inner)
    for name, value in _cholesky(names):
        near = near.withColumn(name, value)
    near = near.withColumn("logdet", F.lit(2.0) * sum((F.log(f"l_{i}_{i}") for i in d), F.lit(0.0)))
    return near.select(*group, *_estimates(dims))


def concentrated(fit: DataFrame, keys: list[str], steps: int = STEPS, dims: dict[str, float] = DIMS, prior: dict[str, float] = PRIOR) -> DataFrame:
    """Each group's estimate of the smallest determinant: keys, m_i, l_i_j, logdet."""
    names = _estimates(dims)
    params = written(start(fit, keys, dims, prior).withColumn("settled", F.lit(False)), "estimates")
    for _ in range(steps):
        new = step(fit, params.filter("NOT settled"), keys, dims, prior)
        new = new.select(*[F.col(k).alias(f"__{k}") for k in [*keys, "start"]], *[F.col(c).alias(f"new_{c}") for c in names])
        both = params.join(new, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in [*keys, "start"]], "left")
        falls = F.coalesce(F.col("new_logdet") < F.col("logdet") - FALL, F.lit(False))
        chosen = [F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in names]
        params = written(both.select(*keys, "start", *chosen, (~falls).alias("settled")), "estimates")
        if params.filter("NOT settled").isEmpty():
            break
    best = F.min_by(F.struct(*names), F.struct(F.round("logdet", 6), "start"))
    return params.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def fitted(docs: DataFrame, keys: list[str], steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """The statistics of all rows, written once to the shared folder, and each group's estimate.

    Rows that fail the base rules take no part. The texts are read once, each step reads the small vectors."""
    keep = list(dict.fromkeys(["doc_id", *keys]))
    stats = written(vector(base_stats(docs.select(*keep, "text")).drop("text")), "quality")
    return stats, concentrated(stats.filter(~F.col("base_failed")).select(*keys, *DIMS), keys, steps)


def _verdict(rows: DataFrame, params: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    rows = _distance(_with(rows, params, keys), list(DIMS))
    return rows.withColumn("kept", F.coalesce(~F.col("base_failed") & (F.col("d2") <= F.lit(cutoff)), F.lit(False)))


def judge(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """One row per row of `docs`: doc_id, the base statistics, base_failed, kept, d2."""
    stats, params = fitted(docs, list(keys), steps)
    return _verdict(stats, params, list(keys), cutoff).withColumn("d2", F.round("d2", 3))


def filtered(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns; ids may be null or repeated, rows are judged one by one.

    Rows that pass the base rules are written once beside their vectors, so texts are read and counted once; the steps
    read the vectors alone, and joining the small estimates moves no text between machines."""
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), *keys, "text")
    # A filter here would be pushed below and count every text once more for each of its uses: rows that fail lose their texts.
    passed = F.when(~F.col("base_failed"), F.col("__doc")).alias("__doc")
    rows = written(vector(base_stats(rows)).select(passed, *keys, "base_failed", *DIMS), "quality").filter(~F.col("base_failed"))
    return _verdict(rows, concentrated(rows.select(*keys, *DIMS), list(keys), steps), list(keys), cutoff).filter("kept").select("__doc.*")
