"""Joins that a hot key doesn't slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key below which it is never dealt, and the share of a task's rows from which on it is.
FEW, QUARTERS = 256, 4


def share(rows: DataFrame, n: int) -> int:
    """From how many rows on a key of `rows` (`n` rows) is hot: a quarter of what a task gets. At most four keys a task
    can be hot, so a list of them is bounded by the number of tasks."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(FEW, n // (QUARTERS * tasks))


def dealt_join(rows: DataFrame, lookup: DataFrame, key: str, count: str, most: int, by: list[str]) -> DataFrame:
    """Inner join of `rows` with `lookup`, which has one row a key and the number of its rows as `count`.

    Rows of a key with more than `most` are dealt by a hash of `by` over as many parts as keep each within it, and the
    lookup's row goes to every part."""
    parts = F.ceil(F.col(count) / F.lit(most)).cast("int")
    hot = lookup.filter(F.col(count) > most).select(key, parts.alias("__parts"))
    # Hot keys are counted in shares of tasks: a list of at most QUARTERS keys a task.
    rows = rows.join(F.broadcast(hot), key, "left")
    rows = rows.withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*by, F.lit(3)), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    lookup = lookup.withColumn("__part", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > most, parts - 1).otherwise(0))))
    return rows.join(lookup, [key, "__part"]).drop("__part")
