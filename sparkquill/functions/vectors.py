"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _ratio(a: Column, b: Column) -> Column:
    """dot / (norm * norm), null without direction."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different length, without elements or without direction."""
    return F.when(F.size(a) == F.size(b), F.coalesce(_ratio(a, b), F.lit(0.0))).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if a vector has no direction. A longer vector counts as far as the shorter goes."""
    return 1 - F.coalesce(_ratio(a, b), F.lit(0.0))


def same_dimension(a: Column, dim: int) -> Column:
    return F.size(a) == dim


def mean_pool(rows: Column) -> Column:
    """The mean of an array of equally long vectors."""
    n = F.size(rows)
    first = F.transform(F.get(rows, F.lit(0)), lambda x: x.cast("double"))
    total = F.aggregate(F.slice(rows, 2, 1_000_000_000), first, lambda s, r: F.zip_with(s, r, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)


def mean_pooled(rows: DataFrame, by: list[str], column: str = "embedding") -> DataFrame:
    """The means of groups of vectors of any size: `by`, pos (from 0), value.

    Components are added where they are read, so a group that holds most of the rows is as many partial sums as tasks."""
    each = rows.select(*by, F.posexplode(column).alias("pos", "value"))
    return each.groupBy(*by, F.col("pos").cast("long").alias("pos")).agg(F.avg(F.col("value").cast("double")).alias("value"))
