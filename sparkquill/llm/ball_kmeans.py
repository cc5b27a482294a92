"""Ball k-means: exact Lloyd rounds that compare a vector only with the centroids whose balls can reach it.

Vectors hang on anchors: a vector's anchor is the cluster it was in when the anchors were last written. The members of an
anchor are a ball around its present centroid. With d the squared distances,

- centroid j is a neighbour of ball i only if d(i, j) <= 4 r_i, where the radius r_i is known from the round before, plus
  the way the centroid has gone since; the driver lists each ball's neighbours, nearest first;
- a member x with 4 d(x, i) < d(i, nearest neighbour) is in the stable core and is compared with nobody;
- the neighbours' distances cut the rest into annuli: a member of annulus p is compared with the p nearest neighbours only.

By the triangle inequality a centroid left out is strictly farther than x's own, whatever the anchor, so results are those
of plain Lloyd rounds to the last digit, ties to the smaller number included, and anchors may grow old: they are written
anew only after a round in which more than `STALE` of the vectors were nearer to another centroid than to their anchor's.
A round otherwise is one scan whose tasks each send one row a cluster, of counts and componentwise sums.

All arithmetic is exact. Components are integers held in doubles; where a sum of squares could pass 2 ** 53 Python's
integers take over. Sums of tasks are added as decimals.

Defined results. Rows whose vector is null, has another number of components, or has a null, non-finite or immense
component (an integer over 2 ** 90) are left out. Repeated rows each count; equal hashes of repeated ids are ordered by
their components. A null vec_id hashes like `3:`. With fewer vectors than clusters there are as many clusters as vectors;
without vectors the result is empty. A distance or inertia that no long holds is null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.arrowio import lean, sized
from sparkquill.tables import written

SCALE, LARGEST = 1024, 2.0**90
#: Share of the vectors that have left their anchors from which on anchors are written anew.
STALE = 0.1
#: Rows that are compared at once, and the largest component with which 64 squares stay exact in doubles.
BLOCK, EXACT = 4096, 1 << 20
#: A squared radius from which on a ball may reach everywhere.
IMMENSE = 10**38 - 1


@dataclass
class Balls:
    """Centroids (exact integers) and each ball's neighbours, nearest first: (number, squared distance)."""

    centroids: list[list[int]]
    neighbours: list[list[tuple[int, int]]]
    #: All distances are exact in doubles.
    small: bool = field(init=False)
    at: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        largest = max((abs(x) for c in self.centroids for x in c), default=0)
        width = len(self.centroids[0]) if self.centroids else 0
        self.small = largest <= EXACT and width <= 2048
        self.at = np.array(self.centroids, dtype=np.float64 if self.small else object)


def _gap(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _root(x: int) -> int:
    """The least integer whose square is x or more."""
    r = math.isqrt(x)
    return r + (r * r < x)


def balls(centroids: list[list[int]], radii: list[int] | None = None) -> Balls:
    """Balls with these squared radii; without radii every other centroid is a neighbour."""
    lists = []
    for i, c in enumerate(centroids):
        gaps = sorted((_gap(c, other), j) for j, other in enumerate(centroids) if j != i)
        lists.append([(j, g) for g, j in gaps if radii is None or g <= 4 * radii[i]])
    return Balls(centroids, lists)


def quantized(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 x) of the vectors as integers held in doubles, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).reshape(-1, width)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return (gap * gap).sum(axis=1)


def assign(x: np.ndarray, anchor: np.ndarray | None, b: Balls) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, its squared distance, squared distance to the anchor, number of distances worked out) of the rows of x.

    Without anchors all rows hang on centroid 0, whose neighbours must then be all others."""
    n = len(x)
    small = b.small and (not n or np.abs(x).max() <= EXACT)
    if not small:
        x = np.array([[int(v) for v in row] for row in x], dtype=object).reshape(n, -1)
    at = b.at if small or not b.small else np.array(b.centroids, dtype=object)
    anchor = np.zeros(n, np.int64) if anchor is None else anchor
    cluster = anchor.astype(np.int64).copy()
    best = np.zeros(n, dtype=np.float64 if small else object)
    for i in np.unique(anchor):
        rows = np.flatnonzero(anchor == i)
        best[rows] = _distances(x[rows], at[i])
    own, made = best.copy(), n
    for i in np.unique(anchor):
        members = np.flatnonzero(anchor == i)
        for j, gap in b.neighbours[i]:
            # Annuli: whoever is too near to its own centroid for this neighbour is so for all later ones.
            members = members[4 * own[members] >= gap]
            if not len(members):
                break
            d = _distances(x[members], at[j])
            made += len(members)
            closer = (d < best[members]) | ((d == best[members]) & (j < cluster[members]))
            best[members[closer]], cluster[members[closer]] = d[closer], j
    return cluster, best, own, made


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, BLOCK):
        yield batch.slice(start, BLOCK)


def _anchored(b: Balls, width: int) -> Callable:
    """Each vector with its cluster as its anchor."""

    def run(batches):
        for whole in batches:
            for batch in _blocks(whole):
                old = np.asarray(batch.column("anchor")) if "anchor" in batch.schema.names else None
                cluster, *_ = assign(quantized(batch.column("vector"), width), old, b)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cluster, pa.int32())], names=["vec_id", "vector", "anchor"])

    return run


_SUMS = "cluster int, n long, dim int, total decimal(38,0), radius decimal(38,0), gone long, made long"


def _totals(b: Balls, width: int) -> Callable:
    """One row a cluster and component, of everything a task has read."""

    def run(batches):
        k = len(b.centroids)
        n, sums = [0] * k, [[0] * width for _ in range(k)]
        radius, gone, made = [0] * k, [0] * k, [0] * k
        for whole in batches:
            for batch in _blocks(whole):
                x, anchor = quantized(batch.column("vector"), width), np.asarray(batch.column("anchor")).astype(np.int64)
                cluster, _, own, work = assign(x, anchor, b)
                made[0] += work
                large = bool(len(x)) and np.abs(x).max() > EXACT
                for i in np.unique(cluster):
                    part = x[cluster == i]
                    added = [sum(map(int, part[:, c])) for c in range(width)] if large else part.sum(axis=0).astype(np.int64).tolist()
                    n[i] += len(part)
                    sums[i] = [a + c for a, c in zip(sums[i], added, strict=True)]
                for i in np.unique(anchor):
                    mine = anchor == i
                    radius[i] = max(radius[i], int(own[mine].max()))
                    gone[i] += int((cluster[mine] != i).sum())
        rows = [(i, n[i], c, sums[i][c], min(radius[i], IMMENSE), gone[i], made[i]) for i in range(k) for c in range(width)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        types = [pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.int64(), pa.int64()]
        values = [[Decimal(v) for v in c] if pa.types.is_decimal(t) else list(c) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in _SUMS.split(", ")])

    return run


@dataclass
class Round:
    """What a round did: rows, distances worked out, rows that were nearer to another centroid than to their anchor's."""

    rows: int
    made: int
    gone: int


def kept_vectors(df: DataFrame, width: int) -> DataFrame:
    """vec_id, vector of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * SCALE > F.lit(LARGEST)))
    rows = df.filter(F.col("embedding").isNotNull() & (F.size("embedding") == width)).filter(~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of `seed:vec_id`; a top-k, of which every task keeps k."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return [[math.floor(float(x) * SCALE) for x in r["vector"]] for r in first]


@dataclass
class Clustering:
    """The fitted centroids, the anchored vectors they were fitted on, and what each round did."""

    vectors: DataFrame
    balls: Balls
    width: int
    rounds: list[Round]

    def assigned(self) -> DataFrame:
        """vec_id, cluster, distance of every vector."""
        b, width = self.balls, self.width

        def run(batches):
            for whole in batches:
                for batch in _blocks(whole):
                    cluster, best, *_ = assign(quantized(batch.column("vector"), width), np.asarray(batch.column("anchor")).astype(np.int64), b)
                    exact = [d if d < 1 << 63 else None for d in map(int, best)]
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(exact, pa.int64())], names=["vec_id", "cluster", "distance"])

        return sized(self.vectors).mapInArrow(lean(run), "vec_id long, cluster int, distance long")


def fit(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3) -> Clustering:
    """`rounds` rounds from the k vectors of the smallest hashes. vectors: vec_id, embedding.

    The driver holds k centroids and receives k rows of sums a component, from an aggregation."""
    rows = kept_vectors(vectors, width)
    now = balls(first_centroids(rows, k, seed))
    done: list[Round] = []
    if not now.centroids:
        return Clustering(rows.withColumn("anchor", F.lit(0)), now, width, done)
    anchored = written(sized(rows).mapInArrow(lean(_anchored(now, width)), rows.withColumn("anchor", F.lit(0)).schema), "anchors")
    n_clusters = len(now.centroids)
    for turn in range(rounds):
        each = sized(anchored).mapInArrow(lean(_totals(now, width)), _SUMS)
        both = each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("radius").alias("radius"), F.sum("gone").alias("gone"), F.sum("made").alias("made"))
        got = {(r["cluster"], r["dim"]): r for r in both.collect()}
        firsts = [got[i, 0] for i in range(n_clusters)]
        done.append(Round(sum(r["n"] for r in firsts), sum(r["made"] for r in firsts), sum(r["gone"] for r in firsts)))
        moved = [[int(got[i, c]["total"]) // f["n"] for c in range(width)] if f["n"] else now.centroids[i] for i, f in enumerate(firsts)]
        way = [_root(_gap(a, b)) for a, b in zip(now.centroids, moved, strict=True)]
        reach = [(_root(int(f["radius"])) + w) ** 2 for f, w in zip(firsts, way, strict=True)]
        if any(int(f["radius"]) >= IMMENSE for f in firsts):
            reach = None
        if done[-1].gone > STALE * done[-1].rows and turn + 1 < rounds:
            # Members of the new anchors are those of the clusters just found; their balls aren't known before the next round.
            anchored = written(sized(anchored).mapInArrow(lean(_anchored(now, width)), anchored.schema), "anchors")
            now = balls(moved)
        else:
            now = balls(moved, reach)
    return Clustering(anchored, now, width, done)


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    found = fit(vectors, k, rounds, width, seed)
    rows = found.assigned()
    each = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.count("distance").alias("held"), F.count("*").alias("n"))
    sums = {r["cluster"]: int(r["sum"]) if r["held"] == r["n"] else None for r in each.collect()}
    fits = lambda s: s if s is not None and s < 1 << 63 else None
    every = None if None in sums.values() else fits(sum(sums.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.balls.centroids]
    # One row a cluster: bounded by k.
    facts = vectors.sparkSession.createDataFrame([(i, fits(sums.get(i)), every, name) for i, name in enumerate(names)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
