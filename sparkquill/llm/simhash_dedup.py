"""SimHash near-duplicates, compared by bit planes.

1. Each text becomes a 64-bit majority fingerprint of its word shingles. Equal fingerprints are one class at once.
2. Distinct fingerprints at `radius` differing bits agree on `extra` of any `radius + extra` parts of their bits, so
   every close pair meets in a bucket of at least one of the choose(radius + extra, extra) tables. `extra` follows the
   number of distinct fingerprints, so buckets stay small; any choice finds all pairs.
3. Inside a bucket 64 fingerprints at a time stand as vertical planes: word b holds bit b of all 64. A query's bits
   turn a plane into 64 differences, three planes at a time are added to bit-sliced counters by carry-save adders, and a
   block is abandoned once all its lanes are over the radius.
4. A bucket emits a spanning forest of its links, at most one edge a row; components are joined over all buckets.
A bucket of more than TILE rows is parted once more: close pairs agree in one of radius + 1 parts of its other bits, so
each part makes buckets of its own. What is still over TILE then is cut into tiles, each pair of which is a task.

`deduplicated`, the pipeline's stage, links texts whose shingle sets have an exact Jaccard similarity of 0.8 or more. Such
texts are some ten of 64 bits apart, too far for buckets of equal parts, so candidates agree in one of BANDS bands of
minima. Inside a group of candidates the fingerprints are compared by bit planes as above, within SCREEN bits, and pairs
that pass are verified exactly.

Hot fingerprints, buckets and classes: joins deal a key with more rows than a share of a task over several (`skew`).

Defined results. Null or empty texts have fingerprint zero, linked like any other. Fewer words than the shingle: the
whole sequence is the only shingle. Repeated rows give repeated results. Null ids are rows like others; a class of null
ids alone has a null component_id. Extra columns are ignored, an empty table gives an empty result, long texts are hashed
in blocks of words.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.arrowio import in_pieces, lean, raw, sized
from sparkquill.llm.components import components
from sparkquill.skew import dealt_join, share
from sparkquill.tables import written

BITS, SEED, TILE = 64, 42, 4096
#: Fingerprints that a bucket should hold on average at most, blocks compared and rows laid out at once.
BUCKET, AT_ONCE, ROWS = 64, 1 << 17, 1 << 15
#: Bands and minima a band of the search for similar texts.
BANDS, BAND_ROWS = 24, 4
#: Differing bits up to which candidates are verified. Sets at 0.8 differ in 10 bits on average; in more than 28 with a
#: probability under 1e-6, whatever their size.
SCREEN = 28
#: Keys, of eight bytes, that are sent to every executor at most.
MOST_KEYS = 1_000_000


def shingle_hashes(text: bytes, size: int, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of the lower-cased words, block by block."""
    digest, kept, seen, at = xxhash.xxh64_intdigest, [], 0, 0
    while at < len(text):
        end = min(at + block, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = kept + text[at:end].lower().split()
        at = end
        if len(words) >= size:
            joined = b" ".join(words)
            ends = list(itertools.accumulate([len(w) + 1 for w in words]))
            starts = [0, *ends[: len(words) - size]]
            yield np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[size - 1 :], strict=True)), np.uint64, len(starts))
            seen += len(starts)
        kept = words[-(size - 1) :] if size > 1 else []
    if not seen and kept:
        yield np.array([digest(b" ".join(kept), SEED)], np.uint64)


def fingerprint(text: bytes, size: int) -> int:
    counts, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, size):
        total += len(hashes)
        for part in np.array_split(hashes, len(hashes) // 65536 + 1):
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in in_pieces(batches, "text"):
            data, offsets = raw(batch.column("text"))
            fps = np.fromiter((fingerprint(bytes(data[a:b]), size) for a, b in itertools.pairwise(offsets)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(lean(run), "doc_id long, fp long")


def masks(radius: int, extra: int, bits: int = BITS) -> list[int]:
    """The bits of each table's key: all ways to take `extra` of `radius + extra` even parts."""
    edges = [round(i * bits / (radius + extra)) for i in range(radius + extra + 1)]
    parts = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(parts, extra)]


def extra_parts(n: int, radius: int) -> int:
    """The fewest parts whose key leaves BUCKET fingerprints in a bucket on average."""
    for extra in range(1, 6):
        if n / 2 ** (BITS * extra / (radius + extra)) <= BUCKET:
            return extra
    return 5


def _planes(fps: np.ndarray, block_of: np.ndarray, lane: np.ndarray, starts: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    shifted = lane.astype(np.uint64)
    return np.stack([np.add.reduceat(((fps >> np.uint64(b)) & one) << shifted, starts) for b in range(BITS)])


def close_pairs(fps: np.ndarray, bucket: np.ndarray, tile: np.ndarray, cross: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, other) within the radius, of rows in one bucket. Rows stand sorted by bucket, then tile; where
    cross, only pairs of different tiles count."""
    n = len(fps)
    run = np.r_[True, (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])]
    run_start = np.flatnonzero(run)[np.cumsum(run) - 1]
    lane = (np.arange(n) - run_start) % 64
    fresh = lane == 0
    block_of = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    planes = _planes(fps, block_of, lane, starts)
    width = np.diff(np.r_[starts, n]).astype(np.uint64)
    full = np.where(width == 64, ~np.uint64(0), (np.uint64(1) << (width % np.uint64(64))) - np.uint64(1))
    last_of_bucket = np.r_[np.flatnonzero(bucket[1:] != bucket[:-1]), n - 1]
    ends = block_of[last_of_bucket][np.searchsorted(last_of_bucket, np.arange(n))]
    first = np.where(cross, block_of[np.minimum(_next_run(run, n), n - 1)], block_of)
    counts = np.where(cross & (_next_run(run, n) > last_of_bucket[np.searchsorted(last_of_bucket, np.arange(n))]), 0, ends - first + 1)
    before = np.r_[0, np.cumsum(counts)]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(before, before[at] + AT_ONCE, side="right")) - 1)
        c = counts[at:to]
        query = np.repeat(np.arange(at, to), c)
        block = np.arange(len(query)) - np.repeat(before[at:to] - before[at], c) + first[query]
        at = to
        valid = full[block].copy()
        own = block == block_of[query]
        valid[own] &= ~((np.uint64(2) << lane[query[own]].astype(np.uint64)) - np.uint64(1))
        yield from _compare(fps, planes, query, block, valid, starts, radius)


def _next_run(run: np.ndarray, n: int) -> np.ndarray:
    """For each row the first row of the run after its own."""
    starts = np.r_[np.flatnonzero(run), n]
    return starts[np.cumsum(run)]


def _compare(fps, planes, query, block, valid, starts, radius) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if not len(query):
        return
    digits = max(2, (radius + 1).bit_length())
    counter = [np.zeros(len(query), np.uint64) for _ in range(digits)]
    over = np.zeros(len(query), np.uint64)
    words = fps[query]
    for b in range(0, BITS, 3):
        diff = [planes[x][block] ^ (np.uint64(0) - ((words >> np.uint64(x)) & np.uint64(1))) for x in range(b, min(b + 3, BITS))]
        while len(diff) < 3:
            diff.append(np.zeros(len(query), np.uint64))
        x, y, z = diff
        half = x ^ y
        total, twice = half ^ z, (x & y) | (half & z)
        up = counter[0] & total
        counter[0] = counter[0] ^ total
        half = counter[1] ^ twice
        counter[1], up = half ^ up, (counter[1] & twice) | (half & up)
        for k in range(2, digits):
            counter[k], up = counter[k] ^ up, counter[k] & up
        over |= up
        # Nothing is over the radius before that many bits are counted; then every third round tells.
        if b + 3 > radius and (b % 9 == 6 or b + 3 >= BITS):
            alive = valid & ~(over | _above(counter, radius))
            keep = alive != 0
            if not keep.all():
                query, block, valid, over, words = (v[keep] for v in (query, block, valid, over, words))
                counter = [c[keep] for c in counter]
                if not len(query):
                    return
    alive = valid & ~(over | _above(counter, radius))
    hit = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
    yield query[hit // 64], starts[block[hit // 64]] + hit % 64


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over the radius: compared digit by digit from the highest."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above |= equal & counter[k]
            equal = equal & ~counter[k]
    return above


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _buckets(batches, radius: int):
    """Spanning edges of each bucket; a bucket that goes on in the next batch waits for it."""
    columns, rest = ("fp", "bucket", "tile", "cross"), None

    def edges(part):
        fps = part["fp"].view(np.uint64)
        left, right = [], []
        for a, b in close_pairs(fps, part["bucket"], part["tile"], part["cross"], radius):
            left.append(a)
            right.append(b)
            if sum(map(len, left)) > 4_000_000:
                label = _forest(len(fps), np.concatenate(left), np.concatenate(right))
                left, right = [np.flatnonzero(label != np.arange(len(fps)))], [label[label != np.arange(len(fps))]]
        if left:
            label = _forest(len(fps), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(label != np.arange(len(fps)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(part["fp"][moved]), pa.array(part["fp"][label[moved]])], names=["u", "v"])

    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        now = new if rest is None else {c: np.concatenate([rest[c], new[c]]) for c in columns}
        n = len(now["fp"])
        if not n:
            continue
        # Ids are not in order within a batch, but equal ones stand together: the last run starts after the last other id.
        others = np.flatnonzero(now["bucket"] != now["bucket"][-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        # Whole buckets, some ten thousand rows at a time: planes of many small buckets are larger than their rows.
        ends = np.flatnonzero(np.r_[now["bucket"][1:cut] != now["bucket"][: max(cut - 1, 0)], True]) + 1 if cut else []
        at = 0
        for end in ends:
            if end - at >= ROWS or end == cut:
                yield from edges({c: v[at:end] for c, v in now.items()})
                at = int(end)
        rest = {c: v[cut:] for c, v in now.items()}
    if rest is not None and len(rest["fp"]):
        yield from edges(rest)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _inner_masks(mask: int, radius: int) -> list[int]:
    """The bits outside of a table's key, in radius + 1 parts: a close pair of its bucket agrees in one of them."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    edges = [round(i * len(free) / (radius + 1)) for i in range(radius + 2)]
    return [sum(1 << b for b in free[i:j]) for i, j in itertools.pairwise(edges)]


def _oversize(rows: DataFrame) -> DataFrame:
    """`rows` with n, the size of a bucket of more than TILE rows, else null. At most one bucket in TILE rows is listed."""
    large = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > TILE), "oversize")
    small = large.count() <= MOST_KEYS
    return rows.join(F.broadcast(large) if small else large, "bucket", "left")


def links(distinct: DataFrame, n: int, radius: int = 4, extra: int | None = None) -> DataFrame:
    """Spanning edges (u, v) of the graph of fingerprints within the radius. distinct: column fp, `n` rows."""
    tables = masks(radius, extra or extra_parts(n, radius))
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(tables)])
    rows = _oversize(distinct.select("fp", F.posexplode(keys).alias("t", "bucket")))
    inner = F.array(*[F.array(*[F.lit(_signed(x)) for x in _inner_masks(m, radius)]) for m in tables])
    parted = F.transform(F.get(inner, F.col("t")), lambda x, j: F.xxhash64("bucket", j, F.col("fp").bitwiseAND(x)))
    rows = _oversize(rows.select("fp", F.explode(F.when(F.col("n").isNull(), F.array("bucket")).otherwise(parted)).alias("bucket")))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda o: F.struct(F.least(o, mine).alias("a"), F.greatest(o, mine).alias("b")))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    rows = rows.select("fp", "bucket", F.when(F.col("n").isNull(), F.lit(0)).otherwise(mine).alias("tile"), F.explode(F.when(F.col("n").isNull(), whole).otherwise(pairs)).alias("p"))
    rows = rows.select(
        "fp",
        F.xxhash64("bucket", "p.a", "p.b").alias("bucket"),
        "tile",
        (F.col("p.a") != F.col("p.b")).alias("cross"),
    )
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "tile", "fp")
    return sized(rows).mapInArrow(lean(lambda it: _buckets(it, radius)), "u long, v long")


def classes(docs: DataFrame, size: int = 4, radius: int = 4, extra: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    fps = written(fingerprints(docs, size), "simhash")
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "first")
    n, rows = first.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(links(first.select("fp"), n, radius, extra)).withColumnRenamed("node", "fp")
    linked = written(first.join(roots, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("members"))
    linked = dealt_join(linked, least, "root", "members", share(linked, n), ["fp"]).select("fp", F.col("component_id").alias("least"))
    named = first.join(linked, "fp", "left").select("fp", F.coalesce("least", "first_doc").alias("component_id"), "n")
    return dealt_join(fps, named, "fp", "n", share(fps, rows), ["doc_id"]).select("doc_id", "fp", "component_id")


def _shingle_set(text: bytes, size: int) -> np.ndarray:
    parts = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row a set, one column a band: a hash of the band's minima. All empty sets agree."""
    rng = np.random.default_rng(SEED)
    mult, add = (rng.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) for _ in range(2))
    full = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
    flat, starts = np.concatenate(full), np.r_[0, np.cumsum([len(s) for s in full])[:-1]]
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            least = np.minimum.reduceat((flat * (mult[k] | np.uint64(1)) + add[k]) >> np.uint64(32), starts)
            key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def _banded(batches, size: int):
    for batch in in_pieces(batches, "text", 4 << 20):
        data, offsets = raw(batch.column("text"))
        keys = band_keys([_shingle_set(bytes(data[a:b]), size) for a, b in itertools.pairwise(offsets)])
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "bands"])


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def similar_forest(sets: list[np.ndarray], similarity: float, screen: int = SCREEN) -> list[tuple[int, int]]:
    """Spanning edges of the graph of sets whose exact Jaccard similarity is `similarity` or more. Fingerprints are
    compared by bit planes first; only pairs within `screen` bits are verified."""
    n, out = len(sets), []
    sizes = np.array([len(s) for s in sets])
    fps = np.fromiter((_majority(s) for s in sets), np.uint64, n)
    lane, starts = np.arange(n) % 64, np.arange(0, n, 64)
    planes = _planes(fps, np.arange(n) // 64, lane, starts)
    waiting = np.ones(-(-n // 64) * 64, bool)
    waiting[n:] = False
    for first in range(n):
        if not waiting[first]:
            continue
        waiting[first], todo = False, [first]
        while todo:
            i = todo.pop()
            valid = np.packbits(waiting, bitorder="little").view(np.uint64)
            block = np.flatnonzero(valid)
            if not len(block):
                return out
            for _, near in _compare(fps, planes, np.full(len(block), i), block, valid[block], starts, screen):
                near = near[sizes[near] >= similarity * sizes[i] - 1e-9]
                near = near[sizes[i] >= similarity * sizes[near] - 1e-9]
                if not len(near):
                    continue
                flat = np.concatenate([sets[j] for j in near.tolist()])
                same = np.zeros(len(flat), bool)
                if sizes[i]:
                    same = sets[i][np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)] == flat
                run = np.r_[0, np.cumsum(same)]
                ends = np.cumsum(sizes[near])
                shared = run[ends] - run[ends - sizes[near]]
                hits = near[shared >= similarity * (sizes[near] + sizes[i] - shared) - 1e-9].tolist()
                waiting[hits] = False
                out += [(i, j) for j in hits]
                todo += hits
    return out


def _verified(batches, size: int, similarity: float):
    """Edges of each task's rows, which stand together; a task that goes on in the next batch waits for it."""
    keys: list[int] = []
    sets: list[np.ndarray] = []
    now = None

    def edges():
        found = similar_forest(sets, similarity) if len(sets) > 1 else []
        return [(keys[i], keys[j]) for i, j in found]

    for batch in in_pieces(batches, "text", 4 << 20):
        data, offsets = raw(batch.column("text"))
        found: list[tuple[int, int]] = []
        for task, key, (a, b) in zip(batch.column("task").to_pylist(), batch.column("key").to_pylist(), itertools.pairwise(offsets), strict=True):
            if task != now:
                found += edges()
                keys, sets, now = [], [], task
            keys.append(key)
            sets.append(_shingle_set(bytes(data[a:b]), size))
        yield _pairs(found)
    yield _pairs(edges())


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])


def similar_links(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Edges (u, v) between keys whose texts are similar. texts: key, text; equal texts have one key."""
    banded = sized(texts).mapInArrow(lean(lambda it: _banded(it, size)), "key long, bands array<long>")
    rows = written(banded.dropDuplicates(["key"]), "bands").select("key", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("key").alias("least"), F.count("*").alias("n")).filter("n > 1")
    shared = written(shared, "shared")
    stars = dealt_join(rows, shared, "bucket", "n", share(rows, rows.count()), ["key"])
    groups = written(components(stars.select(F.col("key").alias("u"), F.col("least").alias("v"))), "groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    n = groups.count()
    groups = dealt_join(groups, sizes, "root", "n", share(groups, n), ["node"])
    groups = groups.select(F.col("node").alias("key"), "root", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    if n <= MOST_KEYS:
        # A counted number of keys goes to the texts: those without a candidate stay where they are.
        texts = texts.join(F.broadcast(groups.select("key")), "key", "left_semi")
    # Copies of a text are one row before they leave their task, so a text that a third of the rows share is no large group.
    members = texts.dropDuplicates(["key"]).join(groups, "key")
    mine = F.pmod(F.xxhash64("key", F.lit(7)), F.col("tiles")).cast("int")
    # Each pair of tiles is a task; one tile alone is a pair with itself.
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: (F.col("tiles") == 1) | (o != mine))
    pairs = F.transform(others, lambda o: F.xxhash64("root", F.least(o, mine), F.greatest(o, mine)))
    tasks = members.select("key", "text", F.explode(pairs).alias("task")).repartition("task").sortWithinPartitions("task")
    return sized(tasks).mapInArrow(lean(lambda it: _verified(it, size, similarity)), "u long, v long")


def deduplicated(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The columns of `docs`, one row of each near-duplicate class: that of its smallest doc_id, null ids last, then of
    the least text hash. Rows that share an id but not a class all stay, null ids too: one of each class.

    Texts are linked by the exact Jaccard similarity of their sets of shingles; at 0.8 the bands retrieve all but four in
    a million pairs, nearer ones more."""
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = docs.select(key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    roots = components(similar_links(texts, size, similarity)).withColumnRenamed("node", "key")
    ids = docs.select(F.col("doc_id").alias("id"), key.alias("key")).distinct().join(roots, "key", "left")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least")
    stay = ids.groupBy(F.coalesce("root", "key").alias("class")).agg(least).select(F.col("least.id").alias("id"), F.col("least.key").alias("stays"))
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("doc_id").alias("own"), key.alias("key"))
    rows = rows.join(stay, (F.col("key") == F.col("stays")) & F.col("own").eqNullSafe(F.col("id")), "left_semi")
    return rows.dropDuplicates(["key", "own"]).select("__doc.*")
