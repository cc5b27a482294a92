"""Repeated byte strings: interval expansion on Burrows-Wheeler transforms of blocks.

A window is a string of `length` bytes. It is removed where the same string starts earlier (smaller doc_id, or earlier
in the same document). Sorting all suffixes of the corpus in one place can't scale, so windows are first dealt out:

1. Anchors. A window's anchor is the rightmost of its `ANCHOR`-byte strings with the least hash, so equal windows have
   equal anchors at equal offsets. Windows in a row with the same anchor are one segment; its key is the anchor's hash.
   Each batch of documents keeps the first segment of each content (later ones are repeats whatever else there is).
2. Keys. Segments with the same key meet in one task. A key seen once has no repeats; of equal contents all but the first
   are repeats. Different contents under one key go on if any two agree on 38 bytes left or right of the anchor, as
   every two equal windows do.
3. Blocks. What is left, one segment of each content, is gathered by key, some hundred KB to a block. A block's suffixes
   are sorted by their first `length` bytes at least and transformed. Breadth first, string by string of growing length,
   intervals are extended backwards by every byte: each interval bound found at length n is a place where neighbouring
   suffixes share n bytes only. After `length` rounds it stops; suffixes with no bound between them share their window.
   A key with over WIDE bytes doesn't fit a block: its windows meet by their 128-bit hash instead, in Spark's own
   aggregation, which has no large groups.
4. Spans of repeated windows are joined to their documents and cut out.

Defined results. A null text is empty; a null doc_id comes before all others. Rows with the same doc_id and text are one
document and get equal results; texts that share a doc_id are ordered by their hash. A text shorter than a window loses
nothing. Extra columns are ignored, an empty table gives an empty result, periodic text repeats itself from its second
period on.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.arrowio import in_pieces, lean, raw, sized
from sparkquill.tables import written

LENGTH, ANCHOR, PIECE = 100, 24, 1 << 17
BLOCK, WIDE = 256 << 10, 4 << 20
LOWEST = -(1 << 63)

_ODD = [np.uint64(v | 1) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_BYTE = (np.arange(1, 257, dtype=np.uint64) * _ODD[6]) ^ ((np.arange(1, 257, dtype=np.uint64) * _ODD[4]) >> np.uint64(31))


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on, by doubling."""
    parts, width, level = {1: _BYTE[x]}, 1, 0
    while 2 * width <= size:
        h = parts[width]
        parts[2 * width] = h[: len(h) - width] * _ODD[level % 5] + h[width:]
        width, level = 2 * width, level + 1
    out, done = None, 0
    for width in sorted(parts, reverse=True):
        if size & width:
            out = parts[width] if out is None else out[: len(x) - done - width + 1] * _ODD[5] + parts[width][done:]
            done += width
    out = (out ^ (out >> np.uint64(29))) * _ODD[1]
    return out ^ (out >> np.uint64(32))


def window_least(values: np.ndarray, size: int) -> np.ndarray:
    least, width = values, 1
    while 2 * width <= size:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    n = len(values) - size + 1
    return np.minimum(least[:n], least[size - width : size - width + n])


def segments(x: np.ndarray, bounds: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of texts that stand in a row: start and end of each segment's windows (inclusive), place of the anchor, all hashes."""
    hashes = np.empty(len(x) - anchor + 1, np.uint64)
    for a in range(0, len(hashes), PIECE):
        hashes[a : a + PIECE] = gram_hashes(x[a : a + PIECE + anchor - 1], anchor)
    order = (hashes >> np.uint64(32)).astype(np.uint32)
    span = length - anchor + 1
    least = window_least(order, span)
    inside = np.ones(len(least), bool)
    for a, b in itertools.pairwise(bounds.tolist()):
        inside[max(a, b - length + 1) : b] = False
    fresh = np.empty(len(least), bool)
    fresh[0] = True
    fresh[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    fresh |= order[span - 1 :] == least
    start = np.flatnonzero(fresh)
    end = np.r_[start[1:], len(least)] - 1
    keep = inside[start]
    start, end = start[keep], end[keep]
    place = start + span - 1
    seek = np.flatnonzero(order[place] != least[start])
    for a in range(0, len(seek), 1 << 14):
        part = start[seek[a : a + (1 << 14)]]
        hit = order[part[:, None] + np.arange(span)[None, ::-1]] == least[part][:, None]
        place[seek[a : a + (1 << 14)]] = part + span - 1 - hit.argmax(axis=1)
    return start, end, place, hashes


def _sides(start, end, place, hashes, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """16-bit hashes of the anchor with 38 bytes to its left and to its right; 0 where the segment doesn't reach so far.

    Of the 76 bytes that a window has beside its anchor, 38 at least are on one side."""
    reach = (length - anchor + 1) // 2
    second = max(reach - anchor, 0)
    fold = lambda a, b: (((a * _ODD[0]) ^ (b * _ODD[2])) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    last = len(hashes) - 1
    left = fold(hashes[np.maximum(place - reach, 0)], hashes[np.maximum(place - second, 0)])
    right = fold(hashes[np.minimum(place + reach, last)], hashes[np.minimum(place + second, last)])
    left[place - reach < start] = 0
    right[place + anchor + reach > end + length] = 0
    return left, right


#: The columns of a packed list of segments. Ids stand as differences, which compress to next to nothing.
_FIELDS = (("key", np.uint64), ("content", np.uint64), ("left", np.uint16), ("right", np.uint16), ("doc", np.int64), ("tie", np.int64), ("pos", np.uint32), ("wins", np.uint8))


def _pack(cols: dict[str, np.ndarray], at: np.ndarray) -> bytes:
    parts = [np.uint32(len(at)).tobytes()]
    for name, kind in _FIELDS:
        v = cols[name][at]
        parts.append((np.diff(v, prepend=v.dtype.type(0)) if name in ("doc", "tie") else v).astype(kind).tobytes())
    return b"".join(parts)


def _unpack(payloads: list[bytes]) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {name: [] for name, _ in _FIELDS}
    for p in payloads:
        n, at = int(np.frombuffer(p, np.uint32, 1)[0]), 4
        for name, kind in _FIELDS:
            v = np.frombuffer(p, kind, n, at)
            at += v.nbytes
            out[name].append(np.cumsum(v) if name in ("doc", "tie") else v)
    return {name: np.concatenate(v) for name, v in out.items()}


FIRST, AGAIN = 0, 1
_DEALT = "bucket int, kind int, payload binary"


def _deal(batches, buckets: int, length: int, anchor: int):
    """Packed segments by bucket of their key; and, by bucket of their document, segments that repeat within the batch."""
    for batch in in_pieces(batches, "text", 4 << 20):
        data, offsets = raw(batch.column("text"))
        base = int(offsets[0])
        x = np.frombuffer(data, np.uint8)[base : int(offsets[-1])]
        bounds = offsets - base
        if len(x) < length:
            continue
        start, end, place, hashes = segments(x, bounds, length, anchor)
        if not len(start):
            continue
        left, right = _sides(start, end, place, hashes, length, anchor)
        content = x.tobytes()
        digest = xxhash.xxh3_64_intdigest
        contents = np.fromiter((digest(content[a:b]) for a, b in zip(start.tolist(), (end + length).tolist(), strict=True)), np.uint64, len(start))
        row = np.searchsorted(bounds, start, side="right") - 1
        doc = batch.column("k").to_numpy(zero_copy_only=False)[row]
        tie = batch.column("tie").to_numpy(zero_copy_only=False)[row]
        cols = {"key": hashes[place], "content": contents, "left": left, "right": right, "doc": doc, "tie": tie, "pos": (start - bounds[row]).astype(np.uint32), "wins": (end - start + 1).astype(np.uint8)}
        order = np.lexsort((cols["pos"], tie, doc, contents, cols["key"]))
        same = np.zeros(len(order), bool)
        same[1:] = (cols["key"][order][1:] == cols["key"][order][:-1]) & (contents[order][1:] == contents[order][:-1])
        twin = np.zeros(len(order), bool)
        for name in ("doc", "tie", "pos"):
            v = cols[name][order]
            twin[1:] = (v[1:] == v[:-1]) & (twin[1:] if name != "doc" else True)
        twin &= same
        first, again = np.sort(order[~same]), np.sort(order[same & ~twin])
        out: list[tuple[int, int, bytes]] = []
        for kind, rows, by in ((FIRST, first, cols["key"] % np.uint64(buckets)), (AGAIN, again, doc.view(np.uint64) % np.uint64(buckets))):
            place_of = by[rows].astype(np.int64)
            sort = np.argsort(place_of, kind="stable")
            rows, place_of = rows[sort], place_of[sort]
            cuts = np.flatnonzero(np.r_[True, place_of[1:] != place_of[:-1]]) if len(rows) else []
            for a, b in itertools.pairwise([*cuts, len(rows)]):
                out.append((int(place_of[a]), kind, _pack(cols, rows[a:b])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["bucket", "kind", "payload"])


_FOUND = "kind int, k long, tie long, pos int, wins int, key long"
REPEAT, OPEN, HUGE = 0, 1, 2


def _found(kind: int, cols: dict[str, np.ndarray], at: np.ndarray):
    for a in range(0, len(at), 200_000):
        i = at[a : a + 200_000]
        arrays = [np.full(len(i), kind, np.int32), cols["doc"][i], cols["tie"][i], cols["pos"][i].astype(np.int32), cols["wins"][i].astype(np.int32), cols["key"][i].view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=["kind", "k", "tie", "pos", "wins", "key"])


def _shared(group: np.ndarray, side: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Representatives whose side occurs with another representative of the group."""
    out = np.zeros(len(group), bool)
    at = np.flatnonzero(rep & (side != 0))
    both = group[at].astype(np.uint64) << np.uint64(16) | side[at].astype(np.uint64)
    _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
    out[at] = count[inverse] > 1
    return out


def _meet(batches, length: int, most: int):
    """All segments of a partition's buckets: which repeat a whole segment, and which must be compared window by window."""
    packed: list[bytes] = []
    for batch in batches:
        kinds, payloads = batch.column("kind").to_pylist(), batch.column("payload").to_pylist()
        packed += [p for k, p in zip(kinds, payloads, strict=True) if k == FIRST]
        done = [p for k, p in zip(kinds, payloads, strict=True) if k == AGAIN]
        if done:
            cols = _unpack(done)
            yield from _found(REPEAT, cols, np.arange(len(cols["doc"])))
    if not packed:
        return
    cols = _unpack(packed)
    del packed
    order = np.lexsort((cols["pos"], cols["tie"], cols["doc"], cols["content"], cols["key"]))
    cols = {name: v[order] for name, v in cols.items()}
    changed = lambda *names: np.r_[True, np.logical_or.reduce([cols[c][1:] != cols[c][:-1] for c in names])]
    twin = ~changed("key", "content", "doc", "tie", "pos")
    cols = {name: v[~twin] for name, v in cols.items()}
    new_key = changed("key")
    rep = new_key | changed("content")
    group = np.cumsum(new_key) - 1
    contents = np.bincount(group, weights=rep)[group]
    yield from _found(REPEAT, cols, np.flatnonzero(~rep))
    go = rep & (contents > 1)
    go &= _shared(group, cols["left"], go) | _shared(group, cols["right"], go)
    size = np.bincount(group, weights=np.where(go, cols["wins"].astype(np.int64) + length, 0))[group]
    yield from _found(OPEN, cols, np.flatnonzero(go & (size <= most)))
    yield from _found(HUGE, cols, np.flatnonzero(go & (size > most)))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row and fields of every struct in a column of arrays, without Python objects; null arrays are empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    fields = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    return np.repeat(np.arange(len(column)), sizes), fields


def _cut(batches, length: int):
    """The bytes of each listed segment."""
    for batch in in_pieces(batches, "text", 4 << 20):
        data, offsets = raw(batch.column("text"))
        row, f = _lists(batch.column("spans"))
        k, tie = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("k", "tie"))
        start = offsets[row] + f["pos"]
        end = start + f["wins"] - 1 + length
        for a in range(0, len(row), 10_000):
            i = slice(a, a + 10_000)
            seg = [bytes(data[s:e]) for s, e in zip(start[i].tolist(), end[i].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(f["key"][i]), pa.array(k[i]), pa.array(tie[i]), pa.array(f["pos"][i]), pa.array(f["wins"][i]), pa.array(f["kind"][i]), pa.array(seg, pa.binary())], names=["key", "k", "tie", "pos", "wins", "kind", "seg"])


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Places of x in the order of their next `depth` symbols at least; x holds values under 512, and ends with its least."""
    n, first = len(x), 7
    padded = np.r_[x.astype(np.uint64), np.zeros(first, np.uint64)]
    key = np.zeros(n, np.uint64)
    for i in range(first):
        key = key << np.uint64(9) | padded[i : i + n]
    width = first
    while True:
        sa = np.argsort(key)
        ranked = key[sa]
        new = np.r_[np.uint64(0), (ranked[1:] != ranked[:-1]).astype(np.uint64)]
        rank = np.empty(n, np.uint64)
        rank[sa] = np.cumsum(new) + np.uint64(1)
        if width >= depth or rank[sa[-1]] == n:
            return sa
        after = np.r_[rank[width:], np.zeros(min(width, n), np.uint64)][:n]
        key = rank << np.uint64(32) | after
        width *= 2


class Occurrences:
    """How often each symbol stands before a place of a transform: counts every 64 places, and bit planes between."""

    def __init__(self, bwt: np.ndarray, symbols: int):
        words = len(bwt) // 64 + 1
        places = np.arange(len(bwt))
        cell = (places >> 5) * symbols + bwt
        # Sums of up to 32 powers of two below 2 ** 32 are exact in a double.
        half = np.bincount(cell, weights=np.exp2(places & 31), minlength=2 * words * symbols).astype(np.uint64).reshape(words, 2, symbols)
        self.bits = half[:, 0] | half[:, 1] << np.uint64(32)
        per = np.bitwise_count(self.bits).astype(np.uint32)
        self.before = np.zeros((words, symbols), np.uint32)
        np.cumsum(per[:-1], axis=0, out=self.before[1:])

    def at(self, place: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[place >> 6] + np.bitwise_count(self.bits[place >> 6] & low[:, None])


#: Intervals up to this size are extended place by place, larger ones symbol by symbol.
NARROW = 64


def _extend_narrow(low: np.ndarray, high: np.ndarray, bwt: np.ndarray, last: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All extensions of intervals, by the places they hold. last: where a place's symbol stands among the first symbols;
    first: the place of each of these. A place is its symbol's first in an interval if the one before is outside."""
    size = high - low
    of = np.repeat(np.arange(len(low)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]
    to, symbol = last[at], bwt[at]
    before, after = first[np.maximum(to - 1, 0)], first[np.minimum(to + 1, len(first) - 1)]
    starts = (to == 0) | (bwt[before] != symbol) | (before < low[of])
    ends = (to == len(first) - 1) | (bwt[after] != symbol) | (after >= high[of])
    # Strings of one length have intervals apart, so the n-th start belongs to the n-th end.
    return np.sort(to[starts]), np.sort(to[ends]) + 1


def _extend_wide(low: np.ndarray, high: np.ndarray, occ: Occurrences, smaller: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(low), 1 << 14):
        lo = smaller + occ.at(low[a : a + (1 << 14)])
        hi = smaller + occ.at(high[a : a + (1 << 14)])
        lows.append(lo[hi > lo])
        highs.append(hi[hi > lo])
    return np.concatenate(lows), np.concatenate(highs)


def shared_prefixes(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(sa, group): suffixes in order, and a number that neighbours share if their first `depth` symbols are equal.

    Beginning with the empty string, every interval is extended backwards by each symbol; a bound that no shorter string
    had set is new, and only intervals with a new bound are extended further. So bounds appear in the order of the common
    prefix they stand for, and the work is bounded by their number."""
    sa = suffix_order(x, depth)
    used, y = np.unique(x, return_inverse=True)
    bwt = y[sa - 1].astype(np.int16)
    occ = Occurrences(bwt, len(used))
    smaller = np.r_[0, np.cumsum(np.bincount(y, minlength=len(used)))][:-1]
    n = len(x)
    first = np.argsort(bwt, kind="stable")
    last = np.empty(n, np.int64)
    last[first] = np.arange(n)
    bound = np.zeros(n + 1, bool)
    bound[0] = bound[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        narrow = high - low <= NARROW
        parts = [_extend_wide(low[~narrow], high[~narrow], occ, smaller), _extend_narrow(low[narrow], high[narrow], bwt, last, first)]
        low, high = (np.concatenate(v) for v in zip(*parts, strict=True))
        new = ~bound[low] | ~bound[high]
        low, high = low[new], high[new]
        bound[low] = True
        bound[high] = True
        if not len(low):
            break
    return sa, np.cumsum(bound[:n])


def _expand(rows: list[tuple], length: int):
    """Repeated windows of a block of segments (key, k, tie, pos, wins, seg), as spans of windows."""
    segs = [r[5] for r in rows]
    sizes = np.array([len(s) for s in segs])
    x = np.frombuffer(b"\0".join(segs) + b"\0", np.uint8).astype(np.uint16) + np.uint16(2)
    ends = np.cumsum(sizes + 1) - 1
    x[ends] = 1
    x[-1] = 0
    starts = ends - sizes
    wins = np.array([r[4] for r in rows])
    sa, group = shared_prefixes(x, length)
    of_place = np.empty(len(x), np.int64)
    of_place[sa] = group
    seg = np.repeat(np.arange(len(rows)), wins)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(wins) - wins, wins)
    gid = of_place[starts[seg] + offset]
    rank = np.empty(len(rows), np.int64)
    rank[np.lexsort(([r[3] for r in rows], [r[2] for r in rows], [r[1] for r in rows]))] = np.arange(len(rows))
    order = np.lexsort((rank[seg], gid))
    again = np.zeros(len(seg), bool)
    again[order[1:]] = gid[order][1:] == gid[order][:-1]
    yield from _spans(rows, seg, offset, again)


def _spans(rows, seg, offset, again):
    at = np.flatnonzero(again)
    if not len(at):
        return
    breaks = np.r_[True, (np.diff(at) != 1) | (np.diff(seg[at]) != 0)]
    first = at[breaks]
    count = np.diff(np.r_[np.flatnonzero(breaks), len(at)])
    s = seg[first].tolist()
    yield pa.RecordBatch.from_arrays(
        [pa.array([rows[i][1] for i in s], pa.int64()), pa.array([rows[i][2] for i in s], pa.int64()), pa.array([rows[i][3] + int(o) for i, o in zip(s, offset[first], strict=True)], pa.int32()), pa.array(count.astype(np.int32))],
        names=["k", "tie", "pos", "wins"],
    )


def _blocks(batches, length: int):
    """Whole keys, which stand together, until a block is full."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("key", "k", "tie", "pos", "wins", "seg")), strict=True):
            if size > BLOCK and r[0] != rows[-1][0]:
                yield from _expand(rows, length)
                rows, size = [], 0
            rows.append(r)
            size += len(r[5])
    if rows:
        yield from _expand(rows, length)


def _windows(batches, length: int):
    """Every window of a segment by its hash, for keys too wide for a block."""
    for batch in batches:
        for k, tie, pos, wins, seg in zip(*(batch.column(c).to_pylist() for c in ("k", "tie", "pos", "wins", "seg")), strict=True):
            h = [xxhash.xxh3_128_digest(seg[i : i + length]) for i in range(wins)]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array([k] * wins, pa.int64()), pa.array([tie] * wins, pa.int64()), pa.array(range(pos, pos + wins), pa.int32())], names=["h", "k", "tie", "pos"])


def _cut_out(batches, length: int):
    """The results of each document, from its spans of repeated windows."""
    for batch in in_pieces(batches, "text", 4 << 20):
        data, offsets = raw(batch.column("text"))
        removed, spans, digests = [], [], []
        row, f = _lists(batch.column("spans"))
        first = np.searchsorted(row, np.arange(batch.num_rows + 1))
        for i in range(batch.num_rows):
            text = data[int(offsets[i]) : int(offsets[i + 1])]
            gone, runs, at, kept = 0, 0, 0, hashlib.sha256()
            if first[i] < first[i + 1]:
                pos = f["pos"][first[i] : first[i + 1]].astype(np.int64)
                end = pos + f["wins"][first[i] : first[i + 1]] - 1 + length
                order = np.argsort(pos, kind="stable")
                pos, end = pos[order], np.maximum.accumulate(end[order])
                opens = np.flatnonzero(np.r_[True, pos[1:] > end[:-1]])
                for a, b in zip(pos[opens].tolist(), end[np.r_[opens[1:] - 1, len(end) - 1]].tolist(), strict=True):
                    kept.update(text[at:a])
                    at, gone, runs = b, gone + b - a, runs + 1
            kept.update(text[at:])
            removed.append(gone)
            spans.append(runs)
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, wide_bytes: int = WIDE) -> DataFrame:
    """doc_id, text, k, tie and spans: the array of (pos, wins), windows to remove, from byte `pos` on `wins` in a row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("k", F.coalesce("doc_id", F.lit(LOWEST)))
    unique = docs.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    docs = docs.withColumn("tie", F.lit(0).cast("long") if unique else F.xxhash64("text"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sized(docs.select("k", "tie", "text")).mapInArrow(lean(lambda it: _deal(it, buckets, length, anchor)), _DEALT)
    found = written(dealt.repartition("bucket").mapInArrow(lean(lambda it: _meet(it, length, wide_bytes)), _FOUND), "repeats")
    placed = docs.withColumn("key2", F.struct("k", "tie")).repartition("key2")
    todo = found.filter(F.col("kind") != REPEAT).groupBy(F.struct("k", "tie").alias("key2"))
    todo = todo.agg(F.collect_list(F.struct("key", "pos", "wins", "kind")).alias("spans"))
    cut = placed.join(todo, "key2").select("k", "tie", "text", "spans")
    cut = written(cut.mapInArrow(lean(lambda it: _cut(it, length)), "key long, k long, tie long, pos int, wins int, kind int, seg binary"), "segments")
    narrow = cut.filter(F.col("kind") == OPEN).repartition("key").sortWithinPartitions("key")
    again = narrow.mapInArrow(lean(lambda it: _blocks(it, length)), "k long, tie long, pos int, wins int")
    wide = cut.filter(F.col("kind") == HUGE).mapInArrow(lean(lambda it: _windows(it, length)), "h binary, k long, tie long, pos int")
    earliest = wide.groupBy("h").agg(F.min(F.struct("k", "tie", "pos")).alias("first"))
    late = wide.join(earliest, "h").filter(F.struct("k", "tie", "pos") != F.col("first")).select("k", "tie", "pos", F.lit(1).alias("wins"))
    spans = found.filter(F.col("kind") == REPEAT).select("k", "tie", "pos", "wins").unionByName(again).unionByName(late)
    spans = spans.groupBy(F.struct("k", "tie").alias("key2")).agg(F.collect_list(F.struct("pos", "wins")).alias("spans"))
    return placed.join(spans, "key2", "left").select("doc_id", "text", "k", "tie", "spans")


def removed(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, wide_bytes: int = WIDE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return with_repeats(docs, length, anchor, wide_bytes).select("doc_id", "text", "spans").mapInArrow(
        lean(lambda it: _cut_out(it, length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
