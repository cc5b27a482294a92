"""Quality of documents from their lines: a linear-chain conditional random field over good and bad lines.

A line's evidence is the features of itself and of the lines before and after it; neighbouring labels attract or repel by
a matrix of four weights. Forward and backward messages give every line its marginal probability of being good, and a
document's score is their mean, weighted by the lines' lengths.

Features come from whole texts: shares of kinds of characters, lengths of words and line, ends and beginnings, repeats of
words within the line, of three-word windows and of whole lines within the document. Language, source, ids and labels are
none of them. They are counted over the bytes of a batch at once, with no step for a single line. Messages are products of
2 x 2 matrices, taken by doubling over all lines of a batch: a document's first line resets the product, so documents of
any length share the same logarithm of steps.

Fit. Lines of a labelled document bear its label; a document counts once, whatever its length. The sample is `SAMPLE`
documents, those of the smallest hashes among the labelled rows outside the held-out fold that have at most `MOST_LINES`
lines and `MOST_CHARS` characters; it is all that reaches the driver, where the likelihood, which has one maximum, is
climbed. Scoring reads every text whole, whatever its length.

Defined results. A null or empty text, or one without words, has no lines: its score is the share of good documents in
the sample. Lines without words are left out of the chain. Without any labelled row all scores are 0.5. Where an id bears
several labels, the mean decides, and equal votes are good. A null doc_id is in no held-out fold and has no label.
Repeated rows each get their score. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.arrowio import in_pieces, lean, raw, sized

#: Bounds of the sample that the field is fitted on: documents, lines and characters of each.
SAMPLE, MOST_LINES, MOST_CHARS = 4000, 256, 65_536
FOLDS, HELD_OUT = 3, 1
STEPS, RATE, RIDGE = 120, 0.1, 1e-3

#: Kinds of bytes.
_SPACE, _LOWER, _UPPER, _DIGIT, _POINT, _SHOUT, _SYMBOL, _WIDE, _TAIL = range(9)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[list(b" \t\n\v\f\r")] = _SPACE
_KIND[ord("a") : ord("z") + 1] = _LOWER
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[list(b".,;:'\"()-")] = _POINT
_KIND[list(b"!?")] = _SHOUT
_KIND[0x80:0xC0] = _TAIL
_KIND[0xC0:] = _WIDE
_NEWLINE = 10

NAMES = [
    "log_chars", "log_words", "word_chars", "upper", "digits", "points", "shouts", "symbols", "wide", "symbol_ends",
    "distinct_words", "repeated_windows", "repeated_line", "ends_with_point", "starts_with_upper",
]
WIDTH = len(NAMES)

#: Bytes that are hashed at once.
SPAN = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes: the sum of bytes times powers of an odd number, moved to the run's start. Runs are in
    order; so many are taken at once as lie within `SPAN` bytes, and one that is longer by itself."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            a = int(starts[at])
            end = int(np.searchsorted(ends, a + SPAN, side="right"))
            if end <= at:
                out[at] = xxhash.xxh64_intdigest(data[a : int(ends[at])])
                at += 1
                continue
            part = data[a : int(ends[end - 1])]
            powers, inverse = _powers()
            running = np.r_[np.uint64(0), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)])]
            s, e = starts[at:end] - a, ends[at:end] - a
            out[at:end] = _mixed((running[e] - running[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = end
    return out


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        back = np.uint64(pow(int(_ODD), -1, 1 << 64))
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(SPAN, x, np.uint64)]) for x in (_ODD, back))


def _repeats(key: np.ndarray) -> np.ndarray:
    """Whether a key occurs more than once, for each."""
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[where] > 1


@dataclass
class Lines:
    """The lines with words of a batch: document, number among all lines of the document, code points, features."""

    doc: np.ndarray
    number: np.ndarray
    chars: np.ndarray
    x: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """data: bytes of texts one after the other; offsets: where each starts, and the end of the last."""
    data = data[offsets[0] : offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    n_docs = len(offsets) - 1
    kind = _KIND[data]
    # A line starts where a text does and after each line feed.
    feeds = np.flatnonzero(data == _NEWLINE)
    feed_doc = np.searchsorted(offsets, feeds, side="right") - 1
    starts = np.r_[offsets[:-1], feeds + 1]
    order = np.argsort(starts, kind="stable")
    doc = np.r_[np.arange(n_docs), feed_doc][order]
    starts = starts[order]
    # Texts that are empty start where the next one does; sorting by document keeps lines of one together.
    order = np.lexsort((starts, doc))
    doc, starts = doc[order], starts[order]
    first = np.searchsorted(doc, np.arange(n_docs))
    number = np.arange(len(doc)) - first[doc]
    ends = np.r_[starts[1:] - 1, 0]
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
    ends[last] = offsets[doc[last] + 1]

    space = kind == _SPACE
    before = np.r_[True, space[:-1]] if len(space) else space
    bounds = np.zeros(len(data) + 1, bool)
    bounds[offsets[:-1]] = True
    word_start = np.flatnonzero(~space & (before | bounds[:-1]))
    after = np.r_[space[1:], True] if len(space) else space
    word_end = np.flatnonzero(~space & (after | bounds[1:])) + 1
    word_line = np.searchsorted(starts, word_start, side="right") - 1
    n_words = np.bincount(word_line, minlength=len(starts))

    def per_line(mask: np.ndarray) -> np.ndarray:
        run = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
        np.cumsum(mask, out=run[1:])
        return (run[ends] - run[starts]).astype(np.int64)

    counts = [per_line(kind == k) for k in range(9)]
    solid = ends - starts - counts[_SPACE] - counts[_TAIL]
    keep = n_words > 0
    n, words = np.maximum(solid, 1).astype(float), np.maximum(n_words, 1).astype(float)
    with np.errstate(over="ignore"):
        hashed = _hashes(data, word_start, word_end)
        word_doc = doc[word_line] if len(word_line) else word_line
        own = _mixed(hashed + word_line.astype(np.uint64) * _ODD)
        uniq, at = np.unique(own, return_index=True)
        distinct = np.bincount(word_line[at], minlength=len(starts))
        windows = hashed[:-2] * _ODD * _ODD + hashed[1:-1] * _ODD + hashed[2:] if len(hashed) > 2 else np.zeros(0, np.uint64)
        same = word_doc[:-2] == word_doc[2:] if len(hashed) > 2 else np.zeros(0, bool)
        again = np.zeros(len(hashed), bool)
        if same.any():
            seen = np.flatnonzero(same)
            twice = seen[_repeats(_mixed(windows[seen] + word_doc[seen].astype(np.uint64) * _ODD))]
            for i in range(3):
                again[twice + i] = True
        covered = np.bincount(word_line[again], minlength=len(starts))
        line_hash = _hashes(data, starts, ends)
        repeated = np.zeros(len(starts), bool)
        held = np.flatnonzero(keep)
        if len(held):
            repeated[held] = _repeats(_mixed(line_hash[held] + doc[held].astype(np.uint64) * _ODD))
    final = kind[word_end - 1] if len(word_end) else np.zeros(0, np.uint8)
    symbol_ends = np.bincount(word_line[(final == _SYMBOL) | (final == _SHOUT)], minlength=len(starts))
    first_word = np.searchsorted(word_line, np.arange(len(starts)))
    last_word = np.searchsorted(word_line, np.arange(len(starts)), side="right") - 1
    pointed, upper = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    if len(held):
        pointed[held] = np.isin(final[last_word[held]], (_POINT, _SHOUT))
        upper[held] = np.isin(kind[word_start[first_word[held]]], (_UPPER, _WIDE))
    columns = [
        np.log1p(solid), np.log1p(n_words), np.log(n / words), counts[_UPPER] / n, counts[_DIGIT] / n, counts[_POINT] / n, counts[_SHOUT] / n,
        counts[_SYMBOL] / n, counts[_WIDE] / n, symbol_ends / words, distinct / words, covered / words, repeated, pointed, upper,
    ]
    x = np.stack([np.asarray(c, np.float64)[keep] for c in columns], axis=1) if len(starts) else np.zeros((0, WIDTH))
    chars = ends - starts - counts[_TAIL]
    return Lines(doc[keep], number[keep], chars[keep], x)


@dataclass
class Model:
    """Weights of a line's, the last and the next line's features and of the edges; weights of neighbouring labels."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    pairs: np.ndarray
    #: The score of a document without lines.
    share: float


def _evidence(x: np.ndarray, doc: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features of each line with those of its neighbours, two marks for a missing neighbour, and 1."""
    z = np.clip((x - mean) / scale, -5, 5)
    n = len(z)
    first = np.r_[True, doc[1:] != doc[:-1]] if n else np.zeros(0, bool)
    last = np.r_[doc[1:] != doc[:-1], True] if n else np.zeros(0, bool)
    back, ahead = np.zeros_like(z), np.zeros_like(z)
    back[1:], ahead[:-1] = z[:-1], z[1:]
    back[first], ahead[last] = 0, 0
    return np.concatenate([z, back, ahead, first[:, None], last[:, None], np.ones((n, 1))], axis=1)


def _products(m: np.ndarray, longest: int) -> np.ndarray:
    """Running products of the matrices m[0], m[0] m[1], ... up to factors, looking back over `longest` of them at least."""
    a, b, c, d = (np.ascontiguousarray(m[:, i, j]) for i in (0, 1) for j in (0, 1))
    step = 1
    while step < longest:
        p, q, r, s = (x[:-step] for x in (a, b, c, d))
        e, f, g, h = (x[step:] for x in (a, b, c, d))
        e, f, g, h = p * e + q * g, p * f + q * h, r * e + s * g, r * f + s * h
        most = np.maximum(np.maximum(e, f), np.maximum(g, h))
        a, b, c, d = (np.concatenate([old[:step], np.maximum(new / most, 1e-300)]) for old, new in ((a, e), (b, f), (c, g), (d, h)))
        step *= 2
    return np.stack([a, b, c, d], axis=1).reshape(-1, 2, 2)


def messages(e: np.ndarray, doc: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of each line, up to factors. e: evidence for good over bad; label 1 is good."""
    n = len(e)
    if not n:
        return np.zeros((0, 2)), np.zeros((0, 2))
    e = np.clip(e, -60, 60)
    first, last = np.r_[True, doc[1:] != doc[:-1]], np.r_[doc[1:] != doc[:-1], True]
    longest = int(np.diff(np.r_[np.flatnonzero(first), n]).max())
    local = np.stack([np.exp(-e / 2), np.exp(e / 2)], axis=1)
    local /= local.max(axis=1, keepdims=True)
    m = np.exp(pairs - pairs.max())[None] * local[:, None, :]
    ahead = m.copy()
    # Equal rows forget what was before.
    ahead[first] = local[first][:, None, :]
    forward = _products(ahead, longest)[:, 0, :]
    after = np.ones((n, 2, 2))
    after[~last] = m[1:][~last[:-1]]
    # Products from the right: of the transposes in reverse order.
    backward = _products(after[::-1].transpose(0, 2, 1), longest)[::-1][:, 0, :]
    return forward, backward


def marginals(e: np.ndarray, doc: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Probability of good for each line."""
    a, b = messages(e, doc, pairs)
    p = a * b
    return p[:, 1] / p.sum(axis=1) if len(p) else np.zeros(0)


def climbed(x: np.ndarray, doc: np.ndarray, good: np.ndarray, share: float) -> Model:
    """The field of greatest penalised likelihood for lines x of documents, `good` for each line."""
    if not len(x):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(3 * WIDTH + 3), np.zeros((2, 2)), share)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    f = _evidence(x, doc, mean, scale)
    sizes = np.bincount(doc)[doc]
    weight = 1.0 / sizes
    weight /= weight.sum()
    same = np.r_[False, doc[1:] == doc[:-1]]
    to, at = np.flatnonzero(same), np.flatnonzero(same) - 1
    y = good.astype(int)
    theta = np.zeros(f.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at], y[to]), weight[to])
    for step in range(1, STEPS + 1):
        w, pairs = theta[:-4], theta[-4:].reshape(2, 2)
        e = f @ w
        a, b = messages(e, doc, pairs)
        p = a * b
        p = p[:, 1] / p.sum(axis=1)
        grad = np.zeros_like(theta)
        grad[:-4] = f.T @ (weight * (y - p))
        if len(to):
            ce = np.clip(e[to], -60, 60)
            joint = a[at][:, :, None] * np.exp(pairs - pairs.max())[None] * np.stack([np.exp(-ce / 2), np.exp(ce / 2)], axis=1)[:, None, :] * b[to][:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            grad[-4:] = (seen - (weight[to][:, None, None] * joint).sum(axis=0)).ravel()
        grad -= RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), share)


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id in decimal, modulo FOLDS; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % FOLDS


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    for batch in in_pieces(batches, "text", 4 << 20):
        data, offsets = raw(batch.column("text"))
        yield batch, lines_of(np.frombuffer(data, np.uint8), np.asarray(offsets, np.int64))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. labels: doc_id, quality. Learns from rows outside the held-out fold only."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(fold() != HELD_OUT)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).alias("good"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    texts = texts.filter((F.length("text") <= MOST_CHARS) & (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < MOST_LINES))
    # The smallest hashes: a top-k of ids, of which every task keeps `sample`; their texts are then read where they are.
    by = F.xxhash64(F.col("doc_id"), F.lit(11))
    ids = texts.select("doc_id").join(known, "doc_id").distinct().orderBy(by, "doc_id").limit(sample)
    chosen = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "good").orderBy(by, "text").limit(sample)

    def run(batches):
        for batch, found in _parts(batches):
            good = np.asarray(batch.column("good").to_pylist(), bool)
            split = np.searchsorted(found.doc, np.arange(batch.num_rows + 1))
            rows = [found.x[split[i] : split[i + 1]].astype("<f8").tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(good), pa.array(rows, pa.binary())], names=["doc_id", "good", "lines"])

    got = sized(chosen).mapInArrow(lean(run), "doc_id long, good boolean, lines binary").collect()
    if not got:
        return climbed(np.zeros((0, WIDTH)), np.zeros(0, int), np.zeros(0, bool), 0.5)
    got.sort(key=lambda r: (r["doc_id"], r["lines"]))
    share = sum(r["good"] for r in got) / len(got)
    each = [np.frombuffer(r["lines"], "<f8").reshape(-1, WIDTH) for r in got]
    held = [i for i, x in enumerate(each) if len(x)]
    if not held:
        return climbed(np.zeros((0, WIDTH)), np.zeros(0, int), np.zeros(0, bool), share)
    doc = np.repeat(np.arange(len(held)), [len(each[i]) for i in held])
    good = np.repeat([got[i]["good"] for i in held], [len(each[i]) for i in held])
    return climbed(np.concatenate([each[i] for i in held]), doc, good, share)


def _texts(docs: DataFrame) -> DataFrame:
    return sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def _judged(found: Lines, model: Model) -> np.ndarray:
    return marginals(_evidence(found.x, found.doc, model.mean, model.scale) @ model.w, found.doc, model.pairs)


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """One row per line with words: doc_id, line (from 0, by line feeds), n_chars, p_good, good."""

    def run(batches):
        for batch, found in _parts(batches):
            p = _judged(found, model)
            ids = batch.column("doc_id").take(pa.array(found.doc, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.number, pa.int64()), pa.array(found.chars, pa.int64()), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "line", "n_chars", "p_good", "good"])

    return _texts(docs).mapInArrow(lean(run), "doc_id long, line long, n_chars long, p_good double, good boolean")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_lines, n_bad_lines."""

    def run(batches):
        for batch, found in _parts(batches):
            p, n = _judged(found, model), batch.num_rows
            total = np.bincount(found.doc, found.chars, n)
            score = np.where(total > 0, np.bincount(found.doc, found.chars * p, n) / np.maximum(total, 1), model.share)
            score = np.clip(np.round(score, 6), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array(score >= 0.5).cast(pa.int32()), pa.array(np.bincount(found.doc, minlength=n)), pa.array(np.bincount(found.doc[p < 0.5], minlength=n))],
                names=["doc_id", "score", "predicted", "n_lines", "n_bad_lines"],
            )

    rows = _texts(docs).mapInArrow(lean(run), "doc_id long, score double, predicted int, n_lines long, n_bad_lines long")
    return rows.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted", "n_lines", "n_bad_lines")
