"""Encoding to and decoding from the pieces of a SentencePiece model, as a parallel scan in the max-plus semiring.

A text's segmentations are the paths of a lattice whose nodes are occurrences of pieces. For a byte-pair model the weight
of two neighbouring pieces is 0 if encoding their joint text gives back the two, else minus infinity: a path's total is
0 for the model's own encoding and minus infinity for all others, so the best path is the encoding, exactly. For each
place at most one piece ends a path of total 0 from a given start, so one table of last pieces is a whole forward pass.

Words. No piece holds a space mark after another character, so paths pass every start of a word in one state. Short words
are scanned in bulk, once each, all words of a batch side by side. Longer ones are scanned one place at a time.

Models of scored pieces. `Scored` takes pieces with log probabilities, as a unigram model has: there a piece's score is its
weight, whatever stands beside it, and the best path is that of the greatest sum. The state at a cut is then how many
characters of a piece reach over it, and maxima decide between paths in every chunk, product and backtrace.

Giant texts are cut into chunks at fixed places, in the middle of words as it comes. The state at a cut is the piece that
reaches over it or ends there. A chunk yields its transfer matrix from the states of its left cut to those of its right
one; scans from two states soon pass the same piece and are one from there. Matrices are combined by the associative
max-plus product, and with its two states known each chunk is traced back on its own, wherever it is.

Defined results. A null or empty text has no tokens. Characters that the model lacks are their UTF-8 bytes. Space marks
(U+2581) in a text are spaces, as for the model's own library, so decoding gives a space for them; all else comes back
as it was. Repeated rows and ids: each row has its result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.arrowio import in_pieces, lean, sized
from sparkquill.tables import written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SHORT, CHUNK = 40, 1 << 16
NONE, START, UNKNOWN = -1, -2, -3
#: A place that no text has: marks a pass that met an earlier one.
MET = -1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_GROW = np.uint64(0xD6E8FEB86659FD93)


class _Table:
    """Open addressing from 64-bit keys to int32 values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 3)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, NONE, np.int32)
        for k, v in zip(keys, values, strict=True):
            at = int(self._slot(np.array([k]))[0])
            while self.values[at] != NONE:
                at = (at + 1) & int(self.mask)
            self.keys[at], self.values[at] = k, v

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at]
        todo = np.flatnonzero((out != NONE) & (self.keys[at] != keys))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            out[todo] = self.values[at]
            more = (out[todo] != NONE) & (self.keys[at] != keys[todo])
            todo, at = todo[more], at[more]
        return out


class Pieces:
    """A model's pieces in ranks: 0.. for single characters, then merged pieces by falling score."""

    #: Texts are given a space mark in front and in place of spaces.
    mark = True

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(names)) if not (sp.is_byte(i) or sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i))]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.as_bytes = [names[i].replace(MARK, " ").encode() for i in range(len(names))]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.as_bytes[i] = bytes([b])
        chars = [i for i in plain if len(names[i]) == 1]
        merged = sorted((i for i in plain if len(names[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        self.ids = np.array(chars + merged, np.int32)
        self.text = [names[i] for i in self.ids]
        self.rank = {t: r for r, t in enumerate(self.text)}
        self.n_chars = len(chars)
        self.longest = max(map(len, self.text))
        self.left = np.arange(len(self.text), dtype=np.int32)
        self.right = self.left.copy()
        reachable = np.ones(len(self.text), bool)
        for r in range(self.n_chars, len(self.text)):
            halves = self._last_merge(self.text[r])
            if halves is None:
                reachable[r] = False
                del self.rank[self.text[r]]
            else:
                self.left[r], self.right[r] = halves
        kept = np.flatnonzero(reachable)
        self.by_hash = _Table(np.array([self._hash(self.text[r]) for r in kept], np.uint64), kept.astype(np.int32))
        pairs = kept[kept >= self.n_chars]
        self.pair = {(int(self.left[r]), int(self.right[r])): int(r) for r in pairs}
        self.by_pair = _Table(self._pair_key(self.left[pairs], self.right[pairs]), pairs.astype(np.int32))
        self._fits: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_GROW) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    @staticmethod
    def _pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) + np.uint64(1))

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        """The two pieces whose merge completes `text`; None if its characters merge into something else."""
        parts = list(text)
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in itertools.pairwise(parts)]
            best = min(ranks)
            if best == 1 << 30:
                return None
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 2 or parts[0] not in self.rank or parts[1] not in self.rank:
            return None
        return self.rank[parts[0]], self.rank[parts[1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether encoding the joint text of pieces a and b gives back the two: the weight 0."""
        if a < 0 or b < 0:
            return True
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 100_000:
                self._fits.clear()
            known = self._fits[a, b] = bool(self.fit(np.array([a], np.int32), np.array([b], np.int32))[0])
        return known

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`fits` for arrays. The later of the two merges is undone until a merge across the border would have come first,
        or only characters are left."""
        out = np.ones(len(a), bool)
        rows = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[rows].astype(np.int32), b[rows].astype(np.int32)
        limit = np.full(len(rows), 1 << 30, np.int32)
        while len(rows):
            across = self.by_pair.get(self._pair_key(a, b))
            bad = (across != NONE) & (across < limit)
            out[rows[bad]] = False
            a_merged, b_merged = a >= self.n_chars, b >= self.n_chars
            go = ~bad & (a_merged | b_merged)
            rows, a, b = rows[go], a[go], b[go]
            # Equal merges happen from left to right: undoing the right one, its own rank still counts as earlier.
            first = a > b
            limit = np.where(first, a, b + 1).astype(np.int32)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def chunk(self, text: str, at: int, end: int, first: bool, final: bool) -> Chunk:
        return Chunk(self, text, at, end, first, final)

    def token_ids(self, ranks: list[int], chars: str) -> list[int]:
        """Ids of pieces by rank; those unknown (one character each) as bytes."""
        out, at = [], 0
        for r in ranks:
            if r == UNKNOWN:
                out += self.byte_ids[list(chars[at].encode())].tolist()
                at += 1
            else:
                out.append(int(self.ids[r]))
                at += len(self.text[r])
        return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def scan(p: Pieces, text: str, state: int, at: int, end: int, stop: dict[int, tuple[int, int]] | None = None) -> dict[int, tuple[int, int]]:
    """Forward pass from place `at`, reached with piece `state`: for each place that paths of total 0 reach, the last
    piece and its start. Pieces start before `end`. Ends early where all that lies open is as in `stop`, an earlier pass."""
    last: dict[int, tuple[int, int]] = {at: (state, at)}
    rank, fits, longest = p.rank, p.fits, p.longest
    for i in range(at, end):
        here = last.get(i)
        if here is None:
            continue
        if stop is not None and i > at and i in stop and _same_front(last, stop, i, longest):
            last[MET] = (NONE, i)
            break
        if text[i] not in rank:
            last[i + 1] = (UNKNOWN, i)
            continue
        for j in range(i + 1, min(i + longest, len(text)) + 1):
            r = rank.get(text[i:j])
            if r is not None and fits(here[0], r):
                last[j] = (r, i)
    return last


def _same_front(last: dict, stop: dict, i: int, longest: int) -> bool:
    """Whether two passes have the same pieces over place i and ending there."""
    for j in range(i, i + longest + 1):
        a, b = last.get(j), stop.get(j)
        if (a and a[0] if a and a[1] < i else None) != (b[0] if b and b[1] < i else None):
            return False
    return True


def trace(last: dict[int, tuple[int, int]], at: int, end: int) -> list[int]:
    out = []
    while end > at:
        r, start = last[end]
        out.append(r)
        end = start
    return out[::-1]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def encode_words(p: Pieces, words: list[str]) -> list[bytes]:
    """Ids of each word (space marks written as spaces) as little-endian 32-bit numbers in a row. Words up to SHORT
    characters are scanned side by side."""
    out = [b""] * len(words)
    marked = [w.replace(" ", MARK) for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    for i in np.flatnonzero(sizes > SHORT).tolist():
        last = scan(p, marked[i], START, 0, len(marked[i]))
        out[i] = _packed(p.token_ids(trace(last, 0, len(marked[i])), marked[i]))
    order = np.argsort(sizes, kind="stable")
    order = order[(sizes[order] <= SHORT) & (sizes[order] > 0)]
    for a in range(0, len(order), 20_000):
        rows = order[a : a + 20_000]
        _side_by_side(p, rows.tolist(), marked, sizes[rows], out)
    return out


def _side_by_side(p: Pieces, rows: list[int], marked: list[str], sizes: np.ndarray, out: list) -> None:
    n, width = len(rows), int(sizes.max())
    flat = np.frombuffer("".join(marked[i] for i in rows).encode("utf-32-le"), np.uint32)
    codes = np.zeros((n, width), np.uint64)
    codes[np.arange(width)[None, :] < sizes[:, None]] = flat
    found = []
    h = np.zeros((n, width), np.uint64)
    for size in range(1, min(p.longest, width) + 1):
        h = h[:, : width - size + 1] * _GROW + codes[:, size - 1 :] + np.uint64(1)
        ids = p.by_hash.get(h.ravel()).reshape(h.shape)
        ids[(np.arange(width - size + 1) + size)[None, :] > sizes[:, None]] = NONE
        if size == 1:
            ids[(ids == NONE) & (np.arange(width)[None, :] < sizes[:, None])] = UNKNOWN
        found.append(ids)
    last = np.full((n, width + 1), NONE, np.int32)
    back = np.zeros((n, width + 1), np.int8)
    last[:, 0] = START
    for end in range(1, width + 1):
        who, size_of, ids, before = [], [], [], []
        for size in range(1, min(len(found), end) + 1):
            t, b = found[size - 1][:, end - size], last[:, end - size]
            r = np.flatnonzero((t != NONE) & (b != NONE))
            who.append(r)
            size_of.append(np.full(len(r), size, np.int8))
            ids.append(t[r])
            before.append(b[r])
        who, size_of, ids, before = (np.concatenate(v) for v in (who, size_of, ids, before))
        ok = p.fit(before, ids)
        last[who[ok], end] = ids[ok]
        back[who[ok], end] = size_of[ok]
    at = sizes.copy()
    live = np.arange(n)
    taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        taken.append((live, last[live, at[live]], at[live]))
        at[live] -= back[live, at[live]]
        live = live[at[live] > 0]
    row = np.concatenate([t[0] for t in taken])
    rank = np.concatenate([t[1] for t in taken])
    place = np.concatenate([t[2] for t in taken])
    sort = np.lexsort((place, row))
    row, rank, place = row[sort], rank[sort], place[sort]
    ids = p.ids[np.maximum(rank, 0)].astype("<i4").tobytes()
    bounds = np.searchsorted(row, np.arange(n + 1)).tolist()
    for k, i in enumerate(rows):
        out[i] = ids[4 * bounds[k] : 4 * bounds[k + 1]]
    for k in np.unique(row[rank == UNKNOWN]).tolist():
        out[rows[k]] = _packed(p.token_ids(rank[bounds[k] : bounds[k + 1]].tolist(), marked[rows[k]]))


_WORD = re.compile(" +[^ ]*")


class Encoder:
    """Encodes texts batch by batch; words met before are kept, up to a number."""

    def __init__(self, path: str, keep: int = 300_000):
        self.p, self.keep = pieces(path), keep
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [_WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        known = self.known
        new = list({w for ws in words for w in ws if w not in known})
        if len(known) + len(new) > self.keep:
            known.clear()
            new = list({w for ws in words for w in ws})
        known.update(zip(new, encode_words(self.p, new), strict=True))
        return [np.frombuffer(b"".join([known[w] for w in ws]), "<i4") for ws in words]


def decode(p: Pieces, ids: np.ndarray) -> bytes:
    """The text of ids, as UTF-8, without the space that encoding put in front."""
    names = p.as_bytes
    return b"".join([names[i] for i in ids.tolist()])[1:]


# Giant texts


def cut_states(p: Pieces, text: str, cut: int) -> list[tuple[int, int, int]]:
    """All (start, end, piece) with start < cut <= end: what may reach over a cut or end at it, in a fixed order."""
    out = []
    for start in range(max(0, cut - p.longest), cut):
        for end in range(cut, min(start + p.longest, len(text)) + 1):
            r = p.rank.get(text[start:end])
            if r is not None:
                out.append((start, end, r))
    if cut > 0 and text[cut - 1] not in p.rank:
        out.append((cut - 1, cut, UNKNOWN))
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by halves: product is associative, so each half can be combined anywhere."""
    if len(matrices) <= 1:
        return list(matrices)
    pairs = [product(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
    even = prefixes(pairs)
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(even[i // 2] if i % 2 else product(even[i // 2 - 1], matrices[i]))
    return out


def _word_cuts(text: str, at: int, end: int) -> tuple[int, int] | None:
    """The first and last start of a word in (at, end)."""
    first = re.compile(f"(?<=[^{MARK}]){MARK}").search(text, at + 1, end)
    if first is None:
        return None
    i = end
    while (i := text.rfind(MARK, at, i)) > first.start():
        if text[i - 1] != MARK:
            return first.start(), i
    return first.start(), first.start()


class Chunk:
    """Places [at, end) of a text, with `text` holding some places before and after."""

    def __init__(self, p: Pieces, text: str, at: int, end: int, first: bool, final: bool):
        self.p, self.text, self.at, self.end = p, text, at, end
        self.left = [(at, at, START)] if first else cut_states(p, text, at)
        self.right = [(end, end, START)] if final else cut_states(p, text, end)
        self.final = final
        self.cuts = _word_cuts(text, at + p.longest, end) if end - at > 2 * p.longest else None

    def _reached(self, last: dict[int, tuple[int, int]]) -> np.ndarray:
        out = np.full(len(self.right), -np.inf)
        for s, (start, end, r) in enumerate(self.right):
            if self.final and self.end in last or not self.final and last.get(end) == (r, start):
                out[s] = 0.0
        return out

    def matrix(self) -> np.ndarray:
        """Weights from each left state to each right state."""
        out = np.full((len(self.left), len(self.right)), -np.inf)
        if self.cuts:
            tail = self._reached(scan(self.p, self.text, START, self.cuts[1], self.end))
            for s, (_, end, r) in enumerate(self.left):
                if self.cuts[0] in scan(self.p, self.text, r, end, self.cuts[0]):
                    out[s] = tail
            return out
        whole: list[tuple[dict[int, tuple[int, int]], np.ndarray]] = []
        for s, (_, end, r) in enumerate(self.left):
            for stop, reached in whole:
                last = scan(self.p, self.text, r, end, self.end, stop)
                if MET in last:
                    out[s] = reached
                    break
            else:
                last = scan(self.p, self.text, r, end, self.end)
                out[s] = self._reached(last)
                if np.isfinite(out[s]).any():
                    whole.append((last, out[s]))
        return out

    def ids(self, left: int, right: int, encoder: Encoder) -> list[int]:
        """Ids of the pieces that start in the chunk, given its two states."""
        _, at, state = self.left[left]
        end = self.end if self.final else self.right[right][1]
        if at >= self.end and at == end:
            return []
        if not self.cuts or at > self.cuts[0]:
            last = scan(self.p, self.text, state, at, self.end)
            return self.p.token_ids(trace(last, at, end), self.text[at:])
        a, b = self.cuts
        head = trace(scan(self.p, self.text, state, at, a), at, a)
        tail = trace(scan(self.p, self.text, START, b, self.end), b, end)
        out = self.p.token_ids(head, self.text[at:])
        if b > a:
            # Words with their space marks stand as encode() makes them of a text whose first space is put in front.
            out += encoder.encode([self.text[a + 1 : b].replace(MARK, " ")])[0].tolist()
        return out + self.p.token_ids(tail, self.text[b:])


class Scored:
    """Pieces with scores. A character that is no piece is one of `unknown` score; of equal sums the path whose last piece
    is longest counts. Ids are places in `table`, and -1 for unknown characters."""

    mark = False

    def __init__(self, table: list[tuple[str, float]], unknown: float):
        self.score = {t: s for t, s in table}
        self.id = {t: i for i, (t, _) in enumerate(table)}
        self.unknown, self.longest = unknown, max((len(t) for t, _ in table), default=1)

    def forward(self, text: str, at: int, end: int) -> tuple[dict[int, float], dict[int, int]]:
        """For each place that pieces from `at` reach, the best sum and the start of its last piece. Pieces start before `end`."""
        best, back = {at: 0.0}, {}
        score = self.score
        for i in range(at, end):
            here = best.get(i)
            if here is None:
                continue
            for j in range(i + 1, min(i + self.longest, len(text)) + 1):
                s = score.get(text[i:j])
                if s is None:
                    if j > i + 1 or text[i] in score:
                        continue
                    s = self.unknown
                if j not in best or here + s > best[j]:
                    best[j], back[j] = here + s, i
        return best, back

    def path(self, text: str, at: int, to: int, end: int) -> list[int]:
        """Ids of the best path from `at` to `to` whose pieces start before `end`."""
        _, back = self.forward(text, at, end)
        out = []
        while to > at:
            out.append(self.id.get(text[back[to] : to], -1))
            to = back[to]
        return out[::-1]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.path(t, 0, len(t), len(t)), np.int32) for t in texts]

    def chunk(self, text: str, at: int, end: int, first: bool, final: bool) -> ScoredChunk:
        return ScoredChunk(self, text, at, end, first, final)


class ScoredChunk:
    """Places [at, end) of a text. States: how many characters of a piece reach over a cut, 0 at the text's ends."""

    def __init__(self, p: Scored, text: str, at: int, end: int, first: bool, final: bool):
        self.p, self.text, self.at, self.end = p, text, at, end
        self.n_left, self.n_right = 1 if first else p.longest, 1 if final else p.longest

    def matrix(self) -> np.ndarray:
        out = np.full((self.n_left, self.n_right), -np.inf)
        for a in range(self.n_left):
            if self.at + a > len(self.text):
                break
            if self.at + a >= self.end:
                # The piece before the chunk reaches past it: what is over goes on.
                if self.at + a - self.end < self.n_right:
                    out[a, self.at + a - self.end] = 0.0
                continue
            best, _ = self.p.forward(self.text, self.at + a, self.end)
            for b in range(self.n_right):
                out[a, b] = best.get(self.end + b, -np.inf)
        return out

    def ids(self, left: int, right: int, encoder=None) -> list[int]:
        at = self.at + left
        return self.p.path(self.text, at, self.end + right, self.end) if at < self.end else []


_CHUNKS = "row string, c int, n int, at int, end int, text string"


def _split(batches, model, chunk: int):
    longest, mark = model().longest, model().mark
    for batch in in_pieces(batches, "text"):
        out = []
        for row, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = MARK + t.replace(" ", MARK) if mark else t
            n = -(-len(text) // chunk)
            for c in range(n):
                a = max(0, c * chunk - 2 * longest)
                end = min((c + 1) * chunk, len(text))
                out.append((row, c, n, c * chunk - a, end - a, text[a : end + 2 * longest]))
                if len(out) >= 64:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["row", "c", "n", "at", "end", "text"]).astype({"c": "int32", "n": "int32", "at": "int32", "end": "int32"}), preserve_index=False)
                    out = []
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["row", "c", "n", "at", "end", "text"]).astype({"c": "int32", "n": "int32", "at": "int32", "end": "int32"}), preserve_index=False)


def _chunk_of(p: Pieces | Scored, r: dict) -> Chunk | ScoredChunk:
    return p.chunk(r["text"], r["at"], r["end"], r["c"] == 0, r["c"] == r["n"] - 1)


_MATRIX = pa.schema([("row", pa.string()), ("c", pa.int32()), ("rows", pa.int32()), ("cols", pa.int32()), ("free", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64()))])


def _matrices(batches, model):
    p = model()
    for batch in batches:
        for r in batch.to_pylist():
            m = _chunk_of(p, r).matrix()
            free = np.flatnonzero(np.isfinite(m.ravel()))
            yield pa.RecordBatch.from_pylist([{"row": r["row"], "c": r["c"], "rows": m.shape[0], "cols": m.shape[1], "free": free.tolist(), "weight": m.ravel()[free].tolist()}], schema=_MATRIX)


def _states(batches):
    """Of each text its chunks' matrices, in order: the left and right state of every chunk on the best path."""
    for batch in batches:
        for r in batch.to_pylist():
            ms = []
            for c in r["chunks"]:
                m = np.full(c["rows"] * c["cols"], -np.inf)
                m[c["free"]] = c["weight"]
                ms.append(m.reshape(c["rows"], c["cols"]))
            n = len(ms)
            before = prefixes(ms)
            # What follows a state decides between those that the start can reach.
            follow = np.zeros((ms[-1].shape[1], 1))
            right = [0] * n
            for i in range(n - 1, -1, -1):
                total = before[i][0] + follow[:, 0]
                # A state on the best path, and one from which the state chosen after it is reached on it.
                if i < n - 1:
                    total = before[i][0] + ms[i + 1][:, right[i + 1]]
                right[i] = int(np.argmax(total))
                assert np.isfinite(total[right[i]]), "no path"
            yield pa.RecordBatch.from_arrays([pa.array([r["row"]] * n), pa.array(range(n), pa.int32()), pa.array([0, *right[:-1]], pa.int32()), pa.array(right, pa.int32())], names=["row", "c", "left", "right"])


def _traced(batches, model, encoder_of):
    p, encoder = model(), encoder_of()
    for batch in batches:
        for r in batch.to_pylist():
            ids = _chunk_of(p, r).ids(r["left"], r["right"], encoder)
            yield pa.RecordBatch.from_arrays([pa.array([r["row"]]), pa.array([r["c"]], pa.int32()), pa.array([ids], pa.list_(pa.int32()))], names=["row", "c", "ids"])


def _giant_ids(docs: DataFrame, model, encoder_of, chunk: int) -> DataFrame:
    """(row string, text) -> row, ids: by chunks, matrices and states. model: makes the pieces in a worker."""
    limit = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    chunks = written(docs.mapInArrow(lean(lambda it: _split(it, model, chunk)), _CHUNKS).repartition(int(limit), "row", "c"), "chunks")
    matrices = chunks.mapInArrow(lean(lambda it: _matrices(it, model)), "row string, c int, rows int, cols int, free array<int>, weight array<double>")
    ordered = matrices.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("c", "rows", "cols", "free", "weight"))).alias("chunks"))
    states = ordered.mapInArrow(lean(_states), "row string, c int, left int, right int")
    traced = chunks.join(states, ["row", "c"]).mapInArrow(lean(lambda it: _traced(it, model, encoder_of)), "row string, c int, ids array<int>")
    parts = traced.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("c", "ids"))).alias("parts"))
    return parts.select("row", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))


def giant_ids(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(row string, text) -> row, ids by the byte-pair model at `path`."""
    return _giant_ids(docs, lambda: pieces(path), lambda: Encoder(path), chunk)


def scored_ids(docs: DataFrame, table: list[tuple[str, float]], unknown: float, chunk: int = CHUNK) -> DataFrame:
    """One row per row of `docs`: doc_id, ids of the best segmentation of the text, as it stands, by scored pieces.

    The vocabulary goes to the workers with the function; it is a bounded table. A null text has no ids."""
    longest = max((len(t) for t, _ in table), default=1)
    if chunk < longest:
        raise ValueError("a chunk must be as long as the longest piece")
    docs = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))

    def run(batches):
        model = Scored(table, unknown)
        for batch in in_pieces(batches, "text", 2 << 20):
            ids = model.encode(batch.column("text").to_pylist())
            bounds = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    small = docs.filter(F.length("text") <= chunk).mapInArrow(lean(run), "doc_id long, ids array<int>")
    giant = docs.filter(F.length("text") > chunk)
    giant = giant.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)))
    ids = _giant_ids(giant.select("row", "text").dropDuplicates(["row"]), lambda: Scored(table, unknown), lambda: None, chunk)
    return small.unionByName(giant.join(ids, "row").select("doc_id", "ids"))


def _digests(ids: np.ndarray, text: bytes, p: Pieces) -> tuple[int, str, bool]:
    back = decode(p, ids) if len(ids) else b""
    return len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), back == text.replace(MARK.encode(), b" ")


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean"


def _encoded(batches, path: str, with_ids: bool):
    p, encoder = pieces(path), Encoder(path)
    for batch in in_pieces(batches, "text", 2 << 20):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = encoder.encode(texts)
        columns = [batch.column("doc_id")]
        names = ["doc_id"]
        n, sha, back = zip(*[_digests(i, t.encode(), p) for i, t in zip(ids, texts, strict=True)], strict=True)
        columns += [pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
        names += ["n_tokens", "ids_sha256", "round_trip"]
        if with_ids:
            bounds = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _giants(batches, path: str, with_ids: bool):
    p = pieces(path)
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.array(r["ids"], np.int32)
            n, sha, back = _digests(ids, r["text"].encode(), p)
            columns = [pa.array([r["doc_id"]], pa.int64()), pa.array([n], pa.int64()), pa.array([sha]), pa.array([back])]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([ids], pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "n_tokens", "ids_sha256", "round_trip"] + ["ids"] * with_ids)


def encoded(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), round_trip, and ids if wanted."""
    docs = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    schema = _RESULT + (", ids array<int>" if with_ids else "")
    small = docs.filter(F.length("text") <= chunk).mapInArrow(lean(lambda it: _encoded(it, path, with_ids)), schema)
    giant = docs.filter(F.length("text") > chunk)
    # Rows are matched by id and text; repeated rows have equal results, so one of each is encoded.
    giant = giant.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)))
    ids = giant_ids(giant.select("row", "text").dropDuplicates(["row"]), path, chunk)
    large = giant.join(ids, "row").select("doc_id", "text", "ids").mapInArrow(lean(lambda it: _giants(it, path, with_ids)), schema)
    return small.unionByName(large)
