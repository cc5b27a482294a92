"""FNV-1a over normalised sentences. Spark's BIGINT product is checked for overflow, so this one runs in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkquill.functions.text import sentence_key

#: Fixed values of 64-bit FNV-1a.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    return int(fnv1a_all([data])[0])


def fnv1a_all(values: list[bytes]) -> np.ndarray:
    """Hashes of many values, side by side: one step a byte place, over those that are so long."""
    sizes = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    data = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    out = np.full(len(values), OFFSET, np.uint64)
    longer = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    for place, n in enumerate(longer.tolist()):
        rows = order[:n]
        out[rows] = (out[rows] ^ data[starts[:n] + place]) * np.uint64(PRIME)
    return out


def _fnv1a_hex(texts: pd.Series) -> pd.Series:
    known = texts.notna().to_numpy()
    hashes = iter(fnv1a_all([t.encode() for t in texts[known]]).tolist())
    return pd.Series([f"{next(hashes):016x}" if k else None for k in known], dtype=object)


def sentence_hash(c: Column) -> Column:
    """Hash of a sentence as 16 hex digits; case and white space don't matter."""
    return F.pandas_udf(_fnv1a_hex, "string")(sentence_key(c))
