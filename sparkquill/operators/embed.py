"""Embedders: any function from a column of texts to a column of float arrays.

`model_embedder` runs an ONNX model with one session per Python worker, over Arrow batches; it needs onnxruntime,
tokenizers and the model's files. `hashing_embedder` needs no model: it is deterministic and meant for tests and trials."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.functions.text import let, tokens

Embedder = Callable[[Column], Column]

#: Subword ids in one run of a model: 32 of the short texts, 16 of the longest.
IDS_A_RUN = 8192
#: Texts whose subword ids a worker holds at once.
AT_ONCE = 256


def hashing_embedder(dim: int = 64) -> Embedder:
    """Counts of token hashes, signed, as built-in expressions. A text without tokens is the zero vector."""

    def embed(text: Column) -> Column:
        slot = lambda h: F.pmod(h, F.lit(dim)).cast("int")
        sign = lambda h: F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        cells = let(
            F.transform(tokens(text), lambda t: F.xxhash64(t)),
            lambda hashes: F.transform(
                F.sequence(F.lit(0), F.lit(dim - 1)),
                lambda i: F.aggregate(F.filter(hashes, lambda h: slot(h) == i), F.lit(0.0), lambda s, h: s + sign(h)),
            ),
        )
        return cells.cast("array<float>")

    return embed


def pooled(output: np.ndarray) -> np.ndarray:
    """A model's first output as one vector: the mean over tokens of three dimensions, else its row as it is."""
    if output.ndim == 3:
        return output[0].mean(axis=0)
    return output[0] if output.ndim == 2 else output


@functools.lru_cache(maxsize=1)
def _session(model: str, tokenizer: str):
    import onnxruntime
    from tokenizers import Tokenizer

    return onnxruntime.InferenceSession(model), Tokenizer.from_file(tokenizer)


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def limit_of(text: str) -> int:
    return 512 if len(text) >= 2400 else 384 if len(text) >= 1200 else 256


def subword_ids(tokenizer, text: str) -> list[int]:
    """Ids with the special tokens, cut to the limit for the text's length, not padded."""
    tokenizer.no_padding()
    tokenizer.enable_truncation(limit_of(text))
    return tokenizer.encode(text).ids


def _some(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Batches in parts of AT_ONCE rows, so that a worker's lists of ids don't grow with the rows of its task."""
    for rows in batches:
        for a in range(0, len(rows), AT_ONCE):
            yield rows.iloc[a : a + AT_ONCE]


def tokenize_column(path: str) -> Callable[[Column], Column]:
    """A column of texts to one of subword ids, by a tokenizer file that each worker loads once."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(path)
        for texts in _some(batches):
            yield texts.map(lambda x: None if x is None else np.array(subword_ids(t, x), np.int32))

    return run


def decode_column(path: str) -> Callable[[Column], Column]:
    """A column of subword ids to one of texts, special tokens left out."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(path)
        for ids in _some(batches):
            yield ids.map(lambda x: None if x is None else t.decode([int(i) for i in x], skip_special_tokens=True))

    return run


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def vectors_of(session, tokenizer, texts: list[str | None]) -> list[list[float] | None]:
    """A vector for each text, several texts a run of the model.

    Only texts of the same number of ids share a run, so nothing is padded and a text's vector doesn't depend on its
    neighbours. A null text, and one without any id, has no vector."""
    inputs = session.get_inputs()
    fixed = inputs[0].shape[0] if inputs[0].shape and isinstance(inputs[0].shape[0], int) else None
    by_length: dict[int, list[tuple[int, list[int]]]] = {}
    for i, text in enumerate(texts):
        ids = subword_ids(tokenizer, text) if text is not None else []
        if ids:
            by_length.setdefault(len(ids), []).append((i, ids))
    out: list[list[float] | None] = [None] * len(texts)
    for length, rows in by_length.items():
        many = fixed or max(1, IDS_A_RUN // length)
        for a in range(0, len(rows), many):
            part = rows[a : a + many]
            ids = np.array([r[1] for r in part], np.int64)
            if fixed:  # a model that takes exactly so many rows
                ids = np.vstack([ids, np.repeat(ids[-1:], fixed - len(part), axis=0)])
            feed = {n.name: np.ones_like(ids) if "mask" in n.name else np.zeros_like(ids) if "type" in n.name else ids for n in inputs}
            found = session.run(None, feed)[0]
            for j, (i, _) in enumerate(part):
                out[i] = pooled(found[j : j + 1]).astype(np.float32).tolist()
    return out


def model_embedder(model: str, tokenizer: str) -> Embedder:
    """Texts through the tokenizer and the model, an Arrow batch at a time; vectors are pooled, not normalised."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        session, t = _session(model, tokenizer)
        for texts in batches:
            yield pd.Series(vectors_of(session, t, texts.tolist()), dtype=object)

    return run


def embedded(chunks: DataFrame, embed: Embedder, text: str = "content") -> DataFrame:
    """`chunks` with their embedding anew."""
    return chunks.withColumn("embedding", embed(F.col(text)))
