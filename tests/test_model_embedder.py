"""The model embedder with a real session: a model written here byte by byte, that looks subword ids up in a table."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquill.operators import embed

tokenizers = pytest.importorskip("tokenizers")
onnxruntime = pytest.importorskip("onnxruntime")

WORDS = ["[UNK]", "red", "green", "blue", "apple", "pear"]
DIM = 3
TABLE = np.random.default_rng(4).normal(size=(len(WORDS), DIM)).astype(np.float32)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    """One field of a protocol buffer: a number, or bytes with their length."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tensor_type(name, kind, *dims):
    shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def model(rows="rows"):
    """Gather(table, input_ids): rows, ids, DIM. `rows` may be a fixed number."""
    table = field(1, len(WORDS)) + field(1, DIM) + field(2, 1) + field(8, "table") + field(9, struct.pack(f"<{TABLE.size}f", *TABLE.ravel()))
    node = field(1, "table") + field(1, "input_ids") + field(2, "hidden") + field(4, "Gather")
    inputs = [tensor_type(n, 7, rows, "ids") for n in ("input_ids", "attention_mask", "token_type_ids")]
    graph = field(1, node) + field(2, "g") + field(5, table) + b"".join(field(11, i) for i in inputs) + field(12, tensor_type("hidden", 1, rows, "ids", DIM))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("model")
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: i for i, w in enumerate(WORDS)}, unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.save(str(folder / "tokenizer.json"))
    (folder / "model.onnx").write_bytes(model())
    return folder


TEXTS = ["red apple", "", None, "green pear", "red", "red green blue", "unheard of", "apple red", " ", "red apple", "pear " * 700]


def expected(text):
    """The mean of the table's rows, of the first 512 ids of a text as long as the last."""
    ids = [WORDS.index(w) if w in WORDS else 0 for w in (text or "").split()]
    ids = ids[: 512 if len(text or "") >= 2400 else 256]
    return TABLE[ids].mean(axis=0) if ids else None


class Counted:
    """A session that counts the rows of its runs."""

    def __init__(self, session):
        self.session, self.runs = session, []

    def get_inputs(self):
        return self.session.get_inputs()

    def run(self, names, feed):
        assert len({v.shape for v in feed.values()}) == 1
        self.runs.append(feed["input_ids"].shape)
        return self.session.run(names, feed)


def check(got):
    assert len(got) == len(TEXTS)
    for text, vector in zip(TEXTS, got, strict=True):
        want = expected(text)
        assert (vector is None) == (want is None)
        if want is not None:
            np.testing.assert_allclose(vector, want, rtol=1e-4, atol=1e-6)


def test_texts_share_runs(files):
    session = Counted(onnxruntime.InferenceSession(str(files / "model.onnx")))
    t = tokenizers.Tokenizer.from_file(str(files / "tokenizer.json"))
    check(embed.vectors_of(session, t, TEXTS))
    assert sorted(session.runs) == [(1, 1), (1, 3), (1, 512), (5, 2)]
    session.runs.clear()
    embed.vectors_of(session, t, ["red apple"] * 10_000)
    assert session.runs == [(4096, 2), (4096, 2), (1808, 2)]
    assert embed.vectors_of(session, t, []) == []


def test_model_of_fixed_rows(files):
    session = Counted(onnxruntime.InferenceSession(model(rows=2)))
    check(embed.vectors_of(session, tokenizers.Tokenizer.from_file(str(files / "tokenizer.json")), TEXTS))
    assert all(shape[0] == 2 for shape in session.runs)


def test_column(spark, files):
    e = embed.model_embedder(str(files / "model.onnx"), str(files / "tokenizer.json"))
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i long, content string").repartition(3)
    check([r["embedding"] for r in embed.embedded(rows, e).orderBy("i").collect()])
    none = embed.embedded(rows.filter(F.col("i") < 0), e)
    assert none.collect() == [] and dict(none.dtypes)["embedding"] == "array<float>"
