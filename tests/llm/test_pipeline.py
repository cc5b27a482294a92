"""The whole pipeline against its stages in plain Python and SQL."""

import random

import duckdb
import pandas as pd
import pytest
import regex
import sentencepiece

import corpus_pipeline
from sparkquill.llm import oracles, piece_codec, secret_scan

from .conftest import SCHEMA, prose
from .test_brute import grams
from .test_models import plain_score


@pytest.fixture(scope="module")
def rows():
    r = random.Random(31)
    out = [(i, prose(3000 + i, 60 + i), ["en", "de"][i % 2], f"src{i % 7 % 3}") for i in range(90)]
    for i in range(30):
        w = out[i][1].split(" ")
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"changed{i}"
        out.append((200 + i, " ".join(w), *out[i][2:]))
    for i in range(40):
        value, before, after, _ = secret_scan.findings(40, seed=3)[i]
        out.append((300 + i, prose(4000 + i, 330 + i) + f"\n{before}{value}{after}", "en", "src1"))
    out += [(None, prose(5000 + i, 260 + i), "en", "src2") for i in range(3)]
    out += [(7, prose(5100, 270), "en", "src0"), (7, prose(5101, 271), "de", "src1"), out[11], (400, None, "en", "src0"), (401, "", None, None), (402, "too short", "en", "src0")]
    out += [(410 + i, " ".join(x + "***$$" for x in prose(6000 + i, 120).split()), "en", "src0") for i in range(2)]
    r.shuffle(out)
    return [(d, t, la, s, None if t is None else len(t)) for d, t, la, s in out]


def in_duckdb(rows, sql):
    c = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
    frame["row"] = range(len(rows))
    c.register("documents", frame)
    return c.execute(sql).fetchall()


def quality(rows):
    return [rows[i] for i, kept in in_duckdb(rows, f'WITH {oracles.judged()} SELECT "row", kept FROM judged') if kept]


def near(rows):
    sets = [set(grams(t or "", 5)) for _, t, *_ in rows]
    label = [None] * len(rows)
    for i in range(len(rows)):
        if label[i] is None:
            label[i], todo = i, [i]
            while todo:
                a = todo.pop()
                for b in range(len(rows)):
                    if label[b] is None and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                        label[b] = i
                        todo.append(b)
    best = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        if label[i] not in best or key < best[label[i]][0]:
            best[label[i]] = (key, r)
    return [r for _, r in best.values()]


def redacted(rows, forest):
    out = []
    for d, t, la, s, _ in rows:
        text, at = "", 0
        spans = [m.span() for m in regex.finditer(secret_scan.CANDIDATE, t)]
        for k, (a, b) in enumerate(spans):
            before, after = t[at:a][-secret_scan.BEFORE :], t[b : spans[k + 1][0] if k + 1 < len(spans) else len(t)][: secret_scan.AFTER]
            text += t[at:a] + (secret_scan.MARK if round(plain_score(forest, t[a:b], before, after), 6) >= 0.5 else t[a:b])
            at = b
        out.append((d, text + t[at:], la, s, len(text + t[at:])))
    return out


def mixed(rows):
    """Each draw's text, found by its id, source and number of words."""
    text = {(d, s, len(t.split())): t for d, t, _, s, _ in rows}
    assert len(text) == len(rows)
    sql = oracles.source_mixing(0.92, 4.0, 0)
    return [(d, text[d, s, n]) for _, _, d, s, _, n in in_duckdb(rows, f"SELECT block, sort_key, doc_id, source, epoch, n_tokens FROM ({sql})")]


def test_run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = quality(rows)
    single = near(kept)
    assert len(rows) > len(kept) > len(single) > 90
    clean = redacted(single, secret_scan.train(spark))
    assert sum(secret_scan.MARK in t for _, t, *_ in clean) > 3
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    want = sorted((str(d), sp.encode(t)) for d, t in mixed(clean))
    assert sorted((str(x["doc_id"]), x["ids"]) for x in got) == want
    assert all(x["round_trip"] and x["n_tokens"] == len(x["ids"]) for x in got)
    # Null and repeated ids with texts of their own are all there.
    assert {d for d, *_ in single} >= {None, 7} and sum(d == 7 for d, *_ in single) == 3 and sum(d is None for d, *_ in single) == 3
