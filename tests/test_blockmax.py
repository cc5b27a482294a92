"""Blocks with bounds: the ranks of scoring everything, and what is skipped."""

import random
import time

import pytest

from sparkquill import tables
from sparkquill.operators import bm25, blockmax

SCHEMA = "doc_id long, text string"


def corpus(n, seed=1):
    """Words by Zipf's law; rare ones in long runs of neighbouring ids, as topics are."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        text = r.choices(words, weights=[1 / (j + 1) for j in range(200)], k=r.randint(3, 40))
        text += [f"topic{i // 300}"] * r.randint(0, 3)
        out.append((i if i % 7 else -i, " ".join(text)))
    return out


@pytest.mark.parametrize("k", [1, 5, 40])
def test_same_ranks(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(blockmax, "SPAN", 32)
    docs = spark.createDataFrame([*corpus(3000), (9000, "w1 w1"), (9001, "w1 w1"), (9002, None)], SCHEMA)
    index = bm25.build(docs)
    blocks = blockmax.BlockIndex.build(index)
    blocks.save(str(tmp_path / "b"))
    blocks = blockmax.BlockIndex.load(spark, str(tmp_path / "b"))
    queries = spark.createDataFrame([(0, "w0 w1"), (1, "topic3 w0 w2"), (2, "w150 w0 w0 topic9"), (3, "nothing of it"), (4, ""), (5, "w1 w1 w1"), (6, "w199")], "qid long, query string")
    rows = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(blocks.search(queries, k)) == rows(bm25.search(index, queries, k))
    skipped = {r["qid"]: (r["scored"], r["postings"]) for r in blocks.skipped(queries, k).collect()}
    assert all(a <= b for a, b in skipped.values()) and not {3, 4} & set(skipped)
    if k <= 5:
        # A rare word that stands in few blocks spares most postings of the common ones.
        assert skipped[1][0] < 0.5 * skipped[1][1]


def test_empty(spark):
    blocks = blockmax.BlockIndex.build(bm25.build(spark.createDataFrame([], SCHEMA)))
    assert blocks.search(spark.createDataFrame([(0, "a")], "qid long, query string"), 3).collect() == []


def test_from_texts(spark, monkeypatch):
    """Straight from texts: the blocks and statistics of an index, without a table of postings; ranks in one task or many."""
    monkeypatch.setattr(blockmax, "SPAN", 32)
    docs = spark.createDataFrame([*corpus(1500), (9000, ""), (9001, None), (9002, "w1 w1")], SCHEMA)
    made = []
    for module in (bm25, blockmax):
        monkeypatch.setattr(module, "written", lambda df, label, f=module.written: made.append(label) or f(df, label))
    direct = blockmax.BlockIndex.of(docs)
    assert "postings" not in made
    index = bm25.build(docs)
    assert direct.stats.collect() == index.stats.collect()
    assert direct.blocks.columns == ["term", "block", "n", "max_tf", "min_dl", "docs"]
    queries = spark.createDataFrame([(i, f"w{i} w{3 * i} topic{i % 5}") for i in range(20)], "qid long, query string")
    rows = lambda df: sorted(tuple(r) for r in df.select("qid", "rank", "doc_id", "score").collect())
    want = rows(bm25.search(index, queries, 5))
    for pairs, most in ((1_000_000, 200_000), (64, 200_000), (64, 0)):
        monkeypatch.setattr(blockmax, "PAIRS", pairs)
        monkeypatch.setattr(blockmax, "MOST_BROADCAST", most)
        assert rows(direct.search(queries, 5)) == want


def test_written_leaves_no_shuffle(spark, tmp_path):
    """A working table's shuffle files are gone once it is written, and the session's setting is as it was."""
    before, found = spark.conf.get(tables.DROP, None), []
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(b) for b in local.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in b}
    old = shuffles()
    out = tables.written(spark.range(50_000).repartition(7, "id"), "dealt")
    for _ in range(100):
        found = shuffles() - old
        if not found:
            break
        time.sleep(0.1)
    assert not found and out.count() == 50_000 and spark.conf.get(tables.DROP, None) == before
