import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkquill.operators import blockmax, bm25, embed, evaluate, fusion, store, vector
from sparkquill.plans import queries as plans

CATS = [(1, "The quick brown fox jumps over the lazy dog"), (2, "The lazy cat sleeps all day"), (3, "Quick brown cats are rare")]


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, query string")


def test_bm25_order(spark):
    docs = spark.createDataFrame(CATS, "doc_id long, text string")
    index = bm25.build(docs)
    assert index.n_docs == 3
    best = bm25.search(index, queries(spark, "lazy cat"), 5).filter("rank = 1").first()
    assert best["doc_id"] == 2
    korean = spark.createDataFrame([(1, "삼성전자 주가가 상승했습니다"), (2, "애플 아이폰 신제품 출시"), (3, "현대자동차 전기차 판매 증가")], "doc_id long, text string")
    assert bm25.scan(korean, queries(spark, "삼성전자 주가"), 3).filter("rank = 1").first()["doc_id"] == 1
    assert bm25.search(index, queries(spark, "absent"), 5).count() == 0
    assert bm25.search(index, queries(spark, ""), 5).count() == 0


def test_bm25_changes(spark, tmp_path):
    docs = spark.createDataFrame([*CATS, (4, "..."), (5, None)], "doc_id long, text string")
    index = bm25.build(docs.filter("doc_id <> 2"))
    assert index.n_docs == 2
    again = bm25.add(index, docs.withColumn("text", F.when(F.col("doc_id") == 1, "other words").otherwise(F.col("text"))))
    assert again.n_docs == 3
    assert again.postings.filter("doc_id = 1 AND term = 'fox'").count() == 1
    less = bm25.remove(again, spark.createDataFrame([(1,)], "doc_id long"))
    assert less.n_docs == 2
    assert less.postings.filter("term = 'fox'").count() == 0
    less.save(str(tmp_path / "index"))
    assert bm25.Index.load(spark, str(tmp_path / "index")).n_docs == 2


def test_repeated_query_terms_count(spark):
    docs = spark.createDataFrame(CATS, "doc_id long, text string")
    one, two = (bm25.scan(docs, queries(spark, q), 3).filter("doc_id = 2").first()["score"] for q in ("lazy", "lazy lazy"))
    assert two == pytest.approx(2 * one)


def test_equal_documents_score_the_same_in_any_order(spark):
    """Documents of the same postings, met in other orders: not a bit apart, by keywords and by blocks."""
    posts = [(f"t{i}", tf, tf == 1) for i, tf in enumerate([1 + i * i % 17 for i in range(60)])]
    orders = [np.random.default_rng(d).permutation(60) for d in range(12)]
    rows = [(posts[i][0], d, posts[i][1], 400 + d % 3, bool(i == 0)) for d, order in enumerate(orders) for i in order]
    index = bm25.Index(spark.createDataFrame(rows, "term string, doc_id long, tf long, dl long, lead boolean").coalesce(1), spark.createDataFrame([(12, 4812, 401.0)], "n long, total long, avgdl double"))
    q = queries(spark, " ".join(f"t{i} " * (1 + i % 4) for i in range(60)))
    found = bm25.search(index, q, 12).collect()
    assert len({r["score"] for r in found}) == 3
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["rank"])] == [0, 3, 6, 9, 1, 4, 7, 10, 2, 5, 8, 11]
    part = lambda t, tf, dl: (1 + t % 4) * np.log(0.5 / 12.5 + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 401.0))
    assert found[0]["score"] == pytest.approx(sum(part(t, posts[t][1], 400 + found[0]["doc_id"] % 3) for t in range(60)), rel=1e-14)
    assert sorted(map(tuple, blockmax.BlockIndex.build(index).search(q, 12).collect())) == sorted(map(tuple, found))


@pytest.mark.parametrize("most", [200_000, 0])
def test_a_task_sums_a_bounded_number_of_scores(spark, monkeypatch, most):
    """Pairs of a query and a document are dealt over tasks by their number, for batches of either size, with equal results."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("all of them lazy w"), F.col("id") % 7).alias("text"))
    q = queries(spark, *[f"all lazy w{i}" for i in range(8)])
    index = bm25.build(docs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(index.search(q, 20))
    monkeypatch.setattr(bm25, "PAIRS", 2000, raising=False)
    monkeypatch.setattr(bm25, "MOST_BROADCAST", most)
    each = bm25.scored(index.postings, index.stats, bm25.query_terms(q)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in each) == 24_000 and max(r["count"] for r in each) < 4000
    assert rows(index.search(q, 20)) == want and len(want) == 160


def test_many_terms_use_an_index(spark):
    docs = spark.createDataFrame(CATS, "doc_id long, text string")
    long = "lazy cat " + " ".join(f"w{i}" for i in range(100))
    a = {(r["doc_id"], round(r["score"], 9)) for r in bm25.scan(docs, queries(spark, long), 5).collect()}
    b = {(r["doc_id"], round(r["score"], 9)) for r in bm25.scan(docs, queries(spark, "lazy cat"), 5).collect()}
    assert a == b


def test_vector_topk(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(100, 384)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(500, [1.0]), (501, None), (502, [0.0] * 384)], "id long, embedding array<float>")
    q = spark.createDataFrame([(9, m[0].tolist()), (10, [1.0]), (11, None)], "qid long, embedding array<float>")
    got = vector.topk(rows, q, 5)
    assert [r["doc_id"] for r in got.filter("qid = 9").orderBy("rank").collect()][0] == 0
    assert got.filter("qid = 9").count() == 5
    assert [r["doc_id"] for r in got.filter("qid = 10").collect()] == [500]
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(unit @ unit[0]), kind="stable")[:5].tolist()
    assert [r["doc_id"] for r in got.filter("qid = 9").orderBy("rank").collect()] == want
    assert [r["doc_id"] for r in vector.linear_scan(rows.filter("embedding is not null"), m[0].tolist(), 5).collect()] == want


def test_cell_index_recall(spark, tmp_path):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 16))
    m = (centre[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>")
    q = rows.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    index = vector.CellIndex.build(rows)
    index.save(str(tmp_path / "cells"))
    loaded = vector.CellIndex.load(spark, str(tmp_path / "cells"))
    assert loaded.table.count() == 3000
    exact = {(r["qid"], r["doc_id"]) for r in vector.topk(rows, q, 10).collect()}
    found = {(r["qid"], r["doc_id"]) for r in loaded.search(q, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    assert vector.CellIndex.load(spark, str(tmp_path / "none")) is None
    assert vector.CellIndex.build(rows.limit(0)) is None


FRUIT = [(1, 1, 0, "Apple iPhone is great", [1.0, 0.0]), (2, 1, 1, "Banana is a yellow fruit", [0.0, 1.0]), (3, 2, 0, "Apple pie recipe", [0.9, 0.1])]
CHUNKS = "chunk_id long, source_id long, chunk_index int, content string, embedding array<float>"


def test_hybrid(spark):
    chunks = spark.createDataFrame(FRUIT, CHUNKS)
    q = spark.createDataFrame([(0, "Apple", [1.0, 0.0])], "qid long, query string, embedding array<float>")
    got = fusion.hybrid(chunks, q, 2).orderBy("rank").collect()
    assert {r["doc_id"] for r in got} == {1, 3}
    assert spark.range(1).select(fusion.rrf_score(F.lit(1), 60)).first()[0] == pytest.approx(0.0164, abs=1e-3)
    assert fusion.Fusion.weighted(-1, 7) == fusion.Fusion(60, 0.0, 1.0)
    assert [fusion.service_candidates(k) for k in (1, 10, 100)] == [50, 100, 200]


def test_hybrid_source_filter(spark):
    rows = [(101, 1, 0, "apple c", [1.0, 0.0]), (102, 1, 1, "banana", [0.0, 1.0]), (201, 2, 0, "apple c", [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, CHUNKS)
    sources = spark.createDataFrame([(1, "Alpha_1"), (2, "beta")], "source_id long, metadata string")
    q = spark.createDataFrame([(0, "c", [0.0, 1.0])], "qid long, query string, embedding array<float>")
    got = fusion.hybrid(chunks, q, 5, chosen=fusion.Filter(source_ids=[1])).collect()
    assert {r["doc_id"] for r in got} == {101, 102}
    assert any(r["bm25_rank"] > 0 for r in got)
    like = lambda p, ids=None: {r["doc_id"] for r in fusion.hybrid(chunks, q, 5, chosen=fusion.Filter(ids, p), sources=sources).collect()}
    assert like("ALPHA%") == {101, 102}
    assert like("beta") == {201}
    assert like("alpha_1", [2]) == set()
    assert like("a.*") == set()
    got = fusion.hybrid(chunks, q, 5, chosen=fusion.Filter(metadata_like="beta"), sources=sources).first()
    assert got["vector_rank"] == 1


def test_docs_shadow_chunks(spark):
    chunks = spark.createDataFrame(FRUIT, CHUNKS)
    sources = spark.createDataFrame([(1, "m")], "source_id long, metadata string")
    docs = spark.createDataFrame([(1, "flat")], "doc_id long, content string")
    wanted = spark.createDataFrame([(0, 1), (0, 2), (0, 99)], "qid long, doc_id long")
    got = {r["doc_id"]: (r["content"], r["source_id"], r["metadata"]) for r in fusion.with_content(wanted, chunks, sources, docs).collect()}
    assert got == {1: ("flat", 1, None), 2: ("Banana is a yellow fruit", 1, "m")}


def test_metadata_survives(spark):
    meta = '{"author": "Test Author", "year": 2025}'
    sources = spark.createDataFrame([(1, meta)], "source_id long, metadata string")
    chunks = spark.createDataFrame(FRUIT[:1], CHUNKS).withColumn("chunk_type", F.lit(None).cast("string"))
    got = store.with_source(chunks, sources).first()
    assert (got["metadata"], got["chunk_type"]) == (meta, "general")


def test_embedders(spark):
    e = embed.hashing_embedder(8)
    rows = spark.createDataFrame([("same words here",), ("same words here",), ("other",), (None,)], "t string").select(e(F.col("t")).alias("v")).collect()
    assert rows[0] == rows[1] != rows[2]
    assert rows[3]["v"] == [0.0] * 8
    out = np.arange(12.0).reshape(1, 3, 4)
    assert embed.pooled(out).tolist() == out[0].mean(axis=0).tolist()
    assert embed.pooled(out[0]).tolist() == out[0][0].tolist()


def test_rank_metrics(spark):
    ranks = spark.createDataFrame([(1, "positive", "en", 1), (2, "positive", "ko", 4), (3, "hard_negative", "en", 0), (4, "other", "en", 7)], "qid long, query_type string, language string, rank int")
    got = {r["scope"]: r for r in evaluate.rank_metrics(ranks).collect()}
    assert set(got) == {"overall", "positive", "hard_negative", "en", "ko"}
    assert got["overall"]["recall"] == pytest.approx(0.5)
    assert got["overall"]["mrr"] == pytest.approx((1 + 1 / 4 + 1 / 7) / 4)
    assert got["positive"]["n"] == 3
    assert got["ko"]["ndcg"] == pytest.approx(1 / np.log2(5))


def test_recall_precision(spark):
    results = spark.createDataFrame([(1, 1, "An APPLE a day"), (1, 2, "pear"), (1, 3, "apple pie"), (1, 4, "apple")], "qid long, rank int, content string")
    cases = spark.createDataFrame([(1, ["apple", "fig"]), (2, ["x"])], "qid long, relevant array<string>")
    got = {r["qid"]: tuple(r)[1:] for r in evaluate.recall_precision(results, cases, 3).collect()}
    assert got[1] == (1.0, pytest.approx(2 / 3), True)
    assert got[2] == (0.0, 0.0, False)


def test_latency():
    calls = []
    got = evaluate.latency(lambda: calls.append(1), 3)
    assert len(calls) == 4
    assert got["min_ms"] <= got["avg_ms"] <= got["max_ms"]


def test_content_of_all_ids(spark, tmp_path):
    from sparkquill.plans import queries

    ids = [0, 1999, 2000, 123_456]
    rows = [(i, f"text {i}", "en" if i % 2 else "de", "src1", 6) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [0.5])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(r["doc_id"] for r in queries.content_fetch(spark, str(tmp_path)).collect()) == ids


def test_topk_in_blocks(spark, monkeypatch):
    """More queries than a block holds, and more vectors than are multiplied at once: the same ranks, ties by id."""
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = spark.createDataFrame([*rows[:50], (999, None), (998, [])], "qid long, embedding array<float>")
    want = sorted(map(tuple, vector.topk(v, q, 4).collect()))
    monkeypatch.setattr(vector, "BLOCK", 8)
    monkeypatch.setattr(vector, "AT_ONCE", 16)
    got = sorted(map(tuple, vector.topk(v, q, 4).collect()))
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert len(got) == 200


def test_probes_are_measured(spark):
    """In clusters a few cells suffice; without, as many as the recall asks for. Both find 0.9 or more."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16))
    for spread, most in ((0.05, 0.2), (100.0, 1.0)):
        x = centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 16)) * spread
        v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, embedding array<float>")
        q = v.filter("id % 20 = 0").withColumnRenamed("id", "qid")
        index = vector.CellIndex.build(v)
        exact = vector.topk(v, q, 10).select("qid", "doc_id")
        assert exact.join(index.search(q, 10), ["qid", "doc_id"]).count() >= 0.9 * exact.count()
        assert index.probes <= most * len(index.centres)


@pytest.mark.parametrize("k", [1, 4, 300])
def test_kernel_keeps_little_and_ranks_by_double(k):
    """Similarities that single precision can't tell apart, copies among them: ranks of double precision, ties by ids, and no
    more than some queries' similarities at once."""
    rng = np.random.default_rng(3)
    base = vector._unit(rng.normal(size=(1, 8)))
    m = vector._unit(np.vstack([base + 1e-9 * rng.normal(size=(150, 8)), rng.normal(size=(40, 8)), np.repeat(base, 30, axis=0)]))
    unit, own = vector._unit(rng.normal(size=(70, 8))), rng.permutation(len(m))
    best = vector._Best(np.arange(70), unit, k)
    for a in range(0, len(m), 16):
        best.meet(own[a : a + 16], m[a : a + 16])
    (got,) = best.hits()
    sims = np.round(unit @ m.T, 12)
    want = [[int(own[j]) for j in sorted(range(len(m)), key=lambda j, r=r: (-r[j], own[j]))[:k]] for r in sims]
    assert got.column("doc_id").to_pylist() == sum(want, [])


def test_kernel_memory_is_bounded_by_tiles():
    """4,096 queries and 4,096 vectors: their similarities together would be 128 MB."""
    rng = np.random.default_rng(3)
    m = vector._unit(rng.normal(size=(4096, 16)))
    tracemalloc.start()
    best = vector._Best(np.arange(4096), m, 20)
    best.meet(np.arange(4096), m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_cells_meet_only_the_queries_that_ask_them(spark, monkeypatch):
    """Hits through cells, in blocks of queries: with every cell probed those of a scan, with few only of the probed cells."""
    monkeypatch.setattr(vector, "BLOCK", 16)
    rng = np.random.default_rng(4)
    m = rng.normal(size=(1500, 8)).astype(np.float32)
    m[700:720] = m[5]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>")
    q = v.filter("id % 7 = 0").select(F.col("id").alias("qid"), "embedding")
    index = vector.CellIndex.build(v)
    index.probes = len(index.centres)
    rows = lambda df: sorted((r["qid"], r["rank"], r["doc_id"]) for r in df.collect())
    assert rows(index.search(q, 10)) == rows(vector.topk(v, q, 10))
    index.probes = 2
    cell = {r["id"]: r["cell"] for r in index.table.collect()}
    unit = vector._unit(m.astype(np.float64))
    for r in index.search(q, 10).collect():
        assert cell[r["doc_id"]] in np.argsort(-(index.centres @ unit[r["qid"]]))[:2]


TOKENIZER, SMALL = "/opt/tokenizers/byte_bpe_50k.json", "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isfile(TOKENIZER), reason="no tokenizer")
def test_subword_ids_come_in_parts():
    """However many rows a batch has, a worker holds the ids of some, as arrays."""
    texts = pd.Series([f"text {i}" if i % 7 else None for i in range(1000)])
    parts = list(embed.tokenize_column(TOKENIZER).func(iter([texts])))
    assert max(map(len, parts)) <= 256 and all(x is None or x.dtype == np.int32 for x in parts[0])
    back = pd.concat(list(embed.decode_column(TOKENIZER).func(iter([pd.concat(parts)]))))
    assert back.tolist() == texts.tolist()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_texts_of_hits_stay_where_they_are(spark):
    """Hits are sent to the documents; no text is dealt by its id."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans._ranks(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [doc_id" in plan and "hashpartitioning(doc_id" not in plan
