import os

import pytest
from pyspark.sql import functions as F

from sparkquill import engine
from sparkquill.operators import embed, fusion, segments, store


def test_add_sources(spark):
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "seq long, content string")
    sources, got = store.add_sources(store.empty(spark, store.SOURCES), first)
    rows = {r["seq"]: (r["source_id"], r["is_duplicate"], r["message"]) for r in got.collect()}
    assert rows == {1: (1, False, "Source added"), 2: (2, False, "Source added"), 3: (1, True, "Source already exists (id=1)")}
    assert {r["status"] for r in sources.collect()} == {"pending"}
    sources, got = store.add_sources(sources, spark.createDataFrame([(1, "b"), (2, "c")], "seq long, content string"))
    assert {(r["seq"], r["source_id"], r["is_duplicate"]) for r in got.collect()} == {(1, 2, True), (2, 3, False)}
    assert sources.count() == 3


def test_numbering_is_dense(spark):
    rows = spark.range(1000).withColumn("seq", F.xxhash64("id"))
    got = store.numbered(rows, ["seq"], "n", 5).orderBy("seq").collect()
    assert [r["n"] for r in got] == list(range(5, 1005))


def test_add_documents(spark):
    rows = spark.createDataFrame([(1, "a", [1.0]), (2, "a", [2.0]), (3, "b", []), (4, "c", None)], "seq long, content string, embedding array<float>")
    docs, got = store.add_documents(store.empty(spark, store.DOCS), rows)
    assert {tuple(r) for r in got.collect()} == {(1, True, False), (2, True, True), (3, False, False), (4, False, False)}
    assert docs.count() == 1


def test_changes(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "x", [1.0]), (2, 1, 1, "y", [2.0]), (3, 2, 0, "z", [3.0])], "chunk_id long, source_id long, chunk_index int, content string, embedding array<float>")
    sources = spark.createDataFrame([(1, "new"), (2, "new")], "source_id long, status string")
    new = store.update_embeddings(chunks, spark.createDataFrame([(2, [9.0])], "chunk_id long, embedding array<double>"))
    assert {r["chunk_id"]: r["embedding"] for r in new.collect()} == {1: [1.0], 2: [9.0], 3: [3.0]}
    log = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "source_id long, status string, seq int")
    assert {tuple(r) for r in store.update_status(sources, log).collect()} == {(1, "a"), (2, "new")}
    s, c = store.delete_sources(sources, chunks, spark.createDataFrame([(1,)], "source_id long"))
    assert (s.count(), c.count()) == (1, 1)
    more = store.add_chunks(store.migrated(chunks, store.CHUNKS), spark.createDataFrame([(2, 1, "w")], "source_id long, chunk_index int, content string"))
    assert more.orderBy(F.desc("chunk_id")).first()["chunk_id"] == 4


def test_buffer(spark):
    v = lambda rows: spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    buffer, index = v([(1, [1.0, 0.0]), (2, [0.0, 1.0])]), v([(1, [0.0, -1.0]), (3, [0.9, 0.1])])
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<float>")
    got = store.incremental_search(buffer, index, q, 3).orderBy("rank").collect()
    assert [(r["doc_id"], r["origin"]) for r in got] == [(1, "buffer"), (3, "hnsw"), (2, "buffer")]
    assert {r["doc_id"]: r["embedding"] for r in store.merged(index, buffer).collect()}[1] == [1.0, 0.0]
    stats = store.buffer_stats(store.buffer_remove(buffer, v([(2, None)])), False).first()
    assert tuple(stats) == (1, 100, False, False)


def test_store_snapshots(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.init()
    assert s.get("chunks").count() == 0
    s.put("docs", spark.createDataFrame([(1, "x")], "doc_id long, content string"))
    s.init()
    assert s.get("docs").columns == store.DOCS.names
    assert s.get("docs").first()["content_hash"] is not None
    s.mark_dirty()
    assert s.dirty
    s.clean()
    assert not s.dirty
    s.clear()
    assert s.get("docs").count() == 0
    with pytest.raises(KeyError):
        s.get("absent")


def test_engine(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "e"), embed.hashing_embedder(32), engine.Config(max_chunk_chars=200, overlap_chars=10))
    rows = [(1, "Apples grow on trees in the orchard.\n\nPears grow there as well.", "fruit.txt", "m1"), (2, "# Cats\nThe lazy cat sleeps all day.\n# Dogs\nThe dog barks.", "pets.md", None), (3, "Apples grow on trees in the orchard.\n\nPears grow there as well.", "copy.txt", None)]
    got = e.add(spark.createDataFrame(rows, "seq long, content string, name string, metadata string")).orderBy("seq").collect()
    assert [(r["is_duplicate"], r["chunk_count"]) for r in got] == [(False, 2), (False, 2), (True, 2)]
    assert {r["status"] for r in e.sources.collect()} == {"completed"}
    q = spark.createDataFrame([(0, "lazy cat"), (1, "apples orchard")], "qid long, query string")
    best = {r["qid"]: r["content"] for r in e.search_hybrid(q, 2).filter("rank = 1").collect()}
    assert "lazy cat" in best[0]
    assert best[1].startswith("Apples")
    assert {r["qid"] for r in e.search(q, 1).collect()} == {0, 1}
    only = e.search_hybrid(q, 3, fusion.Filter(source_ids=[2])).collect()
    assert {r["source_id"] for r in only} == {2}
    assert {r["source_id"] for r in e.search(q, 3, [1]).collect()} == {1}
    out = {r["qid"]: r for r in e.answer_context(q, 2, adjacent=1, single_source=True).collect()}
    assert "Pears grow" in out[1]["text"]
    assert out[1]["prompt"].endswith("Question: apples orchard\n\nAnswer:")
    e.delete(spark.createDataFrame([(1,)], "source_id long"))
    assert {r["source_id"] for r in e.search_hybrid(q, 5).collect()} == {2}
    e.regenerate_embeddings()
    assert e.chunks.filter("embedding is null").count() == 0


def test_threads():
    assert engine.threads(10, "low") == 2
    assert engine.threads(10) == 5
    assert engine.threads(10, count=7) == 7
    with pytest.raises(ValueError):
        engine.threads(10, "low", 3)


def test_the_last_of_repeats_stays(spark):
    rows = [(1, [9.0], 0), (1, [2.0], 2), (1, [5.0], 1), (2, [1.0], 0)]
    buffer = spark.createDataFrame(rows, "doc_id long, embedding array<float>, seq long")
    index = spark.createDataFrame([(1, [7.0]), (3, [3.0])], "doc_id long, embedding array<float>")
    assert sorted(map(tuple, store.merged(index, buffer).collect())) == [(1, [2.0]), (2, [1.0]), (3, [3.0])]


def test_put_stopped_anywhere(spark, tmp_path, monkeypatch):
    """Stopped before any of its steps on files, a put leaves the old or the new table, and init loses neither."""

    class Stop(Exception):
        pass

    class Files(store.Files):
        left = 99

        def step(self):
            Files.left -= 1
            if Files.left < 0:
                raise Stop

        def put_once(self, *a):
            self.step()
            return super().put_once(*a)

        def delete(self, *a):
            self.step()
            super().delete(*a)

    monkeypatch.setattr(store, "Files", Files)
    s = store.Store(spark, str(tmp_path / "s"))
    s.init()
    old, seen = 0, set()
    for n in range(1, 9):
        for stop in range(3):
            Files.left = stop
            try:
                s.put("docs", store.migrated(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("content")), store.DOCS))
                new = {n}
            except Stop:
                new = {old, n}
            Files.left = 99
            again = store.Store(spark, s.root)
            again.init()
            assert again.get("docs").count() in new
            old = again.get("docs").count()
            seen.add((stop, old == n))
    assert (0, False) in seen and (1, True) in seen


def test_numbering_holds_when_partitions_are_merged(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("seq"))
    got = store.numbered(rows, ["seq"], "n", 1)
    assert got.join(got.select(F.col("n").alias("m")), F.col("n") == F.col("m")).select("n").distinct().count() == 5000


def test_add_is_made_good_after_a_stop(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "Apples grow on trees.\n\nPears do too."), (2, "Cats sleep all day.")], "seq long, content string").withColumn("name", F.lit("a.txt")).withColumn("metadata", F.lit(None).cast("string"))
    for stop in range(5):
        e = engine.Engine(spark, str(tmp_path / f"e{stop}"), embed.hashing_embedder(8))
        real, left = store.Store.put, [stop]

        def put(self, *a, real=real, left=left):
            if left[0] == 0:
                raise RuntimeError("stopped")
            left[0] -= 1
            real(self, *a)

        def commit(self, *a, real=segments.Parts._commit, left=left):
            if left[0] == 0:
                raise RuntimeError("stopped")
            left[0] -= 1
            return real(self, *a)

        with monkeypatch.context() as m:
            m.setattr(store.Store, "put", put)
            m.setattr(segments.Parts, "_commit", commit)
            try:
                e.add(rows)
            except RuntimeError:
                pass
        got = engine.Engine(spark, str(tmp_path / f"e{stop}"), embed.hashing_embedder(8))
        got.add(rows)
        assert got.sources.count() == 2
        assert got.chunks.groupBy("source_id", "chunk_index").count().filter("count > 1").count() == 0
        assert {r["status"] for r in got.sources.collect()} == {"completed"}
        assert got.chunks.select("chunk_id").distinct().count() == got.chunks.count() > 1


def test_engine_searches_its_vector_index(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "v"), embed.hashing_embedder(16), engine.Config(approximate_from=5))
    rows = [(i, f"text number {i} of {i * i} about {'cats dogs birds fish'.split()[i % 4]}", "a.txt", None) for i in range(30)]
    e.add(spark.createDataFrame(rows, "seq long, content string, name string, metadata string"))
    q = spark.createDataFrame([(0, "cats 16"), (1, "birds")], "qid long, query string")
    near = {(r["qid"], r["chunk_id"]) for r in e.search(q, 3).collect()}
    exact = {(r["qid"], r["chunk_id"]) for r in e.search(q, 3, exact=True).collect()}
    assert e.vector_index() is not None
    assert len(near & exact) >= 0.5 * len(exact) == 3


def test_engine_indexes_what_has_changed(spark, tmp_path):
    """One text more is a segment and a recent vector, one less is on two lists; the graph stays until a tenth has changed."""
    e = engine.Engine(spark, str(tmp_path / "c"), embed.hashing_embedder(16), engine.Config(approximate_from=5))
    rows = lambda ids: spark.createDataFrame([(i, f"text number {i} of {i * i} about {'cats dogs birds fish'.split()[i % 4]}", "a.txt", None) for i in ids], "seq long, content string, name string, metadata string")
    ask = lambda text: e.search_hybrid(spark.createDataFrame([(0, text)], "qid long, query string"), 3).collect()
    e.add(rows(range(40)))
    assert any("number 7 " in r["content"] for r in ask("number 7 of 49"))
    graph, segments = e.store.version("vectors"), {s.name for s in e.index().manifest.segments}
    e.add(rows([77]))
    hit = next(r for r in ask("number 77 of 5929") if "number 77 " in r["content"])
    assert hit["vector_rank"] > 0 and hit["bm25_rank"] > 0
    now = e.index().manifest
    assert e.store.version("vectors") == graph and {s.name for s in now.segments} > segments and len(now.segments) == 2
    assert e.store.get("recent").count() == 1
    e.delete(e.chunks.filter("content LIKE '%number 7 of%'").select("source_id"))
    assert not any("number 7 " in r["content"] for r in ask("number 7 of 49"))
    assert e.store.version("vectors") == graph and e.index().manifest.docs == 40 and e.store.get("gone").count() == 1
    e.add(rows(range(100, 110)))
    assert any("number 105 " in r["content"] for r in ask("number 105 of 11025"))
    assert e.store.version("vectors") != graph and e.store.get("recent").count() == 0
    e.regenerate_embeddings()
    assert e.vector_index() is not None and any("number 105 " in r["content"] for r in ask("number 105 of 11025"))


def test_old_snapshots_expire(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.put("t", spark.range(1))
    reader = s.get("t")
    for n in range(2, 4):
        s.put("t", spark.range(n))
    assert reader.count() == 1
    for n in range(4, 12):
        s.put("t", spark.range(n))
    assert s.get("t").count() == 11
    assert len(os.listdir(tmp_path / "s/tables/t")) == len([f for f in os.listdir(tmp_path / "s/current/t") if f.isdigit()]) == store.KEPT + 1
