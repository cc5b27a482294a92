"""The segmented keyword index: results of a rebuild, bytes written, stops, writers, readers."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquill.operators import bm25, segments
from sparkquill.tables import shared_dir

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
SCHEMA = "doc_id long, text string"


def texts(ids, seed=0):
    out = []
    for i in ids:
        r = random.Random(i * 7 + seed)
        out.append((i, " ".join(r.choices(WORDS, weights=range(12, 0, -1), k=r.randint(1, 30))) + f" word{i % 50}"))
    return out


def asked(spark):
    return spark.createDataFrame([(0, "alpha kappa"), (1, "word7 beta beta"), (2, "mu lambda eta"), (3, "absent")], "qid long, query string")


def ranks(df):
    return sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def same_as_rebuilt(spark, index, live):
    want = bm25.build(spark.createDataFrame(list(live.items()), SCHEMA))
    assert ranks(index.search(asked(spark), 10)) == ranks(bm25.search(want, asked(spark), 10))
    assert index.stats().first()[:2] == want.stats.first()[:2]


def test_a_task_sorts_a_bounded_number_of_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SORTED", 400, raising=False)
    live = dict(texts(range(300)))
    index = segments.SegmentIndex(spark, str(tmp_path / "i")).add(spark.createDataFrame(list(live.items()), SCHEMA))
    each = index.postings().groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in each) == index.manifest.segments[0].postings > 2000
    assert max(r["count"] for r in each) < 800
    same_as_rebuilt(spark, index, live)


def test_a_segment_leaves_no_working_table(spark, tmp_path):
    tables = shared_dir(spark).removeprefix("file://") + "/tables"
    before = {n for n in (os.listdir(tables) if os.path.isdir(tables) else []) if n.startswith("postings-")}
    segments.SegmentIndex(spark, str(tmp_path / "i")).add(spark.createDataFrame(texts(range(20)), SCHEMA))
    assert {n for n in os.listdir(tables) if n.startswith("postings-")} == before


def test_random_changes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SMALLEST", 200)
    r = random.Random(3)
    index, live = segments.SegmentIndex(spark, str(tmp_path / "i")), {}
    for step in range(9):
        new = dict(texts(r.sample(range(120), 25), seed=step))
        index = index.add(spark.createDataFrame(list(new.items()), SCHEMA))
        live = {**new, **live}  # what is present stays
        gone = r.sample(range(120), 15)
        index = index.remove(spark.createDataFrame([(i,) for i in [*gone, gone[0], 999]], "doc_id long"))
        live = {i: t for i, t in live.items() if i not in gone}
        if step % 4 == 0:
            same_as_rebuilt(spark, index, live)
    assert len(index.manifest.segments) < 9
    same_as_rebuilt(spark, index, live)
    index.merge()
    again = segments.SegmentIndex(spark, str(tmp_path / "i"))
    assert len(again.manifest.segments) == 1 and not again.manifest.removals
    same_as_rebuilt(spark, again, live)
    wanted = dict(texts(range(60, 100), seed=50))
    index = again.reconcile(spark.createDataFrame(list(wanted.items()), SCHEMA))
    # Ids that were present keep the text they had: a chunk's content never changes.
    same_as_rebuilt(spark, index, {i: live.get(i, t) for i, t in wanted.items()})


def test_bytes_follow_the_change(spark, tmp_path):
    root = str(tmp_path / "i")
    index = segments.SegmentIndex(spark, root).add(spark.createDataFrame(texts(range(20_000)), SCHEMA).coalesce(2))
    whole = size(root)
    index = index.add(spark.createDataFrame(texts(range(20_000, 20_200)), SCHEMA).coalesce(1))
    assert size(root) - whole < 0.05 * whole
    before = size(root)
    index = index.remove(spark.range(100).select(F.col("id").alias("doc_id")))
    assert size(root) - before < 0.02 * whole
    assert index.manifest.docs == 20_100 and len(index.manifest.segments) == 2


@pytest.mark.parametrize("stop", range(4))
def test_stopped_anywhere(spark, tmp_path, monkeypatch, stop):
    """Whatever step fails, the index is as it was before or after, and doing it again gives the right one."""
    root = str(tmp_path / "i")
    index = segments.SegmentIndex(spark, root).add(spark.createDataFrame(texts(range(30)), SCHEMA))
    wanted = dict(texts(range(10, 50)))
    frame = spark.createDataFrame(list(wanted.items()), SCHEMA)
    calls = 0
    for owner, name in ((segments.SegmentIndex, "_segment"), (segments.SegmentIndex, "_commit")):
        real = getattr(owner, name)

        def failing(self, *a, real=real):
            nonlocal calls
            calls += 1
            if calls == stop + 1:
                raise OSError("stopped")
            out = real(self, *a)
            calls += 1
            if calls == stop + 1:
                raise OSError("stopped")
            return out

        monkeypatch.setattr(owner, name, failing)
    with pytest.raises(OSError):
        index.reconcile(frame)
    monkeypatch.undo()
    index = segments.SegmentIndex(spark, root).reconcile(frame)
    same_as_rebuilt(spark, index, wanted)
    index.expire(1)
    same_as_rebuilt(spark, segments.SegmentIndex(spark, root), wanted)
    assert len(os.listdir(f"{root}/postings")) == len(index.manifest.segments)


def test_two_writers_and_a_reader(spark, tmp_path):
    root = str(tmp_path / "i")
    first = segments.SegmentIndex(spark, root).add(spark.createDataFrame(texts(range(20)), SCHEMA))
    reader = segments.SegmentIndex(spark, root)
    seen = ranks(reader.search(asked(spark), 5))
    first.add(spark.createDataFrame(texts(range(20, 30)), SCHEMA))
    with pytest.raises(segments.Conflict):
        reader.add(spark.createDataFrame(texts(range(30, 40)), SCHEMA))
    segments.SegmentIndex(spark, root).merge().expire(3)
    assert ranks(reader.search(asked(spark), 5)) == seen


def test_nothing_in_it(spark, tmp_path):
    index = segments.SegmentIndex(spark, str(tmp_path / "i"))
    assert index.search(asked(spark), 5).collect() == []
    index = index.add(spark.createDataFrame([(1, None), (2, ""), (None, "alpha")], SCHEMA)).remove(spark.createDataFrame([(1,), (None,)], "doc_id long"))
    assert index.manifest.number == 0 and index.stats().first()[:2] == (0, 0)
    index = index.add(spark.createDataFrame([(1, "alpha"), (1, "alpha")], SCHEMA).withColumn("term", F.lit("clash")))
    assert index.manifest.docs == 1


ROWS = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("tags", T.ArrayType(T.FloatType()))])


def contents(table):
    return {r["k"]: r["v"] for r in table.read().collect()}


def test_keyed_table(spark, tmp_path, monkeypatch):
    """Random additions, changes and removals against a dictionary."""
    monkeypatch.setattr(segments, "SMALLEST", 30)
    r = random.Random(9)
    table, live = segments.KeyedTable(spark, str(tmp_path / "t"), ROWS, "k"), {}
    frame = lambda rows: spark.createDataFrame([(k, v, [1.0]) for k, v in rows.items()], ROWS)
    for step in range(8):
        new = {k: f"v{step}" for k in r.sample(range(80), 12) if k not in live}
        table = table.add(frame(new))
        live |= new
        change = {k: f"u{step}" for k in r.sample(range(80), 9)}
        table = table.upsert(frame(change))
        live |= change
        gone = r.sample(range(80), 10)
        table = table.remove(spark.createDataFrame([(k,) for k in gone], "k long"))
        live = {k: v for k, v in live.items() if k not in gone}
        if step % 3 == 1:
            assert contents(table) == live and table.manifest.docs == len(live)
    table.expire(1)
    again = segments.KeyedTable(spark, str(tmp_path / "t"), ROWS, "k")
    assert contents(again) == live == contents(again.merge())
    assert contents(segments.KeyedTable(spark, str(tmp_path / "none"), ROWS, "k").remove(spark.range(2).toDF("k"))) == {}


def test_keyed_table_writes_what_changes(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.range(40_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.array().cast("array<float>").alias("tags"))
    table = segments.KeyedTable(spark, root, ROWS, "k").add(rows.coalesce(2))
    whole = size(root)
    table = table.upsert(rows.filter("k % 200 = 0").withColumn("v", F.lit("new")).coalesce(1))
    assert size(root) - whole < 0.05 * whole
    before = size(root)
    reader = segments.KeyedTable(spark, root, ROWS, "k")
    table = table.remove(rows.filter("k < 100").select("k"))
    assert size(root) - before < 0.05 * whole
    assert table.read().filter("v = 'new'").count() == 199 and table.manifest.docs == 39_900
    table.merge().expire(3)
    assert reader.read().count() == 40_000
    with pytest.raises(segments.Conflict):
        reader.remove(rows.select("k"))
