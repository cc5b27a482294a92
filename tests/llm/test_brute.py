"""Operators against plain versions of their definitions, on small whole tables."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkquill import skew
from sparkquill.llm import components, license_scan, merkle, mixing, oracles, piece_codec, quality, simhash_dedup, substring_dedup, token_rollup

from .conftest import SCHEMA, prose, rows_of_edges

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def duck(spark, df, sql, **tables):
    c = duckdb.connect()
    for name, frame in {"documents": df, **tables}.items():
        c.register(name, frame.toPandas() if frame.count() else frame.toPandas())
    r = c.execute(sql)
    return [x[0] for x in r.description], r.fetchall()


def same_as_duck(spark, got, df, sql, **tables):
    names, rows = duck(spark, df, sql, **tables)
    cols = sorted(got.columns)
    assert sorted(names) == cols
    mine = sorted(map(repr, got.select(*cols).collect()))
    from pyspark.sql import Row

    theirs = sorted(repr(Row(**{c: row[names.index(c)] for c in cols})) for row in rows)
    assert mine == theirs


@pytest.fixture(scope="module")
def mixed_docs(spark):
    rows = [r for r in rows_of_edges() if r[0] is not None and r[0] not in (3, 36)]
    rows += [(100 + i, prose(1000 + i, 200), "en", f"src{i % 2}", 0) for i in range(40)]
    rows += [(200 + i, " ".join(w + "***$$" for w in prose(2000 + i, 120).split()), "en", "src0", 0) for i in range(3)]
    return spark.createDataFrame(rows, SCHEMA)


def test_quality(spark, mixed_docs):
    got = quality.judge(mixed_docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same_as_duck(spark, got, mixed_docs, oracles.quality_rules())
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert not any(kept[200 + i] for i in range(3))
    assert all(kept[100 + i] for i in range(40))


def test_minimum_determinant(spark):
    """The half found against all halves of small groups. Bins may take a row more than the half, so dets are near."""
    import itertools

    dims, prior = {"a": 0.01, "b": 0.01}, {"a": 0.05, "b": 0.05}
    r = np.random.default_rng(3)
    rows, least, n = [], {}, 12

    def logdet(z):
        c = quality.CONSISTENCY * np.cov(z.T, bias=True)
        c += np.diag(np.maximum(1e-4 - np.diag(c), 0) + quality.RIDGE * 1e-4 + 0.05**2 * quality.PRIOR_ROWS / len(z))
        return np.linalg.slogdet(c)[1]

    for g in range(12):
        z = r.normal(size=(n, 2)) @ r.normal(size=(2, 2))
        z[:4] += r.normal(size=2) * 8
        rows += [(g, float(a), float(b)) for a, b in z]
        least[g] = min(logdet(z[list(c)]) for c in itertools.combinations(range(n), n // 2))
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = {x["g"]: x["logdet"] for x in quality.concentrated(df, ["g"], dims=dims, prior=prior).collect()}
    one = quality.step(df, quality.start(df, ["g"], dims, prior).filter("start = 0"), ["g"], dims, prior)
    once = {x["g"]: x["logdet"] for x in one.collect()}
    assert set(got) == set(least)
    assert all(got[g] >= least[g] - 1e-9 and got[g] <= once[g] + 1e-9 for g in got)
    # Concentration finds local minima: most are the least half or close to it, none is far.
    gaps = sorted(got[g] - least[g] for g in got)
    assert gaps[2] < 1e-9 and gaps[5] < 0.35 and gaps[-1] < 2, gaps


def test_repeat_words(spark):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        return len({j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)})

    r = random.Random(3)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.base_stats(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_mixing(spark, mixed_docs):
    same_as_duck(spark, mixing.draws(mixed_docs, 0.92, 4.0, seed=0), mixed_docs, oracles.source_mixing(0.92, 4.0, 0))


def test_mixing_meets_targets(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    got = {r["source"]: r for r in mixing.weights(totals, 0.5, 1e9).collect()}
    w = np.array([got[s]["weight"] for s in "abc"])
    assert w.sum() == pytest.approx(1)
    assert -(w * np.log(w)).sum() == pytest.approx(0.5 * np.log(3), abs=1e-6)
    limited = {r["source"]: r for r in mixing.weights(totals, 1.0, 4.0).collect()}
    reps = [limited[s]["target"] / limited[s]["tokens"] for s in "abc"]
    assert max(reps) == pytest.approx(4.0, rel=0.2) and max(reps) <= 4.0 + 1e-6
    assert reps[0] == pytest.approx(1.0)
    fixed = mixing.weights(totals, 1.0, 100.0, budget=300).agg(F.sum("target")).first()[0]
    assert 298 <= fixed <= 300


def test_mixing_blocks(spark):
    docs = spark.createDataFrame([(i, prose(i, 50 + i % 30), "en", "abc"[i % 7 % 3], 0) for i in range(300)], SCHEMA)
    got = mixing.draws(docs, block_tokens=2000)
    by = got.groupBy("block", "source").agg(F.sum("n_tokens").alias("n")).toPandas().pivot(index="block", columns="source", values="n")
    share = by.div(by.sum(axis=1), axis=0).iloc[1:-1]
    assert (share.std() < 0.05).all()
    epochs = got.groupBy("doc_id").agg(F.countDistinct("epoch").alias("e"), F.count("*").alias("n")).filter("e <> n").count()
    assert epochs == 0


def test_mixed_rows(spark):
    """Each draw is its own row's: null and repeated ids, ids shared by sources, rows repeated as a whole."""
    rows = [(i, prose(i, 40 + i % 30), "en", "abc"[i % 7 % 3], i) for i in range(120)]
    rows += [(None, prose(700 + i, 50), "en", "ab"[i % 2], 0) for i in range(6)] + [(5, prose(800, 60), "en", "c", 0), (5, rows[5][1], "en", "b", 0)]
    rows += [rows[7], rows[7], rows[121], (None, prose(900, 45), None, None, 1), (9, rows[9][1], "en", rows[9][3], 77), (400, "", "en", "a", 0), (401, None, "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed(df, block_tokens=500)
    got, drawn = [tuple(x) for x in out.collect()], mixing.draws(df, block_tokens=500).collect()
    words = lambda t: len((t or "").split())
    count = lambda it: sorted(((k, list(it).count(k)) for k in set(it)), key=str)
    assert count([(g[0], g[3], words(g[1])) for g in got]) == count([(d["doc_id"], d["source"], d["n_tokens"]) for d in drawn])
    assert {g for g in got} == {r for r in rows if words(r[1])}
    # Every source is drawn whole once at least, and rows that are alike differ by one draw at most.
    times = {r: got.count(r) for r in set(rows)}
    assert abs(times[rows[9]] - times[(9, rows[9][1], "en", rows[9][3], 77)]) <= 1
    # A block's rows stand together and in order.
    place = {}
    for d in drawn:
        place.setdefault((d["doc_id"], d["source"], d["n_tokens"]), []).append((d["block"], d["sort_key"]))
    for part in out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.collect_list(F.struct("doc_id", "source", "text")).alias("r")).collect():
        now, left = (-1, ""), {k: sorted(v) for k, v in place.items()}
        for r in part["r"]:
            at = next(x for x in left[r["doc_id"], r["source"], words(r["text"])] if x >= now)
            left[r["doc_id"], r["source"], words(r["text"])].remove(at)
            now = at


def test_rollup(spark, mixed_docs):
    labels = spark.createDataFrame([(1, 0, 1), (100, 1, 1), (101, 1, 0)], "doc_id long, quality int, toxic int")
    got = token_rollup.maintained(mixed_docs, labels.filter("toxic = 1"))
    same_as_duck(spark, got, mixed_docs, oracles.token_rollup(), labels=labels)


def test_rollup_batches(spark, tmp_path):
    counts = spark.createDataFrame([("s", "en", 5, 3), ("s", None, 2, 2)], "source string, lang string, n long, m long")
    store = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    assert store.commit("one", token_rollup.inserts(counts, "v1", "n"))
    assert not store.commit("one", token_rollup.inserts(counts, "v1", "n"))
    assert store.commit("two", token_rollup.revisions(counts, "v1", "n", "m"))
    assert store.commit("none", token_rollup.inserts(counts.limit(0), "v1", "n"))
    total = lambda: sorted(map(tuple, store.totals().collect()), key=str)
    want = sorted([("s", "en", "v1", 1, 3), ("s", None, "v1", 1, 2)], key=str)
    assert total() == want
    assert store.compact() and not store.compact()
    assert total() == want
    assert not store.commit("two", token_rollup.inserts(counts, "v1", "n"))
    assert store.commit("gone", token_rollup.deletes(counts, "v1", "m"))
    assert total() == []
    # An attempt without a marker, as a lost driver leaves it, doesn't count.
    token_rollup.summed(token_rollup.inserts(counts, "v9", "n")).write.parquet(f"{store.root}/sums/attempt=left-over")
    assert total() == []
    assert store.compact() and store.commit("more", token_rollup.inserts(counts, "v2", "n")) and store.compact()
    assert total() == sorted([("s", "en", "v2", 1, 5), ("s", None, "v2", 1, 2)], key=str)
    assert not any(store.commit(b, token_rollup.inserts(counts, "v1", "n")) for b in ("one", "two", "none", "gone", "more"))
    # Files of batches folded twice over are gone.
    assert len([d for d in os.listdir(f"{store.root}/sums") if d.startswith("attempt=")]) < 5


def test_rollup_stopped_anywhere(spark, tmp_path, monkeypatch):
    """`compact` and `commit` stopped before each of their steps on files: totals are those of before or after, never else."""
    counts = spark.createDataFrame([("s", "en", 5)], "source string, lang string, n long")
    store = token_rollup.Rollup(spark, str(tmp_path / "r"))
    total = lambda: sorted(map(tuple, token_rollup.Rollup(spark, store.root).totals().collect()), key=str)

    class Stop(Exception):
        pass

    def stopped(run, names, at):
        """Runs with the `at`-th call of the named methods replaced by a stop; whether it was reached."""
        left = [at]
        with monkeypatch.context() as m:
            for name in names:
                owner = token_rollup.Rollup if name.startswith("_") else token_rollup.Files
                real = getattr(owner, name)

                def call(self, *a, real=real):
                    left[0] -= 1
                    if left[0] < 0:
                        raise Stop
                    return real(self, *a)

                m.setattr(owner, name, call)
            try:
                run()
            except Stop:
                return True
        return False

    n = 0
    stops = []
    for at in [0, 1, 2, 3, 99, 0, 1, 2, 3, 4, 5, 6, 99, 99]:
        store.commit(f"b{n}", token_rollup.inserts(counts, "v", "n"))
        store.commit(f"c{n}", token_rollup.inserts(counts, "v", "n"))
        n += 1
        want = [("s", "en", "v", 2 * n, 10 * n)]
        assert total() == want
        reached = stopped(store.compact, ["put_once", "delete", "_sums", "_marked"], at)
        assert total() == want
        assert not store.commit(f"b{n - 1}", token_rollup.inserts(counts, "v", "n"))
        stops.append(reached)
    # The first fold has nothing to delete; later ones do.
    assert stops == [True] * 4 + [False] + [True] * 7 + [False] * 2, stops
    assert stopped(lambda: store.commit("late", token_rollup.inserts(counts, "v", "n")), ["put_once"], 0)
    assert total() == want
    assert store.commit("late", token_rollup.inserts(counts, "v", "n"))
    assert total() == [("s", "en", "v", 2 * n + 1, 10 * n + 5)]


def test_rollup_committers_race(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    counts = spark.createDataFrame([("s", "en", 5)], "source string, lang string, n long")
    root = str(tmp_path / "r")
    run = lambda i: token_rollup.Rollup(spark, root).commit("same", token_rollup.inserts(counts, "v", "n"))
    with ThreadPoolExecutor(6) as pool:
        assert sum(pool.map(run, range(6))) == 1
    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(lambda i: token_rollup.Rollup(spark, root).compact(), range(4))) == 1
        assert sum(pool.map(lambda i: token_rollup.Rollup(spark, root).files.put_once(f"{root}/one", str(i)), range(50))) == 1
    assert [tuple(r) for r in token_rollup.Rollup(spark, root).totals().collect()] == [("s", "en", "v", 1, 5)]


def test_rollup_by_a_model(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    texts = [prose(i, 80) for i in range(20)] + ["", None, " ", "漢字" * 100]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = token_rollup.model_tokens(df, piece_codec.MODEL)
    assert got.columns == [*df.columns, "tokens"]
    assert {r["doc_id"]: r["tokens"] for r in got.collect()} == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}


def grams(text, size):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])


def test_simhash(spark, monkeypatch):
    r = random.Random(5)
    texts = [prose(i, 80) for i in range(60)]
    for i in range(40):
        w = texts[i].split(" ")
        for _ in range(r.choice([0, 1, 1, 2])):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ["", None, "ÀB c", "one two three", "ONE two  three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = {}
    for i, t in enumerate(texts):
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams(t or "", 4)]
        fps[i] = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    label = dict.fromkeys(fps)
    for i in fps:
        if label[i] is None:
            todo = [i]
            while todo:
                a = todo.pop()
                if label[a] is None:
                    label[a] = i
                    todo += [b for b in fps if label[b] is None and (fps[a] ^ fps[b]).bit_count() <= 4]
    # Buckets over the size are parted, then tiled; keys over the share are dealt.
    for extra, tile, few in ((None, 4096, 256), (2, 3, 256), (4, 4096, 1)):
        monkeypatch.setattr(simhash_dedup, "TILE", tile)
        monkeypatch.setattr(skew, "FEW", few)
        got = {x["doc_id"]: (x["fp"] % (1 << 64), x["component_id"]) for x in simhash_dedup.classes(df, extra=extra).collect()}
        assert got == {i: (fps[i], label[i]) for i in fps}


def test_similar_texts(spark):
    """The pipeline's stage against all pairs by exact five-word Jaccard; null and shared ids lose no text."""
    r = random.Random(12)
    texts = [prose(i, 120) for i in range(40)]
    for i in range(160):
        w = texts[i % 40].split(" ")
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = f"changed{i}"
        texts.append(" ".join(w))
    texts += ["", None, " \n", "one two three", "ONE two  three"]
    rows = [(r.choice([i, None, i // 2]) if i > 60 else i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[70]]
    sets = [set(grams(t or "", 5)) for _, t in rows]
    near = lambda a, b: not (a or b) or len(a & b) * 5 >= len(a | b) * 4
    label = [None] * len(rows)
    for i in range(len(rows)):
        if label[i] is None:
            label[i], todo = i, [i]
            while todo:
                a = todo.pop()
                for b in range(len(rows)):
                    if label[b] is None and near(sets[a], sets[b]):
                        label[b] = i
                        todo.append(b)
    want = {c: min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if label[i] == c) for c in set(label)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in simhash_dedup.deduplicated(df).collect()]
    found = {label[next(i for i, (d, t) in enumerate(rows) if d == g and (t or "") == (u or ""))]: (g is None, g or 0) for g, u in got}
    assert len(got) == len(want) and found == want


def test_screen_and_forest():
    """Bit planes before exact sets lose no pair; sets at 0.8 are nearer than the screen by far."""
    r = np.random.default_rng(9)
    sets = []
    for i in range(60):
        base = r.integers(0, 1 << 63, int(r.integers(0, 200)) if i else 0, dtype=np.uint64) * np.uint64(2)
        for _ in range(int(r.integers(1, 5))):
            drop = base[r.random(len(base)) > r.choice([0, 0.05, 0.1, 0.2])]
            sets.append(np.unique(drop))
    near = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
    fps = [simhash_dedup._majority(x) for x in sets]
    assert max((fps[i] ^ fps[j]).bit_count() for i, j in pairs) <= simhash_dedup.SCREEN - 4
    got = simhash_dedup.similar_forest(sets, 0.8)
    assert all(near(sets[i], sets[j]) for i, j in got)
    label = simhash_dedup._forest(len(sets), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    own = simhash_dedup._forest(len(sets), np.array([p[0] for p in got]), np.array([p[1] for p in got]))
    assert np.array_equal(label, own)


def test_dealt_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 10)
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 50).alias("k"))
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = skew.dealt_join(rows, lookup, "k", "n", skew.share(rows, 1000), ["id"])
    assert sorted(map(tuple, got.select("id", "k", "n", "m").collect())) == sorted(map(tuple, rows.join(lookup, "k").select("id", "k", "n", "m").collect()))


def test_similar_texts_in_tiles(spark, monkeypatch):
    base = prose(7, 150).split(" ")
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(60)] + [prose(8, 100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash_dedup, "TILE", 9)
    assert sorted(x["doc_id"] for x in simhash_dedup.deduplicated(df).collect()) == [0, 60]


def test_bit_planes():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.concatenate([base[r.integers(0, 6, 300)] ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)), r.integers(0, 1 << 63, 100, dtype=np.uint64)])
    bucket = np.sort(r.integers(0, 3, 400))
    for radius in (*range(9), 15, 28, 31, 40, 63):
        got = {(int(a), int(b)) for x, y in simhash_dedup.close_pairs(fps, bucket, np.zeros(400, int), np.zeros(400, bool), radius) for a, b in zip(x, y, strict=True)}
        want = {(i, j) for i in range(400) for j in range(i + 1, 400) if bucket[i] == bucket[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
        assert got == want
    tile = np.r_[np.zeros(170, int), np.ones(230, int)]
    got = {(int(a), int(b)) for x, y in simhash_dedup.close_pairs(fps, np.zeros(400, int), tile, np.ones(400, bool), 4) for a, b in zip(x, y, strict=True)}
    assert got == {(i, j) for i in range(170) for j in range(170, 400) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}


def test_components(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(0, 300)]
    edges = chain + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (0, 1)] + [(2000, i) for i in range(2001, 2400)]
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in nodes}


def brute_removed(rows, length):
    seen, out = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("length", "anchor", "wide"), [(100, 24, 4 << 20), (100, 24, 300), (30, 8, 4 << 20)])
def test_substring(spark, length, anchor, wide):
    r = random.Random(6)
    passage = [prose(500 + i, 40) for i in range(5)]
    rows = []
    for i in range(80):
        parts = [prose(i, r.randint(0, 60))] + [r.choice(passage)[r.randint(0, 30) :] for _ in range(r.randint(0, 3))]
        r.shuffle(parts)
        rows.append((i * 3, r.choice([" ", "é", "\n"]).join(parts)))
    rows += [(500, "ab" * 200), (501, "x" * 260), (502, "ab" * 100), (503, None), (504, "y" * 99), (505, rows[4][1]), (506, "\x00" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: tuple(x)[1:] for x in substring_dedup.removed(df, length, anchor, wide).collect()}
    assert got == brute_removed(rows, length)


def test_interval_expansion():
    r = np.random.default_rng(1)
    for _ in range(30):
        n = int(r.integers(2, 400))
        x = np.r_[r.integers(2, 2 + int(r.integers(1, 4)), n), 0].astype(np.uint16)
        depth = int(r.integers(1, 20))
        sa, group = substring_dedup.shared_prefixes(x, depth)
        of = np.empty(n + 1, int)
        of[sa] = group
        for _ in range(200):
            i, j = r.integers(0, max(1, n - depth + 1), 2)
            if max(i, j) + depth <= n:
                assert (of[i] == of[j]) == (x[i : i + depth].tolist() == x[j : j + depth].tolist())


def test_merkle(spark, mixed_docs):
    one = mixed_docs.dropDuplicates(["doc_id"])
    same_as_duck(spark, merkle.fingerprinted(one), one, oracles.fingerprints())


def test_merkle_buckets(spark, mixed_docs, monkeypatch):
    one = mixed_docs.dropDuplicates(["doc_id"])
    want = sorted(map(tuple, merkle.fingerprinted(one).collect()))
    for rows in (1, 3, 10):
        monkeypatch.setattr(merkle, "ROWS", rows)
        assert sorted(map(tuple, merkle.fingerprinted(one).collect())) == want


def merkle_pair(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = merkle.with_tree(merkle.with_tree(df, "a", "fa"), "b", "fb")
    df = merkle.with_edits(merkle.with_items(merkle.with_items(df, "fa", "ia"), "fb", "ib"), "fa", "fb")
    return df.select("fa", "fb", merkle.likeness("fa", "fb", "ia", "ib").alias("near"), "edit_first", "edit_last", "piece_first", "piece_last").first()


def test_merkle_locates_edits(spark):
    lines = [prose(i, 30).replace("\n", " ") for i in range(60)]
    join = "\n".join
    r = merkle_pair(spark, join(lines), join([*lines[:41], "quite another line, it is", *lines[42:]]))
    assert (r["edit_first"], r["edit_last"]) == (41, 18) and 0.9 < r["near"] < 1 and r["fa"][:32] != r["fb"][:32]
    r = merkle_pair(spark, join(lines), join([*lines[:7], "one more", *lines[7:]]))
    assert (r["edit_first"], r["edit_last"]) == (7, 53)
    r = merkle_pair(spark, join(lines), join([*lines[:7], lines[6], *lines[7:]]))
    assert (r["edit_first"], r["edit_last"]) == (7, 53)
    assert merkle_pair(spark, join(lines), join(lines))[2:] == (1.0, -1, -1, -1, -1)
    assert merkle_pair(spark, "", "")[2:] == (1.0, -1, -1, -1, -1)
    assert merkle_pair(spark, "", "some text that is here")["near"] == 0.0


THAI, CHINESE = "กขคงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮะาำเแโใไ", "".join(chr(0x4E00 + 37 * i) for i in range(400))


@pytest.mark.parametrize("kind", ["latin", "letters", "chinese", "stops", "thai", "base64", "lines"])
def test_merkle_one_character_more(spark, kind):
    """Leaves follow the text around them: a character put in anywhere leaves the others as they are."""
    r = random.Random(4)
    many = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    text = {
        "latin": lambda: re.sub("[^a-z ]", " ", prose(3, 450)),
        "letters": lambda: many("abcdefghijklmnopqrstuvwxyz", 3000),
        "chinese": lambda: many(CHINESE, 2500),
        "stops": lambda: "".join(many(CHINESE, 15) + "。" for _ in range(100)),
        "thai": lambda: many(THAI, 2500),
        "base64": lambda: many("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 60_000),
        "lines": lambda: prose(5, 900),
    }[kind]()
    for at in (0, len(text) // 3, len(text)):
        got = merkle_pair(spark, text, text[:at] + "x" + text[at:])
        assert 0.9 < got["near"] < 1.0, (kind, at)
        if len(text) < merkle.BLOCK:
            assert got["piece_first"] + got["piece_last"] >= len(re.findall("[,;/]", got["fa"])) - 3, (kind, at)


def test_merkle_order_and_repeats_count(spark):
    lines = [prose(i, 30).replace("\n", " ") for i in range(60)]
    assert merkle_pair(spark, "\n".join(lines), "\n".join(lines[::-1]))["near"] < 0.95
    assert merkle_pair(spark, lines[0], "\n".join([lines[0]] * 50))["near"] < 0.2
    assert merkle_pair(spark, "a line here.\n", "a line here.")["near"] < 1


def test_merkle_roots_tell_texts_apart(spark):
    """Lines whose hashes agree in their first 32 bits, as a short node would have them."""
    r = merkle_pair(spark, "record number 15379 of it", "record number 43782 of it")
    assert r["fa"][:32] != r["fb"][:32] and r["near"] < 0.7
    df = spark.range(44_000).select(F.concat(F.lit("record number "), F.col("id").cast("string"), F.lit(" of it")).alias("a"))
    got = merkle.with_tree(df, "a", "f").agg(F.countDistinct(F.substring("f", 1, 32)), F.countDistinct(F.substring("f", 1, 8))).first()
    assert got[0] == 44_000


@pytest.mark.parametrize("chunk", [200, 5000])
def test_codec(spark, chunk):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    r = random.Random(8)
    odd = "aab  bcthe\n\tinéß漢字😀▁ <s>1239.,"
    texts = [prose(i, r.randint(1, 300)) for i in range(30)] + ["".join(r.choice(odd) for _ in range(r.randint(0, 900))) for _ in range(60)]
    texts += ["", None, " ", "   x", "a" * 3000, "漢字" * 900, "the" * 700, " " * 50, "\n" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in piece_codec.encoded(df, chunk=chunk, with_ids=True).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == sp.encode(t or ""), repr(t)[:80]
        assert got[i]["round_trip"]
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(got[i]["ids"], "<i4").tobytes()).hexdigest()


def test_scored_pieces(spark):
    """The best segmentation by scores against all segmentations, in one piece and over chunks of a few characters."""
    r = random.Random(21)
    table = [(t, -r.uniform(1, 9)) for t in sorted({"".join(r.choice("abc ") for _ in range(r.randint(1, 6))) for _ in range(80)})]
    score, place = dict(table), {t: i for i, (t, _) in enumerate(table)}
    unknown = -11.5

    def brute(text):
        best = {0: (0.0, [])}
        for j in range(1, len(text) + 1):
            options = []
            for i in range(max(0, j - 6), j):
                piece = text[i:j]
                s = score.get(piece, unknown if j == i + 1 else None)
                if s is not None and i in best:
                    options.append((best[i][0] + s, [*best[i][1], place.get(piece, -1)]))
            if options:
                best[j] = max(options)
        return best[len(text)]

    def total(ids, text):
        out, at = 0.0, 0
        for i in ids:
            assert i < 0 or text.startswith(table[i][0], at)
            out += unknown if i < 0 else table[i][1]
            at += 1 if i < 0 else len(table[i][0])
        assert at == len(text)
        return out

    texts = ["".join(r.choice("abc  é") for _ in range(r.randint(0, 120))) for _ in range(60)] + ["", None, "é" * 30, "a" * 200]
    # Few enough segmentations to list them all.
    for t in (x[:9] for x in texts[:20]):
        def every(t):
            if not t:
                return [0.0]
            return [score.get(t[:k], unknown if k == 1 else -1e9) + x for k in range(1, min(6, len(t)) + 1) for x in every(t[k:])]

        assert max(every(t)) == pytest.approx(brute(t)[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (6, 7, 40, 1000):
        got = {x["doc_id"]: x["ids"] for x in piece_codec.scored_ids(df, table, unknown, chunk).collect()}
        for i, t in enumerate(texts):
            assert total(got[i], t or "") == pytest.approx(brute(t or "")[0])


def test_max_plus_product_is_associative():
    r = np.random.default_rng(0)
    ms = [np.where(r.random((n, m)) < 0.4, 0.0, -np.inf) for n, m in ((1, 3), (3, 5), (5, 2), (2, 4), (4, 1))]
    out = piece_codec.prefixes(ms)
    total = ms[0]
    for m, o in zip(ms[1:], out[1:], strict=True):
        total = piece_codec.product(total, m)
        assert np.array_equal(total, o)


def test_license(spark):
    r = random.Random(9)
    texts = [prose(i, 200) for i in range(60)]
    for i in range(50):
        w = r.choice(license_scan.all_templates())[1].split()
        for _ in range(r.choice([0, 0, 1, 2])):
            j = r.randrange(len(w))
            w[j : j + 1] = r.choice([[], ["xx"], [w[j], "yy"]])
        t = texts[i].split(" ")
        p = r.randrange(len(t))
        texts[i] = " ".join(t[:p] + w + t[p:])
    shingle = lambda t: [tuple(x) for x in zip(*[license_scan._WORD.findall(t.lower())[k:] for k in range(5)], strict=False)]
    want = set()
    for d, t in enumerate(texts):
        z = shingle(t)
        for i, (_, template) in enumerate(license_scan.all_templates()):
            if template.endswith("\n"):
                continue
            s = set(shingle(template))
            if len(s) < license_scan.EXACT:
                own, words = license_scan._WORD.findall(template.lower()), license_scan._WORD.findall(t.lower())
                want |= {(d, i)} if any(words[k : k + len(own)] == own for k in range(len(words))) else set()
                continue
            at = [k for k, x in enumerate(z) if x in s]
            if any(len({z[q] for q in at if p <= q < p + len(s) * 1.25 + 2}) >= 0.8 * len(s) for p in at):
                want.add((d, i))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    headings = {i for i, (_, template) in enumerate(license_scan.all_templates()) if template.endswith("\n")}
    got = {(x["doc_id"], x["template"]) for x in license_scan.scanned(df).collect()}
    assert {x for x in got if x[1] not in headings} == want


def test_license_in_pieces(monkeypatch):
    text = prose(1, 30_000) + " Released under the MIT License. " + prose(2, 5000)
    t, words = license_scan.Templates(license_scan.TEMPLATES, license_scan.BANDS), license_scan._Hashes()
    whole = license_scan.scan([text], t, words)
    monkeypatch.setattr(license_scan, "PIECE", 50_000)
    parts = list(license_scan._parts(text, 4000))
    assert len(parts) > 2
    found = {(i, at + before) for (piece, before) in parts for _, i, _, at in license_scan.scan([piece], t, words)}
    assert found == {(i, at) for _, i, _, at in whole}


@pytest.mark.parametrize("pieces", [1, 2, 3, 4])
def test_giant_license_texts_through_spark(spark, pieces):
    """Texts of several pieces, at the real bound, equal a scan of the whole text."""
    body = prose(pieces, 1500)
    n = license_scan.PIECE * (pieces - 1) + 700_000
    filler = (body + " ") * (n // (len(body) + 1))
    notice = "Released under the MIT License. "
    text = notice + filler[: n // 2] + notice + filler[n // 2 :] + " This work is licensed under the GNU General Public License, version 3."
    t, words = license_scan.Templates(license_scan.all_templates(), license_scan.BANDS), license_scan._Hashes()
    want = {(i, round(share, 6), at) for _, i, share, at in license_scan.scan([text], t, words)}
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string").coalesce(1)
    got = {(r["template"], r["containment"], r["first_word"]) for r in license_scan.scanned(df).collect() if r["doc_id"] == 1}
    assert got == want and {license_scan.all_templates()[i][0] for i, _, _ in got} == {"MIT", "GPL-3.0"}


def test_license_in_unbroken_text(monkeypatch):
    """Without white space a piece is cut where it is: pieces advance, whatever the text, and one is held at a time."""
    text = "x" * 3_000_000 + " Released under the MIT License. " + "é" * 17_000_000
    parts = [(len(part), before) for part, before in license_scan._parts(text, 40_000)]
    assert len(parts) <= len(text) // (license_scan.PIECE - 80_000) + 1
    assert sum(n for n, _ in parts) < len(text) + 80_000 * len(parts)
    t, words = license_scan.Templates(license_scan.all_templates(), license_scan.BANDS), license_scan._Hashes()
    found = {t_ for part, _ in license_scan._parts(text, 40_000) for _, t_, _, _ in license_scan.scan([part], t, words)}
    assert {license_scan.all_templates()[i][0] for i in found} == {"MIT"}
    monkeypatch.setattr(license_scan, "PIECE", 2000)
    assert len(list(license_scan._parts("y" * 3000, 400))) < 5


def test_license_templates_of_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may use this work as you like if you say whose it is and ask for nothing more than that.")
    found = license_scan.templates_of(spark, str(tmp_path))
    assert [n for n, _ in found] == ["Own-1.0"]
    df = spark.createDataFrame([(1, prose(1, 50) + " " + found[0][1]), (2, prose(2, 50))], "doc_id long, text string")
    assert [(x["doc_id"], x["license"]) for x in license_scan.scanned(df, found).collect()] == [(1, "Own-1.0")]


def test_short_notices():
    texts = ["Copyright. All rights\n reserved.", "/* SPDX-License-Identifier: MIT */", "# MIT License\n\nCopyright", "under the MIT License we", "all rights", "reserved", "one two All Rights Reserved"]
    chosen = [*license_scan.TEMPLATES, *license_scan.NOTICES]
    t = license_scan.Templates(chosen, license_scan.BANDS)
    got = [(d, *chosen[i], share, at) for d, i, share, at in license_scan.scan(texts, t, license_scan._Hashes())]
    assert got == [
        (0, "All-Rights-Reserved", "All rights reserved.", 1.0, 1),
        (1, "MIT", "SPDX-License-Identifier: MIT", 1.0, 0),
        (2, "MIT", "MIT License\n", 1.0, 0),
        (6, "All-Rights-Reserved", "All rights reserved.", 1.0, 2),
    ]
    assert license_scan.scan(["ALL rights reserved"], t, license_scan._Hashes()) == [(0, len(license_scan.TEMPLATES), 1.0, 0)]
