"""Line quality, ball k-means and the prefix trie against brute force, SQL, held-out labels, and their edges."""

import hashlib
import itertools
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquill.llm import ball_kmeans, line_crf, oracles, prefix_trie, queries
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def duck(sql, **frames):
    c = duckdb.connect()
    for name, rows in frames.items():
        c.register(name, rows)
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return [dict(zip(names, row, strict=True)) for row in r.fetchall()]


# Ball k-means


def lloyd(rows, k, rounds, width, seed):
    """Plain rounds in Python's integers."""
    kept = [(v, [math.floor(1024 * float(x)) for x in e]) for v, e in rows if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cs = [x for _, x in sorted(kept, key=key)[:k]]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda x: min((gap(x, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        found = [near(x)[1] for _, x in kept]
        for j in range(len(cs)):
            mine = [x for (_, x), f in zip(kept, found, strict=True) if f == j]
            if mine:
                cs[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted(((v, near(x)[1], near(x)[0], hashlib.sha256(",".join(map(str, cs[near(x)[1]])).encode()).hexdigest()) for v, x in kept), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def kmeans_rows(df, **how):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in ball_kmeans.clustered(df, **how).collect()), key=repr)


@pytest.mark.parametrize("scale", [0.01, 1.0, 3e5])
def test_kmeans_brute(spark, scale):
    """Small vectors tie often; large ones leave the doubles' exact range."""
    r = random.Random(1)
    centres = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(np.float32(scale * (c + r.gauss(0, 0.2)))) for c in r.choice(centres)]) for i in range(300)]
    rows += [(400 + i, rows[i][1]) for i in range(20)] + [(7, rows[7][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(500, None), (501, []), (502, rows[0][1][:5]), (503, [float("nan"), *rows[0][1][1:]]), (504, [float("inf"), *rows[0][1][1:]]), (505, [None, *rows[0][1][1:]])]
    how = dict(k=7, rounds=6, width=6, seed=3)
    assert kmeans_rows(vectors(spark, rows), **how) == lloyd(rows, **how)


def test_kmeans_edges(spark):
    assert ball_kmeans.clustered(vectors(spark, []), width=2).collect() == []
    assert ball_kmeans.clustered(vectors(spark, [(1, None), (2, [1.0])]), width=2).collect() == []
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-0.5, 1e-4])]
    how = dict(k=8, rounds=3, width=2, seed=3)
    df = vectors(spark, rows).withColumn("cluster", F.lit("x")).withColumn("anchor", F.lit(9)).withColumn("vector", F.lit(1))
    assert kmeans_rows(df, **how) == lloyd(rows, **how)
    # Distances that no long holds are null; a component over the bound takes its row out.
    got = {r["vec_id"]: r for r in ball_kmeans.clustered(vectors(spark, [(1, [1e18, 0.0]), (2, [-1e18, 0.0]), (3, [1e30, 0.0])]), k=1, rounds=1, width=2).collect()}
    assert set(got) == {1, 2} and got[1]["distance"] is None and got[1]["inertia"] is None


def test_kmeans_spares_comparisons(spark):
    """In clusters most vectors are in stable cores, and anchors aren't written every round."""
    r = random.Random(5)
    rows = [(i, [10.0 * (i % 8 == j) + r.gauss(0, 0.3) for j in range(8)]) for i in range(4000)]
    found = ball_kmeans.fit(vectors(spark, rows), k=8, rounds=8, width=8)
    assert found.rounds[-1].made < 0.5 * 8 * found.rounds[-1].rows
    assert all(x.rows == 4000 for x in found.rounds)


@tables
def test_kmeans_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = c.execute(oracles.ball_kmeans()).fetchall()
    got = [tuple(r) for r in queries.op12_ball_kmeans(spark, SF).collect()]
    assert sorted(got) == sorted(want)


# Prefix trie


def trie_brute(rows, block, heads):
    own = {}
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(own.get(c - c % block, [])[:h] + x[h:])
    members = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members.setdefault(x[:d], []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda v: sum(len(q) == len(v) + 1 and q[:-1] == v for q in members)
        ends = ",".join(str(c) for c in sorted(c for c in cs if built[c] == p))
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids(p), sum(not kids(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def trie_rows(df, **how):
    return sorted((tuple(r) for r in prefix_trie.nodes(df, **how).collect()), key=repr)


def test_trie_brute(spark):
    r = random.Random(2)
    words = ["a", "b", "é漢", ""]
    rows = [(c, t, r.choice(["user", None]), r.choice(words)) for c in [*range(95, 125), 300, 305, 507] for t in range(r.randrange(1, 12))]
    # Absent bases, conversations that lose all turns, repeated rows and numbers, nulls anywhere.
    rows += [(101, 0, "user", "a"), (101, 0, "user", "a"), (102, None, None, None), (None, 1, "user", "a"), (803, 0, "user", "a"), (9, 5, "x", "y")]
    df = spark.createDataFrame(rows, TURNS)
    for c in ("name", "n", "depth", "part", "digest"):
        df = df.withColumn(c, F.lit("clash"))
    assert trie_rows(df) == trie_brute(rows, 100, 6)
    assert trie_rows(df, heads=1) == trie_brute(rows, 100, 1)


def test_trie_long_and_hot(spark):
    """A conversation of thousands of turns, and many copies of one, whose turns share names."""
    rows = [(1000, t, "user", f"turn {t % 7}") for t in range(3000)]
    rows += [(c, t, "user", "hot") for c in range(2000, 2400) for t in range(3)]
    nodes = {(r["conv_id"], r["depth"]): r for r in prefix_trie.nodes(spark.createDataFrame(rows, TURNS)).collect()}
    assert nodes[1000, 3000]["n_children"] == 0 and nodes[1000, 3000]["n_convs"] == 1
    root = next(r for k, r in nodes.items() if k[1] == 0)
    assert root["n_convs"] == 401 and root["parent_conv_id"] is None
    hot = [r for r in nodes.values() if r["depth"] == 3 and r["conv_id"] >= 2000]
    built = {c: min(zlib.crc32(str(c).encode()) % 6, 3) + max(0, 3 - zlib.crc32(str(c).encode()) % 6) for c in range(2000, 2400)}
    assert len(hot) == 1 and hot[0]["n_convs"] == sum(n >= 3 for n in built.values())
    ids = ",".join(str(c) for c, n in built.items() if n == 3)
    assert hot[0]["ends_sha256"] == hashlib.sha256(ids.encode()).hexdigest()


def test_trie_ends_cross_batches(spark):
    rows = spark.range(50_000).select(F.lit(7).cast("long").alias("name"), (F.col("id") * 3).alias("conv_id")).unionByName(spark.sql("select 8L as name, 5L as conv_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r["name"]: r["ends_sha256"] for r in prefix_trie.ends(rows).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {7: hashlib.sha256(",".join(str(3 * i) for i in range(50_000)).encode()).hexdigest(), 8: hashlib.sha256(b"5").hexdigest()}


def test_trie_edges(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], TURNS)).collect() == []
    lost = next(c for c in range(701, 800) if zlib.crc32(str(c).encode()) % 6)
    got = trie_rows(spark.createDataFrame([(lost, 0, "user", "gone")], TURNS))
    assert got == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]


@tables
def test_trie_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = c.execute(oracles.prefix_trie()).fetchall()
    got = [tuple(r) for r in queries.op13_prefix_trie(spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# Line quality


def enumerated(e, pairs):
    """Marginals of good by summing over all labellings of one chain."""
    total, good = 0.0, np.zeros(len(e))
    for y in itertools.product((0, 1), repeat=len(e)):
        w = math.exp(sum((1 if a else -1) * x / 2 for a, x in zip(y, e, strict=True)) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    return good / total


def test_marginals_brute():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 1, 9, 2, 7]
    doc, e, pairs = np.repeat(np.arange(6), sizes), rng.normal(0, 3, sum(sizes)), rng.normal(0, 1, (2, 2))
    want = np.concatenate([enumerated(e[doc == d], pairs) for d in range(6)])
    assert np.allclose(line_crf.marginals(e, doc, pairs), want, atol=1e-10)
    # A chain of 100,000 lines against messages passed one by one.
    e, doc = rng.normal(0, 2, 100_000), np.zeros(100_000, int)
    t = np.exp(pairs)
    a, b = np.zeros((len(e), 2)), np.ones((len(e), 2))
    local = np.exp(np.stack([-e / 2, e / 2], 1))
    a[0] = local[0]
    for i in range(1, len(e)):
        a[i] = (a[i - 1] @ t) * local[i]
        a[i] /= a[i].sum()
    for i in range(len(e) - 2, -1, -1):
        b[i] = t @ (local[i + 1] * b[i + 1])
        b[i] /= b[i].sum()
    p = a * b
    assert np.allclose(line_crf.marginals(e, doc, pairs), p[:, 1] / p.sum(1), atol=1e-9)


def features_brute(text):
    """The features of the lines with words of one text, one by one."""
    white = " \t\n\v\f\r"
    words_of = lambda line: [w for w in "".join(" " if c in white else c for c in line).split(" ") if w]
    lines = [(i, x) for i, x in enumerate(text.split("\n"))]
    seq = [(i, w) for i, x in lines for w in words_of(x)]
    tri = [tuple(w for _, w in seq[k : k + 3]) for k in range(len(seq) - 2)]
    covered = {k + j for k, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)}
    out = []
    for i, x in lines:
        w = words_of(x)
        if not w:
            continue
        solid = sum(c not in white for c in x)
        symbol = lambda c: ord(c) < 128 and not c.isalnum() and c not in white + ".,;:'\"()-!?"
        share = lambda f: sum(f(c) for c in x) / solid
        out.append([
            math.log1p(solid), math.log1p(len(w)), math.log(solid / len(w)), share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(lambda c: c in ".,;:'\"()-"),
            share(lambda c: c in "!?"), share(symbol), share(lambda c: ord(c) > 127), sum(symbol(v[-1]) or v[-1] in "!?" for v in w) / len(w), len(set(w)) / len(w),
            sum(k in covered for k, (j, _) in enumerate(seq) if j == i) / len(w), sum(y == x for _, y in lines) > 1, w[-1][-1] in ".,;:'\"()-!?", "A" <= w[0][0] <= "Z" or ord(w[0][0]) > 127,
        ])
    return out


def features(texts):
    data = "".join(texts).encode()
    return line_crf.lines_of(np.frombuffer(data, np.uint8), np.r_[0, np.cumsum([len(t.encode()) for t in texts])])


@pytest.mark.parametrize("span", [None, 64])
def test_features_brute(monkeypatch, span):
    if span:
        monkeypatch.setattr(line_crf, "SPAN", span)
        line_crf._powers.cache_clear()
    texts = ["One two three.\none two three\n\nOne two three.", "", " \n ", "x", "é漢 $$ a!! b?\n\nÀ la la la la la la\n", "no end", prose(3, 90), "a\n" * 20 + "b", "y" * 200 + " z"]
    found = features(texts)
    for d, text in enumerate(texts):
        got, want = found.x[found.doc == d], features_brute(text)
        assert len(got) == len(want), text
        if want:
            assert np.allclose(got, np.array(want, float)), text
            assert found.chars[found.doc == d].tolist() == [len(x) for x in text.split("\n") if x.strip(" \t\v\f\r")]
    line_crf._powers.cache_clear()


def test_batches_do_not_matter():
    texts = [prose(i, 40 + i) for i in range(12)] + ["", "z\n" * 40]
    whole = features(texts)
    for d, t in enumerate(texts):
        assert np.array_equal(whole.x[whole.doc == d], features([t]).x)


def corpus(n, seed=0):
    """(doc_id, text, good): poor texts are symbols or repeats, some with a good line between."""
    out = []
    for i in range(n):
        text = prose(seed * 10_000 + i, 80)
        good = i % 4 != 0
        if not good:
            text = " ".join(w + "$$$" for w in text.split(" ")) if i % 8 else "Buy now now now now\n" * 12 + prose(i, 10)
        out.append((i, text, good))
    return out


def test_held_out_and_lines(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in rows], "doc_id long, quality int")
    model = line_crf.fit(docs, labels)
    got = {r["doc_id"]: r for r in line_crf.scored(docs, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i]["predicted"], int(g)) for i, _, g in rows if got[i]["held_out"]]
    assert len(held) > 150 and sum(a == b for a, b in held) >= 0.98 * len(held)
    # Labels of the held-out fold are never read: turning them over changes nothing.
    turned = spark.createDataFrame([(i, 1 - int(g) if zlib.crc32(str(i).encode()) % 3 == 1 else int(g)) for i, _, g in rows], "doc_id long, quality int")
    again = line_crf.fit(docs, turned)
    assert np.array_equal(again.w, model.w) and np.array_equal(again.pairs, model.pairs)
    # A document's score is its lines' marginals by length.
    lines = [r for r in line_crf.line_labels(docs, model).collect() if r["doc_id"] == 0]
    assert abs(sum(r["p_good"] * r["n_chars"] for r in lines) / sum(r["n_chars"] for r in lines) - got[0]["score"]) < 1e-5
    assert got[0]["n_lines"] == len(lines) == rows[0][1].strip("\n").count("\n") + 1


def test_quality_edges(spark, edges, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, None), (None, 1), (3, 0), (5, 1), (6, 0), (8, 1), (31, 0)], "doc_id long, quality int")
    model = line_crf.fit(edges, labels)
    got = line_crf.scored(edges, model).collect()
    assert len(got) == edges.count() and all(0 <= r["score"] <= 1 for r in got)
    blank = [r for r in got if r["doc_id"] in (30, 31, 32)]
    assert {r["score"] for r in blank} == {round(model.share, 6)} and {r["n_lines"] for r in blank} == {0}
    same = [r for r in got if r["doc_id"] == 0]
    assert len(same) == 2 and same[0] == same[1]
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert line_crf.scored(empty, model).collect() == []
    none = line_crf.fit(edges, labels.limit(0))
    assert {r["score"] for r in line_crf.scored(edges, none).collect()} == {0.5}
    one = line_crf.fit(edges, labels.filter("quality = 1"))
    assert all(r["predicted"] == 1 for r in line_crf.scored(edges, one).collect())


def test_quality_of_giant_texts(spark):
    """Texts over the bounds of the sample, a line of millions of characters among them, are read whole."""
    rows = [(i, t) for i, t, _ in corpus(300)]
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in corpus(300)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = line_crf.fit(docs, labels)
    junk = "w&&& " * 900_000
    big = spark.createDataFrame([(1, prose(1, 700_000)), (2, prose(2, 300) + "\n" + junk), (3, "q" * 5_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_crf.scored(big, model).collect()}
    assert got[1]["n_lines"] > 20_000 and got[1]["score"] > 0.5
    assert got[2]["score"] < 0.5
    assert got[3]["n_lines"] == 1
