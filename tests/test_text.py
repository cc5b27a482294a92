import pytest
from pyspark.sql import functions as F

from sparkquill.functions import hashing, text, vectors


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("안녕하세요! 반갑습니다.", ["안녕하세요", "반갑습니다"]),
        ("車 C R a i 7", ["車", "c", "r", "7"]),
        ("iPhone15 프로 출시", ["iphone15", "프로", "출시"]),
        ("don’t stop 3.14 a.b word.19 é", ["don’t", "stop", "3.14", "a.b", "word", "19"]),
        ("__ _ a_b", ["a_b"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, given, want):
    assert one(spark, given, text.tokens) == want


def test_sentences(spark):
    assert one(spark, " One. Two?  three! . 四。tail ", text.sentences) == ["One.", "Two?", "three!", "四。", "tail"]
    assert one(spark, "First. Second.  first . FIRST.", text.distinct_sentences) == ["First.", "Second.", "first ."]
    got = one(spark, "First. Second. First.", text.compressed)
    assert (got["text"], got["sentences_removed"], got["original_chars"]) == ("First. Second.", 1, 21)
    cut = one(spark, "One sentence。 Another that is long.", lambda c: text.compressed(c, 20))
    assert cut["text"] == "One sentence。"
    assert one(spark, "", text.compressed)["ratio"] == 1.0
    assert one(spark, "no end at all here", lambda c: text.compressed(c, 5))["text"] == "no en"


def test_sentence_hash(spark):
    rows = spark.createDataFrame([("Hello World",), ("hello   world",), ("x",)], "x string").select(hashing.sentence_hash(F.col("x")).alias("h")).collect()
    assert rows[0] == rows[1] != rows[2]
    assert hashing.fnv1a(b"") == 0xCBF29CE484222325
    assert hashing.fnv1a(b"a") == 0xAF63DC4C8601EC8C


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("A blockchain is defined as a distributed ledger.", "definition"),
        ("Features:\n• Item1\n• Item2\n• Item3", "list"),
        ("1. a\n2) b\n3. c", "list"),
        ("For instance, this", "example"),
        ("how to do it: step 1 is", "procedure"),
        ("this versus that", "comparison"),
        ("plain words", "general"),
    ],
)
def test_classify(spark, given, want):
    assert one(spark, given, text.chunk_type) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("/summary about RWA", ("summary", "about RWA", True, None)),
        ("/define smart contract", ("define", "smart contract", True, None)),
        ("/DEFINE  ", ("invalid", "/define", False, text.TERM_REQUIRED)),
        ("/more", ("more", "", True, None)),
        ("  ", ("invalid", "", False, "Empty input")),
        (None, ("invalid", "", False, "Empty input")),
        ("/Find x", ("invalid", "/find", False, "Unknown command '/find'. Available: /summary, /define, /more")),
        (" just words ", ("general", "just words", True, None)),
    ],
)
def test_intent(spark, given, want):
    assert tuple(one(spark, given, text.intent)) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (["This is a hyphen-", "ated word in the text."], "This is a hyphenated word in the text."),
        (["highly-read-\n\nable"], "highly-readable"),
        (["highly-read­\n\nable"], "highly-readable"),
        (["Some content here.\n\n42"], "Some content here."),
        (["One page\n1", "two\n2\n\n"], "One page two"),
        (["user-\nFacing"], "user- Facing"),
        ([], ""),
    ],
)
def test_join_pages(spark, given, want):
    rows = spark.createDataFrame([(given,)], "p array<string>")
    assert rows.select(text.join_pages(F.col("p")).alias("y")).first()["y"] == want


def test_page_number(spark):
    assert one(spark, "text\n123\n\n", text.strip_page_number) == "text\n"
    assert one(spark, "text\n12a", text.strip_page_number) == "text\n12a"
    assert one(spark, "7", text.strip_page_number) == ""
    assert one(spark, "漢\n字 x", text.join_cjk_lines) == "漢字 x"


@pytest.mark.parametrize(("n", "want"), [(10, 256), (1500, 384), (3000, 512)])
def test_truncation(spark, n, want):
    assert one(spark, "x" * n, text.truncation_limit) == want


def test_small_functions(spark):
    assert one(spark, "The quick-fox, the 漢 a x1", text.significant_terms) == ["the", "quick", "fox", "漢", "x1"]
    assert one(spark, "x" * 8, lambda c: text.should_compress(c, 1)) is True
    assert one(spark, "x" * 7, lambda c: text.should_compress(c, 1)) is False
    assert one(spark, "a/b.MD", text.chunking_strategy) == "markdown"
    assert one(spark, "a.txt", text.chunking_strategy) == "recursive"
    assert one(spark, "LIST", text.known_chunk_type) == "list"
    assert one(spark, "other", text.known_chunk_type) == "general"
    kinds = [one(spark, s, lambda c: text.document_kind(c.cast("binary"))) for s in ("%PDF-1", "PK\x03\x04", "ab", "abcd")]
    assert kinds == ["pdf", "docx", "too small", "unsupported"]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [[1.0, 2.0], [3.0, 4.0], [5.0, 9.0]])], "a array<float>, b array<float>, m array<array<float>>")
    zero, short = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(2.0))
    a, b = F.col("a"), F.col("b")
    r = rows.select(vectors.cosine(a, b), vectors.cosine(a, zero), vectors.cosine(a, short), vectors.cosine_distance(a, zero), vectors.cosine_distance(a, short), vectors.mean_pool(F.col("m"))).first()
    assert r[0] == pytest.approx(2**-0.5)
    assert r[1:4] == (0.0, 0.0, 1.0)
    assert r[4] == pytest.approx(0.0)
    assert r[5] == [3.0, 5.0]


def test_mean_pooled(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, 5.0]), (1, [2.0, -1.0]), (2, [0.5, 0.25]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "label int, embedding array<float>").withColumn("pos", F.lit("clash")).withColumn("value", F.lit(0))
    got = {(r["label"], r["pos"]): r["value"] for r in vectors.mean_pooled(df, ["label"]).collect()}
    assert got == {(1, 0): 2.0, (1, 1): 2.0, (2, 0): 0.5, (2, 1): 0.25}
    whole = df.filter("label = 1").groupBy().agg(F.collect_list("embedding").alias("m")).select(vectors.mean_pool(F.col("m")).alias("v")).first()["v"]
    assert whole == [got[1, 0], got[1, 1]]
