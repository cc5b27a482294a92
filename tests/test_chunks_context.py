import pytest
from pyspark.sql import functions as F

from sparkquill.operators import chunking as C
from sparkquill.operators import context


def test_semantic_positions():
    assert C.semantic("", 500) == []
    assert C.semantic("First paragraph.\n\n\n\n Second. ", 500) == [("First paragraph.", 0, 16), ("Second.", 17, 24)]
    lines = "\n".join(f"line {i} " + "x" * 40 for i in range(6))
    got = C.semantic(lines + "\n\nlast", 100)
    assert all(len(c.encode()) <= 100 for c, _, _ in got)
    assert [s for _, s, _ in got] == [0, 96, 192, 289]
    assert C.semantic("漢" * 40, 100)[0][2] == 120


def test_long_line_is_cut():
    text = "word " * 100
    got = C.split_long(text.strip(), 60)
    assert all(0 < len(p) <= 60 for p in got)
    assert " ".join(got) == text.strip()
    assert "".join(C.split_long("x" * 250, 100)) == "x" * 250


def test_overlap(spark):
    docs = spark.createDataFrame([(1, "First chunk content here.\n\nSecond chunk starts here."), (2, None), (3, "ab\n\nab c")], "source_id long, content string")
    got = C.with_overlap(C.semantic_chunks(docs, 500), 5).orderBy("source_id", "chunk_index").collect()
    assert [r["content"] for r in got] == ["First chunk content here.", "here.\nSecond chunk starts here.", "ab", "ab c"]
    assert (got[1]["start_pos"], got[1]["end_pos"]) == (21, 21 + len(got[1]["content"]))
    same = C.with_overlap(C.semantic_chunks(docs, 500), 0).count()
    assert same == 4


def test_markdown_headers():
    got = C.markdown("# Main\ntext\n## Section A\nmore\n### Subsection\ndeep\nx\n# Next\ny", 500)
    paths = [r[4] for r in got]
    assert paths == ["Main", "Main > Section A", "Main > Section A > Subsection", "Next"]
    assert [r[3] for r in got] == ["header", "header", "text", "header"]
    assert C.markdown("##no space\nbody\nz", 500)[0][4] == "no space"


def test_markdown_code_is_linked():
    code = "```rust\n" + "\n".join(f"let value_{i} = compute_something({i});" for i in range(6)) + "\n```"
    got = C.markdown(code, 100)
    assert len(got) >= 2
    assert {r[3] for r in got} == {"code:rust"}
    assert len({r[5] for r in got}) == 1
    assert [r[6] for r in got] == list(range(len(got)))
    assert {r[7] for r in got} == {len(got)}
    assert "\n".join(r[0] for r in got) == code
    assert C.markdown(code, 100) == got


def test_markdown_table_keeps_header():
    table = "| Name | Value |\n|---|---|\n" + "\n".join(f"| row number {i} | {i * 1000} |" for i in range(6))
    got = C.markdown(table, 100)
    assert len(got) > 1
    assert all(r[0].startswith("| Name | Value |\n|---|---|") and r[3] == "table" for r in got)


def test_markdown_open_fence_is_kept():
    assert [r[3] for r in C.markdown("text here\n```py\nx = 1", 500)] == ["text", "code:py"]


def test_chunked_by_name(spark):
    docs = spark.createDataFrame([(1, "# A\nbody\nmore", "x.md"), (2, "# A\nbody", "x.txt")], "source_id long, content string, name string")
    got = {r["source_id"]: r["chunk_type"] for r in C.chunked(docs).collect()}
    assert got == {1: "text|A", 2: "general"}


HITS = "qid long, rank int, chunk_id long, source_id long, chunk_index int, content string, similarity double, metadata string"


def test_single_source(spark):
    hits = spark.createDataFrame([(0, 1, 1, 1, 0, "first", 0.9, None), (0, 2, 2, 1, 1, "second", 0.85, None), (0, 3, 3, 2, 0, "third", 0.3, None)], HITS)
    q = spark.createDataFrame([(0, "third"), (1, "none")], "qid long, query string")
    got = {r["qid"]: r for r in context.assembled(hits, q, separator=" | ", single=True).collect()}
    assert (got[0]["text"], got[0]["included"]) == ("first | second", 2)
    assert tuple(got[1])[1:] == ("", 0, 0, 0)
    assert [r["source_id"] for r in context.single_source_by_text(hits, q).collect()] == [2]
    assert {r["source_id"] for r in context.single_source_by_text(hits, q.withColumn("query", F.lit("zz"))).collect()} == {1}


def test_budget(spark):
    hits = spark.createDataFrame([(0, i + 1, i, i, 0, "c" * 40, 0.5, "m" * 60) for i in range(2)], HITS)
    q = spark.createDataFrame([(0, "x")], "qid long, query string")
    got = context.assembled(hits, q, 45).first()
    assert got["included"] == 1
    assert got["estimated_tokens"] == -(-len(got["text"]) // 4) <= 45


@pytest.mark.parametrize("budget", [30, 60, 100, 150, 400])
def test_budget_is_the_rendered_length(spark, budget):
    rows = [(0, i + 1, i, (i * 7) % 3, i, "é漢😀 text " * (i + 1), 0.5, None if i % 2 else "meta 😀") for i in range(8)]
    hits = spark.createDataFrame(rows, HITS)
    q = spark.createDataFrame([(0, "x")], "qid long, query string")
    got = context.assembled(hits, q, budget).first()
    n = len(got["text"].encode("utf-16-le")) // 2
    assert got["estimated_tokens"] == -(-n // 4) <= budget
    more = hits.filter(F.col("rank") <= got["included"] + 1)
    if got["included"] < 8:
        longer = len(context.render(more).first()["text"].encode("utf-16-le")) // 2
        assert -(-longer // 4) > budget


def test_orders(spark):
    rows = [(0, r, r, s, r, "x", 0.1, None) for r, s in enumerate([1, 1, 1, 2, 3, 3], 1)]
    hits = spark.createDataFrame(rows, HITS)
    got = [r["chunk_id"] for r in context.diverse(hits).orderBy("rank").collect()]
    assert got == [1, 4, 2, 5, 3, 6]
    assert [r["source_id"] for r in context.chronological(hits).orderBy("rank").collect()] == [1, 1, 1, 2, 3, 3]
    assert context.by_relevance(hits) is hits


def test_adjacent(spark):
    chunks = spark.createDataFrame([(i, 1, i, f"t{i}") for i in range(6)], "chunk_id long, source_id long, chunk_index int, content string")
    hits = spark.createDataFrame([(0, 1, 0, 1, 0, "t0", 0.9, None), (0, 2, 3, 1, 3, "t3", 0.8, None)], HITS)
    got = context.expand_adjacent(hits, chunks, 1).orderBy("rank").collect()
    assert [(r["chunk_index"], r["is_hit"]) for r in got] == [(0, True), (1, False), (2, False), (3, True), (4, False)]


def test_prompt(spark):
    row = spark.createDataFrame([("Q?", "ctx", "")], "q string, c string, e string")
    q = F.col("q")
    strict, plain, bare = row.select(context.prompt(q, F.col("c")), context.prompt(q, F.col("c"), False), context.prompt(q, F.col("e"))).first()
    assert strict.startswith("Answer the question based ONLY") and strict.endswith("--- Reference Documents ---\nctx\n--- End of Documents ---\n\nQuestion: Q?\n\nAnswer:")
    assert plain.startswith(context.PLAIN)
    assert bare == "Q?"
