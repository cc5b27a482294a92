import io
import json
import logging
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkquill.operators.store import Store
from sparkquill.plans import queries
from sparkquill.sources import documents
from sparkquill.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("One", "Two &amp; three"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 whatever")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01\x02\x03")
    (tmp_path / "d.bin").write_bytes(b"\x00")
    files = documents.read_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in documents.extracted(files, pdf=lambda b: ["page one cut-", "ting here\n2"]).collect()}
    assert got["a.docx"]["text"] == "One\nTwo & three"
    assert got["b.pdf"]["text"] == "page one cutting here"
    assert (got["c.bin"]["text"], got["c.bin"]["error"]) == (None, "unsupported")
    assert got["d.bin"]["error"] == "too small"


def test_pdf_reader_says_what_it_needs(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 whatever")
    got = documents.extracted(documents.read_files(spark, str(tmp_path))).first()
    assert got["error"]


def test_evalset(spark, tmp_path):
    item = {"dataset_id": "d", "schema_version": 1, "item_id": "i1", "query": "q", "language": "en", "query_type": "positive", "expected_source_key": "s1", "tags": ["a"]}
    (tmp_path / "m.json").write_text(json.dumps({"dataset_id": "d", "schema_version": 1, "sources": [{"source_key": "s1", "file_path": "x.pdf", "language": "en"}]}, indent=1))
    (tmp_path / "ok.jsonl").write_text(json.dumps(item) + "\n" + json.dumps(item | {"item_id": "i2"}) + "\n")
    (tmp_path / "twice.jsonl").write_text(json.dumps(item) + "\n" + json.dumps(item) + "\n")
    (tmp_path / "unknown.jsonl").write_text(json.dumps(item | {"expected_source_key": "s9"}) + "\n")
    manifest = documents.read_manifest(spark, str(tmp_path / "m.json"))
    assert documents.read_evalset(spark, str(tmp_path / "ok.jsonl"), manifest).count() == 2
    for name in ("twice", "unknown"):
        with pytest.raises(ValueError, match="i1|s9"):
            documents.read_evalset(spark, str(tmp_path / f"{name}.jsonl"), manifest)
    documents.write_snapshot(str(tmp_path / "snap"), spark.range(1), spark.range(3))
    assert spark.read.json(str(tmp_path / "snap/outcomes")).count() == 3


def test_logging():
    lines = []

    class Sink(logging.Handler):
        def emit(self, record):
            lines.append(record.getMessage())

    documents.init_logging(sink=Sink()).info("hello")
    documents.close_logging()
    assert lines == ["hello"]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_of_a_table_of_several_files(spark, tmp_path, files):
    """A table may be a file or a folder of files with names of their own."""
    rows = spark.range(150).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"), F.lit(0).alias("label"))
    rows.repartition(files).write.parquet(str(tmp_path / "embeddings.parquet"))
    if files == 1:
        (one,) = (tmp_path / "embeddings.parquet").glob("part-*.parquet")
        one.rename(tmp_path / "one")
        (tmp_path / "embeddings.parquet").rename(tmp_path / "rest")
        (tmp_path / "one").rename(tmp_path / "embeddings.parquet")
    assert {(r["doc_id"], r["dim"]) for r in queries.stream_ingest(spark, str(tmp_path)).collect()} == {(i, 1) for i in range(150)}


def test_stream(spark, tmp_path):
    rows = spark.range(150).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    rows.filter("doc_id < 60").write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    buffer = ingest.Buffer(spark, store)

    def run():
        stream = spark.readStream.schema(ingest.BUFFER).parquet(str(tmp_path / "in"))
        ingest.start(stream, buffer, str(tmp_path / "check")).awaitTermination()

    run()
    assert buffer.rows().count() == 60
    assert not buffer.due()
    assert store.dirty
    rows.filter("doc_id >= 60").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert buffer.rows().count() == 0
    assert store.get("index").count() == 150
    buffer.add(rows.filter("doc_id = 1"), 99)
    buffer.add(rows.filter("doc_id = 1"), 99)
    assert buffer.rows().count() == 1
    buffer.merge()
    assert store.get("index").count() == 150
