"""Documents from files: kind by magic bytes, DOCX by the standard library, PDF by an adapter; evaluation sets as JSON."""

from __future__ import annotations

import io
import json
import logging
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.functions.text import document_kind, join_pages

log = logging.getLogger("sparkquill")
MOST_BYTES = 50 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file, one a line; tabs and breaks as such."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
        out.append("".join(parts[e.tag](e) for e in p.iter() if e.tag in parts))
    return "\n".join(out)


def pdf_pages(content: bytes) -> list[str]:
    """The texts of a PDF's pages, by whichever reader is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the package pypdf") from e
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, kind of all files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", document_kind(F.col("content")).alias("kind"))


_TEXTS = "path string, kind string, pages array<string>, error string"


def extracted(files: DataFrame, pdf: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """path, kind, text, error of files (path, content, kind). A file that can't be read has its error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                pages, error = None, None
                try:
                    if r.kind == "pdf":
                        pages = pdf(bytes(r.content))
                    elif r.kind == "docx":
                        pages = [docx_text(bytes(r.content))]
                    else:
                        error = r.kind
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((r.path, r.kind, pages, error))
            yield pd.DataFrame(out, columns=["path", "kind", "pages", "error"])

    rows = files.select("path", "kind", "content").mapInPandas(run, _TEXTS)
    text = F.when(F.col("kind") == "pdf", join_pages(F.col("pages"))).otherwise(F.get("pages", F.lit(0)))
    return rows.select("path", "kind", text.alias("text"), "error")


EVAL_ITEM = "dataset_id string, schema_version int, item_id string, query string, language string, query_type string, expected_source_key string, hard_negative_source_keys array<string>, tags array<string>, collected_at date"
MANIFEST = "dataset_id string, schema_version int, sources array<struct<source_key string, file_path string, language string, description string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The sources of a manifest, one a row."""
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select("dataset_id", F.inline("sources"))


def read_evalset(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Evaluation items, one a line of JSON. ValueError for repeated ids, or for source keys the manifest lacks."""
    items = spark.read.schema(EVAL_ITEM).json(path)
    twice = items.groupBy("item_id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated item_id: {[r['item_id'] for r in twice]}")
    if manifest is not None:
        unknown = items.join(manifest.select(F.col("source_key").alias("expected_source_key")), "expected_source_key", "left_anti").limit(5).collect()
        if unknown:
            raise ValueError(f"unknown source keys: {[r['expected_source_key'] for r in unknown]}")
    return items


def write_snapshot(path: str, metrics: DataFrame, outcomes: DataFrame) -> None:
    """Metrics, few rows, and the outcomes of each query as JSON lines below a path."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    outcomes.write.mode("overwrite").json(f"{path}/outcomes")
    log.info("snapshot written: %s", json.dumps({"path": path}))


def init_logging(level: int = logging.INFO, sink: logging.Handler | None = None) -> logging.Logger:
    """Log lines to the handler given, else to standard output."""
    for h in list(log.handlers):
        log.removeHandler(h)
    log.addHandler(sink or logging.StreamHandler())
    log.setLevel(level)
    return log


def close_logging() -> None:
    for h in list(log.handlers):
        log.removeHandler(h)
