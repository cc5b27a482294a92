"""Chunkers: paragraphs first, or along Markdown's structure.

Chunking a text is a walk over its lines with state, so it runs in Arrow batches, one text at a time; overlap between
chunks and their classes are window and column expressions. Sizes are UTF-8 bytes, as positions are; only a line or
sentence that is too long is cut by characters."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions.text import chunk_type

LEAST = 100
FENCE = "```"


def _size(s: str) -> int:
    return len(s.encode())


def _lines(text: str) -> list[str]:
    """Lines without their ends; a last empty one is none."""
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [s.removesuffix("\r") for s in out]


def split_long(text: str, most: int) -> list[str]:
    """A text without smaller structure in pieces of at most `most` characters: at a sentence end if there is one in the
    second half, else at white space, else anywhere. Pieces are trimmed, none is empty."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            window = text[at:end]
            ends = [m.end() for m in re.finditer(r"[.!?。]\s", window)]
            spaces = [m.start() for m in re.finditer(r"\s", window)]
            if ends and ends[-1] > most // 2:
                end = at + ends[-1]
            elif spaces and spaces[-1] > 0:
                end = at + spaces[-1]
        if piece := text[at:end].strip():
            out.append(piece)
        at = end
    return out


def pack(parts: list[str], most: int, glue: str, oversize: Callable[[str], list[str]], extra: int | None = None) -> list[str]:
    """Parts joined by glue as long as they fit, one after the other; those too long for themselves by `oversize`.

    extra: bytes that a join counts for, also before a first part."""
    out: list[str] = []
    held = ""
    for part in parts:
        joined = held + glue + part if held else part
        size = _size(joined) if extra is None else _size(held) + _size(part) + extra
        if size <= most:
            held = joined
            continue
        if held:
            out.append(held)
            held = ""
        if _size(part) <= most:
            held = part
        else:
            out += oversize(part)
    if held:
        out.append(held)
    return out


# Paragraphs first


def semantic(text: str, most: int) -> list[tuple[str, int, int]]:
    """(content, start, end): positions count bytes along the chunks, with one byte after a whole paragraph or a full
    buffer, two after a paragraph's last buffer and none after a piece of a long line."""
    most = max(most, LEAST)
    out: list[tuple[str, int, int]] = []
    at = 0

    def emit(content: str, gap: int) -> None:
        nonlocal at
        out.append((content, at, at + _size(content)))
        at += _size(content) + gap

    for paragraph in (p.strip() for p in text.split("\n\n")):
        if not paragraph:
            continue
        if _size(paragraph) <= most:
            emit(paragraph, 1)
            continue
        held = ""
        for line in filter(None, (s.strip() for s in paragraph.split("\n"))):
            longer = f"{held}\n{line}" if held else line
            if _size(longer) <= most:
                held = longer
                continue
            if held:
                emit(held, 1)
                held = ""
            if _size(line) <= most:
                held = line
            else:
                for piece in split_long(line, most):
                    emit(piece, 0)
        if held:
            emit(held, 2)
    return out


_SEMANTIC = "source_id long, chunk_index int, content string, start_pos int, end_pos int"


def _rows(batches, walk: Callable[[str], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for ident, text in zip(batch.column("source_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            out += [(ident, i, *row) for i, row in enumerate(walk(text or ""))]
            if len(out) >= 5000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def semantic_chunks(docs: DataFrame, most: int = 500, ident: str = "source_id", text: str = "content") -> DataFrame:
    """source_id, chunk_index, content, start_pos, end_pos, chunk_type. A null or empty text has no chunks."""
    schema = pa.schema([("source_id", pa.int64()), ("chunk_index", pa.int32()), ("content", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())])
    rows = docs.select(F.col(ident).cast("long").alias("source_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(lambda it: _rows(it, lambda t: semantic(t, most), schema), _SEMANTIC)
    return out.withColumn("chunk_type", chunk_type(F.col("content")))


def with_overlap(chunks: DataFrame, overlap: int) -> DataFrame:
    """Every chunk but a source's first begins with the last characters of the one before it, unless it does already."""
    if overlap <= 0:
        return chunks
    w = Window.partitionBy("source_id").orderBy("chunk_index")
    tail = F.lag("content").over(w)
    df = chunks.withColumn("__tail", F.when(F.length(tail) > overlap, F.substring(tail, F.length(tail) - overlap + 1, F.lit(overlap))).otherwise(tail))
    add = F.coalesce((F.col("__tail") != "") & ~F.startswith("content", "__tail"), F.lit(False))
    content = F.concat("__tail", F.lit("\n"), "content")
    start = F.greatest(F.col("start_pos") - F.octet_length("__tail"), F.lit(0)).cast("int")
    df = df.withColumn("__add", add).withColumn("__start", F.when(F.col("__add"), start).otherwise(F.col("start_pos")))
    df = df.withColumn("content", F.when(F.col("__add"), content).otherwise(F.col("content")))
    df = df.withColumn("end_pos", F.when(F.col("__add"), F.col("__start") + F.octet_length("content")).otherwise(F.col("end_pos")).cast("int"))
    return df.withColumn("start_pos", F.col("__start").cast("int")).drop("__tail", "__add", "__start")


# Markdown


@dataclass
class Section:
    kind: str  # text, code or table
    lines: list[str]
    header: tuple[int, str] | None = None
    language: str = ""


def sections(text: str) -> Iterator[Section]:
    """Runs of text below a header, fenced code and tables, in the order in which they are complete.

    A fence that opens right after a table comes before it. An open fence at the end is code."""
    prose, table, code = Section("text", []), [], None

    def flush() -> Iterator[Section]:
        nonlocal prose
        if any(s.strip() for s in prose.lines):
            yield prose
            prose = Section("text", [])

    for line in _lines(text):
        bare = line.strip()
        if bare.startswith(FENCE):
            if code is None:
                yield from flush()
                code = Section("code", [line], None, bare.lstrip("`"))
            else:
                code.lines.append(line)
                yield code
                code = None
        elif code is not None:
            code.lines.append(line)
        elif bare.startswith("|") and bare.endswith("|"):
            if not table:
                yield from flush()
            table.append(line)
        else:
            if table:
                yield Section("table", table)
                table = []
            if line.startswith("#"):
                yield from flush()
                rest = line.lstrip("#")
                prose.header = (len(line) - len(rest), rest.strip())
            prose.lines.append(line)
    if code is not None:
        yield code
    if table:
        yield Section("table", table)
    yield from flush()


def split_lines(text: str, most: int) -> list[str]:
    parts = pack(_lines(text), most, "\n", lambda s: split_long(s, most))
    return [p for p in parts if p]


def split_table(text: str, most: int) -> list[str]:
    """Parts of a table, each with its two header lines; a row too long for one stands alone under them."""
    lines = _lines(text)
    if len(lines) < 3:
        return split_lines(text, most)
    head = "\n".join(lines[:2])
    out, now = [], head
    for row in lines[2:]:
        if _size(now) + 1 + _size(row) > most:
            out.append(now)
            now = head
        now += "\n" + row
    return [*out, now]


def split_sentences(text: str, most: int) -> list[str]:
    parts = re.findall(r"[^.!?]*[.!?]|[^.!?]+", text)
    return [s for s in (p.strip() for p in pack(parts, most, "", lambda s: split_long(s, most))) if s]


def split_text(text: str, most: int) -> list[str]:
    if _size(text) <= most:
        return [text]
    paragraphs = text.split("\n\n")
    if len(paragraphs) == 1:
        return split_sentences(text, most)
    return [p for p in pack(paragraphs, most, "\n\n", lambda p: split_sentences(p, most), extra=2) if p]


def markdown(text: str, most: int) -> list[tuple]:
    """(content, start, end, type, header_path, batch_id, batch_index, batch_total). Parts of one code block share a
    batch id made from its content and place, so a repeated run gives the same."""
    most = max(most, LEAST)
    out: list[tuple] = []
    stack: list[tuple[int, str]] = []
    at = 0
    for section in sections(text):
        if section.header:
            while stack and stack[-1][0] >= section.header[0]:
                stack.pop()
            stack.append(section.header)
        content = "\n".join(section.lines).strip()
        if not content:
            continue
        whole = _size(content) <= most
        if section.kind == "code":
            kind, parts = f"code:{section.language}" if section.language else "code", [content] if whole else split_lines(content, most)
        elif section.kind == "table":
            kind, parts = "table", [content] if whole else split_table(content, most)
        else:
            short = whole and section.header is not None and len(_lines(content)) <= 2
            kind, parts = "header" if short else "text", [content] if whole else split_text(content, most)
        linked = section.kind == "code" and len(parts) > 1
        batch = hashlib.sha256(f"{at}:{content}".encode()).hexdigest()[:32] if linked else None
        for i, part in enumerate(parts):
            out.append((part, at, at + _size(part), kind, " > ".join(h for _, h in stack), batch, i if linked else None, len(parts) if linked else None))
            at += _size(part) + 1
    return out


_MARKDOWN = "source_id long, chunk_index int, content string, start_pos int, end_pos int, chunk_type string, header_path string, batch_id string, batch_index int, batch_total int"


def markdown_chunks(docs: DataFrame, most: int = 500, ident: str = "source_id", text: str = "content") -> DataFrame:
    schema = pa.schema([("source_id", pa.int64()), ("chunk_index", pa.int32()), ("content", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("chunk_type", pa.string()), ("header_path", pa.string()), ("batch_id", pa.string()), ("batch_index", pa.int32()), ("batch_total", pa.int32())])
    rows = docs.select(F.col(ident).cast("long").alias("source_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _rows(it, lambda t: markdown(t, most), schema), _MARKDOWN)


def stored_type(chunks: DataFrame) -> DataFrame:
    """Markdown chunks as they are stored: `type|path` where there is a header path."""
    folded = F.when(F.col("header_path") != "", F.concat_ws("|", "chunk_type", "header_path")).otherwise(F.col("chunk_type"))
    return chunks.withColumn("chunk_type", folded).select("source_id", "chunk_index", "content", "start_pos", "end_pos", "chunk_type")


def chunked(docs: DataFrame, most: int = 500, overlap: int = 50) -> DataFrame:
    """docs (source_id, content, name): by the strategy that the name's extension asks for."""
    from sparkquill.functions.text import chunking_strategy

    named = docs.withColumn("__strategy", chunking_strategy(F.coalesce("name", F.lit(""))))
    plain = with_overlap(semantic_chunks(named.filter("__strategy = 'recursive'"), most), overlap)
    return plain.unionByName(stored_type(markdown_chunks(named.filter("__strategy = 'markdown'"), most)))
