"""Documents from files: pdf, docx, xlsx, csv, html, htm, txt and md."""

from __future__ import annotations

import csv
import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources import text as T

SUFFIXES = (".pdf", ".docx", ".xlsx", ".csv", ".html", ".htm", ".txt", ".md")
Page = tuple[str, int | None]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def html_text(raw: str) -> str:
    """All text nodes, scripts and styles with them, stripped, one a line."""
    lines: list[str] = []
    events = HTMLParser()
    events.handle_data = lambda node: lines.extend(filter(None, [node.strip()]))
    events.feed(raw)
    return "\n".join(lines)


def _csv(raw: bytes) -> list[Page]:
    rows = csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""))
    return [("\n".join(" | ".join(cell.strip() for cell in row) for row in rows), None)]


def _docx(raw: bytes) -> list[Page]:
    """Paragraphs of the body, then the rows of its tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")

    def plain(node: ElementTree.Element) -> str:
        out = []
        for part in node.iter():
            if part.tag == f"{_W}t":
                out.append(part.text or "")
            elif part.tag == f"{_W}tab":
                out.append("\t")
            elif part.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
        return "".join(out)

    lines = [plain(p).strip() for p in body.findall(f"{_W}p")]
    lines = [line for line in lines if line]
    for table in body.findall(f"{_W}tbl"):
        for row in table.findall(f"{_W}tr"):
            lines.append(" | ".join("\n".join(plain(p) for p in cell.findall(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")))
    return [("\n".join(lines), None)]


def _xlsx(raw: bytes) -> list[Page]:
    """A page a sheet: its name and its cells as CSV."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    pages = []
    for number, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_S}sheets"), 1):
        target = links[sheet.get(f"{_R}id")].lstrip("/")
        grid: list[list[str]] = []
        for row in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
            cells: list[str] = []
            for cell in row.findall(f"{_S}c"):
                letters = re.match(r"[A-Z]+", cell.get("r") or "")
                column = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) if letters else len(cells) + 1
                value = cell.find(f"{_S}v")
                text = "".join(t.text or "" for t in cell.iter(f"{_S}t")) if cell.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                if cell.get("t") == "s":
                    text = shared[int(text)]
                cells += [""] * (column - 1 - len(cells)) + [text]
            grid.append(cells)
        width = max(map(len, grid), default=0)
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(row + [""] * (width - len(row)) for row in grid)
        pages.append((f"工作表：{sheet.get('name')}\n{out.getvalue()}", number))
    return pages


def _pdf(raw: bytes) -> list[Page]:
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise RuntimeError("reading PDF files needs the package pypdf") from error
    return [((page.extract_text() or "").strip(), i) for i, page in enumerate(PdfReader(io.BytesIO(raw)).pages, 1)]


def parse_bytes(suffix: str, raw: bytes) -> list[Page]:
    """Pages of one file, without NUL and lone surrogates."""
    suffix = suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file type: {suffix}")
    if suffix in (".html", ".htm"):
        pages = [(html_text(raw.decode("utf-8")), None)]
    elif suffix in (".txt", ".md"):
        pages = [(raw.decode("utf-8"), None)]
    else:
        pages = {".csv": _csv, ".docx": _docx, ".xlsx": _xlsx, ".pdf": _pdf}[suffix](raw)
    return [(clean(text), number) for text, number in pages]


def clean(text: str) -> str:
    return text.replace("\0", "").encode("utf-8", "replace").decode("utf-8")


def check_paths(paths: list[str]) -> None:
    for path in paths:
        if "://" not in path and not os.path.exists(path):
            raise FileNotFoundError(path)
        if Path(path).suffix.lower() not in SUFFIXES:
            raise ValueError(f"unsupported file type: {Path(path).suffix}")


def read_files(spark: SparkSession, paths: list[str], uploads: str | None = None) -> DataFrame:
    """``doc_id, title, source, publish_time, metadata, page_pos, page_number, text``: a row a page."""
    check_paths(paths)
    return parse_files(spark.read.format("binaryFile").load(paths), uploads)


def parse_files(files: DataFrame, uploads: str | None = None) -> DataFrame:
    """As read_files, of rows (path, content); the one place where files meet Python.

    With ``uploads``, the tasks copy each file there, and metadata has its ``stored_path``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [[{"text": t, "page_number": n} for t, n in parse_bytes(Path(path).suffix, raw)] for path, raw in zip(batch["path"], batch["content"], strict=True)]
            stored = [store_copy(raw, Path(path).suffix, doc, uploads) if uploads else None for path, raw, doc in zip(batch["path"], batch["content"], batch["doc_id"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "doc_id": batch["doc_id"], "pages": pages, "stored": stored})

    hashed = files.select("path", "content", T.doc_id(F.col("content")).alias("doc_id"))
    parsed = hashed.mapInPandas(run, "path string, doc_id string, pages array<struct<text:string,page_number:int>>, stored string")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    whole = F.transform("pages", lambda p: p["text"])
    metadata = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("file_type"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("value")),
        F.struct(F.lit("original_path"), F.col("path").alias("value")),
        F.struct(F.lit("stored_path"), F.col("stored").alias("value")),
    ), lambda e: e["value"].isNotNull()))
    described = parsed.select(
        "doc_id",
        T.title(F.array_join(F.slice(whole, 1, 3), "\n"), F.regexp_replace(name, r"\.[^.]*$", "")).alias("title"),
        name.alias("source"),
        T.publish_time(whole).alias("publish_time"),
        metadata.alias("metadata"),
        "pages",
    )
    return described.select("doc_id", "title", "source", "publish_time", "metadata", F.posexplode("pages").alias("page_pos", "page")).select("doc_id", "title", "source", "publish_time", "metadata", "page_pos", "page.page_number", "page.text")


def store_copy(raw: bytes, suffix: str, doc_id: str, uploads: str) -> str:
    """Write a file's bytes to their content address; nothing is done if they lie there."""
    system, folder = fs.FileSystem.from_uri(uploads if "://" in uploads else os.path.abspath(uploads))
    target = f"{folder.rstrip('/')}/{doc_id}{suffix.lower()}"
    if system.get_file_info(target).size != len(raw):
        system.create_dir(folder, recursive=True)
        part = f"{target}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(raw)
        system.move(part, target)
    return target
