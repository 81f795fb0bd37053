"""Parsers by file suffix: content and typed metadata of one file. A parser never raises; its error goes to the row."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import pdf as pdf_file

# Languages of source files by suffix, and the patterns of their leading comment, functions, classes and imports.
_COMMENT = r"/\*\*(.*?)\*/"
_C = {"comment": _COMMENT, "functions": r"^(?:[\w\*]+\s+)+(\w+)\s*\([^;]*$", "classes": r"^(?:typedef\s+)?(?:struct|union|enum)\s+(\w+)", "imports": r'^#include\s+[<"][\w./]+"?'}
_JAVASCRIPT = {"comment": _COMMENT, "functions": r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "classes": r"^(?:export\s+)?class\s+(\w+)", "imports": r"^(?:import\s+.+|(?:const|let|var)\s+.*?=\s*require\s*\()"}
_TYPESCRIPT = {"comment": _COMMENT, "functions": r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "classes": r"^(?:export\s+)?(?:class|interface|enum|type)\s+(\w+)", "imports": r"^import\s+.+"}
_MQL = {"comment": _COMMENT, "functions": r"^(?:[\w\*]+\s+)+(\w+)\s*\(", "classes": r"^class\s+(\w+)", "imports": r"^#(?:include|property)\s+.+"}
LANGUAGES = {
    ".py": ("python", {"comment": r"""^["\'][\'"]{2}(.*?)["\'][\'"]{2}""", "functions": r"^def\s+(\w+)\s*\(", "classes": r"^class\s+(\w+)\s*[:\(]", "imports": r"^(?:from\s+[\w.]+\s+)?import\s+[\w.,\s]+"}),
    ".c": ("c", _C),
    ".h": ("c", _C | {"functions": r"^(?:[\w\*]+\s+)+(\w+)\s*\("}),
    ".cpp": ("cpp", {"comment": _COMMENT, "functions": r"^(?:[\w\*:&]+\s+)+(\w+)\s*\([^;]*$", "classes": r"^(?:class|struct)\s+(\w+)", "imports": r'^#include\s+[<"][\w./]+"?'}),
    ".js": ("javascript", _JAVASCRIPT),
    ".jsx": ("javascript", _JAVASCRIPT),
    ".ts": ("typescript", _TYPESCRIPT),
    ".tsx": ("typescript", _TYPESCRIPT),
    ".mqh": ("mql4", _MQL),
    ".mq4": ("mql4", _MQL),
}


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", errors="replace")


def markdown(raw: bytes, stem: str) -> tuple[str, dict]:
    text = _text(raw)
    body = re.sub(r"\A---\n.*?\n---\n", "", text, count=1, flags=re.S)
    headers = [{"level": len(m[1]), "title": m[2].strip()} for m in re.finditer(r"^(#{1,6})\s+(.+)$", text, re.M)]
    title = next((h["title"] for h in headers if h["level"] == 1), stem)
    return body, {"type": "markdown", "title": title, "headers": headers, "has_code_blocks": "```" in text, "has_frontmatter": body != text}


def plain(raw: bytes, stem: str) -> tuple[str, dict]:
    text = _text(raw)
    return text, {"type": "text", "title": stem, "line_count": text.count("\n") + 1}


def code(raw: bytes, stem: str, suffix: str) -> tuple[str, dict]:
    """Names at the start of a line, imports as they are written (ten at most)."""
    text = raw.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")
    language, patterns = LANGUAGES[suffix]
    found = {k: re.findall(patterns[k], text, re.M) for k in ("functions", "classes", "imports")}
    doc = re.match(patterns["comment"], text, re.S)
    return text, {"type": "code", "title": stem, "language": language, **found, "imports": found["imports"][:10], "docstring": doc[1].strip() if doc else "", "line_count": text.count("\n") + 1}


def xml(raw: bytes, stem: str) -> tuple[str, dict]:
    text = _text(raw)
    root = next((m[1] for m in re.finditer(r"<([A-Za-z_][\w:.-]*)", text) if m[1].lower() != "xml"), "")
    spaces = [{"prefix": m[1] or "default", "uri": m[2]} for m in re.finditer(r"xmlns(?::(\w+))?=[\"']([^\"']+)[\"']", text)]
    return text, {"type": "xml", "title": stem, "root_element": root, "namespaces": spaces}


def json_(raw: bytes, stem: str) -> tuple[str, dict]:
    text = _text(raw)
    try:
        value = json.loads(text)
    except ValueError:
        return text, {"type": "json", "title": stem, "is_valid_json": False}
    meta = {"type": "json", "title": stem, "is_valid_json": True, "structure": type(value).__name__}
    if isinstance(value, dict):
        meta["keys"] = list(value)[:20]
    elif isinstance(value, list):
        meta["length"] = len(value)
    return json.dumps(value, indent=2, ensure_ascii=False), meta


def csv_(raw: bytes, stem: str) -> tuple[str, dict]:
    rows = list(csv.reader(io.StringIO(_text(raw))))
    return "\n".join(" | ".join(r) for r in rows), {"type": "csv", "title": stem, "rows": len(rows), "columns": len(rows[0]) if rows else 0}


def notebook(raw: bytes, stem: str) -> tuple[str, dict]:
    book = json.loads(_text(raw))
    book = book if isinstance(book, dict) else {}
    cells = [c for c in book.get("cells") or [] if isinstance(c, dict)] if isinstance(book.get("cells"), list) else []
    meta = book.get("metadata") if isinstance(book.get("metadata"), dict) else {}
    spec = meta.get("kernelspec") if isinstance(meta.get("kernelspec"), dict) else {}
    info = meta.get("language_info") if isinstance(meta.get("language_info"), dict) else {}
    language = info.get("name") or spec.get("language") or "python"
    out, kinds = [], []
    for c in cells:
        source = c.get("source", "")
        source = "".join(x for x in source if isinstance(x, str)) if isinstance(source, list) else source if isinstance(source, str) else ""
        kinds.append(c.get("cell_type"))
        if source.strip() and c.get("cell_type") == "markdown":
            out.append(source)
        elif source.strip() and c.get("cell_type") == "code":
            out.append(f"```{language}\n{source}\n```")
    number = book.get("nbformat")
    return "\n\n".join(out), {"type": "notebook", "title": stem, "nbformat": number if isinstance(number, int) else None, "kernel": spec.get("name") if isinstance(spec.get("name"), str) else "", "cells": len(cells), "code_cells": kinds.count("code"), "markdown_cells": kinds.count("markdown")}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _within(node, name: str):
    return (x for x in node.iter() if _local(x.tag) == name)


def docx(raw: bytes, stem: str) -> tuple[str, dict]:
    """Paragraphs, with heading styles as #, and tables as rows."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(_within(ElementTree.fromstring(z.read("word/document.xml")), "body"))
    words = lambda n: "".join(t.text or "" for t in _within(n, "t"))
    out, paragraphs, tables = [], 0, 0
    for x in body:
        if _local(x.tag) == "p":
            paragraphs += 1
            line = words(x)
            style = next((v for s in _within(x, "pStyle") for k, v in s.attrib.items() if _local(k) == "val"), "")
            level = re.fullmatch(r"[Hh]eading\s*(\d)", style)
            if line.strip():
                out.append(f"{'#' * int(level[1])} {line}" if level else line)
    for t in _within(body, "tbl"):
        tables += 1
        out += [" | ".join(words(c) for c in _within(r, "tc")) for r in _within(t, "tr")]
    return "\n\n".join(out), {"type": "docx", "title": stem, "paragraphs": paragraphs, "tables": tables}


def xlsx(raw: bytes, stem: str) -> tuple[str, dict]:
    """All sheets, a header each, rows joined; blank rows are dropped."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in _within(s, "t")) for s in _within(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.attrib["Id"]: r.attrib["Target"].lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        out, sheets = [], []
        for i, s in enumerate(_within(book, "sheet"), 1):
            sheets.append(s.attrib.get("name", ""))
            target = rels.get(next((v for k, v in s.attrib.items() if _local(k) == "id"), ""), f"worksheets/sheet{i}.xml")
            out.append(f"## Sheet: {sheets[-1]}")
            for r in _within(ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")), "row"):
                cells = []
                for c in _within(r, "c"):
                    v = next(_within(c, "v"), None)
                    cells.append(strings[int(v.text)] if c.attrib.get("t") == "s" and v is not None else "".join(t.text or "" for t in _within(c, "t")) if c.attrib.get("t") == "inlineStr" else (v.text or "") if v is not None else "")
                if any(x.strip() for x in cells):
                    out.append(" | ".join(cells))
    return "\n".join(out), {"type": "xlsx", "title": stem, "sheets": sheets}


def pptx(raw: bytes, stem: str) -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        out = []
        for i, n in enumerate(slides, 1):
            lines = ["".join(t.text or "" for t in _within(p, "t")) for p in _within(ElementTree.fromstring(z.read(n)), "p")]
            out += [f"## Slide {i}", *(x for x in lines if x.strip())]
    return "\n\n".join(out), {"type": "pptx", "title": stem, "slides": len(slides)}


def pdf(raw: bytes, stem: str) -> tuple[str, dict]:
    """Pages as [Page n] and text, by a blank line; title and author as the file has them."""
    texts, title, author = pdf_file.read(raw)
    pages = [f"[Page {i}]\n{t}" for i, t in enumerate(texts, 1) if t.strip()]
    return "\n\n".join(pages), {"type": "pdf", "title": title or stem, "author": author, "pages": len(texts)}


#: The parser of each suffix. Users may add their own.
PARSERS: dict[str, Callable[[bytes, str], tuple[str, dict]]] = {
    ".md": markdown, ".txt": plain, ".pdf": pdf, ".xml": xml, ".json": json_, ".csv": csv_, ".ipynb": notebook, ".docx": docx, ".xlsx": xlsx, ".pptx": pptx,
    **{s: (lambda raw, stem, suffix=s: code(raw, stem, suffix)) for s in LANGUAGES},
}

META = (
    "struct<title:string,type:string,headers:array<struct<level:int,title:string>>,has_code_blocks:boolean,has_frontmatter:boolean,pages:int,author:string,line_count:int,"
    "language:string,functions:array<string>,classes:array<string>,imports:array<string>,docstring:string,root_element:string,namespaces:array<struct<prefix:string,uri:string>>,"
    "is_valid_json:boolean,keys:array<string>,structure:string,length:int,rows:int,columns:int,paragraphs:int,tables:int,sheets:array<string>,slides:int,nbformat:int,kernel:string,"
    "cells:int,code_cells:int,markdown_cells:int>"
)


def parse(path: str, raw: bytes) -> tuple[str | None, str, str | None]:
    """S3: content, metadata as JSON, error. Blank content is none."""
    p = PurePosixPath(path)
    parser = PARSERS.get(p.suffix.lower())
    if parser is None:
        return None, "{}", f"unsupported format: {p.suffix}"
    try:
        text, meta = parser(raw, p.stem)
    except Exception as e:  # a bad file must not end the job
        return None, "{}", f"{type(e).__name__}: {e}"
    return (text if text.strip() else None), json.dumps(meta, ensure_ascii=False), None


def parsed(files: DataFrame) -> DataFrame:
    """Of binaryFile rows (path, modificationTime, length, content): source, filename, format, content, meta, error, mtime, size."""

    def run(frames):
        for f in frames:
            rows = [parse(p, bytes(c)) for p, c in zip(f["path"], f["content"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "text": [r[0] for r in rows], "meta_json": [r[1] for r in rows], "error": [r[2] for r in rows], "mtime": f["modificationTime"], "size": f["length"]})

    raw = files.select("path", "content", "modificationTime", "length").mapInPandas(run, "path string, text string, meta_json string, error string, mtime timestamp, size long")
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(
        tx.document_key(F.col("path"), F.col("mtime"), F.col("size")).alias("doc_id"), F.col("path").alias("source"), name.alias("filename"),
        F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("format"), F.col("text").alias("content"), F.from_json("meta_json", META).alias("meta"), "error", "mtime", "size",
    )


def read_files(spark, folder: str, exclude: tuple[str, ...] = (), suffixes: tuple[str, ...] = tuple(PARSERS)) -> DataFrame:
    """All files of a folder with a known suffix, but for the excluded ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)
    base = re.sub(r"^file:/+", "/", folder).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^" + re.escape(base) + "/", "")
    return files.where(wanted & ~tx.excluded(relative, exclude)) if exclude else files.where(wanted)


class _Page(HTMLParser):
    DROPPED = ("script", "style", "nav", "footer", "header")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.title, self.in_title, self.parts, self.open = 0, None, False, [], False

    def handle_starttag(self, tag, attrs):
        self.open = False
        self.inside += tag in self.DROPPED
        if tag == "title" and self.title is None:
            self.in_title, self.title = True, ""

    def handle_endtag(self, tag):
        self.open = False
        self.inside = max(0, self.inside - (tag in self.DROPPED))
        if tag == "title":
            self.in_title = False

    def handle_comment(self, data):
        self.open = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.inside:  # the parser may give one text node in parts
            if self.open:
                self.parts[-1] += data
            else:
                self.parts.append(data)
            self.open = True


def page_text(html: str) -> tuple[str, str]:
    """Title and text: one line a text node, stripped, blank ones dropped; scripts, styles and page furniture left out."""
    p = _Page()
    p.feed(html or "")
    p.close()
    lines = (x.strip() for x in "\n".join(p.parts).split("\n"))
    return (p.title or "").strip(), "\n".join(x for x in lines if x)


#: Pages whose texts a task holds at once.
PAGES = 256


def pages(html: DataFrame, key: str = "page_id") -> DataFrame:
    """S15 over fetched pages (key, url, html): title, slug, content as markdown. Only http and https count."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, PAGES):
                part = b.slice(i, PAGES)
                got = [page_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=[key, "url", "title", "text"])

    kind = html.schema[key].dataType.simpleString()
    p = html.where(F.col("url").rlike("^https?://")).select(key, "url", "html").mapInArrow(run, f"{key} {kind}, url string, title string, text string")
    name = F.when(F.col("title") != "", F.col("title")).otherwise(F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/"), -1))
    p = p.withColumn("title", name).withColumn("slug", tx.slug("title"))
    return p.withColumn("content", F.concat(F.lit("# "), "title", F.lit("\n\nSource: "), "url", F.lit("\n\n"), "text"))
