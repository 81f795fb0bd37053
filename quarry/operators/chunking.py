"""Chunkers: a sliding window that prefers natural breaks (P1), a markdown one that follows sections (P2), and dedup (A10)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

SIZE, OVERLAP, SHORTEST = 1000, 200, 100
BREAKS = ("\n\n", "\n", ". ", " ")


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Windows of a text. One that doesn't reach the end is cut behind the last break of the best kind in its last fifth."""
    at, n = 0, len(text)
    while at < n:
        stop = min(at + size, n)
        if stop < n:
            zone = at + int(size * 0.8)
            cut = next((found + len(b) for b in BREAKS if (found := text.rfind(b, zone, stop)) >= 0), stop)
            stop = cut
        yield at, stop
        at = stop - overlap if stop - overlap > at else stop


def window_chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, str, str]]:
    """(start, end, content, header) of the windows that aren't blank."""
    return [(a, b, body, "") for a, b in spans(text, size, overlap) if (body := text[a:b].strip())]


def _sections(text: str) -> list[str]:
    """Parts that begin at second- and third-level headers outside code fences."""
    fences = [m.span() for m in re.finditer(r"```.*?```", text, re.S)]
    starts = [m.start() for m in re.finditer(r"^#{2,3}\s+", text, re.M) if not any(a < m.start() < b for a, b in fences)]
    edges = sorted({0, *starts, len(text)})
    return [s for a, b in zip(edges[:-1], edges[1:], strict=True) if (s := text[a:b]).strip()]


def _joined(sections: list[str]) -> list[str]:
    """Short sections go in front of the next one, the last short ones behind what was before."""
    out, held = [], ""
    for s in sections:
        s = f"{held}\n\n{s}" if held else s
        held = s if len(s.strip()) < SHORTEST else ""
        if not held:
            out.append(s)
    if held and out:
        out[-1] += "\n\n" + held
    elif held:
        out.append(held)
    return out


def markdown_chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, str, str]]:
    """Sections as chunks; a long one goes through the window, with its header in front of all but the first piece.
    Offsets count the joined sections, not the text."""
    sections = _sections(text)
    if len(sections) <= 1:
        return window_chunks(text, size, overlap)
    out, at = [], 0
    for section in _joined(sections):
        body = section.strip()
        head = re.match(r"#{2,3}\s+.+$", body, re.M)
        header = head[0] if head else ""
        if len(body) <= size:
            out.append((at, at + len(section), body, header))
        else:
            for i, (a, b, piece, _) in enumerate(window_chunks(body, size, overlap)):
                out.append((at + a, at + b, f"{header}\n\n{piece}" if i and header else piece, header))
        at += len(section)
    return out


CHUNKS = "doc_id string, chunk_index int, start_char int, end_char int, content string, section_header string"


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, markdown: str = "false") -> DataFrame:
    """One row a chunk of (doc_id, content), with chunk_id and content_hash. markdown: SQL condition for rows that the markdown chunker takes."""

    def run(frames):
        for f in frames:
            rows = [
                (d, i, a, b, c, h)
                for d, t, md in zip(f["doc_id"], f["content"], f["md"], strict=True)
                for i, (a, b, c, h) in enumerate((markdown_chunks if md else window_chunks)(t or "", size, overlap))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start_char", "end_char", "content", "section_header"])

    c = docs.withColumn("md", F.coalesce(F.expr(markdown), F.lit(False))).select(F.col("doc_id").cast("string"), "content", "md").mapInPandas(run, CHUNKS)
    return c.withColumn("chunk_id", F.concat_ws("_", "doc_id", "chunk_index")).withColumn("content_hash", tx.content_hash("content"))


def deduplicated(c: DataFrame) -> DataFrame:
    """A10: of equal chunks of one document the first. Numbers are not given anew."""
    first = F.row_number().over(Window.partitionBy("doc_id", "content_hash").orderBy("chunk_index"))
    return c.withColumn("_n", first).where("_n = 1").drop("_n")


def register(spark) -> None:
    """chunk_text(text, size, overlap) as a table function for SQL."""
    from pyspark.sql.functions import udtf

    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            for i, (a, b, c, _) in enumerate(window_chunks(text or "", size, overlap)):
                yield i, a, b, c

    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="chunk_index int, start_char int, end_char int, content string"))
