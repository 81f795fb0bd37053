"""Operator 9, media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a value. Each hit goes to its format's
validator, which checks structure and lengths and gives the extent of the file; hits without a valid structure count for
nothing. A valid hit at 0 that spans the value names its true type, which corrects a declared one; valid
hits further in are embedded media, which can be carved out.

store() keeps byte payloads as lossless media: 8-bit mono PCM in a WAVE file, one sample a byte, in a column with the type that the
payload is declared as. restore() sniffs the stored bytes, corrects that type, takes the payload from the validated data chunk and carves
the media that lie in it. The query writes the media table to the shared folder and reads it again.

A PDF may hold several %%EOF (updates, linearized files): it ends with the last one that a startxref with its number precedes before the next
header, and the line end behind it.

Very long values are gone through once: places that validators look for are found once a value (`Marks`), and chains of blocks that
several hits run into are followed once.

Cases: null content gives null type and no embedded media, as an empty one does; equal contents give equal
results; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import by_bytes, table, written

RATE = 8000


class Marks:
    """Where a value's marks are, each found when it is first asked for, and what is known of chains that begin at a place."""

    def __init__(self, b: bytes):
        self.b, self.places, self.known, self._zips = b, {}, {}, None

    def of(self, mark: bytes) -> list[int]:
        got = self.places.get(mark)
        if got is None:
            got, p = [], self.b.find(mark)
            while p >= 0:
                got.append(p)
                p = self.b.find(mark, p + 1)
            self.places[mark] = got
        return got

    def zips(self) -> dict[int, int]:
        """By a file's first byte the end of the first directory that fits."""
        if self._zips is None:
            b, self._zips = self.b, {}
            for end in self.of(b"PK\x05\x06"):
                if end + 22 <= len(b):
                    size, offset, note = struct.unpack("<IIH", b[end + 12 : end + 22])
                    at = end - offset - size
                    if at >= 0 and (size == 0 or b[at + offset : at + offset + 4] == b"PK\x01\x02") and end + 22 + note <= len(b):
                        self._zips.setdefault(at, end + 22 + note)
        return self._zips

    def chain(self, name, p: int, step) -> int:
        """step(p): the place behind p as (next, None), or the outcome as (None, end). Places that lead to a known one aren't followed on."""
        path = []
        while True:
            out = self.known.get((name, p))
            if out is None:
                path.append(p)
                after, out = step(p)
                if out is None:
                    p = after
                    continue
            for x in path:
                self.known[name, x] = out
            return out


def _wave(b: bytes, at: int, marks: Marks) -> int:
    """Each validator gives the end of the file that starts at `at`, or 0."""
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return 0
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return 0
    p, seen = at + 12, set()
    while p + 8 <= end:
        seen.add(b[p : p + 4])
        p += 8 + (n := int.from_bytes(b[p + 4 : p + 8], "little")) + n % 2
    return end if p == end and {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int, marks: Marks) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or first and n != 13 or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p
    return 0


def _gif(b: bytes, at: int, marks: Marks) -> int:
    if len(b) < at + 14:
        return 0

    def block(p: int):
        if p < len(b):
            return (p + 1 + b[p], None) if b[p] else (None, p + 1 if p + 1 <= len(b) else 0)
        return None, 0

    def part(p: int):
        if p < len(b) and b[p] == 0x3B:
            return None, p + 1
        if p < len(b) and b[p] == 0x21:
            end = marks.chain("gif block", p + 2, block)
        elif p + 10 < len(b) and b[p] == 0x2C:
            end = marks.chain("gif block", p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0), block)
        else:
            end = 0
        return (end, None) if end else (None, 0)

    return marks.chain("gif", at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0), part)


def _jpeg(b: bytes, at: int, marks: Marks) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, n = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if mark == 0xDA:
            p += 2 + n
            while 0 <= (p := b.find(b"\xff", p)) < len(b) - 1:
                if b[p + 1] == 0xD9:
                    return p + 2
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
            if p < 0 or p >= len(b) - 1:
                return 0
        elif n < 2 or mark in (0, 0xFF):
            return 0
        else:
            p += 2 + n
    return 0


def _pdf(b: bytes, at: int, marks: Marks) -> int:
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return 0
    heads, ends, starts = (marks.of(m) for m in (b"%PDF-", b"%%EOF", b"startxref"))
    after = bisect.bisect_right(heads, at)
    stop, out = heads[after] if after < len(heads) else len(b), 0
    for i in range(bisect.bisect_left(ends, at), bisect.bisect_left(ends, stop)):
        end, before = ends[i], bisect.bisect_left(starts, ends[i]) - 1
        # only the first %%EOF behind a startxref can have nothing but its number between them
        if before >= 0 and starts[before] >= at and not (i and ends[i - 1] > starts[before]) and b[starts[before] + 9 : end].strip().isdigit():
            out = end + 5
    for line_end in (b"\r\n", b"\n", b"\r"):
        if out and b[out : out + len(line_end)] == line_end:
            return out + len(line_end)
    return out


def _zip(b: bytes, at: int, marks: Marks) -> int:
    return marks.zips().get(at, 0)


def _bmp(b: bytes, at: int, marks: Marks) -> int:
    if len(b) < at + 26:
        return 0
    size, _, offset, header = struct.unpack("<IIII", b[at + 2 : at + 18])
    return at + size if header in (12, 40, 52, 56, 108, 124) and 14 + header <= offset <= size and at + size <= len(b) else 0


def _ogg(b: bytes, at: int, marks: Marks) -> int:
    def page(p: int):
        if not (b[p : p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0):
            return None, p
        sizes = b[p + 27 : p + 27 + b[p + 26]]
        end = p + 27 + len(sizes) + sum(sizes)
        return (None, 0) if len(sizes) < b[p + 26] or end > len(b) else (end, None)

    end = marks.chain("ogg", at, page)
    return end if end > at else 0


def _gzip(b: bytes, at: int, marks: Marks) -> int:
    d = zlib.decompressobj(31)
    try:
        rest = memoryview(b)[at:]
        while not d.eof and len(rest):
            d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
        return len(b) - len(d.unused_data) if d.eof else 0
    except zlib.error:
        return 0


#: Media type, its magic bytes, its validator.
FORMATS = [
    ("audio/wav", b"RIFF", _wave),
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/gif", b"GIF87a", _gif),
    ("image/gif", b"GIF89a", _gif),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("application/pdf", b"%PDF-", _pdf),
    ("application/zip", b"PK\x03\x04", _zip),
    ("image/bmp", b"BM", _bmp),
    ("application/ogg", b"OggS", _ogg),
    ("application/gzip", b"\x1f\x8b\x08", _gzip),
]


@functools.cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, magic, check in FORMATS:
        a.add_word(magic.decode("latin-1"), (len(magic), kind, check))
    a.make_automaton()
    return a


def sniff_bytes(b: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The true type of a value, and its embedded media as (type, offset, length). Media within found media are not listed again."""
    kind, found, inside, marks = None, [], 0, Marks(b)
    for last, (n, name, check) in automaton().iter(b.decode("latin-1")):
        at = last - n + 1
        if at < inside:
            continue
        end = check(b, at, marks)
        if not end:
            continue
        if at == 0 and end == len(b):
            kind = name  # its parts may hold further media
        else:
            found.append((name, at, end - at))
            inside = end
    return kind, found


SNIFFED = "id long, declared string, kind string, corrected boolean, embedded array<struct<kind:string,offset:long,length:long>>"


def sniff(media: DataFrame, content: str = "content", declared: str | None = None, key: str = "id") -> DataFrame:
    """The true type of each value, whether it corrects the declared one, and where media are embedded."""

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, 2, 8 << 20):
                said = b.column(1).to_pylist()
                got = [sniff_bytes(x or b"") for x in b.column(2).to_pylist()]
                rows = [{"declared": d, "kind": k, "corrected": k is not None and d is not None and k != d, "embedded": [{"kind": n, "offset": o, "length": m} for n, o, m in e]} for d, (k, e) in zip(said, got, strict=True)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string()), pa.array([r["kind"] for r in rows], pa.string()), pa.array([r["corrected"] for r in rows]), pa.array([r["embedded"] for r in rows], kind)], names=["id", "declared", "kind", "corrected", "embedded"])

    said = F.col(declared).cast("string") if declared else F.lit(None).cast("string")
    return media.select(F.col(key).cast("long").alias("id"), said.alias("declared"), F.col(content).cast("binary").alias("content")).mapInArrow(run, SNIFFED)


def carve(media: DataFrame, content: str = "content", key: str = "id") -> DataFrame:
    """One row per embedded medium, with its bytes."""

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, 1, 8 << 20):
                rows = [(i, n, o, x[o : o + m]) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, o, m in sniff_bytes(x or b"")[1]]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.binary()))], names=["id", "kind", "offset", "content"])

    return media.select(F.col(key).cast("long").alias("id"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "id long, kind string, offset long, content binary")


def wave_of(payload: bytes) -> bytes:
    fmt = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples_of(media: bytes) -> bytes:
    """The data chunk of a validated WAVE file."""
    if _wave(media, 0, Marks(media)) != len(media):
        raise ValueError("not a whole WAVE file")
    p = 12
    while media[p : p + 4] != b"data":
        p += 8 + (n := int.from_bytes(media[p + 4 : p + 8], "little")) + n % 2
    return media[p + 8 : p + 8 + int.from_bytes(media[p + 4 : p + 8], "little")]


STORED = "doc_id long, n_bytes long, declared string, content binary"


def store(docs: DataFrame, declared: str = "text/plain") -> DataFrame:
    """STORED: each text's UTF-8 bytes, zero-filled to a positive multiple of 64, as a WAVE file."""

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, 1, 4 << 20):
                raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
                media = [wave_of(x + b"\0" * (-len(x) % 64 or 64 * (not x))) for x in raw]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([declared] * len(raw), pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "content"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, STORED)


CARVED = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())]))
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "declared string, kind string, corrected boolean, carved array<struct<kind:string,offset:long,length:long,sha256:string>>"
)


def restore(media: DataFrame) -> DataFrame:
    """Reads stored media back: digests of payload and stored form; the sniffed feature (type, rate, embedded media by kind); the declared type,
    the true one and whether they differ; and the media that are carved from the payload, with their digests."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), CARVED]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "kind", "corrected", "carved"]

    def one(doc, n, declared, m):
        payload = samples_of(m)
        kind, embedded = sniff_bytes(m)
        feature = f"{kind};pcm8;rate={RATE};samples={len(payload)};embedded=" + ",".join(f"{k}:{c}" for k, c in sorted(Counter(e[0] for e in embedded).items()))
        carved = [{"kind": k, "offset": o, "length": z, "sha256": hashlib.sha256(m[o : o + z]).hexdigest()} for k, o, z in embedded]
        return doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, declared, kind, declared is not None and kind != declared, carved

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, 3, 4 << 20):
                rows = [one(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "declared", "content").mapInArrow(run, FEATURES)


def op9_media(spark, sf_dir: str) -> DataFrame:
    return restore(written(store(table(spark, sf_dir, "documents")), "media"))
