"""Hand-made PDFs of both kinds of cross-references."""

import struct
import zlib

import pytest

from quarry.sources import pdf
from quarry.sources.parsers import parse

PAGES = [b"BT /F1 12 Tf 72 700 Td (Hello \\(first\\) page) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET", b"", b"BT /F2 9 Tf 1 0 0 1 10 10 Tm <00410042> Tj T* <0043> Tj ET /X1 Do"]
CMAP = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0041> <0416> endbfchar 1 beginbfrange <0042> <0043> <00E9> endbfrange endcmap"


def stream(data, extra=b"", flate=True):
    data = zlib.compress(data) if flate else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if flate else b"", extra, data)


def objects():
    o = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 /Resources << /Font << /F1 8 0 R /F2 9 0 R >> /XObject << /X1 11 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >>",
        4: b"<< /Type /Pages /Parent 2 0 R /Kids [13 0 R 14 0 R 2 0 R] /Count 2 >>",  # 2 0 R: a cycle
        13: b"<< /Type /Page /Parent 4 0 R /Contents 6 0 R >>",
        14: b"<< /Type /Page /Parent 4 0 R /Contents 7 0 R >>",
        8: b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>",
        9: b"<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>",
        12: b"<< /Title (A \\164itle) /Author <FEFF00C9> >>",
    }
    streams = {5: stream(PAGES[0]), 6: stream(PAGES[1]), 7: stream(PAGES[2], flate=False), 10: stream(CMAP), 11: stream(b"BT (in a form) Tj ET", b"/Type /XObject /Subtype /Form")}
    return o, streams


def classic(broken=False):
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\n"), {}
    o, s = objects()
    for n, body in sorted((o | s).items()):
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n0 15\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % (places[n] + 7 * broken) for n in range(1, 15))
    return bytes(out + b"trailer << /Size 15 /Root 1 0 R /Info 12 0 R >>\nstartxref\n%d\n%%%%EOF" % at)


def modern(predictor=12):
    """Object streams, and a cross-reference stream with a predictor."""
    out, places = bytearray(b"%PDF-1.7\n"), {}
    o, s = objects()
    for n, body in s.items():
        places[n] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    head, bodies = b"", b""
    for i, (n, body) in enumerate(o.items()):
        head += b"%d %d " % (n, len(bodies))
        bodies += body + b" "
        places[n] = (2, 20, i)
    places[20] = (1, len(out), 0)
    out += b"20 0 obj\n" + stream(head + bodies, b"/Type /ObjStm /N %d /First %d" % (len(o), len(head))) + b"\nendobj\n"
    places[21] = (1, len(out), 0)
    rows = [struct.pack(">BHB", *places.get(n, (0, 0, 0))) for n in range(22)]
    before, coded = bytes(4), b""
    for r in rows:
        coded += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, before, strict=True))
        before = r
    at = len(out)
    out += b"21 0 obj\n" + stream(coded, b"/Type /XRef /Size 22 /W [1 2 1] /Root 1 0 R /Info 12 0 R /DecodeParms << /Predictor %d /Columns 4 >>" % predictor) + b"\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)


WANT = "[Page 1]\nHello (first) page\nsecond line\n\n[Page 3]\nЖé\nê in a form"


@pytest.mark.parametrize("raw", [classic(), classic(broken=True), modern(), modern()[:-40]], ids=["classic", "broken", "modern", "cut"])
def test_pages_title_and_author(raw):
    text, meta, error = parse("a/b.pdf", raw)
    assert error is None and text == WANT
    if raw[-40:] in (classic()[-40:], modern()[-40:]):
        assert '"title": "A title"' in meta and '"author": "É"' in meta and '"pages": 3' in meta


def test_what_is_no_pdf():
    assert parse("x.pdf", b"text")[2] and parse("x.pdf", b"")[2] and parse("x.pdf", b"%PDF-1.4")[0] is None
    assert "encrypted" in parse("x.pdf", classic().replace(b"/Info 12 0 R", b"/Encrypt 12 0 R"))[2]


def test_parts():
    assert pdf._ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert pdf.Reader(b"[1 -2.5 (a\\\nb\\051) /N#20x 3 0 R <4> << /A null >>]").next() == [1, -2.5, b"ab)", "N x", (3, 0), b"@", {"A": None}]
    assert [pdf.glyph(n) for n in ("uni0416", "eacute", "a", "five", "Adieresis", "nothing")] == ["Ж", "é", "a", "5", "Ä", ""]
    for tag, row in ((0, [5, 6, 7]), (1, [5, 1, 1]), (2, [4, 4, 4]), (3, [5, 3, 3]), (4, [4, 1, 1])):
        assert len(pdf.unpredicted(bytes([0, 1, 2, 3, tag, *row]), {"Predictor": 15, "Columns": 3})) == 6
    assert pdf.unpredicted(bytes([2, 1, 1, 1, 2, 1, 1, 1]), {"Predictor": 12, "Columns": 3}) == bytes([1, 1, 1, 2, 2, 2])
