import io
import json
import zipfile

import pytest

from quarry.sources import parsers as ps
from quarry.sources import snapshot as sn


def zipped(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in files.items():
            z.writestr(n.replace("__", "/").replace("_xml", ".xml").replace("_rels", ".rels") if "/" not in n else n, t)
    return b.getvalue()


def meta(path, raw):
    text, m, error = ps.parse(path, raw)
    assert error is None
    return text, json.loads(m)


def test_markdown_and_text():
    text, m = meta("a/n.md", b"---\nx: 1\n---\n# Title\n## Sub\n```\ncode\n```\n")
    assert text.startswith("# Title") and m["title"] == "Title" and m["has_code_blocks"] and m["has_frontmatter"]
    assert [h["level"] for h in m["headers"]] == [1, 2]
    assert meta("x.txt", b"a\nb\nc")[1]["line_count"] == 3


@pytest.mark.parametrize(
    ("path", "raw", "functions", "classes", "imports"),
    [
        ("a.py", b'"""Doc."""\nimport os, sys\nx = 1\nfrom x.y import z\nclass A:\n    def f(self): pass\ndef g(): pass\n', ["g"], ["A"], ["import os, sys\nx ", "from x.y import z\nclass A"]),
        ("a.cpp", b"#include <vector>\nclass P {};\nint main(int a) {\n return 0; }\n", ["main"], ["P"], ["#include <vector"]),
        ("a.c", b"/** Doc. */\r\n#include \"a/b.h\"\r\ntypedef struct point { int x; } point;\r\nenum color { RED };\r\nint add(int a)\r\n{ return a; }\r\nint later(int a);\r\n", ["add"], ["point", "color"], ['#include "a/b.h"']),
        ("a.h", b"union u { int x; };\nint later(int a);\n", ["later"], ["u"], []),
        ("a.ts", b"import {x} from 'm';\nexport class T {}\ninterface I {}\nexport enum E {}\ntype K = 1;\nexport async function f() {}\nconst g = (a) => a;\n", ["f"], ["T", "I", "E", "K"], ["import {x} from 'm';"]),
        ("a.jsx", b"const a = require('m');\nimport b from 'n'\nfunction f() {}\nclass C {}\n  class D {}\n", ["f"], ["C"], ["const a = require(", "import b from 'n'"]),
        ("a.mq4", b"#property strict\nvoid OnTick() {}\nclass B {};\n", ["OnTick"], ["B"], ["#property strict"]),
    ],
)
def test_code(path, raw, functions, classes, imports):
    _, m = meta(path, raw)
    assert (m["functions"], m["classes"], m["imports"]) == (functions, classes, imports)


def test_data_formats():
    assert meta("a.json", b'{"b": [1], "a": 2}')[1]["keys"] == ["b", "a"]
    assert meta("a.json", b"{bad")[1]["is_valid_json"] is False
    assert meta("a.csv", b'Name,Role\n"A, b",x\n')[0] == "Name | Role\nA, b | x"
    assert meta("a.xml", b'<?xml version="1.0"?><project xmlns="u" xmlns:xsi="v"/>')[1]["root_element"] == "project"
    book = {"nbformat": 4, "metadata": {"kernelspec": {"name": "python3"}}, "cells": [{"cell_type": "markdown", "source": ["# A\n", "b"]}, {"cell_type": "code", "source": "x=1", "outputs": [{"data": "LEAK"}]}, 5]}
    text, m = meta("n.ipynb", json.dumps(book).encode())
    assert "LEAK" not in text and "```python\nx=1\n```" in text and (m["cells"], m["code_cells"]) == (2, 1)
    for odd in (b"[]", b'{"cells": 3}', b'{"cells": [{"source": {}}], "metadata": []}'):
        assert ps.parse("n.ipynb", odd)[2] is None
    assert ps.parse("n.ipynb", b"{")[2]
    assert ps.parse("a.exe", b"x")[2].startswith("unsupported")
    assert ps.parse("a.txt", b"  \n")[0] is None


def test_office():
    w = 'xmlns:w="http://w"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    text, m = meta("a.docx", zipped(**{"word/document.xml": doc}))
    assert text == "## Head\n\nBody\n\na | b" and m["tables"] == 1
    text, m = meta("a.xlsx", zipped(**{"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>x</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row><row><c><v></v></c></row></sheetData></worksheet>'}))
    assert text == "## Sheet: S\nx | 2" and m["sheets"] == ["S"]
    text, m = meta("a.pptx", zipped(**{"ppt/slides/slide1.xml": '<s xmlns:a="http://a"><a:p><a:r><a:t>Hi</a:t></a:r></a:p></s>'}))
    assert text == "## Slide 1\n\nHi" and m["slides"] == 1


def test_page_text():
    title, text = ps.page_text("<html><head><title> T &amp; U </title><script>x('</p>')</script></head><body><nav>n</nav><p>a<br>b</p></body></html>")
    assert title == "T & U" and text.split("\n")[-2:] == ["a", "b"] and "x(" not in text


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "drafts").mkdir()
    for n in ("a.md", "sub/b.TXT", "drafts/c.md", "d.exe"):
        (tmp_path / n).write_text("# X\nbody")
    got = ps.parsed(ps.read_files(spark, str(tmp_path), ("drafts",))).collect()
    assert sorted(r["filename"] for r in got) == ["a.md", "b.TXT"]
    assert all(len(r["doc_id"]) == 16 and r["error"] is None for r in got)


def test_snapshot(spark):
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "name string, content binary")
    import hashlib

    manifest = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest()), ("b", "0"), ("c", "1")], "name string, sha256 string")
    assert [r["name"] for r in sn.verified(files, manifest).collect()] == ["a"]
    assert {(r["name"], r["difference"]) for r in sn.mismatched(files, manifest).collect()} == {("b", "differing"), ("c", "missing")}
    r = spark.createDataFrame([(1, 'T "q"', "b" * 81), (2, None, "short")], "record_id long, title string, body string")
    got = sn.rendered(r, ["title"], "body").collect()
    assert len(got) == 1 and got[0]["markdown"].startswith('---\ntitle: "T \\"q\\""\n---\nbbb')
