"""Text of PDF files (S5): cross-references of both kinds, object streams, filters, page tree, text operators and character maps.

One file is one row, so this is a per-row helper like the other parsers. What is not read: encrypted files (an error), images, and
characters of fonts that neither have a ToUnicode map nor a simple encoding (left out). Broken cross-references are replaced by a scan for objects.
"""

from __future__ import annotations

import html.entities
import re
import struct
import zlib

WHITE = b"\0\t\n\x0c\r "
BREAK = WHITE + b"()<>[]{}/%"
#: Depth of nested objects and forms.
DEEP = 40


class Name(str):
    pass


class Word(str):
    """An operator or keyword."""


class Ref(tuple):
    pass


class Stream(dict):
    raw = b""


class Reader:
    """Objects of a byte string, one after the other."""

    def __init__(self, b: bytes, at: int = 0):
        self.b, self.at = b, at

    def skip(self) -> None:
        b = self.b
        while self.at < len(b):
            if b[self.at] in WHITE:
                self.at += 1
            elif b[self.at] == 0x25:  # a comment
                ends = [e for e in (b.find(b"\n", self.at), b.find(b"\r", self.at)) if e >= 0]
                self.at = min(ends) if ends else len(b)
            else:
                return

    def word(self) -> bytes:
        start = self.at
        while self.at < len(self.b) and self.b[self.at] not in BREAK:
            self.at += 1
        return self.b[start : self.at]

    def next(self, depth: int = 0):
        """The next object; None at the end."""
        self.skip()
        b, at = self.b, self.at
        if at >= len(b):
            return None
        if depth > DEEP:
            raise ValueError("too deeply nested")
        c = b[at : at + 1]
        if c == b"/":
            self.at += 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self.word()).decode("latin-1"))
        if c == b"(":
            return self.literal()
        if b[at : at + 2] == b"<<":
            self.at += 2
            return self.dictionary(depth)
        if c == b"<":
            end = b.find(b">", at)
            end = len(b) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", b[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.at >= len(b) or b[self.at] == 0x5D:
                    self.at += 1
                    return out
                self.push(out, self.next(depth + 1))
        if c in b")>]{}":
            self.at += 1
            return Word(c.decode())
        word = self.word()
        if re.fullmatch(rb"[+-]?\d+", word):
            return int(word)
        if re.fullmatch(rb"[+-]*\d*\.?\d*(?:-\d*)?", word) and re.search(rb"\d", word):
            return float(re.match(rb"-*\d*\.?\d*", word.lstrip(b"+"))[0].replace(b"--", b"-") or 0)
        return Word(word.decode("latin-1"))

    @staticmethod
    def push(out: list, x) -> None:
        """Two numbers and R are a reference."""
        if x == "R" and isinstance(x, Word) and len(out) > 1 and isinstance(out[-1], int) and isinstance(out[-2], int):
            out[-2:] = [Ref((out[-2], out[-1]))]
        else:
            out.append({"true": True, "false": False, "null": None}.get(x, x) if isinstance(x, Word) else x)

    def dictionary(self, depth: int) -> dict:
        parts: list = []
        while True:
            self.skip()
            if self.at >= len(self.b) or self.b[self.at : self.at + 2] == b">>":
                self.at += 2
                break
            self.push(parts, self.next(depth + 1))
        return {k: v for k, v in zip(parts[::2], parts[1::2], strict=False) if isinstance(k, Name)}

    def literal(self) -> bytes:
        b, out, level, p = self.b, bytearray(), 1, self.at + 1
        plain = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
        while p < len(b):
            c = b[p]
            if c == 0x5C and p + 1 < len(b):
                if m := re.compile(rb"[0-7]{1,3}").match(b, p + 1):
                    out.append(int(m[0], 8) & 255)
                    p = m.end()
                    continue
                if b[p + 1] in b"\r\n":  # a line that goes on
                    p += 3 if b[p + 1 : p + 3] == b"\r\n" else 2
                    continue
                out.append(plain.get(b[p + 1], b[p + 1]))
                p += 2
                continue
            level += (c == 0x28) - (c == 0x29)
            if not level:
                break
            out.append(c)
            p += 1
        self.at = p + 1
        return bytes(out)


def unpredicted(raw: bytes, parms: dict) -> bytes:
    """PNG and TIFF predictors undone."""
    kind, colors, bits, columns = (parms.get(k, d) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if kind < 2:
        return raw
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        out = bytearray(raw)
        for i in range(len(out)):
            if i % width >= step and bits == 8:
                out[i] = (out[i] + out[i - step]) & 255
        return bytes(out)
    rows, before = bytearray(), bytearray(width)
    for at in range(0, len(raw), width + 1):
        tag, row = raw[at], bytearray(raw[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left, up, corner = (row[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
            if tag == 4:
                guess = left + up - corner
                add = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            else:
                add = (0, left, up, (left + up) // 2)[tag] if tag < 4 else 0
            row[i] = (row[i] + add) & 255
        rows += row
        before = row + bytearray(width - len(row))
    return bytes(rows)


def _ascii85(raw: bytes) -> bytes:
    out, group = bytearray(), []
    for c in raw.split(b"~>")[0]:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += struct.pack(">I", sum(d * 85 ** (4 - i) for i, d in enumerate(group)) & 0xFFFFFFFF)
                group = []
    if len(group) > 1:
        n, group = len(group) - 1, group + [84] * (5 - len(group))
        out += struct.pack(">I", sum(d * 85 ** (4 - i) for i, d in enumerate(group)) & 0xFFFFFFFF)[:n]
    return bytes(out)


class File:
    def __init__(self, raw: bytes):
        if b"%PDF-" not in raw[:1024]:
            raise ValueError("no PDF header")
        self.raw, self.places, self.trailer, self.made = raw, {}, {}, {}
        try:
            self.linked(int(re.findall(rb"startxref\s+(\d+)", raw)[-1]))
            if not self.pages_root():
                raise ValueError("no pages")
        except (ValueError, IndexError, KeyError, TypeError, AttributeError, struct.error, zlib.error):
            self.scanned()
        if "Encrypt" in self.trailer:
            raise ValueError("the file is encrypted")

    def pages_root(self):
        return self.get(self.get(self.trailer.get("Root")).get("Pages"))

    def linked(self, at: int) -> None:
        """Cross-references from the last section back; what a later one says holds."""
        seen = set()
        todo = [at]
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.raw):
                continue
            seen.add(at)
            r = Reader(self.raw, at)
            if self.raw[at : at + 64].lstrip(WHITE)[:4] == b"xref":
                r.next()
                while isinstance(first := r.next(), int):
                    for i in range(r.next()):
                        offset, gen, kind = r.next(), r.next(), r.next()
                        if kind == "n":
                            self.places.setdefault(first + i, (1, offset, gen))
                        else:
                            self.places.setdefault(first + i, None)
                trailer = r.next()
                todo += [trailer[k] for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]
            else:
                trailer = self.object_at(at)
                data, widths = self.decoded(trailer), trailer["W"]
                index, p = trailer.get("Index") or [0, trailer["Size"]], 0
                for first, n in zip(index[::2], index[1::2], strict=True):
                    for i in range(n):
                        f = []
                        for w in widths:
                            f.append(int.from_bytes(data[p : p + w], "big") if w else None)
                            p += w
                        kind = 1 if f[0] is None else f[0]
                        self.places.setdefault(first + i, (kind, f[1], f[2] or 0) if kind in (1, 2) else None)
                if isinstance(trailer.get("Prev"), int):
                    todo.append(trailer["Prev"])
            self.trailer = {**{k: v for k, v in trailer.items() if k in ("Root", "Info", "Encrypt")}, **self.trailer}

    def scanned(self) -> None:
        """The last object of each number, wherever it is."""
        self.places, self.made = {}, {}
        for m in re.finditer(rb"(?<!\d)(\d{1,9})\s+(\d{1,5})\s+obj\b", self.raw):
            self.places[int(m[1])] = (1, m.start(), int(m[2]))
        for n in [*self.places]:
            x = self.get(Ref((n, 0)))
            if isinstance(x, Stream) and x.get("Type") == "ObjStm":
                for i, (k, _) in enumerate(self.directory(x)):
                    self.places.setdefault(k, (2, n, i))
            if isinstance(x, dict) and x.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in x.items() if k in ("Root", "Info", "Encrypt")}
        for n in [*self.places]:
            x = self.get(Ref((n, 0)))
            if isinstance(x, dict) and x.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref((n, 0)))
        for m in re.finditer(rb"trailer", self.raw):
            x = Reader(self.raw, m.end()).next()
            self.trailer |= {k: v for k, v in (x.items() if isinstance(x, dict) else ()) if k in ("Root", "Info", "Encrypt")}

    def object_at(self, at: int):
        r = Reader(self.raw, at)
        if not isinstance(r.next(), int) or not isinstance(r.next(), int) or r.next() != "obj":
            raise ValueError("no object")
        out = []
        r.push(out, r.next())
        keep = r.at
        for _ in range(2):  # a reference has three words
            x = r.next()
            if isinstance(out[0], int) and (isinstance(x, int) or x == "R"):
                r.push(out, x)
        r.at = keep
        if isinstance(out[0], dict) and r.next() == "stream":
            p = r.at + (2 if self.raw[r.at : r.at + 2] == b"\r\n" else 1)
            s = Stream(out[0])
            n = s.get("Length")
            n = self.get(n) if isinstance(n, Ref) and n[0] in self.places else n
            if not isinstance(n, int) or self.raw[p + n : p + n + 20].lstrip(WHITE)[:9] != b"endstream":
                end = self.raw.find(b"endstream", p)
                n = (end if end >= 0 else len(self.raw)) - p
            s.raw = self.raw[p : p + n]
            return s
        return out[0]

    def directory(self, s: Stream) -> list[tuple[int, int]]:
        r = Reader(self.decoded(s))
        return [(r.next(), r.next()) for _ in range(self.get(s["N"]))]

    def get(self, x, depth: int = 0):
        """What a reference stands for."""
        while isinstance(x, Ref):
            n = x[0]
            if depth > DEEP:
                return None
            if n not in self.made:
                place, self.made[n] = self.places.get(n), None
                if place and place[0] == 1:
                    self.made[n] = self.object_at(place[1])
                elif place:
                    s = self.get(Ref((place[1], 0)), depth + 1)
                    inner = next(o for k, o in self.directory(s) if k == n)
                    self.made[n] = Reader(self.decoded(s), self.get(s["First"]) + inner).next()
            x, depth = self.made[n], depth + 1
        return x

    def decoded(self, s: Stream) -> bytes:
        raw = s.raw
        filters, parms = self.get(s.get("Filter")), self.get(s.get("DecodeParms"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        parms = parms if isinstance(parms, list) else [parms] * len(filters)
        for f, p in zip(map(self.get, filters), [*map(self.get, parms), *[None] * len(filters)], strict=False):
            if f in ("FlateDecode", "Fl"):
                d = zlib.decompressobj()
                raw = unpredicted(d.decompress(raw) + d.flush(), {k: self.get(v) for k, v in (p or {}).items()})
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw.split(b">")[0])
                raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif f in ("ASCII85Decode", "A85"):
                raw = _ascii85(raw)
            else:
                raise ValueError(f"filter {f}")
        return raw

    def pages(self):
        """Pages in order, with what they inherit."""
        seen, todo = set(), [(self.trailer.get("Root") and self.get(self.trailer["Root"]).get("Pages"), {})]
        while todo:
            ref, inherited = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref) if isinstance(ref, Ref) else None
            own = inherited | {k: node[k] for k in ("Resources",) if k in node}
            if "Kids" in node:
                todo += [(k, own) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                yield node | own

    def text_of(self, page: dict) -> str:
        content = self.get(page.get("Contents"))
        parts = [self.get(x) for x in content] if isinstance(content, list) else [content]
        out = Writer()
        self.run(b"\n".join(self.decoded(x) for x in parts if isinstance(x, Stream)), self.get(page.get("Resources")) or {}, out, 0)
        return out.text()

    def run(self, raw: bytes, resources: dict, out: Writer, depth: int) -> None:
        r, args, fonts, font = Reader(raw), [], self.get(resources.get("Font")) or {}, None
        made: dict = {}
        while (x := r.next()) is not None:
            if not isinstance(x, Word):
                args.append(x)
                continue
            if x in ("true", "false", "null"):
                args.append(None)
            elif x == "Tf" and len(args) > 1:
                if args[-2] not in made:
                    made[args[-2]] = Font(self, self.get(fonts.get(args[-2])) or {})
                font, out.size = made[args[-2]], args[-1] if isinstance(args[-1], (int, float)) else out.size
            elif x in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
                if x != "Tj":
                    out.line()
                out.put(font.text(args[-1]) if font else args[-1].decode("latin-1"))
            elif x == "TJ" and args and isinstance(args[-1], list):
                for a in args[-1]:
                    if isinstance(a, bytes):
                        out.put(font.text(a) if font else a.decode("latin-1"))
                    elif isinstance(a, (int, float)) and a < -200:
                        out.gap()
            elif x in ("Td", "TD") and len(args) > 1:
                out.moved(args[-2], args[-1])
            elif x == "Tm" and len(args) > 5:
                out.placed(args[-2], args[-1])
            elif x == "T*":
                out.line()
            elif x == "ET":
                out.gap()
            elif x == "BT":
                out.placed(0, None)
            elif x == "BI":  # an image in the text; its bytes are passed over
                end = re.compile(rb"\sEI(?=\s|\Z)").search(raw, r.at)
                r.at = end.end() if end else len(raw)
            elif x == "Do" and args and depth < DEEP:
                form = self.get((self.get(resources.get("XObject")) or {}).get(args[-1]))
                if isinstance(form, Stream) and form.get("Subtype") == "Form":
                    self.run(self.decoded(form), self.get(form.get("Resources")) or resources, out, depth + 10)
            args = []


class Writer:
    """Text as it is put on a page: moves down or up begin lines, gaps become blanks."""

    def __init__(self):
        self.parts, self.size, self.y = [], 1, None

    def put(self, text: str) -> None:
        if text:
            self.parts.append(text)

    def gap(self) -> None:
        if self.parts and not self.parts[-1].endswith((" ", "\n")):
            self.parts.append(" ")

    def line(self) -> None:
        if self.parts and not self.parts[-1].endswith("\n"):
            self.parts.append("\n")

    def moved(self, x, y) -> None:
        if y:
            self.line()
            self.y = None if self.y is None else self.y + y
        elif x:
            self.gap()

    def placed(self, x, y) -> None:
        if y is not None and self.y is not None and y != self.y:
            self.line()
        elif self.y is not None:
            self.gap()
        self.y = y if y is not None else self.y

    def text(self) -> str:
        return "\n".join(s for s in (" ".join(x.split(" ")).rstrip() for x in "".join(self.parts).split("\n")) if s.strip())


class Font:
    """Bytes of strings to text."""

    def __init__(self, file: File, font: dict):
        self.wide = font.get("Subtype") == "Type0"
        self.codec = {"MacRomanEncoding": "mac_roman"}.get(str(file.get(font.get("Encoding"))), "cp1252")
        self.own: dict[int, str] = {}
        encoding = file.get(font.get("Encoding"))
        if isinstance(encoding, dict):
            self.codec = "mac_roman" if encoding.get("BaseEncoding") == "MacRomanEncoding" else "cp1252"
            code = 0
            for x in file.get(encoding.get("Differences")) or []:
                if isinstance(x, int):
                    code = x
                else:
                    self.own[code] = glyph(x)
                    code += 1
        self.map: dict[bytes, str] = {}
        self.widths = [2] if self.wide else [1]
        stream = file.get(font.get("ToUnicode"))
        if isinstance(stream, Stream):
            self.read(file.decoded(stream))

    def read(self, raw: bytes) -> None:
        r, args = Reader(raw), []
        text = lambda b: b.decode("utf-16-be", "replace")
        while (x := r.next()) is not None:
            if not isinstance(x, Word):
                args.append(x)
                continue
            if x == "endcodespacerange" and (sizes := {len(a) for a in args if isinstance(a, bytes)}):
                self.widths = sorted(sizes)
            elif x == "endbfchar":
                self.map |= {a: text(b) for a, b in zip(args[::2], args[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif x == "endbfrange":
                for lo, hi, to in zip(args[::3], args[1::3], args[2::3], strict=False):
                    first, last = int.from_bytes(lo, "big"), min(int.from_bytes(hi, "big"), int.from_bytes(lo, "big") + 0xFFFF)
                    for i, code in enumerate(range(first, last + 1)):
                        if isinstance(to, list):
                            if i < len(to):
                                self.map[code.to_bytes(len(lo), "big")] = text(to[i])
                        else:
                            at = (int.from_bytes(to, "big") + i).to_bytes(len(to) + 1, "big")[-len(to) :]
                            self.map[code.to_bytes(len(lo), "big")] = text(at)
            args = []

    def text(self, raw: bytes) -> str:
        if not self.map:
            return "" if self.wide else "".join(self.own.get(c) or bytes([c]).decode(self.codec, "ignore") for c in raw)
        out, p = [], 0
        while p < len(raw):
            n = next((w for w in self.widths if raw[p : p + w] in self.map), self.widths[0])
            got = self.map.get(raw[p : p + n])
            if got is None and not self.wide:
                got = self.own.get(raw[p]) or raw[p : p + 1].decode(self.codec, "ignore")
            out.append(got or "")
            p += n
        return "".join(out)


def glyph(name: str) -> str:
    """The character of a glyph's name, as far as names tell: uniXXXX, letters, and names that HTML has too."""
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name):
        return chr(int(m[1] or m[2], 16))
    base = name.split(".")[0]
    other = {"space": " ", "period": ".", "comma": ",", "hyphen": "-", "colon": ":", "semicolon": ";", "fi": "fi", "fl": "fl", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")"}
    other |= {n: str(i) for i, n in enumerate("zero one two three four five six seven eight nine".split())}
    code = html.entities.name2codepoint.get(base.replace("dieresis", "uml"))
    return base if len(base) == 1 else other.get(base) or (chr(code) if code else "")


def string(x) -> str:
    """A text string of the document's information."""
    if not isinstance(x, bytes):
        return ""
    return x[2:].decode("utf-16-be", "replace") if x[:2] == b"\xfe\xff" else x[3:].decode("utf-8", "replace") if x[:3] == b"\xef\xbb\xbf" else x.decode("latin-1")


def read(raw: bytes) -> tuple[list[str], str, str]:
    """The text of each page, title and author."""
    f = File(raw)
    info = f.get(f.trailer.get("Info")) or {}
    return [f.text_of(p) for p in f.pages()], string(f.get(info.get("Title"))).strip(), string(f.get(info.get("Author"))).strip()
