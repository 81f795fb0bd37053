"""Analyzers and scalar derivations as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as many

#: A word: letters and digits of any script, joined by single hyphens.
WORD = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
#: A token of the lexical index, where . _ - belong to words.
LEXICAL = r"[\p{L}\p{N}._-]+"

#: Precomposed small letters and the letter of a to z that they stand on; the long s counts as s, and ǡ is left out, as in SQLite's table.
PLAIN = {c: b for c in map(chr, range(0x80, 0x2000)) if c == c.lower() and c != "ǡ" and "a" <= (b := unicodedata.normalize("NFD", c)[0].replace("ſ", "s")) <= "z"}

# What sends a query to the lexical index.
LEXICAL_PATTERNS = [r"[A-Z]{2,}-\d+", r"CVE-\d{4}-\d+", r"^[a-f0-9]{32,64}$"]

# Tool names that count as keywords.
TOOLS = [
    "nmap", "burp", "metasploit", "wireshark", "hydra", "john", "hashcat", "gobuster", "nikto",
    "sqlmap", "nuclei", "ffuf", "bloodhound", "mimikatz", "responder", "crackmapexec", "impacket",
]

# Words that ask rather than name a subject, beginnings of such words, and lead-ins of questions.
ASKING = ["что", "чем", "чём", "чего", "чему"]
ASKING_PREFIXES = ["как", "наш", "материал", "сказ", "говор", "рассказ", "расскаж", "информац", "данн", "известн", "описан", "упомян", "упомин"]
LEAD_INS = [
    "что в наших материалах сказано об ",
    "что в наших материалах сказано о ",
    "что в материалах сказано об ",
    "что в материалах сказано о ",
    "что сказано об ",
    "что сказано о ",
]

# Control strings that are defused in text from outside, in this order, as (first character)(rest).
_ROLE = "(?:system|instructions?|assistant|user|developer)[ \\t]*:"
SENTINELS = [
    r"(<)(\|[A-Za-z0-9_]{1,32}\|>)",
    r"(?i)(<)(</?SYS>>)",
    r"(?i)(\[)(/?INST\])",
    r"(?i)(<)(/?(?:system|instructions?|assistant|user|human)\s*>)",
    r"(?i)(<)(/?external_content\b[^>]*>)",
    rf"(?im)^(?:([ \t])([ \t]{{0,2}}#{{1,6}}[ \t]*{_ROLE})|(#)(#{{0,5}}[ \t]*{_ROLE}))",
]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at both ends (trim knows blanks only)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def words(x: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(WORD), F.lit(0))


def tokens(x: Column | str) -> Column:
    """Words in order, with repeats; a hyphenated word with a digit is followed by its parts of two letters or more."""
    parts = lambda t: F.concat(F.array(t), F.filter(F.split(t, "-"), lambda p: F.length(p) >= 2))
    return F.flatten(F.transform(words(x), lambda t: F.when(F.contains(t, F.lit("-")) & t.rlike(r"\d"), parts(t)).otherwise(F.array(t))))


def lexical_tokens(x: Column | str) -> Column:
    """Lower case without diacritics; . _ - are letters. Letters fold as by SQLite's unicode61 with remove_diacritics 2: precomposed ones to their
    letter of a to z; precomposed Greek and Cyrillic ones stay. Marks of their own are dropped."""
    plain = F.translate(F.lower(_c(x)), "".join(PLAIN), "".join(PLAIN.values()))
    return F.regexp_extract_all(F.regexp_replace(plain, r"\p{M}", ""), F.lit(LEXICAL), F.lit(0))


def blank_tokens(x: Column | str) -> Column:
    """The distinct blank-separated words, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(x)), r"\s+"), lambda t: t != ""))


def phrases(query: Column | str) -> Column:
    """T4: each blank-separated part of a query as a list of lexical tokens that have to stand side by side."""
    return F.filter(F.transform(F.filter(F.split(_c(query), r"\s+"), lambda t: t != ""), lexical_tokens), lambda p: F.size(p) > 0)


def stems(x: Column | str, stop: Sequence[str] = tuple(ASKING), stop_prefixes: Sequence[str] = tuple(ASKING_PREFIXES)) -> Column:
    """The first six letters of words of three letters or more, distinct, in order."""
    w = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    keep = lambda t: (F.length(t) >= 3) & (~t.isin(*stop) if stop else F.lit(True)) & (~t.rlike("^(?:" + "|".join(stop_prefixes) + ")") if stop_prefixes else F.lit(True))
    return F.array_distinct(F.transform(F.filter(w, keep), lambda t: F.substring(t, 1, 6)))


def subject(query: Column | str, prefixes: Sequence[str] = tuple(LEAD_INS)) -> Column:
    """A query without its lead-in; the query itself where nothing is left."""
    q = F.ltrim(_c(query))
    out = _c(query)
    for p in reversed(prefixes):
        rest = F.regexp_replace(strip(F.substring(q, len(p) + 1, 1 << 30)), r"^[?!.,;:]+|[?!.,;:]+$", "")
        out = F.when(F.startswith(F.lower(q), F.lit(p)), F.when(rest != "", rest).otherwise(_c(query))).otherwise(out)
    return out


def route(query: Column | str, patterns: Sequence[str] = tuple(LEXICAL_PATTERNS)) -> Column:
    """lexical if any pattern is found in the query, else semantic."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | _c(query).rlike(p)
    return F.when(F.coalesce(hit, F.lit(False)) & (_c(query) != ""), "lexical").otherwise("semantic")


def category(path: Column | str, patterns: dict[str, str], default: str = "general") -> Column:
    """P5: the category of the longest pattern that the path holds; of equally long ones, the first given."""
    p = F.lower(F.replace(_c(path), F.lit("\\"), F.lit("/")))
    if len(patterns) > many.FEW:
        return F.coalesce(many.longest(p, patterns), F.lit(default))
    out = F.lit(default)
    for pattern, name in reversed(sorted(patterns.items(), key=lambda x: -len(x[0]))):
        out = F.when(F.contains(p, F.lit(pattern)), name).otherwise(out)
    return out


def keywords(text: Column | str, routes: dict[str, Sequence[str]]) -> Column:
    """Route keywords and tools that the text holds, CVE ids, technique ids, and addresses if there are five at most; sorted."""
    t = _c(text)
    low = F.lower(t)
    known = list(dict.fromkeys([k.lower() for ks in routes.values() for k in ks] + TOOLS))
    held = many.held(low, known) if len(known) > many.FEW else F.filter(F.array(*[F.lit(k) for k in known]), lambda k: F.contains(low, k))
    cve = F.regexp_extract_all(t, F.lit(r"(?i)CVE-\d{4}-\d{4,}"), F.lit(0))
    technique = F.regexp_extract_all(t, F.lit(r"T\d{4}(?:\.\d{3})?"), F.lit(0))
    ip = F.regexp_extract_all(t, F.lit(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), F.lit(0))
    ip = F.when(F.size(ip) <= 5, ip).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(held, cve, technique, ip)))


def path_boost(query: Column | str, source: Column | str, filename: Column | str) -> Column:
    """0.0006 for a query word among the path's words, 0.0003 for one inside the path, 0.0012 for the whole query; 0.003 at most."""
    path = F.lower(F.concat(F.coalesce(_c(source), F.lit("")), F.lit(" "), F.coalesce(_c(filename), F.lit(""))))
    names, q = words(path), words(query)
    each = F.aggregate(q, F.lit(0.0), lambda s, t: s + F.when(F.array_contains(names, t), 0.0006).when(F.contains(path, t), 0.0003).otherwise(0.0))
    whole = F.lower(strip(query))
    all_ = F.when((whole != "") & F.contains(path, whole), 0.0012).otherwise(0.0)
    return F.when((F.size(q) == 0) | (F.size(names) == 0), 0.0).otherwise(F.least(each + all_, F.lit(0.003)))


def last_at(x: Column, what: str, start: int) -> Column:
    """0-based place of the last occurrence of a string at or after start, else -1."""
    tail = F.substring(x, start + 1, 1 << 30)
    back = F.instr(F.reverse(tail), what[::-1])
    return F.when(back > 0, F.lit(start) + F.length(tail) - (back - 1) - len(what)).otherwise(-1)


def snippet(text: Column | str, most: int = 500) -> Column:
    """At most so many characters, cut at a line, a sentence or a word in the last two fifths."""
    t = _c(text)
    head, low = F.substring(t, 1, most), int(most * 0.6)
    out = F.concat(head, F.lit("..."))
    blank = last_at(head, " ", low)
    out = F.when(blank > low, F.concat(F.substring(head, F.lit(1), blank), F.lit(" ..."))).otherwise(out)
    for sep in ("; ", "! ", "? ", ". "):
        at = last_at(head, sep, low)
        out = F.when(at > low, F.concat(F.substring(head, F.lit(1), at + 1), F.lit(" ..."))).otherwise(out)
    line = last_at(head, "\n", low)
    out = F.when(line > low, F.concat(F.regexp_replace(F.substring(head, F.lit(1), line), r"(?U)\s+$", ""), F.lit("\n..."))).otherwise(out)
    return F.when(F.length(t) <= most, t).otherwise(out)


def neutralized(text: Column | str) -> Column:
    """A zero-width space behind the first character of each control string."""
    out = _c(text)
    for p in SENTINELS:
        out = F.regexp_replace(out, p, "$1$3\u200b$2$4" if "|(#)" in p else "$1\u200b$2")
    return out


def attribute(x: Column | str) -> Column:
    """A source name that is safe inside an attribute: no quotes, angle brackets or control characters, 512 characters."""
    return F.substring(F.regexp_replace(_c(x), r"[\p{C}\p{Zl}\p{Zp}\"'<>]", ""), 1, 512)


def fenced(text: Column | str, source: Column | str) -> Column:
    """The text inside its provenance marker."""
    t = _c(text)
    return F.concat(F.lit('<external_content source="'), attribute(source), F.lit('" sha256="'), F.sha2(t, 256), F.lit('">\n'), t, F.lit("\n</external_content>"))


MARKER = r'(?i)^\s*<external_content\s+source="([^"]*)"\s+sha256="([0-9a-f]{64})"\s*>'


def marker(text: Column | str) -> Column:
    """Source and sha256 of a marker that opens the text, else null."""
    t = _c(text)
    return F.when(t.rlike(MARKER), F.struct(F.regexp_extract(t, MARKER, 1).alias("source"), F.regexp_extract(t, MARKER, 2).alias("sha256")))


def content_hash(text: Column | str) -> Column:
    """P4"""
    return F.substring(F.sha2(_c(text), 256), 1, 20)


def document_key(path: Column, mtime: Column, size: Column) -> Column:
    """P3"""
    return F.substring(F.sha2(F.concat_ws(":", path, mtime, size), 256), 1, 16)


def slug(x: Column | str) -> Column:
    """At most 60 letters, digits and hyphens."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 60)


def path_matches(expected: Column | str, source: Column | str) -> Column:
    """equality for an absolute path; for a relative one also the end of the source at a path boundary."""
    e, s = (F.replace(F.coalesce(_c(x), F.lit("")), F.lit("\\"), F.lit("/")) for x in (expected, source))
    absolute = F.startswith(e, F.lit("/")) | e.rlike("^[A-Za-z]:/")
    return (e != "") & (s != "") & ((s == e) | (~absolute & F.endswith(s, F.concat(F.lit("/"), e))))


def finite(x: Column | str) -> Column:
    """the number, or null where it is none."""
    c = _c(x).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    d = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(_c(a), _c(b), d), F.lit(0.0), lambda s, v: s + v)


def _matching(rx: Column):
    return lambda part: F.rlike(part, rx)


def excluded(path: Column | str, patterns: Sequence[str]) -> Column:
    """Whether a glob matches the relative path or one of its parts."""
    import fnmatch

    out = F.lit(False)
    for p in patterns:
        rx = F.lit("^" + fnmatch.translate(p))
        out = out | F.rlike(_c(path), rx) | (F.size(F.filter(F.split(_c(path), "/"), _matching(rx))) > 0)
    return out
