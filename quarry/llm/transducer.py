"""Operator 12, BPE encoding and decoding: a streaming transducer with bounded lookahead.

The text comes in blocks. Two machines follow each other, and neither keeps more than a bounded part of what it has read:

Pre-tokens. What stands before a blank between two characters that aren't white is settled, as a pre-token always starts there.
Elsewhere all matches of the pattern but those that reach into the last two characters are (a contraction is known by two letters, a
run by the character behind it). A run that goes on and on, of letters, say, is handed on while it is still open.

Merges. The end of a stream that is still open can change tokens before it only through a chain of merges of rising rank: where two
continuations first differ moves to the left by one token u when a rule (u, v) joins it to a v that only one of them has, and v starts
with the token u that the move before was about. `sufficient_lookahead` gives the longest such chain of the merge list in bytes (320 for
the vocabulary here), with one step for each rule. Tokens that end so many bytes before the end of what is known are
final and leave; the rest is merged again with what follows, which gives the same as merging the whole, as no merge crosses a final token's edge.

Decoding is the machine of UTF-8: bytes of ids are added, and a character not yet whole at the end (three bytes at most) waits.
Bytes that are no UTF-8 become U+FFFD, one for each longest broken part, as the library has it.

Cases: a null or empty text has no ids and decodes to an empty text; a null id of a row stays null; repeated rows give repeated results; very
long texts, also of one pre-token, take blocks of memory besides their own row; an empty table gives no rows; further columns don't
matter. Strings of the special token inside texts are that token, as the library has it by default.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import by_bytes, table
from .vocab import CACHE, WHITE, ranges, tokenizer_path

#: Characters that are fed at once, and those of an unsettled end from which it is treated as an open run.
FED, OPEN = 1 << 16, 1 << 11
#: Bytes of an open pre-token that are merged at once.
BLOCK = 1 << 12


def sufficient_lookahead(rules: list[tuple[bytes, bytes]]) -> int:
    """Bytes before the end of a stream from which on no continuation changes a token, for merges in the order of their ranks."""
    left: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}
    most = 0
    for u, v in rules:
        if any(len(x) > 1 and x not in left for x in (u, v)) or u + v in left:
            raise ValueError("a merge uses a token that no merge before it makes, or makes one twice")
        first, before = v, 0
        while first is not None:  # tokens that v starts with
            before = max(before, reach.get(first, 0))
            first = left.get(first)
        far = len(u) + before
        reach[u] = max(reach.get(u, 0), far)
        most = max(most, far)
        left[u + v] = u
    return most


class Tables:
    """What encoders and decoders of a vocabulary share."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        import tiktoken

        with open(tokenizer_path(name)) as f:
            described = json.load(f)
        model = described["model"]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: how byte-level vocabularies write bytes
        shown = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in letters)}
        ids = {bytes(shown[c] for c in t): i for t, i in model["vocab"].items()}
        rules = [tuple(bytes(shown[c] for c in t) for t in (pair if isinstance(pair, list) else pair.split(" "))) for pair in model["merges"]]
        if any(ids[u + v] != 256 + i for i, (u, v) in enumerate(rules)):
            raise ValueError("ids aren't in the order of the merges")
        self.lookahead = sufficient_lookahead(rules)
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.bytes = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in [*ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes[i] = t
        self.decimals = [str(i).encode() for i in range(len(self.bytes))]
        self.block = max(BLOCK, 2 * (self.lookahead + max(map(len, self.bytes))))
        self.merge = tiktoken.Encoding(name, pat_str=r"\S+", mergeable_ranks=ids, special_tokens={})._encode_single_piece
        word, number = ranges("L"), ranges("N")
        other = f"[^{WHITE}{word}{number}]"
        self.pattern = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{word}]+| ?[{number}]+| ?{other}+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.runs = {k: re.compile(f"[{c}]*") for k, c in (("word", word), ("number", number), ("white", WHITE))} | {"other": re.compile(f"{other}*")}
        self.edge = re.compile(f"(?<=[^{WHITE}])(?= [^{WHITE}])")
        self.white = re.compile(f"[{WHITE}]")
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, bytes] = {"": b""}

    def kind(self, text: str) -> str:
        """The class of the run that a pre-token is."""
        c = text[1] if text[0] == " " and len(text) > 1 else text[0]
        return next(k for k, run in self.runs.items() if run.match(c).end())

    def part(self, text: str) -> bytes:
        """Ids of whole pre-tokens."""
        got = array("I", [i for t in self.pattern.findall(text) for i in self.merge(t.encode())]).tobytes()
        if len(text) <= 64 and not self.white.match(text[-1]) and not self.white.match(text[1:2]):
            if len(self.known) > CACHE:
                self.known.clear()
                self.known[""] = b""
            self.known[text] = got
        return got

    def settled(self, text: str) -> bytes:
        """Ids of text between two edges of pre-tokens."""
        known = self.known
        if "\0" not in text:
            try:  # parts that are known don't end in white space, nor does a second white character follow their blank
                return b"".join(map(known.__getitem__, text.replace(" ", "\0 ").split("\0")))
            except KeyError:
                pass
        return b"".join([known.get(p) or self.part(p) for p in self.edge.split(text) if p])


@functools.cache
def tables(name: str = "byte_bpe_50k.json") -> Tables:
    return Tables(name)


class Merger:
    """Tokens of one pre-token whose bytes come in pieces."""

    def __init__(self, t: Tables):
        self.t, self.held = t, b""

    def feed(self, raw: bytes) -> list[int]:
        t, held, start, out = self.t, self.held + raw, 0, []
        while len(held) - start >= t.block:
            end, final = start, start + t.block - t.lookahead
            for i in t.merge(held[start : start + t.block]):
                if end + len(t.bytes[i]) > final:
                    break
                end += len(t.bytes[i])
                out.append(i)
            start = end
        self.held = held[start:]
        return out

    def close(self) -> list[int]:
        held, self.held = self.held, b""
        return list(self.t.merge(held)) if held else []


class Encoder:
    """feed() and finish() give the ids of a stream of text, as little-endian uint32, as soon as they are final."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        self.t = tables(name)
        self.tail, self.open, self.merger = "", None, Merger(self.t)

    def held(self) -> int:
        """Characters and bytes that wait."""
        return len(self.tail) + len(self.merger.held)

    def feed(self, text: str) -> bytes:
        return self._marked(self.tail + text, False)

    def finish(self) -> bytes:
        return self._marked(self.tail, True)

    def _marked(self, text: str, last: bool) -> bytes:
        out, t = [], self.t
        if t.marks:
            at = 0
            for m in t.marks.finditer(text):
                out += [self._plain(text[at : m.start()], True), array("I", [t.special[m[0]]]).tobytes()]
                at = m.end()
            text = text[at:]
            if not last:  # a mark may have begun
                most = max(map(len, t.special)) - 1
                begun = next((n for n in range(min(most, len(text)), 0, -1) if any(s.startswith(text[-n:]) and len(s) > n for s in t.special)), 0)
                kept = text[len(text) - begun :]
                out.append(self._plain(text[: len(text) - begun], False))
                self.tail += kept
                return b"".join(out)
        out.append(self._plain(text, last))
        return b"".join(out)

    def _plain(self, text: str, last: bool) -> bytes:
        """Ids of the settled part of a text without marks; the rest becomes the tail."""
        out, t = [], self.t
        self.tail = ""
        if self.open:
            end = t.runs[self.open].match(text).end()
            goes_on = end == len(text) and not last
            if self.open == "white" and (goes_on or end < len(text)):
                end = max(0, end - 1)  # the last one may belong to what follows
            out.append(array("I", self.merger.feed(text[:end].encode())).tobytes())
            text = text[end:]
            if goes_on:
                self.tail = text
                return b"".join(out)
            out.append(array("I", self.merger.close()).tobytes())
            self.open = None
        if last:
            return b"".join([*out, t.settled(text)])
        cut = text.rfind(" ", 1, -1)
        while cut > 0 and (t.white.match(text[cut - 1]) or t.white.match(text[cut + 1])):
            cut = text.rfind(" ", 1, cut)
        if cut > 0:
            out.append(t.settled(text[:cut]))
            text = text[cut:]
        if len(text) > OPEN:
            found, end = t.pattern.findall(text), len(text)
            while found and end > 0 and (end == len(text) or end > len(text) - 2):
                end -= len(found.pop())
            out.append(b"".join([t.known.get(p) or t.part(p) for p in found]))
            text = text[end:]
            if len(text) > OPEN and t.runs[kind := t.kind(text)].match(text, text[0] == " " and kind != "white").end() == len(text):
                self.open, end = kind, len(text) - (kind == "white")
                out.append(array("I", self.merger.feed(text[:end].encode())).tobytes())
                text = text[end:]
        self.tail = text
        return b"".join(out)


class Decoder:
    """feed() gives the text of a stream of ids, character by character as they are whole."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        self.t, self.held = tables(name), b""

    def feed(self, ids: list[int]) -> str:
        raw = self.held + b"".join(map(self.t.bytes.__getitem__, ids))
        wait = 0
        for n in range(1, min(3, len(raw)) + 1):  # does a character begin in the last three bytes that needs more?
            c = raw[-n]
            if c >= 0xC0:
                needs = 2 if c < 0xE0 else 3 if c < 0xF0 else 4 if c < 0xF5 else 0
                wait = n if n < needs else 0
            if c < 0x80 or c >= 0xC0:
                break
        cut = len(raw) - wait
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


def encode(text: str, name: str = "byte_bpe_50k.json", fed: int = FED) -> bytes:
    e = Encoder(name)
    if len(text) <= fed:
        return e._marked(text, True)
    return b"".join([*(e.feed(text[i : i + fed]) for i in range(0, len(text), fed)), e.finish()])


def decode(ids: np.ndarray, name: str = "byte_bpe_50k.json", fed: int = FED) -> str:
    d = Decoder(name)
    return "".join([*(d.feed(ids[i : i + fed].tolist()) for i in range(0, len(ids), fed)), d.finish()])


def encoded(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian uint32)."""

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, 1, 4 << 20):
                ids = [encode(t or "", vocabulary) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoded(tokens: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids and their text. A null list of ids is an empty one."""

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, 2, 4 << 20):
                texts = [decode(np.frombuffer(x or b"", dtype="<u4"), vocabulary) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def listed_hash(vocabulary: str = "byte_bpe_50k.json"):
    """SHA-256 of ids as decimal numbers with commas between them."""

    @F.pandas_udf(T.StringType())
    def run(ids):
        import pandas as pd

        decimals = tables(vocabulary).decimals.__getitem__
        return pd.Series([hashlib.sha256(b",".join(map(decimals, np.frombuffer(x, dtype="<u4").tolist()))).hexdigest() for x in ids], dtype="object")

    return run


def op12_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    both = decoded(encoded(table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n_tokens", listed_hash()("ids").alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
