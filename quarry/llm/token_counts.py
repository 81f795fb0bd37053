"""Operator 4, token counts: prefix dynamic programming.

For every prefix of a text the exact number of tokens of the byte-level vocabulary is found by one pass of
dynamic programming: the encoding of a prefix ends in exactly one token t, the one that fits behind the last
token of the prefix before t, so count[i] = count[i - len(t)] + 1. Two tokens fit if merging their joined bytes
gives the two again. Counts start anew at each pre-token, so the programme runs once per distinct blank-separated
piece; a text's table is the running sum of its pieces' steps. Truncation and budget questions are
read off the stored table, without encoding again.

Cases: a null or empty text has 0 tokens and an empty table; a null id stays null; repeated rows give repeated
results; further columns don't matter. Strings of special tokens count as one token, as the library does by default.
"""

from __future__ import annotations

import functools
import re
from array import array
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import by_bytes, table
from .vocab import CACHE, WHITE, byte_encoder, ranges, ranks

SPECIAL = "<|endoftext|>"
#: Stands for the token before the first.
START = (1 << 31) - 1


class PrefixCounter:
    """Counts of tokens at every prefix, for the vocabulary of a rank file."""

    def __init__(self, name: str = "byte_bpe_50k.tiktoken"):
        import ahocorasick

        rank = ranks(name)
        self.token = {i: t for t, i in rank.items()}
        #: Finds the tokens that end at each byte, longest first.
        self.ends = ahocorasick.Automaton()
        for t, i in rank.items():
            self.ends.add_word(t.decode("latin-1"), (len(t), i))
        self.ends.make_automaton()
        self.merge = byte_encoder(name.removesuffix(".tiktoken")).fast._encode_single_piece
        letters, numbers = ranges("L"), ranges("N")
        #: White space and the pre-token behind it. A contraction counts as one only where no blank stands before it.
        self.units = re.compile(f"([{WHITE}]*)((?<! )'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]+|[^{WHITE}{letters}{numbers}]+)|([{WHITE}]+)")
        #: A blank beside other white space, or white space at the end.
        self.wide = re.compile(r" \s|\s |\s\Z")
        self.pieces: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    def fit(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the two again (START: of the second alone)."""
        if len(self.fits) > CACHE:
            self.fits.clear()
        got = self.fits[a << 32 | b] = self.merge(self.token[b]) == [b] if a == START else self.merge(self.token[a] + self.token[b]) == [a, b]
        return got

    def run(self, text: str) -> list[int]:
        """Counts at each character's end of one pre-token and its prefixes."""
        raw = text if text.isascii() else text.encode().decode("latin-1")
        known, fit = self.fits.get, self.fit
        last, count, i = [START], [0], 0
        # Every byte is a token, so all that ends before `end` is settled when its tokens come.
        for end, (n, t) in self.ends.iter(raw):
            if end == i:
                a = last[i + 1 - n]
                ok = known(a << 32 | t)
                if fit(a, t) if ok is None else ok:
                    last.append(t)
                    count.append(count[i + 1 - n] + 1)
                    i += 1
        return count[1:] if text is raw else [c for c, x in zip(count[1:], [*raw[1:], "a"], strict=True) if not "\x80" <= x < "\xc0"]

    def unit(self, white: str, word: str, tail: str) -> bytes:
        """The steps of the counts over white space and the pre-token behind it."""
        if tail:
            return self.steps(self.run(tail))
        counts, base, blank = [], 0, white[-1:] == " "
        if len(white) == 1 and blank:
            counts = self.run(" " + word)
        else:
            if white:
                counts = self.run(white)
                base = (self.run(white[:-1])[-1] if len(white) > 1 else 0) + (0 if blank else self.run(white[-1])[-1])
            if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # the prefixes of a contraction are two pre-tokens
                counts += [base + c for c in range(1, len(word))] + [base + self.run(word)[-1]]
            else:
                counts += [base + c for c in (self.run(" " + word)[1:] if blank else self.run(word))]
        return self.steps(counts)

    def plain(self, text: str) -> bytes:
        """The steps of the counts over a text that holds no special token."""
        out, known = [], self.runs
        for white, word, tail in self.units.findall(text):
            key = white + word + tail
            got = known.get(key)
            if got is None:
                got = self.unit(white, word, tail)
                if len(key) <= 64:
                    if len(known) > CACHE:
                        known.clear()
                    known[key] = got
            out.append(got)
        return b"".join(out)

    @staticmethod
    def steps(counts: list[int]) -> bytes:
        return array("i", map(sub, counts, [0, *counts])).tobytes()

    def special(self, text: str) -> bytes:
        """The same with special tokens: until one is whole its characters are ordinary, then it is one token."""
        out, parts = [], text.split(SPECIAL)
        for i, part in enumerate(parts):
            if i + 1 == len(parts):
                out.append(self.plain(part))
            else:
                counts = np.cumsum(np.frombuffer(self.plain(part + SPECIAL[:-1]), dtype=np.int32)).tolist()
                out.append(self.steps([*counts, (counts[len(part) - 1] if part else 0) + 1]))
        return b"".join(out)

    def piece(self, text: str) -> bytes:
        got = self.special(text) if SPECIAL in text else self.plain(text)
        if len(text) <= 64 and not text[-1].isspace() and not text[1:2].isspace():  # white space at an edge depends on what is beside it
            if len(self.pieces) > CACHE:
                self.pieces.clear()
                self.pieces[""] = b""
            self.pieces[text] = got
        return got

    def table(self, text: str) -> np.ndarray:
        """int32: the number of tokens of text[:i + 1] at i."""
        known, piece = self.pieces, self.piece
        parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        # A blank between two non-blank characters always starts a pre-token; other white space takes the whole text.
        try:
            steps = b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(parts) == 1 or self.wide.search(text):
                parts = [p for p in re.split(r"(?<=\S)(?= \S)", text) if p]
            steps = b"".join([known.get(p) or piece(p) for p in parts if p])
        return np.cumsum(np.frombuffer(steps, dtype=np.int32), dtype=np.int32)


@functools.cache
def counter(name: str = "byte_bpe_50k.tiktoken") -> PrefixCounter:
    return PrefixCounter(name)


def token_counts(docs: DataFrame, limit: int = 512, keep_table: bool = False, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and with keep_table the table itself: int32 counts, little-endian."""

    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            for b in by_bytes(batch, 1, 8 << 20):
                texts = [t or "" for t in b.column(1).to_pylist()]
                tables = [count.table(t) for t in texts]
                totals = [int(t[-1]) if len(t) else 0 for t in tables]
                columns = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals])]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                if keep_table:
                    columns.append(pa.array([t.astype("<i4").tobytes() for t in tables], pa.binary()))
                    names.append("prefix_counts")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + (", prefix_counts binary" if keep_table else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


@F.pandas_udf(T.LongType())
def longest_prefix(prefix_counts, budget):
    """Characters of the longest prefix within a budget of tokens, from the stored table."""
    import pandas as pd

    def one(raw, most):
        fits = np.flatnonzero(np.frombuffer(raw, dtype="<i4") <= most)
        return int(fits[-1]) + 1 if len(fits) and most >= 0 else 0

    return pd.Series([one(r, b) for r, b in zip(prefix_counts, budget, strict=True)], dtype="int64")


@F.pandas_udf(T.LongType())
def tokens_at(prefix_counts, chars):
    """Tokens of the prefix of so many characters (those of the whole text beyond its end), from the stored table."""
    import pandas as pd

    def one(raw, n):
        t = np.frombuffer(raw, dtype="<i4")
        return int(t[min(n, len(t)) - 1]) if n > 0 and len(t) else 0

    return pd.Series([one(r, c) for r, c in zip(prefix_counts, chars, strict=True)], dtype="int64")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
