"""Public tokenizer files and fast exact encoders for them.

Each encoder gives the ids that the library of its file gives. Workers keep one encoder per file.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import sys
import unicodedata
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries that a cache may hold before it is emptied; bounds a worker's memory.
CACHE = 400_000


#: White space as the tokenizers' patterns see it, as a character class.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def ranges(kind: str) -> str:
    """The characters of a general category, as ranges of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


@functools.cache
def library(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


@functools.cache
def ranks(name: str) -> dict[bytes, int]:
    with open(tokenizer_path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteEncoder:
    """Ids of the byte-level vocabulary, from its rank file; the same ids as the .json file's library gives."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        self.name = name
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(f"{name}.tiktoken"), special_tokens={"<|endoftext|>": 50256})

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the pattern engine gives up (and panics) on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return np.array(library(f"{self.name}.json").encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class WordEncoder:
    """Ids of the word vocabulary. A blank always parts words there, so ids are kept by blank-separated piece.

    The end of a word is byte 0xFF, which no UTF-8 text holds; the merges of a last byte with it come first, as ids
    256 to 511. Pieces with characters beyond Latin or special tokens go to the library.
    """

    def __init__(self, name: str = "word_bpe_49k.json"):
        import tiktoken

        with open(tokenizer_path(name)) as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: how byte-level vocabularies write bytes
        shown = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in letters)}
        ids = {bytes(shown[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>"): i for t, i in vocabulary.items()}
        self.largest = max(vocabulary.values())
        self.merge = tiktoken.Encoding(name, pat_str=r"\S+", mergeable_ranks=ids, special_tokens={})._encode_single_piece
        letters, numbers = ranges("L"), ranges("N")
        self.words = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+")
        self.name, self.known, self.units = name, {}, {}

    def unit(self, word: str) -> bytes:
        got = self.units.get(word)
        if got is None:
            got = array("H", self.merge(word.encode() + b"\xff")).tobytes()
            if len(word) <= 64:
                if len(self.units) > CACHE:
                    self.units.clear()
                self.units[word] = got
        return got

    def piece(self, text: str) -> bytes:
        if text.isascii():
            if text.isalpha():
                return self.unit(text.lower())
            if text[:-1].isalpha() and text[-1] in ".,;:!?":  # most of what is not one word
                return self.unit(text[:-1].lower()) + self.unit(text[-1])
        if not text.isascii() and max(text) >= "\u0250" or "<|" in text:
            return array("H", library(self.name).encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
        return b"".join(map(self.unit, self.words.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        pieces = text.split(" ")
        known, piece = self.known, self.piece
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, pieces)), dtype=np.uint16)
        except KeyError:
            pass
        out = []
        for p in pieces:
            got = known.get(p)
            if got is None:
                got = piece(p)
                if len(p) <= 64:
                    if len(known) > CACHE:
                        known.clear()
                    known[p] = got
            out.append(got)
        return np.frombuffer(b"".join(out), dtype=np.uint16)


@functools.cache
def byte_encoder(name: str = "byte_bpe_50k") -> ByteEncoder:
    return ByteEncoder(name)


@functools.cache
def word_encoder(name: str = "word_bpe_49k.json") -> WordEncoder:
    return WordEncoder(name)
