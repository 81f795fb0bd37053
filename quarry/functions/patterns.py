"""Many patterns at once: one automaton a task finds all of them in a pass over each text, so time hardly grows with their number.

Null texts give null. An empty pattern is in every text; with word boundaries, in every text that has a word character. Patterns that repeat are found once.
The patterns are settings, and go to the tasks within the function.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many patterns one condition each is cheaper; the rows are the same.
FEW = 64


@lru_cache(1 << 16)
def _word(c: str) -> bool:
    """What (?U)\\w takes: letters, marks, decimal digits, letter numbers, connectors, joiners, circled letters."""
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "\u200c\u200d" or "Ⓐ" <= c <= "ⓩ"


def _boundary(text: str, at: int) -> bool:
    return (at > 0 and _word(text[at - 1])) != (at < len(text) and _word(text[at]))


class Finder:
    """The places in `patterns` of those that a text holds; of `bounded` ones, between word boundaries."""

    def __init__(self, patterns: Sequence[str], bounded: Sequence[bool] | None = None):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        self.bounded = list(bounded) if bounded is not None else [False] * len(patterns)
        self.empty = [i for i, p in enumerate(patterns) if not p]
        places: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            if p:
                places.setdefault(p, []).append(i)
        for p, ids in places.items():
            self.machine.add_word(p, (len(p), ids))
        if places:
            self.machine.make_automaton()
        self.any = bool(places)

    def __call__(self, text: str) -> list[int]:
        out = {i for i in self.empty if not self.bounded[i] or any(map(_word, text))}
        if self.any:
            for end, (length, ids) in self.machine.iter(text):
                for i in ids:
                    if i not in out and (not self.bounded[i] or _boundary(text, end + 1 - length) and _boundary(text, end + 1)):
                        out.add(i)
        return sorted(out)


def found(text: Column, patterns: Sequence[str], bounded: Sequence[bool] | None = None) -> Column:
    """The ascending 0-based places of the patterns that the text holds."""
    patterns, bounded = list(patterns), bounded and list(bounded)

    @F.pandas_udf("array<int>")
    def places(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(patterns, bounded)
        for s in texts:
            yield s.map(lambda x: None if x is None else finder(x))

    return places(text)


def held(text: Column, patterns: Sequence[str]) -> Column:
    """The patterns that the text holds, in the order given."""
    patterns = list(dict.fromkeys(patterns))

    @F.pandas_udf("array<string>")
    def names(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(patterns)
        for s in texts:
            yield s.map(lambda x: None if x is None else [patterns[i] for i in finder(x)])

    return names(text)


def counted(text: Column, patterns: Sequence[str]) -> Column:
    """n, letters: how many of the patterns the text holds, and their letters in all; the patterns themselves stay in the task."""
    patterns = list(dict.fromkeys(patterns))

    @F.pandas_udf("n long, letters long")
    def numbers(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder, letters = Finder(patterns), [len(p) for p in patterns]
        for s in texts:
            n, of = [], []
            for x in s:
                ids = finder(x) if x is not None else []
                n.append(len(ids))
                of.append(sum(letters[i] for i in ids))
            yield pd.DataFrame({"n": n, "letters": of}, dtype="int64")

    return numbers(text)


def longest(text: Column, names: dict[str, str]) -> Column:
    """The name of the longest pattern that the text holds; of equally long ones, the first given; null without one. names: pattern to name."""
    order = sorted(names, key=lambda p: -len(p))

    @F.pandas_udf("string")
    def best(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(order)
        for s in texts:
            yield s.map(lambda x: next((names[order[i]] for i in finder(x)), None) if x is not None else None)

    return best(text)
