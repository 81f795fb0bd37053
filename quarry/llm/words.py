"""Words and shingles of many texts at once, as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np

_R = np.random.default_rng(20240229)
BYTE = _R.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Positions of a word whose hashes are looked up.
PLACES = 64
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def placed(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A hash of a byte at its place in a word. The places are inside the mixing, so that no rearrangement of bytes keeps a sum."""
    return mixed((place.astype(np.uint64) << np.uint64(8) | byte) * STEP + BYTE[0])


PLACED = placed(np.repeat(np.arange(PLACES), 256), np.tile(np.arange(256, dtype=np.uint64), PLACES))


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word (bytes without space and \\t to \\r) of texts that lie one after the other; bounds: their
    first bytes, and the end. A word never crosses two texts."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~WHITE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = bounds[(bounds > 0) & (bounds < len(raw))]
    first[edges] |= word[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    places = np.flatnonzero(word)
    heads = np.flatnonzero(first[places])
    lengths = np.diff(np.append(heads, len(places)))
    within = np.arange(len(places)) - np.repeat(heads, lengths)
    found = raw[places]
    each = PLACED[np.minimum(within, PLACES - 1) << 8 | found]
    far = np.flatnonzero(within >= PLACES)
    if len(far):
        each[far] = placed(within[far], found[far])
    sums = np.add.reduceat(each, heads)
    return mixed(sums + lengths.astype(np.uint64)), starts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of width words, A-Z in lower case; with fewer words, of the whole
    sequence; empty without words."""
    raw = LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words, starts = word_hashes(raw, bounds)
    cut = np.searchsorted(starts, bounds)
    runs = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for j in range(width):
        runs = (runs + words[j : j + len(runs)]) * STEP if len(runs) else runs
    runs = mixed(runs)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = np.uint64((int(h) + int(w)) * int(STEP) & 0xFFFFFFFFFFFFFFFF)
            out.append(mixed(np.array([h])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
