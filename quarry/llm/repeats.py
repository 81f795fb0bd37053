"""Operator 7, suffix-array dedup: depth-limited radix sort.

Suffixes are ordered through their first DEPTH bytes only, by most-significant-digit passes, and suffixes that are alone in their
group leave after each pass; the groups that are left after the last pass are exactly the repeated windows of DEPTH bytes.

1. First digit: of the GRAM-byte strings in a suffix's window, the one of the smallest hash. It is a function of the window's
   bytes, so equal windows have equal digits. Neighbouring suffixes share it, which makes runs, and only runs are sent to be grouped.
   A run whose digit no other run has is alone: all its windows are unique.
2. Second digit: all bytes that the run's windows cover. Runs that are equal in it are repeated as a whole.
3. Last digit, only for runs whose first digit but not second is shared: each suffix's whole window.

Bytes are compared by two hashes of different kinds: sums modulo 2**64, and sums modulo the prime 2**31 - 1 for two bases. The first digit
is a hash of the first kind alone, as it only parts the work; runs are equal if first digit and second, which is made of both kinds, are
(128 bits); windows of the last pass if both kinds are (126 bits). Each task groups its own rows before it sends them, so a window
that a third of all documents hold is one row a task. Groups are read as sorted streams, one row ahead, so no group is held in memory.

Cases: null texts are empty; texts shorter than DEPTH lose nothing; matches lie within documents, overlaps and repeats within one
document count; rows that repeat a document are occurrences like others; null ids are kept; an empty table gives no rows; further columns are kept,
whatever their names.

A passage of over 50 words is often shorter than DEPTH, and then it stays. So digests also counts passages: repeated windows of passage_of(DEPTH)
bytes are found first, and windows of DEPTH are looked for within their ranges only, as each of them lies in one.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import by_bytes, private, spent, table, written
from .words import BYTE, STEP, mixed

DEPTH = 400
PIECE = 1 << 18
FLUSH = 1 << 18
#: Entries of lists that may be broadcast; beyond, joins shuffle.
BROADCAST = 1_000_000
#: A passage has more words than these.
WORDS = 50
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
PLACE = np.uint64((1 << 24) - 1)


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, STEP, dtype=np.uint64), np.full(n, BACK, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


PRIME = (1 << 31) - 1
#: Random values for two sums modulo PRIME: of each byte, and the bases.
FIELD = np.random.default_rng(20260114).integers(1, PRIME, (2, 257), dtype=np.uint64)


@functools.lru_cache(1)
def _field_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for base in FIELD[:, 256].tolist():
        both = []
        for g in (base, pow(base, -1, PRIME)):
            x = np.ones(1, dtype=np.uint64)
            while len(x) < n:
                x = np.concatenate([x, x * np.uint64(pow(g, len(x), PRIME)) % np.uint64(PRIME)])
            both.append(x[:n])
        out.append(tuple(both))
    return out


class Hashes:
    """Hashes of any byte ranges of one piece of text, from sums over its prefixes."""

    def __init__(self, raw: np.ndarray):
        n = 1 << max(12, len(raw)).bit_length() if len(raw) >= 4096 else 4096
        self.up, self.down = _powers(max(n, 2 * PIECE))
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(BYTE[raw] * self.up[: len(raw)], out=self.sums[1:])
        self.field = []
        for value, (up, down) in zip(FIELD, _field_powers(len(self.up)), strict=True):
            x = value[raw] * up[: len(raw)]
            x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))  # below 2**32, and their sums below 2**64
            self.field.append((np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x)]), down))

    def every(self, n: int) -> np.ndarray:
        """Of all ranges of n bytes."""
        h = self.sums[n:] - self.sums[:-n]
        h *= self.down[: len(h)]
        return h

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def proof(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """62 bits of the other kind of hash."""
        x, y = ((sums[b] - sums[a]) % np.uint64(PRIME) * down[a] % np.uint64(PRIME) for sums, down in self.field)
        return x << np.uint64(31) | y


def gram_of(depth: int) -> int:
    return depth * 16 // 25


def passage_of(depth: int) -> int:
    """Bytes that a passage has at least: 200 of 400, 50 words of three letters."""
    return depth // 2


def pieces(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int):
    """Pieces of the bytes of many texts: (offset of the piece, piece). Long ones overlap by depth - 1, so each window lies in one."""
    at, last = 0, len(raw)
    while at < last:
        end = min(last, at + PIECE + depth - 1)
        yield at, raw[at:end]
        if end == last:
            return
        at += PIECE


def runs(raw: np.ndarray, begin: np.ndarray, depth: int):
    """Of one piece: first window, windows, first digit, second digit of each run. begin: for each window whether it lies within one text
    and, where it does, which; runs do not cross texts."""
    gram = gram_of(depth)
    h = Hashes(raw)
    digit = mixed(h.every(gram))
    n = len(raw) - depth + 1
    x = (digit & ~PLACE) | np.arange(len(digit), dtype=np.uint64)
    width, size = depth - gram + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if width > size:
        x = np.minimum(x[: n], x[width - size : width - size + n])
    owner = (x[:n] & PLACE).astype(np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    inside = begin[first] >= 0
    first, count = first[inside], count[inside]
    place = owner[first]
    end = first + count - 1 + depth
    whole = mixed(h.of(first, end) + mixed(h.proof(first, end) ^ mixed((place - first).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64))))
    return first, count, digit[place], whole


def windows_in(lengths: np.ndarray, starts: np.ndarray, total: int, depth: int) -> np.ndarray:
    """For each byte the number of the text whose window starts there, or -1."""
    out = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(total)
    out[left < depth] = -1
    return out


RANGES = "key long, start long, stop long"
WINDOWS = RANGES + ", hash long, proof long, weight int"
_WINDOW = [x.split()[0] for x in WINDOWS.split(", ")]
RUNS = "key long, start long, stop long, gram long, whole long, weight int, first long, count int"
_RUN = [x.split()[0] for x in RUNS.split(", ")]


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)


def _grouped(*keys: np.ndarray):
    """Order by keys, whether each ordered row is the first of its group, and its group's size."""
    order = np.lexsort(keys[::-1])
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    for k in keys:
        s = k[order]
        same[1:] &= s[1:] == s[:-1]
    first = ~same
    sizes = np.diff(np.append(np.flatnonzero(first), len(order)))
    return order, first, np.repeat(sizes, sizes)


def _joined(key: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Ranges with touching or overlapping neighbours of the same key (sorted by key and start) put together."""
    if not len(key):
        return key, start, stop
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    new = np.ones(len(key), dtype=bool)
    head = np.ones(len(key), dtype=bool)
    head[1:] = key[1:] != key[:-1]
    # the furthest stop so far within a key: stops are lifted by the key's rank so that one running maximum does it
    lift = (np.cumsum(head) - 1) * (int(stop.max()) + 1)
    far = np.maximum.accumulate(stop + lift)
    new[1:] = head[1:] | (start[1:] + lift[1:] > far[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(key)) - 1
    return key[at], start[at], far[ends] - lift[at]


def _first_pass(depth: int):
    """Rows of two kinds: ranges that are known to repeat (gram is null), and runs to be grouped. With starts and stops as third and fourth
    column only these ranges of a text are read, each like a text of its own."""

    def run(batches):
        held, n = [], 0

        def flush():
            key, first, count, gram, whole = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, head, size = _grouped(gram, whole)
            known = order[size > 1]
            if len(known):
                k, a, b = _joined(key[known], first[known], first[known] + count[known] - 1 + depth)
                none = pa.nulls
                yield _batch([k, a, b, none(len(k), pa.int64()), none(len(k), pa.int64()), none(len(k), pa.int32()), none(len(k), pa.int64()), none(len(k), pa.int32())], _RUN)
            sent, weight = order[head], np.minimum(size[head], 2).astype(np.int32)
            for i in range(0, len(sent), 50_000):
                s = sent[i : i + 50_000]
                none = pa.nulls(len(s), pa.int64())
                yield _batch([key[s], none, none, gram[s].view(np.int64), whole[s].view(np.int64), weight[i : i + 50_000], first[s], count[s].astype(np.int32)], _RUN)

        for batch in batches:
            for b in by_bytes(batch, 1, PIECE):
                keys = b.column(0).to_numpy()
                texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
                before = np.zeros(len(texts), dtype=np.int64)
                if b.num_columns > 2:
                    cut = [(i, x, y) for i, (xs, ys) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)) for x, y in zip(xs, ys, strict=True)]
                    keys, before, texts = keys[[i for i, _, _ in cut]], np.array([x for _, x, _ in cut], dtype=np.int64), [texts[i][x:y] for i, x, y in cut]
                lengths = np.array([len(t) for t in texts], dtype=np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
                if len(raw) < depth:
                    continue
                begin = windows_in(lengths, starts, len(raw), depth)
                for at, piece in pieces(raw, starts, lengths, depth):
                    if len(piece) < depth:
                        continue
                    first, count, gram, whole = runs(piece, begin[at : at + len(piece) - depth + 1], depth)
                    doc = begin[at + first]
                    held.append((keys[doc], first + at - starts[doc] + before[doc], count, gram, whole))
                    n += len(first)
                if n > FLUSH:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()

    return run


def _second_pass(depth: int):
    """Runs sorted by both digits. Ranges of runs that are equal in both, and runs that share the first digit with others."""

    def run(batches):
        held: list[list] = []

        def settle(c):
            key, gram, whole, weight, first, count = c
            new_g = np.ones(len(key), dtype=bool)
            new_g[1:] = gram[1:] != gram[:-1]
            new_w = new_g.copy()
            new_w[1:] |= whole[1:] != whole[:-1]
            heads = np.flatnonzero(new_w)
            size = np.add.reduceat(weight.astype(np.int64), heads)
            rows = np.diff(np.append(heads, len(key)))
            known = np.repeat(size > 1, rows)
            kinds = np.add.reduceat(new_w.astype(np.int64), np.flatnonzero(new_g))
            several = np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(new_g), len(key))))
            if known.any():
                k, a, b = _joined(key[known], first[known], first[known] + count[known] - 1 + depth)
                none = pa.nulls
                yield _batch([k, a, b, none(len(k), pa.int64()), none(len(k), pa.int64()), none(len(k), pa.int32()), none(len(k), pa.int64()), none(len(k), pa.int32())], _RUN)
            go = np.flatnonzero(new_w & several)
            if len(go):
                none = pa.nulls(len(go), pa.int64())
                w = np.minimum(np.add.reduceat(weight.astype(np.int64), heads), 2).astype(np.int32)[np.searchsorted(heads, go)]
                yield _batch([key[go], none, none, gram[go], whole[go], w, first[go], count[go]], _RUN)

        for batch in batches:
            c = [x.to_numpy() for x in batch.columns]
            if not len(c[0]):
                continue
            if held and held[-1][1][-1] != c[1][0]:
                yield from settle([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            last = c[1][-1]
            differ = c[1] != last
            cut = len(differ) - int(np.argmax(differ[::-1])) if differ.any() else 0
            if cut:
                held.append([x[:cut] for x in c])
                yield from settle([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            held.append([x[cut:] for x in c])
            if sum(len(h[0]) for h in held) > 4 * FLUSH:  # a digit of very many runs: all but the last kind of them are settled now
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                new = np.ones(len(columns[0]), dtype=bool)
                new[1:] = columns[2][1:] != columns[2][:-1]
                kinds = np.flatnonzero(new)
                if len(kinds) > 1:
                    edge = kinds[-1]
                    yield from settle([x[:edge] for x in columns])
                    # One run stays to tell the others that they are not alone. It counts for nothing if it was sent on.
                    held = [[x[np.append(0, np.arange(edge, len(x)))] for x in columns]]
                    if len(kinds) > 2:
                        held[0][3][0] = 0
                else:  # one kind: its runs repeat, and one stands for two
                    keep = [x[:1].copy() for x in columns]
                    keep[3][0] = 2
                    yield from settle(columns)
                    held = [keep]
        if held:
            yield from settle([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _windows(depth: int):
    """Each window of the runs that are left, with its hash; equal ones of a task are settled here and sent once."""

    def run(batches):
        held, n = [], 0

        def flush():
            key, at, h, proof, weight = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, head, _ = _grouped(h, proof)
            heads = np.flatnonzero(head)
            total = np.add.reduceat(weight[order].astype(np.int64), heads)
            known = order[np.repeat(total > 1, np.diff(np.append(heads, len(order))))]
            if len(known):
                k, a, b = _joined(key[known], at[known], at[known] + depth)
                yield _batch([k, a, b, pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int32())], _WINDOW)
            sent, w = order[heads], np.minimum(total, 2).astype(np.int32)
            for i in range(0, len(sent), 50_000):
                s = sent[i : i + 50_000]
                yield _batch([key[s], at[s], pa.nulls(len(s), pa.int64()), h[s].view(np.int64), proof[s].view(np.int64), w[i : i + 50_000]], _WINDOW)

        for batch in batches:
            for b in by_bytes(batch, 1, PIECE):
                for key, text, firsts, counts, weights in zip(*(c.to_pylist() for c in (b.column(0), b.column(1).cast(pa.binary()), *b.columns[2:])), strict=True):
                    raw = np.frombuffer(text or b"", dtype=np.uint8)
                    for first, count, weight in zip(firsts, counts, weights, strict=True):
                        hashes, at = Hashes(raw[first : first + count - 1 + depth]), np.arange(count)
                        held.append((np.full(count, key), at + first, mixed(hashes.every(depth)), hashes.proof(at, at + depth), np.full(count, weight, dtype=np.int32)))
                        n += count
                    if n > FLUSH:
                        yield from flush()
                        n = 0
        if n:
            yield from flush()

    return run


def _equal_windows(depth: int):
    """Windows sorted by their hashes: ranges of those in a group of two or more."""

    def run(batches):
        held: list[list] = []

        def settle():
            key, at, h, proof, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.ones(len(key), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (proof[1:] != proof[:-1])
            heads = np.flatnonzero(new)
            known = np.repeat(np.add.reduceat(weight.astype(np.int64), heads) > 1, np.diff(np.append(heads, len(key))))
            k, a, b = _joined(key[known], at[known], at[known] + depth)
            return _batch([k, a, b], ["key", "start", "stop"])

        for batch in batches:
            c = [x.to_numpy() for x in batch.columns]
            if not len(c[0]):
                continue
            differ = (c[2] != c[2][-1]) | (c[3] != c[3][-1])
            cut = len(c[2]) - int(np.argmax(differ[::-1])) if differ.any() else 0
            if cut:
                held.append([x[:cut] for x in c])
                yield settle()
                held = []
            elif held and (held[-1][2][-1] != c[2][0] or held[-1][3][-1] != c[3][0]):
                yield settle()
                held = []
            held.append([x[cut:] for x in c])
            if sum(len(x[0]) for x in held) > 4 * FLUSH:  # one window, very many times: it is known to repeat
                yield settle()
                held = [[x[:1] for x in held[0][:4]] + [np.array([2], dtype=np.int32)]]
        if held:
            yield settle()

    return run


def _merged(batches):
    """Ranges sorted by key and start: one row a key, with its maximal ranges."""
    at, starts, stops = None, [], []
    rows: list[tuple] = []

    def out():
        b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["key", "starts", "stops"])
        rows.clear()
        return b

    for batch in batches:
        for key, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != at:
                if starts:
                    rows.append((at, starts, stops))
                    if len(rows) >= 4096:
                        yield out()
                at, starts, stops = key, [], []
            if stops and start <= stops[-1]:
                stops[-1] = max(stops[-1], stop)
            else:
                starts.append(start)
                stops.append(stop)
    if starts:
        rows.append((at, starts, stops))
    if rows:
        yield out()


def small(df: DataFrame, entries) -> DataFrame:
    """With a broadcast hint if it holds no more than BROADCAST entries."""
    n = df.agg(F.coalesce(F.sum(entries + F.lit(1)), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if n <= BROADCAST else df


def repeated_ranges(texts: DataFrame, depth: int = DEPTH, within: DataFrame | None = None) -> DataFrame:
    """Of (key, text) the maximal byte ranges that repeated windows cover: key, starts, stops. Keys without any are left out.
    within: the same of a smaller depth; then only its ranges are searched."""
    searched = texts.select("key", "text")
    if within is not None:
        long = within.select("key", F.expr(f"filter(arrays_zip(starts, stops), x -> x.stops - x.starts >= {depth})").alias("at")).where("size(at) > 0").select("key", "at.starts", "at.stops")
        searched = searched.join(small(long, F.size("starts")), "key").select("key", "text", "starts", "stops")
    first = written(searched.mapInArrow(_first_pass(depth), RUNS), "runs")
    ranges = ["key", "start", "stop"]
    sent = first.where("gram is not null").select("key", "gram", "whole", "weight", "first", "count")
    second = written(sent.repartition("gram").sortWithinPartitions("gram", "whole").mapInArrow(_second_pass(depth), RUNS), "groups")
    known = written(first.where("gram is null").select(ranges).union(second.where("gram is null").select(ranges)), "known")
    spent(first)
    rest = second.where("gram is not null").groupBy("key").agg(F.collect_list("first").alias("firsts"), F.collect_list("count").alias("counts"), F.collect_list("weight").alias("weights"))
    rest = written(rest, "rest")
    spent(second)
    third = texts.join(small(rest, F.size("firsts")), "key").select("key", "text", "firsts", "counts", "weights")
    third = written(third.mapInArrow(_windows(depth), WINDOWS), "windows")
    spent(rest)
    last = third.where("hash is not null").select("key", "start", "hash", "proof", "weight").repartition("hash").sortWithinPartitions("hash", "proof").mapInArrow(_equal_windows(depth), RANGES)
    every = known.union(third.where("hash is null").select(ranges)).union(last)
    out = written(every.repartition("key").sortWithinPartitions("key", "start").mapInArrow(_merged, "key long, starts array<long>, stops array<long>"), "ranges")
    spent(known, third)
    return out


def row_key():
    return F.xxhash64("doc_id", "text")


def with_ranges(docs: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, str, str]:
    """docs with two columns more, and their names: starts and stops of the repeated ranges, null where nothing repeats."""
    names = [private(c, docs) for c in ("key", "starts", "stops")]
    found = repeated_ranges(docs.select(row_key().alias("key"), "text"), depth)
    found = small(found, F.size("starts")).toDF(*names)
    return docs.withColumn(names[0], row_key()).join(found, names[0], "left").drop(names[0]), *names[1:]


def _kept(raw: bytes, starts, stops) -> bytes:
    out, at = [], 0
    for a, b in zip(starts or (), stops or (), strict=True):
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def kept_text(raw: bytes | None, starts, stops) -> str | None:
    """What is left of a text. A character that is cut in two is kept whole."""
    if raw is None:
        return None
    cut = []
    for a, b in zip(starts or (), stops or (), strict=True):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            cut.append((a, b))
    return _kept(raw, [a for a, _ in cut], [b for _, b in cut]).decode()


def deduplicated(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs without their repeated bytes, all columns as they were. A character that is cut in two is kept whole."""
    d, starts, stops = with_ranges(docs, depth)
    d = d.select(*[f"`{c}`" for c in docs.columns], starts, stops)
    at, n = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, at, 4 << 20):
                texts = [kept_text(*x) for x in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(n)], names=b.schema.names[:n])

    return d.mapInArrow(run, docs.schema)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, n_passages long"


def digests(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per document what was removed; the hash is that of the bytes that are left, text is them as characters, those cut in two kept whole.
    n_passages: ranges of more than WORDS words that repeated windows of passage_of(depth) bytes cover; they are counted, not removed."""
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    passages = repeated_ranges(keyed.select("key", "text"), passage_of(depth))
    ranges = repeated_ranges(keyed.select("key", "text"), depth, passages)
    found = written(passages.toDF("key", "heads", "ends").join(ranges, "key", "left"), "found")
    spent(passages, ranges)
    d = keyed.join(small(found, F.size("heads") + F.coalesce(F.size("starts"), F.lit(0))), "key", "left")

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, 1, 4 << 20):
                rows = []
                for doc, raw, s, e, heads, ends in zip(*(c.to_pylist() for c in (b.column(0), b.column(1).cast(pa.binary()), *b.columns[2:])), strict=True):
                    raw = raw or b""
                    kept = _kept(raw, s, e)
                    passages = sum(len(raw[x:y].split()) > WORDS for x, y in zip(heads or (), ends or (), strict=True))
                    rows.append((doc, len(raw), len(raw) - len(kept), len(s or ()), hashlib.sha256(kept).hexdigest(), kept_text(raw, s, e), passages))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return d.select("doc_id", "text", "starts", "stops", "heads", "ends").mapInArrow(run, DIGEST)


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
