"""Operator 1, n-gram Jaccard join: multiple-global-order filtering.

Documents with one and the same shingle set form a node (exact copies collapse, and never make pairs). Two nodes of sizes x and y
that link share o = ceil(T * max(x, y)) shingles at least, so under any global order of shingles they share l of them
within their first x - o + l and y - o + l. Several orders are used, and a candidate has to pass them all:

1. By hash. Each node's first x - ceil(T x) + l(x) shingles are its sample, l(x) = max(SHARED, ceil(x / 10)) or ceil(T x) where that is
   less; its linked nodes share r(x) = l(ceil(T x)) of them or more. A node with fewer shingles in other samples leaves. The samples
   of all linked nodes reach beyond its first r(x) shingles (its core; the whole sample, where they are whole sets), so shingles of the core
   that no other sample holds are in no linked node, which bounds its overlap with any.
2. By how many samples a shingle is in, rarest first, as counted over all documents. Within its sample a linked pair shares a
   shingle of the first (sample - r + 1) under this order. Shingles of passages that many documents share come last.
3. and 4. In the lists of shingles that many nodes share (more than FEW), sets are replaced by their differences from the list's pivot, a
   member of it. If x and y differ from the pivot by the sets u and v, they differ from each other by u ^ v, and a link allows no more than
   (1 - T) / (1 + T) * (x + y) of that; so u and v share (|u| + |v| - that) / 2 elements or more, which is one at least unless
   both are linked to the pivot. Elements that lie in the same differences make a class, which counts by its number of elements: an edit,
   or a slot of a template, is one class however long it is. Prefixes of the classes under two orders, rarest first among those of the same
   pivot and by hash, have to meet, and the weights of the common ones have to suffice. What near copies have in common is thereby gone, and
   only what sets them apart is compared. Their lists are split in the same way where they have more than FEW * MORE members of different components, LEVELS times in all.

Candidates are verified on whole sets. First come star rounds: the list of each shingle has one pivot, which is tried against the
others (first the one with fewest shingles of its own), and what is connected then needs no further test. Then the lists that
still hold several components are gone through as said; only lists of FEW members or less, and those of the last level, give the pairs of their
members, as far as they lie in different components and pass the orders. No link between components is lost.

Shingles and sets are told apart by 64-bit hashes. Cases: null texts are empty; empty sets link with nothing; rows with a null
doc_id are left out of the search and get a null component_id; rows that repeat a doc_id count as copies or as documents of their
own, as their texts say; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import by_bytes, spent, table, written
from .words import mixed, shingle_sets

STARS = 2
#: Shingles that linked nodes share of their samples, if they have so many.
SHARED = 160
#: Counts in a set's histogram, by hash.
BINS = 128
#: Rows that may be broadcast, of three longs at most; beyond, joins shuffle.
BROADCAST = 1_000_000
#: Members of a list whose pairs may be tried one by one; longer lists are split by the differences from a pivot. Lists of differences
#: overlap more, and few of their pairs pass, so MORE times as many members are allowed there.
FEW, MORE, LEVELS = 64, 16, 2
#: Classes of a difference that its rows in lists carry along, the heaviest ones.
CARRIED = 256
#: Elements that one class stands for at most; a token of a class holds their number in its lowest bits.
HEAVIEST = (1 << 20) - 1
DIFFERS = ["shared", "second", "every", "rest"]
#: Bytes of shingles of a bucket that one task counts; larger buckets are salted.
HOT = 1 << 24
FLUSH = 1 << 20
BLOCKS = "bucket int, tokens binary, nodes binary, sizes binary"
FIRST = "doc_id long, text_hash long, n long, node long, " + BLOCKS
SHARED_ROWS = "node long, n long, token long, df long"
MARKED_ROWS = SHARED_ROWS + ", mark long"


def required(n, percent: int):
    """ceil(T n)"""
    return -(-n * percent // 100)


def overlap(n, percent: int):
    """l(n)"""
    return np.minimum(required(n, percent), np.maximum(SHARED, -(-n // 10)))


def sample_size(n, percent: int):
    return n - required(n, percent) + overlap(n, percent)


def core_size(n, percent: int):
    """How many of a sample's first shingles the samples of all linked nodes reach beyond."""
    largest = n * 100 // percent + 1
    whole = overlap(largest, percent) == required(largest, percent)
    return np.where(whole, sample_size(n, percent), overlap(required(n, percent), percent))


def set_hash(s: np.ndarray) -> int:
    """Node of a set: a hash of its sorted members."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([np.bitwise_xor.reduce(mixed(s + np.uint64(77))) + s.sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def edges_of(buckets: int) -> np.ndarray:
    """Borders of equal ranges of hashes."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)


def dealt(tokens: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, edges: np.ndarray):
    """Columns of BLOCKS, a few rows at a time: entries (token, node, size), by range of token."""
    order = np.argsort(tokens, kind="stable")
    tokens, nodes, sizes = tokens[order], nodes[order], sizes[order]
    cut = [0, *np.searchsorted(tokens, edges).tolist(), len(tokens)]
    rows = [(b, x, y) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
    for i in range(0, len(rows), 64):
        part = rows[i : i + 64]
        yield pa.array([b for b, _, _ in part], pa.int32()), *(pa.array([c[x:y].tobytes() for _, x, y in part], pa.binary()) for c in (tokens, nodes, sizes))


def _sampled(width: int, percent: int, buckets: int):
    """Per document its set's size and node; and blocks of (shingle, node, size) of the samples, by range of hash."""
    edges, names = edges_of(buckets), [x.split()[0] for x in FIRST.split(", ")]

    def block(samples, sizes, nodes):
        lengths = np.array([len(s) for s in samples])
        owner = np.repeat(np.arange(len(samples)), lengths)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sizes = np.array(sizes)
        core = (within < core_size(sizes, percent)[owner]).astype("<u4") << np.uint32(31)
        for columns in dealt(np.concatenate(samples), np.array(nodes, dtype="<i8")[owner], sizes.astype("<u4")[owner] | core, edges):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(columns[0]), pa.int64())] * 4, *columns], names=names)

    def run(batches):
        seen: set[int] = set()
        samples, counts, nodes, held = [], [], [], 0
        for batch in batches:
            for b in by_bytes(batch, 1, 1 << 20):
                docs, sizes, mine = b.column(0).to_pylist(), [], []
                for doc, s in zip(docs, shingle_sets([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()], width), strict=True):
                    n = len(s)
                    node = set_hash(s) if n else None
                    sizes.append(n)
                    mine.append(node)
                    if n and doc is not None and node not in seen:
                        if len(seen) < FLUSH:  # what is beyond is sent again and counted once by the receiver
                            seen.add(node)
                        samples.append(s[: int(sample_size(n, percent))])
                        counts.append(n)
                        nodes.append(node)
                        held += len(samples[-1])
                        if held > FLUSH:
                            yield from block(samples, counts, nodes)
                            samples, counts, nodes, held = [], [], [], 0
                none = pa.nulls(len(docs), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), b.column(2), pa.array(sizes, pa.int64()), pa.array(mine, pa.int64()), pa.nulls(len(docs), pa.int32()), none, none, none], names=names)
        if samples:
            yield from block(samples, counts, nodes)

    return run


def _counted(least: int, classes: bool = False):
    """SHARED_ROWS of the entries that lie in `least` nodes of those here or more, one bucket at a time; the highest bit of n marks the core.
    Or MARKED_ROWS, with a hash of the nodes that a token lies in."""

    def out(parts):
        t, v, z = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((v, t))
        t, v, z = t[order], v[order], z[order]
        once = np.ones(len(t), dtype=bool)  # tasks may have sent one node twice
        once[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
        t, v, z = t[once], v[once], z[once]
        first = np.ones(len(t), dtype=bool)
        first[1:] = t[1:] != t[:-1]
        runs = np.diff(np.append(np.flatnonzero(first), len(t)))
        df = np.repeat(runs, runs)
        keep = df >= least
        columns = [v[keep], z[keep].astype(np.int64), t[keep].view(np.int64), df[keep].astype(np.int64)]
        if classes:
            columns.append(np.repeat(np.bitwise_xor.reduceat(mixed(v.view(np.uint64)), np.flatnonzero(first)), runs)[keep].view(np.int64))
        for i in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=["node", "n", "token", "df", "mark"][: len(columns)])

    def run(batches):
        at, parts = None, []
        for batch in batches:
            for b, t, v, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != at and parts:
                    yield from out(parts)
                    parts = []
                at = b
                parts.append((np.frombuffer(t, dtype="<u8"), np.frombuffer(v, dtype="<i8"), np.frombuffer(z, dtype="<u4")))
        if parts:
            yield from out(parts)

    return run


def shared_entries(blocks: DataFrame, hot: int = HOT, *, classes: bool = False) -> DataFrame:
    """SHARED_ROWS (or MARKED_ROWS, for classes) of all tokens of two nodes or more. Buckets of more than hot bytes (a token in a third of all nodes,
    say) are salted, and their counts are added up."""
    columns, schema = ["bucket", "tokens", "nodes", "sizes"], MARKED_ROWS if classes else SHARED_ROWS
    sizes = blocks.groupBy("bucket").agg(F.sum(F.length("tokens")).alias("bytes")).where(F.col("bytes") > hot)
    large = {r["bucket"]: -(-r["bytes"] // hot) for r in sizes.collect()}  # buckets, of which there are a few for each partition
    if not large:
        return blocks.select(columns).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted(2, classes), schema)
    among = F.col("bucket").isin(list(large))
    whole = blocks.where(~among).select(columns).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted(2, classes), schema)
    salts = F.try_element_at(F.create_map(*[F.lit(x) for kv in large.items() for x in kv]), F.col("bucket"))
    some = blocks.where(among).withColumn("salt", F.pmod(F.xxhash64("nodes"), salts))
    some = some.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt").select(columns)
    rows = written(some.mapInArrow(_counted(1), SHARED_ROWS).groupBy("node", "token").agg(F.max("n").alias("n")), "salted")
    marks = [F.bit_xor(F.xxhash64("node")).alias("mark")] if classes else []
    counts = rows.groupBy("token").agg(F.count("*").alias("df"), *marks).where("df > 1")
    return whole.unionByName(rows.join(counts, "token").select(*[c.split()[0] for c in schema.split(", ")]))


def _prefixes(percent: int):
    """Of each node's shared shingles, sorted by node, the prefix under the second order; nothing of nodes that share too few."""

    def run(batches):
        held: list[tuple] = []

        def out(columns):
            node, n, token, df = columns
            order = np.lexsort((mixed(token.view(np.uint64)), df, node))
            node, n, token = node[order], n[order], token[order]
            first = np.ones(len(node), dtype=bool)
            first[1:] = node[1:] != node[:-1]
            heads = np.flatnonzero(first)
            shared = np.diff(np.append(heads, len(node)))
            core, n = n >> 31, n & 0x7FFFFFFF
            size = n[heads]
            most = size - (core_size(size, percent) - np.add.reduceat(core, heads))  # shingles that a linked node can have
            take = np.where(100 * most >= percent * size, np.maximum(0, shared - overlap(required(size, percent), percent) + 1), 0)
            keep = np.arange(len(node)) - np.repeat(heads, shared) < np.repeat(take, shared)
            return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(node[keep]), pa.array(n[keep]), pa.array(np.repeat(most, shared)[keep]), pa.array(np.repeat(shared, shared)[keep])], names=["token", "node", "n", "most", "shared"])

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if not len(columns[0]):
                continue
            held.append(columns)
            last = columns[0][-1]
            if columns[0][0] == last:  # one node so far; it may go on
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.flatnonzero(whole[0] != last)[-1]) + 1
            yield out([c[:cut] for c in whole])
            held = [[c[cut:] for c in whole]]
        if held:
            yield out([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _sets(width: int):
    """The set of each wanted node, with counts of BINS classes of hashes; rows that repeat a document are left out, as far as a task sees."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for b in by_bytes(batch, 0, 1 << 20):
                sets = shingle_sets([t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()], width)
                rows = []
                for s, want, least in zip(sets, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if want not in seen and len(s) and set_hash(s) == want:
                        if len(seen) < FLUSH:
                            seen.add(want)
                        rows.append((want, least, len(s), s.tobytes(), np.minimum(np.bincount((s % BINS).astype(np.int64), minlength=BINS), 32767).astype(np.int16)))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["node", "least", "n", "members", "bins"])

    return run


LINKS = "a long, a_least long, b long, b_least long"
DIFFERENCES = LINKS + ", linked boolean, n long, d long, need long, tokens binary"


def most_apart(n, percent: int):
    """By how many shingles a set of n and one that links with it differ at most."""
    return (100 - percent) * (n + n * 100 // percent) // (100 + percent)


def _verified(percent: int, differences: bool):
    """Rows sorted by pivot, salt and kind: the pivot's set first, then those to be held against it. Gives the links; or
    of all pairs what the set differs by from the pivot's, and how much of that it shares with the difference of any set of another component
    that it links with (need)."""
    more, less = 100 + percent, 100 - percent

    def run(batches):
        at, pivot, pivot_least = None, None, None
        for batch in batches:
            found = []
            for a, salt, kind, b, least, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(members, dtype="<u8")
                if kind == 0:
                    at, pivot, pivot_least = (a, salt), s, least
                elif at == (a, salt):
                    n, m = len(s), len(pivot)
                    if differences:
                        t = np.setxor1d(pivot, s, assume_unique=True)
                        d = len(t)
                        linked = d * more <= less * (n + m)
                        need = max(1, d - most_apart(n, percent), -(-(more * d + less * (m - n) + 1) // (2 * more)) if linked else 1)
                        found.append((a, pivot_least, b, least, linked, n, d, need, mixed(t ^ np.uint64(a & 0xFFFFFFFFFFFFFFFF)).tobytes()))
                    else:
                        both = len(np.intersect1d(pivot, s, assume_unique=True))
                        if 100 * both >= percent * (m + n - both):
                            found.append((a, pivot_least, b, least))
            schema = (DIFFERENCES if differences else LINKS).split(", ")
            types = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], types[c.split()[1]]) for i, c in enumerate(schema)], names=[c.split()[0] for c in schema])

    return run


def small(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """With a broadcast hint if it holds no more than so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def may_link(a: list[Column], b: list[Column], percent: int) -> Column:
    """Whether two nodes, given as [n, most, shared], may reach the threshold."""
    (n, most, shared), (m, most_m, shared_m) = a, b
    both, less = F.least(most, most_m), F.least(n, m)
    needed = F.least(F.ceil(less * percent / 100), F.greatest(F.lit(SHARED), F.ceil(less / 10)))
    return (100 * both >= percent * (n + m - both)) & (F.least(shared, shared_m) >= needed)


def may_differ(a: list[Column], b: list[Column], percent: int) -> Column:
    """Whether two nodes, given by their differences from one pivot as [n, d, *DIFFERS], reach the threshold, as far as that can be told: the
    differences can share enough, their prefixes under the second order meet, and what they share is enough. Classes are carried heaviest first,
    so what two differences share beyond the carried ones lies in the rest of one of them as a whole."""
    (n, d, shared, second, every, rest), (m, e, shared_m, second_m, every_m, rest_m) = a, b
    apart = F.floor((n + m) * (100 - percent) / (100 + percent))
    sizes = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (2 * F.least(shared, shared_m) + apart >= d + e)
    meet = F.coalesce(F.arrays_overlap(second, second_m), F.lit(True))
    both = F.aggregate(F.array_intersect(every, every_m), F.greatest(rest, rest_m), lambda s, x: s + x.bitwiseAND(F.lit(HEAVIEST)))
    return sizes & meet & (2 * both + apart >= d + e)


def open_pairs(here: DataFrame, info: list[str], allowed) -> DataFrame:
    """Pairs (a, b) of lists (token, node, root and info) that lie in different components and are allowed."""
    right = here.select(F.col("token").alias("token_a"), F.col("node").alias("a"), F.col("root").alias("root_a"), *[F.col(c).alias(f"{c}_a") for c in info])
    on = (F.col("token") == F.col("token_a")) & (F.col("a") < F.col("node")) & (F.col("root") != F.col("root_a"))
    return here.join(right, on & allowed([F.col(c) for c in info], [F.col(f"{c}_a") for c in info])).select("a", F.col("node").alias("b")).distinct()


def within_histograms(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets' counts of BINS classes of hashes allow a link."""
    bins = lambda name: sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("bins").alias(f"bins_{name}"))
    both = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    p = pairs.join(bins("a"), "a").join(bins("b"), "b").withColumn("both", both)
    clipped = F.greatest("n_a", "n_b") > 32767  # counts may be too low
    return p.where(clipped | (100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both")))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """The links among pairs (a, b), or the differences of all pairs. Pivots of many pairs are salted."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("k"))
    p = written(pairs.join(small(counts), "a").select("a", "b", F.pmod(F.hash("b"), F.ceil(F.col("k") / 256).cast("int")).alias("salt")), "pairs")
    heads = sets.join(small(p.select("a", "salt").distinct().withColumnRenamed("a", "node")), "node").select(F.col("node").alias("a"), "salt", F.lit(0).alias("kind"), F.col("node").alias("b"), "least", "members")
    rest = sets.join(small(p.withColumnRenamed("b", "node")), "node").select("a", "salt", F.lit(1).alias("kind"), F.col("node").alias("b"), "least", "members")
    rows = heads.unionByName(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    out = written(rows.mapInArrow(_verified(percent, differences), DIFFERENCES if differences else LINKS), "links")
    spent(p)
    return out


def _differences(buckets: int):
    """BLOCKS of the rows (key, need, tokens)."""
    edges, names = edges_of(buckets), [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches):
        held, n = [], 0

        def flush():
            keys, needs, tokens = zip(*held, strict=True)
            held.clear()
            lengths = [len(t) for t in tokens]
            for columns in dealt(np.concatenate(tokens), np.repeat(np.array(keys, dtype="<i8"), lengths), np.repeat(np.array(needs, dtype="<u4"), lengths), edges):
                yield pa.RecordBatch.from_arrays(list(columns), names=names)

        for batch in batches:
            for key, need, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((key, need, np.frombuffer(tokens, dtype="<u8")))
                n += len(tokens) // 8
                if n > FLUSH:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    return run


def _two_prefixes(carried: int):
    """Of each key's shared tokens, sorted by key, the classes (tokens that lie in the same differences); and of these how much they weigh together
    (shared), the prefixes under two orders, rarest first and by hash (the latter null beyond so many), the heaviest ones (every) and the
    weight of the others (rest); nothing of keys that share too little."""
    names = ["key", "shared", "tokens", "second", "every", "rest"]

    def out(columns):
        key, need, _, df, mark = columns
        order = np.lexsort((mark, key))
        key, need, df, mark = key[order], need[order], df[order], mark[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        heads = np.flatnonzero(new)
        weight = np.diff(np.append(heads, len(key)))
        parts = -(-weight // HEAVIEST)
        owner = np.repeat(np.arange(len(heads)), parts)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        weight, at = np.minimum(weight[owner] - part * HEAVIEST, HEAVIEST), heads[owner]
        key, need, df = key[at], need[at], df[at]
        token = mixed(mark[at].view(np.uint64) + part.astype(np.uint64)) & ~np.uint64(HEAVIEST) | weight.astype(np.uint64)
        hashed, token = mixed(token ^ np.uint64(0x5851F42D4C957F2D)), token.view(np.int64)
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        runs = np.diff(np.append(heads, len(key)))
        shared, need = np.add.reduceat(weight, heads), need[heads]

        def prefixes(order):
            """Tokens in this order, and how many each key keeps: those without which less than it needs would be left."""
            before = np.cumsum(weight[order]) - weight[order]
            keep = before - np.repeat(before[heads], runs) <= np.repeat(shared - need, runs)
            return token[order], np.add.reduceat(keep.astype(np.int64), heads)

        (t, first), (u, second) = prefixes(np.lexsort((hashed, df, key))), prefixes(np.lexsort((hashed, key)))
        heavy = token[np.lexsort((token, -weight, key))]
        rows = [x for x in zip(key[heads].tolist(), heads.tolist(), runs.tolist(), shared.tolist(), first.tolist(), second.tolist()) if x[4]]
        every = [np.unique(heavy[h : h + min(n, carried)]) for _, h, n, _, _, _ in rows]
        lists = [[t[x[1] : x[1] + x[4]] for x in rows], [u[x[1] : x[1] + x[5]] if x[5] <= carried else None for x in rows], every]
        rest = [x[3] - int((e & HEAVIEST).sum()) for x, e in zip(rows, every, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[3] for x in rows], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists), pa.array(rest, pa.int64())], names=names)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if not len(columns[0]):
                continue
            held.append(columns)
            last = columns[0][-1]
            if columns[0][0] == last:
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.flatnonzero(whole[0] != last)[-1]) + 1
            yield out([c[:cut] for c in whole])
            held = [[c[cut:] for c in whole]]
        if held:
            yield out([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def difference_lists(differences: DataFrame, buckets: int) -> DataFrame:
    """Lists (token, node, n, d and DIFFERS) of the differences from each pivot."""
    d = differences.withColumn("key", F.xxhash64("a", "b"))
    blocks = written(d.select("key", "need", "tokens").mapInArrow(_differences(buckets), BLOCKS), "differences")
    rows = shared_entries(blocks, classes=True).repartition("node").sortWithinPartitions("node")
    rows = written(rows.mapInArrow(_two_prefixes(CARRIED), "key long, shared long, tokens array<long>, second array<long>, every array<long>, rest long"), "prefixes")
    spent(blocks)
    lists = rows.join(d.select("key", F.col("b").alias("node"), "n", "d"), "key").select(F.explode("tokens").alias("token"), "node", "n", "d", *DIFFERS)
    out = written(lists, "lists")
    spent(rows)
    return out


class Search:
    """The links found so far, and the components that they make."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent, self.links, self.roots = sets, percent, [], None

    def found(self, new: DataFrame) -> bool:
        """Takes up the links that join different components, if there are any."""
        new = new.select("a", "a_least", "b", "b_least")
        if self.roots is not None:
            root = lambda c: self.roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
            known = new.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
            new = written(known.select("a", "a_least", "b", "b_least"), "fresh")
        if not new.limit(1).count():
            return False
        self.links.append(new)
        every = self.links[0]
        for x in self.links[1:]:
            every = every.union(x)
        end = lambda c: F.struct(F.col(f"{c}_least").alias("least"), F.col(c).alias("node"))
        ids = components(every.select(end("a").alias("a"), end("b").alias("b")))
        before, self.roots = self.roots, written(ids.select(F.col("node.node").alias("node"), F.col("root.node").alias("root"), F.col("root.least").alias("cid")), "roots")
        spent(before)
        return True

    def rooted(self, lists: DataFrame) -> DataFrame:
        if self.roots is None:
            return lists.withColumn("root", F.col("node"))
        return lists.join(self.roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def star(self, lists: DataFrame, turn: int) -> bool:
        """Every list's pivot against the members that are not yet connected with it."""
        here = self.rooted(lists)
        rank = [F.xxhash64("node", F.lit(turn)).alias("h")] if turn else [(F.col("n") - F.col("most")).alias("own"), (F.col("n") - F.col("shared")).alias("rare"), F.xxhash64("node", F.lit(turn)).alias("h")]
        info = ("n", "most", "shared")
        pivot = F.struct(*rank, F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in (*info, "root")])
        split = here.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(pivot).alias("p")).where("lo <> hi")
        pairs = here.join(split.select("token", "p.a", "p.root_a", *[f"p.{c}_a" for c in info]), "token").where("root <> root_a")
        pairs = written(pairs.where(may_link([F.col(c) for c in info], [F.col(f"{c}_a") for c in info], self.percent)).select("a", F.col("node").alias("b")).distinct(), "tried")
        out = pairs.limit(1).count() > 0
        if out:
            links = verified(pairs, self.sets, self.percent)
            out = self.found(links)
        spent(pairs)
        return out

    def level(self, lists: DataFrame, info: list[str], allowed, rank: list[Column], few: int | None) -> DataFrame | None:
        """Tries the pairs of all lists with few members (of all lists, where few is None). Of longer lists gives the
        differences from their pivots (the members of the least rank), if there are any."""
        here = written(self.rooted(lists), "here")
        split = here.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k"), F.min(F.struct(*[c.alias(f"rank{i}") for i, c in enumerate(rank)], F.xxhash64("node").alias("h"), F.col("node").alias("a"))).alias("p")).where("lo <> hi")
        split = written(split.select("token", "k", "p.a"), "split")
        short = split if few is None else split.where(F.col("k") <= few)
        kept = written(open_pairs(here.join(short.select("token"), "token"), info, allowed), "open")
        if "every" not in info:
            pairs, kept = kept, written(within_histograms(kept, self.sets, self.percent), "candidates")
            spent(pairs)
        if kept.limit(1).count():
            self.found(verified(kept, self.sets, self.percent))
        spent(kept)
        out = None
        if few is not None and split.where(F.col("k") > few).limit(1).count():
            stars = written(here.join(split.where(F.col("k") > few).select("token", "a"), "token").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "stars")
            out = verified(stars, self.sets, self.percent, differences=True)
            spent(stars)
            self.found(out.where("linked"))
        spent(here, split)
        return out


def jaccard_classes(docs: DataFrame, width: int = 4, percent: int = 85, stars: int = STARS, few: int = FEW, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash (xxhash64 of the text, which with doc_id names a row), node (of equal sets) and
    component_node (of the node that component_id is in: as doc_ids may repeat, only the two together name a component)."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = written(d.mapInArrow(_sampled(width, percent, buckets), FIRST), "samples")
    members = written(first.where("bucket is null").select("doc_id", "text_hash", "n", "node"), "members")
    shared = shared_entries(first.where("bucket is not null"))
    prefixes = written(shared.repartition("node").sortWithinPartitions("node").mapInArrow(_prefixes(percent), "token long, node long, n long, most long, shared long"), "prefixes")
    spent(first)
    several = prefixes.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    lists = written(prefixes.join(several, "token"), "lists")
    spent(prefixes)
    names = members.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    want = written(names.join(lists.select("node").distinct(), "node").select(F.col("least").alias("doc_id"), F.col("node").alias("want")), "want")
    sets = d.join(small(want), "doc_id").select("text", "want", F.col("doc_id").alias("least"))
    sets = written(sets.mapInArrow(_sets(width), "node long, least long, n long, members binary, bins array<short>"), "sets")
    if sets.groupBy("node").count().where("count > 1").limit(1).count():
        once = written(sets.dropDuplicates(["node"]), "sets")
        spent(sets)
        sets = once
    search, turn = Search(sets, percent), 0
    while turn < stars and search.star(lists, turn):
        turn += 1
    info, allowed = ["n", "most", "shared"], lambda a, b: may_link(a, b, percent)
    rank = [F.col("n") - F.col("most"), F.col("n") - F.col("shared")]  # a member with little of its own, so that the differences are small
    for level in range(levels + 1):
        differences = search.level(lists, info, allowed, rank, (few * MORE if level else few) if level < levels else None)
        spent(lists)
        if differences is None:
            break
        lists = difference_lists(differences, buckets)
        info, allowed = ["n", "d", *DIFFERS], lambda a, b: may_differ(a, b, percent)
        rank = [F.col("d") - F.col("shared"), F.col("d")]
    spent(sets, want)
    cid = names.select("node", F.col("least").alias("cid"), F.col("node").alias("root"))
    if search.roots is not None:
        found = names.join(search.roots.withColumnRenamed("cid", "first"), "node", "left")
        cid = found.select("node", F.coalesce("first", "least").alias("cid"), F.coalesce("root", "node").alias("root"))
    out = members.join(written(cid, "classes"), "node", "left")  # a table, so that the rows of a node of very many copies can be split
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("cid")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "text_hash", "node", F.col("root").alias("component_node"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
