"""Approximate nearest vectors (J2, R2): inverted lists of residual codes, and an exact check of what they find.

A quantizer is fitted on a bounded sample (the SAMPLE rows of the smallest key hashes): centres, each of which has a list, and for the
rest of a vector beside its centre a product code of one byte for each few dimensions. Every row of the table is indexed: equal vectors
are one entry with its rows by key (the first COPIES of them, as no search asks for more), the entries' codes lie in blocks of BLOCK by list, and their
vectors in a table by list. How many lists a query visits is measured on the sample, so that the true neighbours there lie in
them at the wanted rate.

A search sends each query to its lists, where whole blocks of queries meet blocks of codes; the best by code are then joined
with their vectors, and ranked by exact distances. Lists that hold very many rows (a third of all, say) have many blocks, so joins split
them. Vectors that are null, of another length than most, or hold nulls or non-finite numbers are not indexed, and such queries
find nothing; `retrieval.nearest` stays the exact way, for these as well, and for more than COPIES rows a query. Equal distances go to
the smaller key; repeated keys are rows of their own.
An empty table has an index without lists, in which nothing is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import new_folder, written
from .retrieval import ranked, small

#: Rows that a quantizer is fitted on, their numbers at most, and the queries among them by which lists are counted.
SAMPLE, NUMBERS, TRIALS = 1 << 14, 1 << 24, 128
LISTS, CODE, BLOCK, QUERIES = 4096, 256, 2048, 128
#: Rows of one vector that a search can give, and rows that a task of a search holds before it drops those beyond each query's best.
COPIES, HELD = 1024, 1 << 18
#: Bytes of routed queries, and rows of short columns, that may be broadcast; beyond, joins shuffle.
SENT, FEW = 1 << 23, 20_000
#: Steps of the fits.
STEPS = 12


@dataclass(frozen=True)
class Quantizer:
    centers: np.ndarray  # lists x dimensions
    books: np.ndarray  # parts x CODE x dimensions of a part
    probes: int
    dimensions: int

    def parts(self, x: np.ndarray) -> np.ndarray:
        """rows x parts x dimensions of a part, with zeros behind the last dimension."""
        m, _, w = self.books.shape
        return np.pad(x, ((0, 0), (0, m * w - x.shape[1]))).reshape(len(x), m, w)

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        d = distances(x, self.centers)
        order = np.argsort(d, axis=1, kind="stable")
        return order[:, :n]

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.parts(x - self.centers[lists])
        return np.stack([distances(rest[:, j], self.books[j]).argmin(axis=1) for j in range(len(self.books))], axis=1).astype(np.uint8)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.square(x).sum(1)[:, None] + np.square(y).sum(1)[None, :] - 2 * (x @ y.T)


def centred(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means, from k of the rows; a centre that nothing is nearest to goes to the row that is farthest from its own."""
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(STEPS):
        d = distances(x, centers)
        own = d.argmin(axis=1)
        counts = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
        far = np.argsort(-d[np.arange(len(x)), own], kind="stable")[: int((~full).sum())]
        centers[np.flatnonzero(~full)[: len(far)]] = x[far]
    return centers


def valid(vectors: DataFrame, dimensions: int) -> DataFrame:
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where((F.size("embedding") == dimensions) & ~bad)


def fitted(vectors: DataFrame, key: str = "chunk_id", lists: int | None = None, width: int = 4, k: int = 10, found: float = 0.97, seed: int = 7) -> Quantizer | None:
    """width: dimensions to a byte of code. found: the share of true neighbours that must lie in the lists that are visited, measured on the sample."""
    most = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if most is None:
        return None
    n = most["n"]
    rows = valid(vectors, n).select(F.col("embedding").cast("array<double>").alias("e"), F.xxhash64(key, "embedding").alias("h")).orderBy("h").limit(max(1, min(SAMPLE, NUMBERS // n))).select("e").toArrow()
    x = rows.column(0).combine_chunks().flatten().to_numpy().reshape(-1, n)
    if not len(x):
        return None
    x = np.unique(x, axis=0)  # copies tell nothing of lists, and would seem easy to find
    rng = np.random.default_rng(seed)
    k_lists = lists or int(min(LISTS, max(1, round(most["count"] ** 0.5)), max(1, len(x) // 8)))
    centers = centred(x, k_lists, rng)
    rest = x - centers[distances(x, centers).argmin(axis=1)]
    m = -(-n // width)
    rest = np.pad(rest, ((0, 0), (0, m * width - n))).reshape(len(x), m, width)
    books = np.stack([np.pad(b := centred(rest[:, j], CODE, rng), ((0, CODE - len(b)), (0, 0)), constant_values=1e6) for j in range(m)])
    q = Quantizer(centers, books, len(centers), n)
    own, asked = q.nearest_lists(x, 1)[:, 0], rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    near = np.argsort(distances(x[asked], x), axis=1, kind="stable")[:, 1 : k + 1]  # without itself
    place = np.argsort(q.nearest_lists(x[asked], len(centers)), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    probes = int(ranks[max(0, int(np.ceil(found * len(ranks))) - 1)]) + 1 if len(ranks) else len(centers)
    return Quantizer(centers, books, probes, n)


def _matrix(column, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


@dataclass(frozen=True)
class Index:
    """blocks: list, entries, codes. vectors: list, entry, embedding. rows: entry, key, place (from 1, by key)."""

    quantizer: Quantizer | None
    key: str
    blocks: DataFrame | None = None
    vectors: DataFrame | None = None
    rows: DataFrame | None = None


def indexed(vectors: DataFrame, key: str = "chunk_id", quantizer: Quantizer | None = None, folder: str | None = None) -> Index:
    """The index of every valid row, written into folder (or one of its own in the shared folder)."""
    q = quantizer or fitted(vectors, key)
    if q is None:
        return Index(None, key)

    def assign(batches):
        for b in batches:
            x = _matrix(b.column(1), q.dimensions)
            lists = q.nearest_lists(x, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
            codes = q.codes(x, lists) if len(x) else []
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], names=["list", "entry", "codes", "embedding"])

    def packed(batches):
        at, entries, codes = None, [], []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([entries], pa.list_(pa.string())), pa.array([b"".join(codes)], pa.binary())], names=["list", "entries", "codes"])

        for b in batches:
            for n, entry, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if entries and (n != at or len(entries) == BLOCK):
                    yield block()
                    entries, codes = [], []
                at = n
                entries.append(entry)
                codes.append(c)
        if entries:
            yield block()

    folder = folder or new_folder(vectors.sparkSession, "ann")
    equal = Window.partitionBy("embedding").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.concat(F.first(F.col(key)).over(equal).cast("string"), F.lit("/"), F.hex(F.xxhash64("embedding")))
    rows = valid(vectors, q.dimensions).select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("place", F.row_number().over(equal)).withColumn("entry", named).where(F.col("place") <= COPIES)
    rows = written(rows.select("entry", key, "place", F.when(F.col("place") == 1, F.col("embedding")).alias("embedding")), "rows", folder=f"{folder}/rows")
    entries = rows.where("place = 1").select("entry", "embedding").mapInArrow(assign, "list int, entry string, codes binary, embedding array<double>")
    entries = written(entries, "entries", folder=f"{folder}/entries")
    # Entries of a list go to as many tasks as its blocks fill; the counts are one row for each list.
    counts = entries.groupBy("list").agg(F.ceil(F.count("*") / (8 * BLOCK)).cast("int").alias("tasks"))
    salted = entries.join(small(counts), "list").withColumn("salt", F.pmod(F.xxhash64("entry"), F.col("tasks")))
    near = salted.select("list", "entry", "codes", "salt").repartition("list", "salt").sortWithinPartitions("list", "salt").select("list", "entry", "codes")
    blocks = written(near.mapInArrow(packed, "list int, entries array<string>, codes binary"), "blocks", folder=f"{folder}/blocks")
    return Index(q, key, blocks, entries.select("list", "entry", "embedding"), rows.select("entry", key, "place"))


def _firsts(parts: list[tuple], keep: int) -> tuple[tuple, dict]:
    """Of (query, list, entry, distance) columns each query's first rows by distance, and the last distance of queries that have enough."""
    query, lists, entries, near = (pa.concat_arrays(c) for c in zip(*parts, strict=True))
    of, d = query.dictionary_encode().indices.to_numpy(), near.to_numpy()
    order = np.lexsort((d, of))
    of = of[order]
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    kept, full = pa.array(order[place < keep]), order[place == keep - 1]
    return tuple(c.take(kept) for c in (query, lists, entries, near)), dict(zip(query.take(pa.array(full)).to_pylist(), d[full].tolist(), strict=True))


def searched(queries: DataFrame, index: Index, k: int = 10, probes: int | None = None, refine: int = 20) -> DataFrame:
    """query_id, rank, key, distance (squared L2, exact). refine * k entries by code are checked for each query."""
    q, key = index.quantizer, index.key
    query_kind = queries.schema["query_id"].dataType.simpleString()
    if k > COPIES:
        raise ValueError(f"the index keeps {COPIES} rows of a vector; nearest() has no such bound")
    if q is None:
        return queries.sparkSession.createDataFrame([], f"query_id {query_kind}, rank int, {key} string, distance double")
    visits, keep = min(probes or q.probes, len(q.centers)), refine * k
    asked = valid(queries, q.dimensions).select("query_id", F.col("embedding").cast("array<double>").alias("probe"))

    def route(batches):
        for b in batches:
            x = _matrix(b.column(1), q.dimensions)
            if len(x):
                lists = q.nearest_lists(x, visits)
                at = pa.array(np.repeat(np.arange(len(x)), visits))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel(), pa.int32()), b.column(0).take(at), b.column(1).take(at)], names=["list", "query_id", "probe"])

    def scan(batches):
        held, n, most, names, bounds = [], 0, HELD, ["query_id", "list", "entry", "near"], {}
        for b in batches:
            for at, ids, probes_, entries, codes in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                x = _matrix(probes_.values, q.dimensions)
                rest = q.parts(x - q.centers[at])
                code = np.frombuffer(codes, dtype=np.uint8).reshape(len(entries), -1)
                d = np.zeros((len(x), len(entries)), dtype=np.float32)
                for j in range(len(q.books)):
                    d += np.take(distances(rest[:, j], q.books[j]).astype(np.float32), code[:, j], axis=1)
                last = np.partition(d, keep - 1, axis=1)[:, keep - 1 : keep] if d.shape[1] > keep else np.full((len(d), 1), np.inf)
                if bounds:
                    last = np.minimum(last, np.array([bounds.get(i, np.inf) for i in ids.as_py()], dtype=np.float32)[:, None])
                of, who = np.nonzero(d <= last)
                held.append((ids.values.take(pa.array(of)), pa.array(np.full(len(of), at), pa.int32()), entries.values.take(pa.array(who)), pa.array(d[of, who].astype(np.float64))))
                n += len(of)
                if n > most:
                    first, bounds = _firsts(held, keep)
                    held, n = [first], len(first[0])
                    most = max(HELD, 2 * n)
                    if n > 4 * HELD:  # very many queries
                        yield pa.RecordBatch.from_arrays(list(held[0]), names=names)
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(_firsts(held, keep)[0]), names=names)

    asked = written(asked, "asked")  # read by several joins
    n = asked.count()
    routed = asked.mapInArrow(route, f"list int, query_id {query_kind}, probe array<double>")
    chunks = max(1, -(-n // QUERIES))
    groups = routed.groupBy("list", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("query_id", "probe")).alias("q"))
    groups = groups.select("list", F.col("q.query_id").alias("ids"), F.col("q.probe").alias("probes"))
    light = n * visits * q.dimensions * 8 <= SENT  # bytes of all that is routed
    met = index.blocks.join(F.broadcast(groups) if light else groups, "list").select("list", "ids", "probes", "entries", "codes")
    found = met.mapInArrow(scan, f"query_id {query_kind}, list int, entry string, near double")
    best = ranked(found, [F.asc("near"), F.asc("entry")], keep).select("query_id", "list", "entry")
    best = written(best, "best")
    exact = index.vectors.join(small(best, FEW), ["list", "entry"]).join(asked, "query_id").withColumn("distance", tx.squared_distance("probe", "embedding"))
    entries = written(ranked(exact, [F.round("distance", 9), F.asc("entry")], k).select("query_id", "entry", "distance"), "found")
    rows = index.rows.where(F.col("place") <= k).join(small(entries, FEW), "entry")
    return ranked(rows, [F.round("distance", 9), F.asc(key)], k).select("query_id", "rank", key, "distance")


def recall(found: DataFrame, exact: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: queries with exact neighbours (n), and the share of those neighbours that was found."""
    hit = exact.select("query_id", key).join(found.select("query_id", key).withColumn("hit", F.lit(1)), ["query_id", key], "left")
    return hit.agg(F.countDistinct("query_id").alias("n"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("recall"))
