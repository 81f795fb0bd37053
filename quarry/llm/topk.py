"""Operator 8, exact top-k search: block-at-a-time pruning.

Vectors become integers and lie in document-range blocks of BLOCK rows. A block keeps a forward index (its rows' weights) and each
term's maximum and minimum. For a query, blocks are ordered by the sum of their terms' largest contributions and
scored through their forward indexes until that sum falls below the k-th score so far. A sum that equals it
is still scored, as ties go to the smaller id.

GROUP blocks form a group, QUERIES queries a query block; one task holds one group and streams query blocks past it, so memory is
bounded whatever the size. Each query block visits one group first. With the k-th scores from there it visits the bounds of all groups (the
maxima and minima of their terms, a small table in chunks of CHUNK groups), and of a query only the groups that it can still enter get a copy.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without id; shorter vectors count as
filled with zeros; repeated ids are never each other's candidates; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import table, written

BLOCK, GROUP, QUERIES, CHUNK = 256, 64, 512, 2048
BOUNDS = "g long, dims long, high binary, low binary"
ROWS = "part long, block long, n long, dims long, ids binary, weights binary"
SEEN = "g long, kind int, block long, n long, dims long, ids binary, weights binary, floor binary"


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v array<long>: floor(scale * component) of the vectors that take part."""
    x = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    x = x.where(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return x.select("vec_id", F.transform("e", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def packed(w: np.ndarray) -> bytes:
    """A matrix of integers, in as few bytes a weight as they need."""
    low, high = (int(w.min()), int(w.max())) if w.size else (0, 0)
    kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return w.astype(kind).tobytes()


def blocks(x: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of up to size vectors, consecutive in id within their part."""

    def run(batches):
        from pyspark import TaskContext

        part, count, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def block():
            nonlocal count
            dims = max(map(len, rows))
            w = np.zeros((len(rows), dims), dtype="<i8")
            for i, r in enumerate(rows):
                w[i, : len(r)] = r
            out = [part, count, len(rows), dims, np.array(ids, dtype="<i8").tobytes(), packed(w)]
            count += 1
            ids.clear(), rows.clear()
            types = (*[pa.int64()] * 4, pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types, strict=True)], names=["part", "block", "n", "dims", "ids", "weights"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield block()
        if ids:
            yield block()

    return written(x.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(run, ROWS), name)


def _matrix(n, dims, raw):
    return np.frombuffer(raw, dtype=f"<i{len(raw) // (n * dims)}" if n * dims else "<i8").reshape(n, dims).astype("<i8")


def _fit(a: np.ndarray, dims: int) -> np.ndarray:
    """Filled with zeros to so many terms."""
    return a if a.shape[-1] == dims else np.concatenate([a, np.zeros((*a.shape[:-1], dims - a.shape[-1]), dtype=a.dtype)], axis=-1)


def _exact(*arrays: np.ndarray) -> type:
    """Doubles where all products and sums are exact in them, else Python integers."""
    most = 1
    for a in arrays:
        most *= max(1, int(np.abs(a).max(initial=0)))
    return np.float64 if most * arrays[0].shape[1] < 1 << 53 else object


class Group:
    """The blocks of one group, with the maxima and minima of their terms."""

    def __init__(self):
        self.ids, self.rows, self.high, self.low = [], [], [], []

    def add(self, n, dims, ids, weights):
        w = _matrix(n, dims, weights)
        self.ids.append(np.frombuffer(ids, dtype="<i8"))
        self.rows.append(w)
        self.high.append(w.max(axis=0))
        self.low.append(w.min(axis=0))

    def fitted(self, dims: int):
        return [_fit(r, dims) for r in self.rows], np.array([_fit(a, dims) for a in self.high]), np.array([_fit(a, dims) for a in self.low])

    def search(self, query_ids, queries, floors, k):
        """For each query its k best rows here as (query, ids, scores), leaving out those below the query's floor."""
        dims = max([queries.shape[1], *(r.shape[1] for r in self.rows)])
        rows, high, low = self.fitted(dims)
        q = np.zeros((len(queries), dims), dtype=np.int64)
        q[:, : queries.shape[1]] = queries
        kind = _exact(q, np.maximum(np.abs(high), np.abs(low)))
        rows, high, low, q = [r.astype(kind) for r in rows], high.astype(kind), low.astype(kind), q.astype(kind)
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        for i, query in enumerate(query_ids):
            ids, scores, floor = np.empty(0, dtype=np.int64), np.empty(0, dtype=kind), floors[i]
            for b in np.argsort(-bounds[i], kind="stable"):
                if floor is not None and bounds[i][b] < floor:
                    break
                s, c = rows[b] @ q[i], self.ids[b]
                keep = c != query if floor is None else (c != query) & (s >= floor)
                ids, scores = np.concatenate([ids, c[keep]]), np.concatenate([scores, s[keep]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k and (floor is None or scores[-1] > floor):
                    floor = scores[-1]
            yield query, ids, scores


def _floors(raw, n):
    return [None] * n if raw is None else [None if x == np.iinfo(np.int64).min else int(x) for x in np.frombuffer(raw, dtype="<i8")]


def _visit(k: int, seed: bool):
    """One pass over rows sorted by group and kind: a group's blocks (kind 0), then the query blocks that visit it."""

    def run(batches):
        at, group = None, None
        for batch in batches:
            for j in range(batch.num_rows):
                r = batch.slice(j, 1).to_pylist()[0]
                if group is None or r["g"] != at:
                    at, group = r["g"], Group()
                if r["kind"] == 0:
                    group.add(r["n"], r["dims"], r["ids"], r["weights"])
                    continue
                ids = np.frombuffer(r["ids"], dtype="<i8").tolist()
                found = group.search(ids, _matrix(r["n"], r["dims"], r["weights"]), _floors(r["floor"], r["n"]), k) if group.rows else ()
                if seed:
                    floors = [int(s[-1]) if len(s) == k and abs(int(s[-1])) < 1 << 62 else np.iinfo(np.int64).min for _, _, s in found]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c]], t) for c, t in (("block", pa.int64()), ("n", pa.int64()), ("dims", pa.int64()), ("ids", pa.binary()), ("weights", pa.binary()))] + [pa.array([np.array(floors, dtype="<i8").tobytes()], pa.binary())], names=["block", "n", "dims", "ids", "weights", "floor"])
                else:
                    rows = [(q, int(i), int(s)) for q, near, score in found for i, s in zip(near, score, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


def _bounds(batches):
    """Of each group, given by its blocks in any order within one task, the maxima and minima of its terms."""
    found: dict[int, tuple] = {}
    for batch in batches:
        for r in batch.to_pylist():
            w = _matrix(r["n"], r["dims"], r["weights"])
            high, low = w.max(axis=0), w.min(axis=0)
            if r["g"] in found:
                h, m = found[r["g"]]
                dims = max(len(h), len(high))
                high, low = np.maximum(_fit(h, dims), _fit(high, dims)), np.minimum(_fit(m, dims), _fit(low, dims))
            found[r["g"]] = high, low
    # A row shorter than its group's widest counts as filled with zeros.
    rows = [(g, len(h), h.astype("<i8").tobytes(), m.astype("<i8").tobytes()) for g, (h, m) in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["g", "dims", "high", "low"])


def _entered(batches):
    """Rows sorted by chunk and kind: groups' bounds (kind 0; high in ids, low in weights), then query blocks. Gives for each group the queries
    that may still find something there."""
    names = [x.split()[0] for x in SEEN.split(", ")]
    at, groups, high, low = None, [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["chunk"] != at:
                at, groups, high, low = r["chunk"], [], [], []
            if r["kind"] == 0:
                groups.append(r["g"])
                high.append(np.frombuffer(r["ids"], dtype="<i8"))
                low.append(np.frombuffer(r["weights"], dtype="<i8"))
                continue
            q = _matrix(r["n"], r["dims"], r["weights"])
            dims = max([q.shape[1], *map(len, high)])
            up, down, wide = np.array([_fit(h, dims) for h in high]), np.array([_fit(m, dims) for m in low]), _fit(q, dims)
            kind = _exact(wide, np.maximum(np.abs(up), np.abs(down)))
            wide, up, down = wide.astype(kind), up.astype(kind), down.astype(kind)
            floors = np.frombuffer(r["floor"], dtype="<i8")
            bounds = np.maximum(wide, 0) @ up.T + np.minimum(wide, 0) @ down.T
            ids = np.frombuffer(r["ids"], dtype="<i8")
            for j, g in enumerate(groups):
                go = bounds[:, j] >= floors
                if go.any():
                    row = (g, 1, r["block"], int(go.sum()), r["dims"], ids[go].tobytes(), packed(q[go]), floors[go].tobytes())
                    types = (pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 3)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)


def top_k(vectors: DataFrame, query_rows: str = "vec_id % 100 = 0", k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score."""
    x = quantized(vectors, scale)
    rows = blocks(x, BLOCK, "blocks").withColumn("at", F.floor(F.col("block") / GROUP))
    numbers = written(rows.select("part", "at").distinct().withColumn("g", F.row_number().over(Window.orderBy("part", "at")).cast("long") - 1), "groups")
    groups = max(1, numbers.count())
    none = F.lit(None).cast("binary").alias("floor")
    docs = rows.join(numbers, ["part", "at"]).select("g", F.lit(0).alias("kind"), "block", "n", "dims", "ids", "weights", none)
    queries = blocks(x.where(query_rows), QUERIES, "queries")
    columns = [x.split()[0] for x in SEEN.split(", ")]

    def visits(q: DataFrame, seed: bool, schema: str) -> DataFrame:
        both = docs.unionByName(q.select("g", F.lit(1).alias("kind"), "block", "n", "dims", "ids", "weights", "floor"))
        return both.repartition("g").sortWithinPartitions("g", "kind", "block").select(columns).mapInArrow(_visit(k, seed), schema)

    first = queries.select(F.pmod(F.hash("part", "block"), F.lit(groups)).cast("long").alias("g"), "block", "n", "dims", "ids", "weights", none)
    seeded = written(visits(first, True, "block long, n long, dims long, ids binary, weights binary, floor binary"), "seeded")
    bounds = docs.select("g", "n", "dims", "weights").repartition("g").mapInArrow(_bounds, BOUNDS)
    chunks = -(-groups // CHUNK)
    bounds = bounds.select(F.floor(F.col("g") / CHUNK).cast("long").alias("chunk"), "g", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("n"), "dims", F.col("high").alias("ids"), F.col("low").alias("weights"), none)
    sent = seeded.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).select("chunk", F.lit(-1).cast("long").alias("g"), F.lit(1).alias("kind"), "block", "n", "dims", "ids", "weights", "floor")
    entered = bounds.unionByName(sent).repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_entered, SEEN)
    found = visits(written(entered, "entered"), False, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
with q as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id as vec_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as score
  from q a join q b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 10
"""
