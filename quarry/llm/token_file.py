"""Operator 10, token-ID output: a wavelet matrix per shard.

Documents are put in ascending order of doc_id by range partitioning, encoded, and cut into shards of whole documents
of about SHARD tokens (a longer document is a shard of its own). A shard is one record of the file:
its document table and a wavelet matrix, one bit-plane per bit of an id from the highest down, each with the ones counted before every
512 bits. rank and select on the planes answer token access, counts and occurrences without decoding the shard. The file is a Parquet file, so it is
compressed, written by Spark's committer to any store, and a shard's planes are read only where they are asked for.

Cases: a null or empty text is its end id alone; rows of one doc_id are ordered by text, null ids first; an empty table gives an
empty file; further columns don't matter. Ids have BITS bits; a vocabulary with larger ones is refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import by_bytes, table, written
from .vocab import word_encoder

SHARD, BITS, BLOCK = 1 << 21, 16, 512
#: Ids that are parted at once, as few as a processor's cache holds.
STRIP = 1 << 16
FILE = "part long, shard long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, planes array<binary>, zeros array<long>, ranks array<binary>"


class WaveletMatrix:
    """Bit-planes of a sequence of 16-bit ids, from the highest bit down; each plane is stably parted by the one above."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ranks: list[bytes]):
        self.n, self.raw, self.zeros, self.raw_ranks = n, planes, zeros, ranks

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        a, planes, zeros, ranks = ids, [], [], []
        for k in range(BITS - 1, -1, -1):
            packed, low, high = [], [], []
            for i in range(0, len(a), STRIP):
                part = a[i : i + STRIP]
                bits = (part & np.uint16(1 << k)) != 0
                packed.append(np.packbits(bits))
                low.append(np.compress(~bits, part))
                high.append(np.compress(bits, part))
            packed = np.concatenate([*packed, np.zeros(0, dtype=np.uint8)])
            planes.append(packed.tobytes())
            zeros.append(sum(map(len, low)))
            a = np.concatenate([*low, *high, a[:0]])
            full = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), dtype=np.uint8)
            full[: len(packed)] = packed
            ones = np.bitwise_count(full.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes())
        return cls(len(ids), planes, zeros, ranks)

    def ids(self) -> np.ndarray:
        """The whole sequence: the planes are undone from the lowest bit up."""
        a = np.zeros(self.n, dtype=np.uint16)
        for k, (plane, zeros) in enumerate(zip(reversed(self.raw), reversed(self.zeros), strict=True)):
            bits = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=self.n).view(bool)
            out, low, high = np.empty_like(a), 0, zeros
            for i in range(0, self.n, STRIP):
                part, to = bits[i : i + STRIP], out[i : i + STRIP]
                one, zero = np.flatnonzero(part), np.flatnonzero(~part)
                to[zero] = a[low : low + len(zero)]
                to[one] = a[high : high + len(one)] | np.uint16(1 << k)
                low, high = low + len(zero), high + len(one)
            a = out
        return a

    def ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block = i // BLOCK
        count = int.from_bytes(self.raw_ranks[level][4 * block : 4 * block + 4], "little")
        rest = int.from_bytes(self.raw[level][block * (BLOCK // 8) : -(-i // 8)], "big")
        return count + (rest >> (-i % 8)).bit_count() if i % BLOCK else count

    def bit(self, level: int, i: int) -> int:
        return self.raw[level][i >> 3] >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        value = 0
        for level in range(BITS):
            b, ones = self.bit(level, i), self.ones(level, i)
            value = value << 1 | b
            i = self.zeros[level] + ones if b else i - ones
        return value

    def interval(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of a value before position i lie beneath the lowest plane."""
        low, high = 0, i
        for level in range(BITS):
            a, b = self.ones(level, low), self.ones(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if value >> (BITS - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, value: int, i: int) -> int:
        """Occurrences of a value before position i."""
        low, high = self.interval(value, i)
        return high - low

    def place(self, level: int, one: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane, by halving over the counts."""
        low, high = 0, self.n
        while high - low > 1:
            mid = (low + high) // 2
            ones = self.ones(level, mid)
            low, high = (mid, high) if (ones if one else mid - ones) <= k else (low, mid)
        return low

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a value."""
        low, high = self.interval(value, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in range(BITS - 1, -1, -1):
            one = value >> (BITS - 1 - level) & 1
            at = self.place(level, one, at - self.zeros[level] if one else at)
        return at


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["planes"], row["zeros"], row["ranks"])


def shards(docs: DataFrame, end: int = 1, vocabulary: str = "word_bpe_49k.json", shard_tokens: int = SHARD) -> DataFrame:
    """The records of the file, in ascending order of doc_id over parts and shards."""

    def run(batches):
        encoder, part, count = word_encoder(vocabulary), TaskContext.get().partitionId(), 0
        if encoder.largest >> BITS:
            raise ValueError(f"{vocabulary} has ids of more than {BITS} bits")
        ids, names, held = [], [], 0

        def record():
            nonlocal count, held
            m = WaveletMatrix.of(np.concatenate(ids))
            row = {"part": part, "shard": count, "n_tokens": m.n, "doc_ids": list(names), "doc_tokens": [len(x) for x in ids], "planes": m.raw, "zeros": m.zeros, "ranks": m.raw_ranks}
            ids.clear(), names.clear()
            count, held = count + 1, 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int64())), ("ranks", pa.list_(pa.binary()))]))

        for batch in batches:
            for b in by_bytes(batch, 1, 1 << 20):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = np.append(encoder.encode(text or ""), np.uint16(end))
                    if held and held + len(x) > shard_tokens:
                        yield record()
                    ids.append(x)
                    names.append(doc)
                    held += len(x)
        if held:
            yield record()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, FILE)


def read_documents(file: DataFrame) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens, start: ids of all documents before it."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = _matrix(row).ids().astype("<u4")
                ends = np.cumsum(row["doc_tokens"]).tolist()
                starts = [0, *ends[:-1]]
                n = len(ends)
                for a in range(0, n, 1024):
                    b = min(n, a + 1024)
                    raw = [ids[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * (b - a), pa.int64()), pa.array([row["shard"]] * (b - a), pa.int64()), pa.array(row["doc_ids"][a:b], pa.int64()), pa.array(starts[a:b], pa.int64()), pa.array(row["doc_tokens"][a:b], pa.int64()), pa.array(raw, pa.binary())], names=["part", "shard", "doc_id", "within", "n_tokens", "ids"])

    return file.mapInArrow(run, "part long, shard long, doc_id long, within long, n_tokens long, ids binary")


def shard_starts(file: DataFrame) -> DataFrame:
    """part, shard, before: tokens of all shards before. Sums go over parts first, so no window sees more than the parts or one part's shards."""
    sizes = file.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("base") + F.col("inner")).alias("before"))


def occurrences(file: DataFrame, token: int) -> DataFrame:
    """Where a token occurs: doc_id, position in the document. Only rank and select are used, no shard is decoded."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                m = _matrix(row)
                at = np.array([m.select(token, k) for k in range(m.rank(token, m.n))], dtype=np.int64)
                ends = np.cumsum(row["doc_tokens"])
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][d] for d in doc], pa.int64()), pa.array(at - (ends - np.array(row["doc_tokens"], dtype=np.int64))[doc], pa.int64())], names=["doc_id", "position"])

    return file.mapInArrow(run, "doc_id long, position long")


def token_frequency(file: DataFrame, token: int) -> DataFrame:
    """One row: occurrences of a token in all shards, by rank."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([_matrix(r).rank(token, r["n_tokens"]) for r in rows], pa.int64())], names=["n"])

    return file.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def op10_token_file(spark, sf_dir: str) -> DataFrame:
    file = written(shards(table(spark, sf_dir, "documents")), "tokens")
    docs = read_documents(file).select("part", "shard", "doc_id", "within", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return docs.join(shard_starts(file), ["part", "shard"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
