"""Operator 6, packing: harmonic packing.

Lengths fall into reciprocal-capacity classes: class k holds the lengths in (C/(k+1), C/k], and each of its bins takes
exactly k of them. Every task fills the bins of its own rows, so nothing is shuffled. A document is cut into whole
sequences first. What is left is kept whole where k such pieces fill a bin to 63/64; otherwise its largest
part of length C/2**j is cut off, which fills its class's bins exactly, until less than C/16 is left. The unfilled bins
at a task's end (one a class at most) are put together, largest first, where they fit.

Sequence ids are (task << 40) + a running number. A task that runs again reads the same rows in the same order
and gives the same ids. Memory: one Arrow slice and one unfilled bin a class.

Cases: a null or empty text is its end token alone; repeated rows and null ids are packed like any others; an empty table
gives no sequence; further columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import by_bytes, table
from .vocab import byte_encoder

CAPACITY = 1024


def cuts(left: int, capacity: int = CAPACITY) -> Iterator[int]:
    """Lengths of the pieces of a document of so many tokens."""
    yield from [capacity] * (left // capacity)
    left %= capacity
    while left:
        k = capacity // left
        if left < capacity // 16 or k * left >= capacity - capacity // 64:
            yield left
            return
        part = 1 << (left.bit_length() - 1) if capacity & (capacity - 1) == 0 else capacity // (k + 1)
        yield part
        left -= part


class Packer:
    """Gives each piece its sequence and offset; pieces come back once their bin is full."""

    def __init__(self, task: int, capacity: int):
        self.next, self.capacity, self.open = task << 40, capacity, {}

    def close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for p in pieces:
            yield (*p, self.next, offset)
            offset += p[2]
        self.next += 1

    def put(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // piece[2]
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            yield from self.close(self.open.pop(k))

    def rest(self) -> Iterator[tuple]:
        """The unfilled bins, as one class cannot fill its last: largest first, into the fullest sequence that holds it."""
        bins: list[list] = []
        rooms: list[int] = []
        for pieces in sorted(self.open.values(), key=lambda x: -sum(p[2] for p in x)):
            for piece in pieces:
                fits = [(room, i) for i, room in enumerate(rooms) if room >= piece[2]]
                if fits:
                    room, i = heapq.nsmallest(1, fits)[0]
                    bins[i].append(piece)
                    rooms[i] -= piece[2]
                else:
                    bins.append([piece])
                    rooms.append(self.capacity - piece[2])
        for pieces in bins:
            yield from self.close(pieces)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", end: int = 0) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        encoder, packer = byte_encoder(vocabulary), Packer(TaskContext.get().partitionId(), capacity)
        out: list[tuple] = []

        def flush():
            columns = list(zip(*out, strict=True))
            out.clear()
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for b in by_bytes(batch, 1, 1 << 20):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = np.append(encoder.encode(text or ""), np.uint32(end)).astype("<u4")
                    start, n = 0, len(ids)
                    for length in cuts(n, capacity):
                        out += packer.put((doc, start, length, ids[start : start + length].tobytes(), n))
                        start += length
                        if len(out) >= 4096:
                            yield flush()
        out += packer.rest()
        if out:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def padded_length(used: int, capacity: int = CAPACITY) -> int:
    """A sequence is padded to the capacity, unless its length is a power of two."""
    return used if used & (used - 1) == 0 else capacity


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
