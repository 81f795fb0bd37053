"""Folders as a data source: spark.read.format("folder") and spark.readStream.format("folder"), once registered with `register(spark)`.

Options: path (a folder that driver and executors share), exclude and suffixes (patterns, endings; by commas), files (at most about so many to a task).
Rows are those of binaryFile, so `parsers.parsed` takes them: path, modificationTime, length, content.

- Links are followed. Each folder is read once, by its real path, under the first of its paths in the order of names; so cycles end.
- Excluded folders are not entered. A pattern is held against the path below the root and each of its parts.
- The driver goes through folders and counts their entries, but keeps no list of files: a task gets folders, or one part of a large folder's names (by their hash),
  and lists and reads its files itself, in batches of bounded size. Each part of a large folder lists its names again, so `files` should grow with such folders.
  For a stream it also looks at each file's stamp once a trigger.
- Files that vanish before they are read, and links to nothing, give no row; a folder that can't be read is an error. Empty files have empty content.
- The stream gives each file when it is new or has changed, by the time that the file system itself stamps (ctime, which no copy or rename presets), up to some seconds ago (option
  settle), so that no file of an interval that was read can still appear. A failed batch is read again from its two offsets. What the stream can't see: deletions, and folders that are
  moved in as a whole with files of an older stamp; a batch read finds both.
"""

from __future__ import annotations

import fnmatch
import os
import time
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
ARROW = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])
#: Bytes of content to a batch; a longer file is a batch of its own.
BATCH = 16 << 20


class Part(InputPartition):
    """Folders whose files a task reads, or one of `of` parts of a folder's names; stamps above `after` up to `upto` (nanoseconds)."""

    def __init__(self, folders: list[str], part: int = 0, of: int = 1, after: int = -1, upto: int | None = None):
        self.folders, self.part, self.of, self.after, self.upto = folders, part, of, after, upto


class Tree:
    """What the options say of a folder."""

    def __init__(self, options: dict[str, str]):
        listed = lambda name: [x.strip() for x in options.get(name, "").split(",") if x.strip()]
        if not options.get("path"):
            raise ValueError("a folder needs a path")
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.exclude, self.suffixes = listed("exclude"), tuple(s.lower() for s in listed("suffixes"))
        self.most = int(options.get("files", "1000"))

    def excluded(self, path: str) -> bool:
        below = os.path.relpath(path, self.root)
        return any(fnmatch.fnmatch(x, p) for p in self.exclude for x in (below, *below.split("/")))

    def folders(self) -> Iterator[tuple[str, int]]:
        """Each folder once, with its number of entries."""
        seen: set[str] = set()
        todo = [self.root]
        while todo:
            folder = todo.pop()
            real = os.path.realpath(folder)
            if real in seen:
                continue
            seen.add(real)
            inner, n = [], 0
            with os.scandir(folder) as entries:
                for e in entries:
                    n += 1
                    if e.is_dir() and not self.excluded(e.path):
                        inner.append(e.path)
            todo += sorted(inner, reverse=True)
            yield folder, n

    def parts(self, after: int = -1, upto: int | None = None) -> list[Part]:
        out: list[Part] = []
        group: list[str] = []
        held = 0
        for folder, n in self.folders():
            if n > self.most:
                of = -(-n // self.most)
                out += [Part([folder], i, of, after, upto) for i in range(of)]
                continue
            if group and held + n > self.most:
                out.append(Part(group, after=after, upto=upto))
                group, held = [], 0
            group.append(folder)
            held += n
        return out + [Part(group, after=after, upto=upto)] * bool(group)

    def files(self, part: Part) -> Iterator[tuple[str, os.stat_result]]:
        for folder in part.folders:
            with os.scandir(folder) as entries:
                for e in entries:
                    if zlib.crc32(os.fsencode(e.name)) % part.of != part.part or self.suffixes and os.path.splitext(e.name)[1].lower() not in self.suffixes:
                        continue
                    if e.is_file() and not self.excluded(e.path):
                        try:
                            stat = e.stat()
                        except FileNotFoundError:
                            continue
                        if stat.st_ctime_ns > part.after and (part.upto is None or stat.st_ctime_ns <= part.upto):
                            yield e.path, stat

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for path, stat in self.files(part):
            try:
                with open(path, "rb") as f:
                    content = f.read()
            except FileNotFoundError:
                continue
            if rows and size + len(content) > BATCH:
                yield _batch(rows)
                rows, size = [], 0
            rows.append((path, datetime.fromtimestamp(stat.st_mtime_ns // 1000 / 1e6, UTC), len(content), content))
            size += len(content)
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class Reader(DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def partitions(self) -> list[Part]:
        return self.tree.parts()

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are stamps in nanoseconds, as text."""

    def __init__(self, tree: Tree, settle: float):
        self.tree, self.settle = tree, int(settle * 1e9)

    def initialOffset(self) -> dict:
        return {"stamp": "-1"}

    def latestOffset(self) -> dict:
        """The newest stamp there is, so that an unchanged folder starts no batch. Where the newest file was deleted it is less than before, and no file lies between."""
        every = Part([folder for folder, _ in self.tree.folders()], upto=time.time_ns() - self.settle)
        return {"stamp": str(max((stat.st_ctime_ns for _, stat in self.tree.files(every)), default=-1))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.tree.parts(int(start["stamp"]), int(end["stamp"]))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(Tree(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Tree(self.options), float(self.options.get("settle", "2")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
