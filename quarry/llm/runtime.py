"""What every operator of this package shares: the shared folder, written tables, Arrow batching."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quarry-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs on this machine alone (tests) it is a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _own_folder()
    return named.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def spent(*tables: DataFrame | None) -> None:
    """Delete tables of written() after their last reader, and let the driver forget the shuffles behind them, so that the
    context cleaner removes their files."""
    spark = None
    for t in tables:
        path = t.__dict__.get("written_at") if t is not None else None
        if path:
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if spark is not None:
        spark._jvm.System.gc()


def private(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name in taken:
        name += "_"
    return name


def by_bytes(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in a string or binary column take about limit bytes (one row at least)."""
    start, taken = 0, 0
    for i, v in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if taken and taken + (v or 0) > limit:
            yield batch.slice(start, i - start)
            start, taken = i, 0
        taken += v or 0
    if start < batch.num_rows:
        yield batch.slice(start)
