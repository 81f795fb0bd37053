"""Stateful and windowed operators over event logs, as batch functions, and their Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / 1e6


def throughput(samples: DataFrame, per: str, span: int = 30, most: int = 100) -> DataFrame:
    """At each event the samples of the last span seconds, the last most at the most, and the seconds that they cover. samples: per, ts, event_id."""
    s = samples.withColumn("t", seconds("ts"))
    recent = Window.partitionBy(per).orderBy("t").rangeBetween(-span, 0)
    last = Window.partitionBy(per).orderBy("t", "event_id").rowsBetween(-(most - 1), 0)
    since = F.greatest(F.min("t").over(recent), F.first("t").over(last))
    return s.select(per, "event_id", F.least(F.count("*").over(recent), F.lit(most)).alias("samples"), F.round(F.col("t") - since, 6).alias("span_s"))


def histogram(df: DataFrame, value: str, buckets: list[float], by: str | None = None) -> DataFrame:
    """Cumulative counts per upper bound, with +Inf, _count and _sum."""
    les = [(repr(float(b)), F.col(value) <= b) for b in buckets] + [("+Inf", F.col(value).isNotNull())]
    aggs = [F.count_if(c).alias(f"b{i}") for i, (_, c) in enumerate(les)]
    g = (df.groupBy(by) if by else df.groupBy()).agg(*aggs, F.count(value).alias("_count"), F.round(F.sum(value), 6).alias("_sum"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, (n, _) in enumerate(les)]))
    return g.select(*([by] if by else []), "_count", "_sum", rows.alias("x")).select(*([by] if by else []), "x.le", "x.cumulative", "_count", "_sum")


def ttl_hits(log: DataFrame, key: str, ttl: int = 300) -> DataFrame:
    """ST7 without eviction by size: a request hits if the last miss of its key is less than ttl seconds old. A hit doesn't renew, so hits
    are found by folding each key's times in order (ties by event_id)."""
    kind = log.schema[key].dataType.simpleString()

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["t", "event_id"])
        since, hits = float("-inf"), []
        for t in f["t"]:
            hits.append(t - since < ttl)
            since = since if hits[-1] else t
        return pd.DataFrame({key: f[key], "event_id": f["event_id"], "hit": hits})

    return log.select(key, "event_id", seconds("ts").alias("t")).groupBy(key).applyInPandas(fold, f"{key} {kind}, event_id long, hit boolean")


def lru_cache(log: DataFrame, key: str, size: int = 100, ttl: float = 300.0, shard: str | None = None) -> DataFrame:
    """ST7: a replay of the least-recently-used cache with expiry, per shard. A put evicts the oldest also where its key is held."""

    def replay(f: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        hits = []
        for k, t in zip(f["k"], f["t"], strict=True):
            ok = k in held and t - held[k] < ttl
            hits.append(ok)
            if ok:
                held[k] = held.pop(k)  # used last
            else:
                held.pop(k, None)
                if len(held) >= size:
                    del held[next(iter(held))]
                held[k] = t
        return pd.DataFrame({"shard": f["shard"], "event_id": f["event_id"], "hit": hits})

    s = log.select((F.col(shard) if shard else F.lit("all")).cast("string").alias("shard"), F.col(key).cast("string").alias("k"), "event_id", seconds("ts").alias("t"))
    return s.groupBy("shard").applyInPandas(lambda f: replay(f.sort_values(["t", "event_id"])), "shard string, event_id long, hit boolean")


def hit_rate(replayed: DataFrame, by: str) -> DataFrame:
    """By, hits, misses, and their rate as text. replayed: by, hit."""
    n = replayed.groupBy(by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return n.withColumn("hit_rate", F.format_string("%.1f%%", 100.0 * F.col("hits") / (F.col("hits") + F.col("misses"))))


def allowed(times: list[float], limit: int, window: float = 60.0, log: list[float] | None = None) -> Iterator[bool]:
    """ST6: a true sliding log; refused calls leave no trace."""
    log = [] if log is None else log
    for t in times:
        while log and log[0] <= t - window:
            log.pop(0)
        ok = len(log) < limit
        if ok:
            log.append(t)
        yield ok


def rate_limited(log: DataFrame, per: str = "user_id", rpm: int = 60, burst: int = 10) -> DataFrame:
    """ST6: per, event_id, allowed."""
    kind = log.schema[per].dataType.simpleString()

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["t", "event_id"])
        return pd.DataFrame({per: f[per], "event_id": f["event_id"], "allowed": list(allowed(f["t"].tolist(), rpm + burst))})

    return log.select(per, "event_id", seconds("ts").alias("t")).groupBy(per).applyInPandas(one, f"{per} {kind}, event_id long, allowed boolean")


def rate_limited_stream(stream: DataFrame, per: str = "user_id", rpm: int = 60, burst: int = 10) -> DataFrame:
    """The same on a stream: the log of accepted calls is kept as state per key. A key's calls of a micro-batch may come in several frames; they
    are put in order as a whole."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = stream.schema[per].dataType.simpleString()

    def step(key, frames, state):
        log = list(state.get[0]) if state.exists else []
        f = pd.concat(list(frames)).sort_values(["t", "event_id"])
        yield pd.DataFrame({per: f[per], "event_id": f["event_id"], "allowed": list(allowed(f["t"].tolist(), rpm + burst, log=log))})
        state.update((log,))

    s = stream.select(per, "event_id", seconds("ts").alias("t"))
    return s.groupBy(per).applyInPandasWithState(step, f"{per} {kind}, event_id long, allowed boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout)


def debounced(events: DataFrame, per: str, wait: float = 10.0) -> DataFrame:
    """ST1: per, batch, deadline, paths: the first event sets a deadline, later ones up to it join. events: per, ts, path."""
    s = events.select(per, seconds("ts").alias("t"), F.col("path").cast("string").alias("path"))
    kind = events.schema[per].dataType.simpleString()

    def run(batches):
        # A key's events come in the order of their times; only its number of batches and its deadline are held from one stretch to the next.
        own, batch, until = object(), -1, float("-inf")
        for b in batches:
            keys, times = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            starts = pc.not_equal(keys.slice(1), keys.slice(0, max(0, b.num_rows - 1))).fill_null(True).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(starts) + 1).tolist(), b.num_rows] if b.num_rows else []
            numbers, deadlines = np.empty(b.num_rows, dtype=np.int64), np.empty(b.num_rows)
            for first, last in zip(edges, edges[1:], strict=False):
                if (key := keys[first].as_py()) != own:
                    own, batch, until = key, -1, float("-inf")
                at, known = first, first + int(np.count_nonzero(~np.isnan(times[first:last])))  # events without a time come last and join
                while at < last:
                    to = at + int(np.searchsorted(times[at:known], until, "right")) if at < known else last
                    to = last if to == known else to
                    numbers[at:to], deadlines[at:to] = batch, until
                    if to < last:
                        batch, until = batch + 1, times[to] + wait
                    at = to
            yield pa.RecordBatch.from_arrays([keys, pa.array(numbers), pa.array(deadlines), b.column(2)], names=[per, "batch", "deadline", "path"])

    placed = s.repartition(per).sortWithinPartitions(per, F.asc_nulls_last("t")).mapInArrow(run, f"{per} {kind}, batch long, deadline double, path string")
    return placed.groupBy(per, "batch", "deadline").agg(F.countDistinct("path").alias("paths"))


def backoff(failures: Column | str, debounce: float = 10.0, longest: float = 300.0) -> Column:
    """ST2: seconds to the next attempt after so many failures in a row."""
    n = F.col(failures) if isinstance(failures, str) else failures
    return F.least(F.lit(debounce) * F.pow(F.lit(2.0), n), F.lit(max(longest, debounce)))


def watch(spark, folder: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str, suffixes: str = "*", interval: str = "10 seconds", once: bool = False):
    """ST1, ST3, ST4: new files of a folder in micro-batches, one at a time; each batch's paths are distinct. Returns the streaming query."""
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", suffixes).option("recursiveFileLookup", "true").load(folder)
    w = files.writeStream.foreachBatch(lambda df, n: apply(df.dropDuplicates(["path"]), n)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()
