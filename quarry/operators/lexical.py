"""The lexical index as a table: where each word stands in each chunk (K6), and phrase search on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import written
from . import index as ix
from .retrieval import few_words, small

#: Words of chunks that are placed at once (one chunk at least), and entries that are sent on at once.
TOKENS, FLUSH = 1 << 18, 50_000
#: Asked words that are looked for as a set, below what is joined to the index before; more are joined to it.
WORDS = 10_000


def _placed(keys: pa.Array, lists: pa.Array):
    """Batches (key, term, places, dl) of chunks' tokens. A word and a chunk make one number; its places are what a stable sort leaves together."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    words = lists.flatten().dictionary_encode()
    many = max(1, len(words.dictionary))
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    pair = row * many + words.indices.to_numpy()
    order = np.argsort(pair, kind="stable")
    pair, place = pair[order], place[order].astype(np.int32)
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(pair))
    row, code = pair[starts] // many, pair[starts] % many
    for i in range(0, len(starts), FLUSH):
        a, b = starts[i : i + FLUSH], ends[i : i + FLUSH]
        places = pa.ListArray.from_arrays(pa.array(np.append(a, b[-1]) - a[0], pa.int32()), pa.array(place[a[0] : b[-1]]))
        of = pa.array(row[i : i + FLUSH])
        yield [keys.take(of), words.dictionary.take(pa.array(code[i : i + FLUSH])), places, pa.array(lengths).take(of)]
    none = pa.array(np.flatnonzero(lengths == 0))
    if len(none):
        yield [keys.take(none), pa.nulls(len(none), pa.string()), pa.array([[]] * len(none), pa.list_(pa.int32())), pa.array(np.zeros(len(none), dtype=np.int64))]


def entries(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, term, places (0-based, ascending), dl: one row for each word of a chunk's content, filename and category, without a shuffle. A chunk
    without words has one row of a null term, as it counts in the mean length."""
    c = chunks.select(key, tx.lexical_tokens(F.concat_ws(" ", "content", "filename", "category")).alias("tokens"))

    def run(batches):
        for batch in batches:
            start, held = 0, 0
            for i, n in enumerate(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_pylist()):
                if i > start and held + n > TOKENS:
                    yield from parts(batch.slice(start, i - start))
                    start, held = i, 0
                held += n
            yield from parts(batch.slice(start))

    def parts(batch):
        return (pa.RecordBatch.from_arrays(x, names=[key, "term", "places", "dl"]) for x in _placed(batch.column(0), batch.column(1)))

    return c.mapInArrow(run, f"{key} {chunks.schema[key].dataType.simpleString()}, term string, places array<int>, dl long")


def inserted(index: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """K6: with the entries of chunks that are not in it yet."""
    return index.unionByName(entries(chunks, key))


def deleted(index: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    """K6: without the entries of these keys; keys that it doesn't hold change nothing."""
    return index.join(small(keys.select(key).distinct()), key, "left_anti")


def replaced(index: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """K6: with the entries of chunks in place of those under the same keys."""
    return inserted(deleted(index, chunks, key), chunks, key)


def _first():
    return F.col("term").isNull() | (F.get("places", F.lit(0)) == 0)


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: n, avgdl; each chunk counts by its first word's entry."""
    return index.where(_first()).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def phrase_hits(queries: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """query_id, key, score of chunks that hold every phrase of a query, as retrieval.phrase_hits finds them, but from the index. It is read
    once: the entries of asked words and each chunk's first one are written for all further reads. A query's candidates are the chunks of its rarest phrase."""
    hint = F.broadcast if few_words(queries, "query_text") else (lambda df: df)
    asked = queries.select("query_id", F.explode(tx.phrases("query_text")).alias("words")).groupBy("query_id", "words").agg(F.count("*").alias("times"))
    # Phrases and words by number, written so that each keeps its own.
    phrases = written(asked.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    parts = phrases.select("phrase", F.size("words").alias("parts"), F.posexplode("words").alias("shift", "term"))
    words = written(parts.groupBy("term").agg((F.max("parts") > 1).alias("placed")).withColumn("word", F.monotonically_increasing_id()), "words")
    parts = parts.join(hint(words.select("term", "word")), "term").select("phrase", "parts", "shift", "word")
    few = [r["term"] for r in words.select("term").limit(WORDS + 1).collect()]
    read = index.where(_first() | F.col("term").isin(few)) if len(few) <= WORDS else index
    read = read.join(hint(words), "term", "left").where(_first() | F.col("word").isNotNull())
    read = written(read.select(key, "word", _first().alias("first"), F.size("places").alias("tf"), F.when(F.col("placed"), F.col("places")).alias("places"), "dl"), "asked")
    at = lambda which: read.where("word is not null").join(hint(parts.where(which)), "word")
    single = at("parts = 1").select("phrase", key, "dl", "tf")
    begins = F.transform("places", lambda p: p - F.col("shift"))
    longer = at("parts > 1").groupBy("phrase", key).agg(F.collect_list(begins).alias("begins"), F.max("dl").alias("dl"), F.max("parts").alias("parts")).where("size(begins) = parts")
    shared = F.aggregate(F.slice("begins", F.lit(2), F.size("begins")), F.col("begins")[0], F.array_intersect)
    tf = single.unionByName(longer.select("phrase", key, "dl", F.size(shared).alias("tf")).where("tf > 0"))
    df = tf.groupBy("phrase").agg(F.count("*").alias("df"))
    each = asked.join(hint(phrases), "words").drop("words")
    known = each.join(hint(df), "phrase", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    w = Window.partitionBy("query_id")
    known = written(known.withColumn("need", F.count("*").over(w)).withColumn("rarity", F.row_number().over(w.orderBy("df", "phrase"))), "known")
    candidates = tf.join(hint(known.where("rarity = 1").select("query_id", "phrase")), "phrase").select("query_id", key)
    held = candidates.join(hint(known), "query_id").join(tf, ["phrase", key])
    stats = read.where("first").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    held = held.join(F.broadcast(stats), F.lit(True))  # one row
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = F.col("times") * idf * ix.contribution(F.col("tf"), F.col("dl"), F.col("avgdl"), 1.2, 0.75)
    scores = held.groupBy("query_id", key).agg(F.sum(part).alias("score"), F.count("*").alias("held"), F.max("need").alias("need"))
    return scores.where("held = need").select("query_id", key, "score")
