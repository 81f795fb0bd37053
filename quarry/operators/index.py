"""Derived index tables: postings, term and corpus statistics. All are pure functions of the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

K1, B, EPSILON = 1.5, 0.75, 0.25


def tokenized(chunks: DataFrame, key: str = "chunk_id", text: str = "content", analyzer=tx.tokens) -> DataFrame:
    """key, tokens, dl"""
    return chunks.select(key, analyzer(F.coalesce(text, F.lit(""))).alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(tokens: DataFrame, key: str = "chunk_id") -> DataFrame:
    """A1: key, term, tf, dl"""
    return tokens.select(key, "dl", F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n, avgdl"""
    return tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def corpus_stats_of(keys: DataFrame, posts: DataFrame) -> DataFrame:
    """The same from the chunks' keys and their postings, without their texts."""
    total = posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))  # one row
    return keys.agg(F.count("*").alias("n")).join(F.broadcast(total), F.lit(True)).select("n", F.try_divide(F.col("total"), F.col("n")).cast("double").alias("avgdl"))


def corpus_stats_changed(stats: DataFrame, before: tuple[DataFrame, DataFrame], now: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The statistics of a corpus of which a part, given as chunks and postings before and now, has changed."""
    total = stats.select("n", F.round(F.coalesce("avgdl", F.lit(0.0)) * F.col("n")).cast("long").alias("total"))
    for sign, (keys, posts) in ((-1, before), (1, now)):
        part = keys.agg(F.count("*").alias("n")).join(F.broadcast(posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))), F.lit(True))  # one row
        total = total.union(part.select(sign * F.col("n"), sign * F.col("total")))
    total = total.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return total.select("n", F.try_divide(F.col("total"), F.col("n")).cast("double").alias("avgdl"))


def term_stats_changed(terms: DataFrame, before: DataFrame, now: DataFrame, stats: DataFrame) -> DataFrame:
    """Term statistics after a part of the postings has changed: frequencies change by the part's, and idf by stats."""
    each = lambda posts, sign: posts.groupBy("term").agg((sign * F.count("*")).alias("df"))
    df = terms.select("term", "df").union(each(before, -1)).union(each(now, 1)).groupBy("term").agg(F.sum("df").alias("df"))
    return with_idf(df.where("df > 0"), stats)


def term_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """A2: term, df, idf. A negative idf becomes a quarter of the mean over all terms."""
    return with_idf(posts.groupBy("term").agg(F.count("*").alias("df")), stats)


def with_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf of (term, df)."""
    raw = df.join(F.broadcast(stats.select("n")), F.lit(True)).select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg((EPSILON * F.avg("raw")).alias("floor"))  # one row
    return raw.join(F.broadcast(mean), F.lit(True)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def contribution(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def build(chunks: DataFrame) -> dict[str, DataFrame]:
    """All derived tables of a chunk table, to be cached or written by the caller."""
    t = tokenized(chunks)
    p = postings(t)
    s = corpus_stats(t)
    return {"tokens": t, "postings": p, "corpus_stats": s, "term_stats": term_stats(p, s)}
