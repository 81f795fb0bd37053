"""Scores from blocks against the join, and what is read for them."""

import random

from pyspark.sql import functions as F

from quarry.operators import blockmax
from quarry.operators import index as ix
from quarry.operators.retrieval import bm25

WORDS = [f"w{i}" for i in range(300)]


def tables(spark, n=1500):
    r = random.Random(4)
    text = lambda: " ".join(WORDS[min(299, int(r.expovariate(0.03)))] for _ in range(r.randint(0, 60)))
    chunks = [(f"c{i:05}", text(), "clash") for i in range(n)] + [("none", None, "x"), ("empty", "", "x"), ("long", "w1 " * 5000, "x")] + [(f"same{i}", "w7 w8 w299", "x") for i in range(40)]
    queries = [(i, text()) for i in range(25)] + [(90, None), (91, "unknown words"), (92, "w299 w299 w298"), (93, "w7 w8")]
    return spark.createDataFrame(chunks, "chunk_id string, content string, score string").repartition(3), spark.createDataFrame(queries, "query_id long, query_text string")


def rows(df):
    return sorted((x["query_id"], x["rank"], x["chunk_id"], round(x["score"], 8)) for x in df.collect())


def test_blocks_give_the_rows_of_the_join(spark):
    chunks, queries = tables(spark)
    tokens = ix.tokenized(chunks)
    want = rows(bm25(queries, ix.build(chunks), 10))
    for docs in (7, 100, 5000):
        index = blockmax.blocks(tokens, docs=docs).cache()
        assert rows(blockmax.searched(queries, index, 10)) == want
    assert rows(blockmax.searched(queries, index, 10, most=5)) == want  # too many words to ship
    assert {tuple(x) for x in blockmax.postings(index).select("chunk_id", "term", "tf", "dl").collect()} == {tuple(x) for x in ix.postings(tokens).select("chunk_id", "term", "tf", "dl").collect()}


def test_fewer_postings_are_read_than_there_are(spark):
    chunks, queries = tables(spark, 6000)
    index = blockmax.blocks(ix.tokenized(chunks.coalesce(1)), docs=200).cache()
    r = blockmax.postings_read(queries, index, 5).agg(F.sum("read").alias("read"), F.sum("all").alias("all")).first()
    assert 0 < r["read"] < 0.7 * r["all"]


def test_empty(spark):
    chunks, queries = tables(spark, 10)
    assert blockmax.searched(queries, blockmax.blocks(ix.tokenized(chunks.limit(0))), 3).count() == 0
    assert blockmax.searched(queries.limit(0), blockmax.blocks(ix.tokenized(chunks)), 3).count() == 0
