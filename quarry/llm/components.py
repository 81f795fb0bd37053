"""Connected components of a graph of ids (of any ordered type, structs too), by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import spent, written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest id of its component) of every node of edges (a, b). The steps end when no edge changes."""
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()  # larger neighbours go to the smallest
        mine = large.groupBy("a").agg(F.min("b").alias("m"))
        before = e
        e = written(large.join(mine, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct(), "edges")
        spent(before)
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        if now == last:
            break
        last = now
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(e.select("b", "b").distinct().toDF("node", "root")).distinct()
