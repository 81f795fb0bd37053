"""Approximate nearest vectors against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ann
from quarry.operators.retrieval import nearest

SCHEMA = "chunk_id string, embedding array<float>, near int"


def clustered(n, d, clusters, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(clusters, d))
    x = c[rng.integers(0, clusters, n)] + 0.35 * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark):
    x = clustered(6000, 32, 60)
    rows = [(f"c{i:05}", v.tolist(), 1) for i, v in enumerate(x)]
    rows += [("null", None, 1), ("short", [1.0, 2.0], 1), ("hole", [None] * 32, 1), ("nan", [float("nan")] * 32, 1), ("empty", [], 1)]
    rows += [(f"copy{i:05}", x[0].tolist(), 1) for i in range(3000)]  # a third of all rows in one place
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def test_recall_on_whole_table(spark, vectors):
    index = ann.indexed(vectors)
    q = vectors.where("chunk_id like '%7' and chunk_id like 'c0%'").select(F.col("chunk_id").alias("query_id"), "embedding")
    r = ann.recall(ann.searched(q, index), nearest(q, vectors)).first()
    assert r["n"] == q.count() and r["recall"] >= 0.9
    assert index.quantizer.probes < len(index.quantizer.centers) / 2  # most lists are not visited
    assert sum(len(x["entries"]) for x in index.blocks.select("entries").collect()) == 6000 == index.vectors.count()  # copies are one entry
    assert index.rows.count() == 5999 + ann.COPIES
    with pytest.raises(ValueError):
        ann.searched(q, index, ann.COPIES + 1)
    everything = ann.searched(q, index, probes=len(index.quantizer.centers), refine=600)
    assert {tuple(x)[:3] for x in everything.collect()} == {tuple(x)[:3] for x in nearest(q, vectors).collect()}


def test_queries_that_do_not_fit_and_empty_tables(spark, vectors):
    index = ann.indexed(vectors)
    q = spark.createDataFrame([(1, None), (2, [1.0]), (3, [float("nan")] * 32)], "query_id long, embedding array<float>")
    assert ann.searched(q, index).count() == 0
    none = ann.indexed(vectors.limit(0))
    assert none.quantizer is None and ann.searched(q, none).count() == 0
    one = ann.indexed(vectors.where("chunk_id = 'c00001'"))
    p = vectors.where("chunk_id = 'c00002'").select(F.lit(1).alias("query_id"), "embedding")
    assert [x["chunk_id"] for x in ann.searched(p, one).collect()] == ["c00001"]


def test_exact_search_in_groups_of_queries(spark, vectors):
    q = vectors.where("chunk_id like 'c0001%'").select(F.col("chunk_id").alias("query_id"), "embedding")
    few = vectors.where("chunk_id like 'c0%'")
    assert {tuple(x) for x in nearest(q, few, 5, probes=3).collect()} == {tuple(x) for x in nearest(q, few, 5).collect()}
    rows = {x["chunk_id"]: np.array(x["embedding"], dtype=float) for x in few.collect()}
    for x in nearest(q, few, 3).collect():
        assert abs(np.square(rows[x["query_id"]] - rows[x["chunk_id"]]).sum() - x["distance"]) < 1e-12
