"""Queries over the log: what they send on grows with the documents, not with documents times queries."""

import pytest
from pyspark.sql import functions as F
from test_blockmax import tables

from quarry.functions import patterns as many
from quarry.operators import blockmax
from quarry.operators import index as ix
from quarry.operators import lexical as lx
from quarry.operators import retrieval as rt
from quarry.plans.search import HybridSearch
from quarry.queries import catalog
from quarry.sources import parsers as ps
from quarry.streaming import events as es


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def searches(spark, sf, name):
    assert "term#" not in plan(catalog.QUERIES[name](spark, sf))  # no postings are dealt out


def test_mmr_select(spark, sf):
    searches(spark, sf, "mmr_select")
    hits = spark.range(40).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("chunk_id"), (F.floor(F.col("id") / 2) + 1).cast("int").alias("rank"), F.concat_ws(" ", F.lit("w"), F.col("id").cast("string")).alias("content"), F.lit(1.0).alias("relevance"))
    chosen = rt.diversified(hits, 5)
    assert plan(chosen).count("Range (") == 1  # what is found is not searched for again
    assert chosen.count() == 10


def test_evaluate_mrr(spark, sf):
    searches(spark, sf, "evaluate_mrr")
    text = plan(catalog.evaluate_mrr(spark, sf))
    assert "Contains(" not in text and text.count("[places(") == 1  # all queries in one pass over each text


def test_holding(spark):
    q = spark.createDataFrame([(1, "b c"), (2, ""), (3, None), (4, "zz"), (5, "b c")], "query_id long, query_text string")
    rows = spark.createDataFrame([("x", "a b c"), ("y", None), ("z", "bc")], "path string, content string")
    want = {(1, "x"), (5, "x"), (2, "x"), (2, "z")}
    assert {(r["query_id"], r["path"]) for r in rt.holding(q, rows).collect()} == want
    assert {(r["query_id"], r["path"]) for r in rt.holding(q, rows, most=2).collect()} == want


@pytest.mark.parametrize("name", ["rerank_lexical", "score_normalize", "fallback_answer", "evidence_units", "hybrid_search", "rrf_fuse", "min_score_filter", "category_filtered_search", "staging_gates"])
def test_searches(spark, sf, name):
    searches(spark, sf, name)


def test_hybrid_search_by_blocks_or_postings(spark):
    chunks, queries = tables(spark, 200)
    chunks = chunks.withColumn("path", F.col("chunk_id")).withColumn("filename", F.col("chunk_id")).withColumn("category", F.when(F.col("chunk_id") < "c00100", "a").otherwise("b"))
    none = spark.createDataFrame([], "query_id long, embedding array<double>")
    vectors = spark.createDataFrame([], "chunk_id string, embedding array<double>")
    found = lambda index, c: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in HybridSearch(chunks, vectors, index=index).run(queries, none, 5, alpha=0.0, category=c).collect())
    for category in (None, "a"):
        assert found(None, category) == found(ix.build(chunks), category) != []


def test_matched_counts_what_is_found(spark):
    chunks, queries = tables(spark, 300)
    want = rt.bm25(queries, ix.build(chunks), 1 << 30).groupBy("query_id").count()
    index = blockmax.blocks(ix.tokenized(chunks), docs=70)
    assert {tuple(r) for r in blockmax.matched(queries, index).collect()} == {tuple(r) for r in want.collect()}
    assert blockmax.matched(queries.limit(0), index).count() == 0


def test_frequencies_are_counted_once(spark):
    chunks, queries = tables(spark, 300)
    terms = blockmax.statistics(blockmax.blocks(ix.tokenized(chunks), docs=70))[1]
    asked = rt.query_terms(queries).join(terms.where("idf <> 0").select("term", "idf"), "term")
    assert asked.collect()
    assert asked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Generate explode(arrays_zip") == 1


def test_debounce_in_stretches(spark):
    """A key's events are read in stretches; batches run on over their ends, ties and events without a time."""
    at = [0.0, 3.0, 10.0, 10.0, 10.5, 30.0, 31.0, 31.0, 40.0, 41.0, None]
    e = spark.createDataFrame([(k, None if t is None else 1e9 + t, p) for k in ("a", "b", None) for i, t in enumerate(at) for p in (f"p{i % 3}", None)] + [("c", None, "p")], "k string, s double, path string").select("k", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "path")
    one = [(0, 1e9 + 10, 3), (1, 1e9 + 20.5, 1), (2, 1e9 + 40, 3), (3, 1e9 + 51, 2)]
    want = {(k, *x) for k in ("a", "b", None) for x in one} | {("c", -1, float("-inf"), 1)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            d = es.debounced(e, "k", 10.0)
            assert {tuple(r) for r in d.collect()} == want
            assert "FlatMapGroupsInPandas" not in plan(d)  # no key's log is one frame
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_benchmark_terms_stay_in_the_task(spark, sf):
    """Counts leave the task, not the patterns that each text holds."""
    d = spark.createDataFrame([("abc b",), ("",), (None,), ("zz",)], "text string")
    assert [tuple(r["x"]) for r in d.select(many.counted(F.col("text"), ["b", "abc", "b", "ß"]).alias("x")).collect()] == [(2, 4), (0, 0), (0, 0), (0, 0)]
    assert "array<string>" not in catalog.benchmark_terms(spark, sf)._jdf.queryExecution().optimizedPlan().toJSON()


def test_pages_leave_in_parts(spark, monkeypatch):
    html = spark.createDataFrame([(i, "https://x.org/a", f"<html><title>t{i}</title><body><p>b{i}</p></body></html>") for i in range(9)] + [(10, "https://x.org/b", None)], "page_id long, url string, html string").coalesce(1)
    whole = sorted(map(repr, ps.pages(html).collect()))
    monkeypatch.setattr(ps, "PAGES", 2)
    assert sorted(map(repr, ps.pages(html).collect())) == whole and len(whole) == 10
    assert "MapInPandas" not in plan(ps.pages(html))


def test_postings_are_counted_where_they_lie(spark, sf, tmp_path):
    assert "Aggregate" not in plan(catalog.postings(spark, sf))
    d = spark.createDataFrame([(1, "a b a", "s", "en"), (1, "b", "s", "en"), (2, "", "s", "en")], "doc_id long, text string, source string, lang string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in catalog.postings(spark, str(tmp_path)).collect()} == {(1, "a", 2, 3), (1, "b", 2, 3)}  # repeated keys are one document


def test_phrases_cut_texts_once(spark, sf):
    for name in ("fts_search", "auto_dispatch"):
        assert "documents.parquet" not in "".join(catalog.QUERIES[name](spark, sf).inputFiles())  # hits, frequencies and lengths are read from one written pass
    none = spark.createDataFrame([], "chunk_id string, content string, filename string, category string")
    queries = spark.createDataFrame([(1, "a b"), (2, "a-b.c"), (3, "?")], "query_id long, query_text string")
    assert rt.phrase_hits(queries, none).count() == 0
    chunks = spark.createDataFrame([("x", "a b a-b.c", "f", "g"), ("y", "b", "f", "g")], none.schema)
    for most in (4_000_000, 1):  # at once, and joined in
        assert {(r["query_id"], r["chunk_id"]) for r in rt.phrase_hits(queries, chunks, most).collect()} == {(1, "x"), (2, "x")}


def test_index_is_read_once(spark, monkeypatch):
    rows = [("a", "one two one two one", "f.md", "g"), ("b", "two one. x-1 X-1", "f.md", "g"), ("c", "", "", ""), ("d", None, None, None), ("e", "one two", "f.md", "h"), ("f", "two one two", "f.md", "g")]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, filename string, category string").repartition(2)
    queries = spark.createDataFrame([(1, "one"), (2, "one,two two"), (3, "x-1 x-1"), (4, "nothing one"), (5, ""), (6, None), (7, "one,two,one")], "query_id long, query_text string")
    scores = lambda df: {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in df.collect()}
    want = scores(rt.phrase_hits(queries, chunks))
    hits = lx.phrase_hits(queries, lx.entries(chunks))
    assert "MapInArrow" not in plan(hits)  # what is joined and counted is read from the entries of asked words, written in one pass
    assert want and scores(hits) == want
    monkeypatch.setattr(lx, "TOKENS", 1)  # a part for each chunk, and words joined to the index
    monkeypatch.setattr(lx, "WORDS", 0)
    assert scores(lx.phrase_hits(queries, lx.entries(chunks))) == want


def test_fts_index_search(spark, sf):
    text = plan(catalog.fts_index_search(spark, sf))
    assert "InMemoryRelation" not in text and "MapInArrow" not in text  # the whole index is neither kept nor read again


def test_fts_index_edits(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(lx, "written", lambda df, name, f=lx.written: asked.append((name, plan(df))) or f(df, name))
    monkeypatch.setattr(lx, "small", lambda df: df)  # as many keys as are not broadcast
    assert "InMemoryRelation" not in plan(catalog.fts_index_edits(spark, sf))
    text = dict(asked)["asked"]
    lines = text.split("\n")
    assert "LeftAnti" in text and all("INSET" in lines[i - 1] or " IN (" in lines[i - 1] for i, x in enumerate(lines) if "MapInArrow" in x)  # deletions meet chosen entries alone
