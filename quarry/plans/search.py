"""The whole search over a table of queries (R12): BM25 and vectors, fusion, path boost, rerank, diversity, scores, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import blockmax
from ..operators import index as ix
from ..operators import lexical as lx
from ..operators import retrieval as rt


class HybridSearch:
    """Holds chunks (key, content, path, filename, category, and for neighbours doc_id and chunk_index), their vectors, and the derived index.

    The index is a pure function of the chunks: blocks of postings (blockmax), or postings and statistics, where a caller keeps them as tables. Callers
    that search more than once pass written tables as index, or call cache().
    """

    def __init__(self, chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id", index: dict[str, DataFrame] | None = None):
        self.chunks, self.vectors, self.key = chunks, vectors, key
        self.index = {"blocks": blockmax.blocks(ix.tokenized(chunks, key), key)} if index is None else index

    def cache(self) -> HybridSearch:
        for name in self.index.keys() & {"blocks", "postings", "term_stats", "corpus_stats"}:
            self.index[name] = self.index[name].cache()
        return self

    def lexical(self, queries: DataFrame, k: int, category: str | None = None) -> DataFrame:
        """R1 by chunk; of a category the chunks, with the statistics of all."""
        key, kept = self.key, self.chunks if category is None else self.chunks.where(F.col("category") == category)
        if "blocks" not in self.index:
            return rt.bm25(queries, self.index, k, key, within=None if category is None else kept.select(key))
        blocks = self.index["blocks"]
        return blockmax.searched(queries, blocks if category is None else blockmax.blocks(ix.tokenized(kept, key), key), k, key, stats=blockmax.statistics(blocks))

    def by_words(self, queries: DataFrame, k: int = 10, category: str | None = None, min_hits: int = 3, patterns=tuple(tx.LEXICAL_PATTERNS), neighbours: bool = False) -> tuple[DataFrame, DataFrame]:
        """Hits of the queries (query_id, query_text, method) that the lexical path serves, and those queries. method is fts5 (always served)
        or auto (served if the query looks lexical, has min_hits hits and keeps some in its category). They are found in the index of places where
        it was written, else in the chunks' texts."""
        key, pool = self.key, max(3 * k, 20)
        asked = queries.where((F.col("method") == "fts5") | (F.col("method") == "auto") & (tx.route("query_text", patterns) == "lexical"))
        if "places" in self.index:
            found = lx.phrase_hits(asked, self.index["places"], key)
        else:
            found = rt.phrase_hits(asked, self.chunks.withColumnRenamed(key, "chunk_id") if key != "chunk_id" else self.chunks).withColumnRenamed("chunk_id", key)
        order = [F.desc(F.round("score", 9)), F.asc(key)]
        found = rt.ranked(found, order, pool).join(rt.small(asked.select("query_id", "method")), "query_id")
        found = found.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).where((F.col("method") == "fts5") | (F.col("n") >= min_hits)).drop("rank", "n", "method")
        extra = [c for c in ("doc_id", "chunk_index") if c in self.chunks.columns and c != key]
        hits = found.join(self.chunks.select(key, "content", "path", "filename", "category", *extra), key)
        hits = rt.ranked(hits if category is None else hits.where(F.col("category") == category), order, k)
        served = asked.where("method = 'fts5'").select("query_id").union(hits.select("query_id")).distinct()
        hits = hits.withColumnRenamed("score", "raw_score").withColumn("score", rt.cohort_score(hits.withColumnRenamed("score", "raw_score"), "raw_score"))
        return (rt.expanded(hits, self.chunks) if neighbours else hits).withColumn("score_source", F.lit("fts5_bm25")).withColumn("search_method", F.lit("fts5")), served

    def run(self, queries: DataFrame, probes: DataFrame, k: int = 10, pool: int | None = None, alpha: float = 0.5, category: str | None = None, scorer=None, mmr: float | None = None, neighbours: bool = False, min_score: float | None = None) -> DataFrame:
        """queries: query_id, query_text; probes: query_id, embedding. One row a hit, best first by rank."""
        key, n = self.key, pool or 3 * k
        k, alpha = max(1, k), min(1.0, max(0.0, alpha))
        vectors = self.vectors
        if category is not None:
            vectors = vectors.join(self.chunks.where(F.col("category") == category).select(key), key, "left_semi")
        semantic = rt.nearest(probes, vectors, n, key)
        lexical = semantic if alpha >= 1 else self.lexical(queries, n, category)  # at 1 it is not asked
        hits = rt.fused(semantic, lexical, alpha, key)
        meta = self.chunks.select(key, "path", "filename", "category")
        hits = rt.small_pool(hits.join(rt.small(queries.select("query_id", "query_text")), "query_id"), queries, 2 * n).join(meta, key)
        hits = hits.withColumn("value", F.col("rrf_score") + tx.path_boost("query_text", "path", "filename"))
        order: list[Column] = [F.desc(F.round("value", 12)), F.asc(key)]
        hits = rt.ranked(hits, order, n if scorer or mmr is not None else k).withColumn("reranker_score", F.lit(None).cast("double"))
        content = self.chunks.select(key, "content", *[c for c in ("doc_id", "chunk_index") if c in self.chunks.columns and c != key])
        if scorer or mmr is not None or neighbours:
            hits = rt.small_pool(hits, queries, 2 * n).join(content, key)  # content comes late, for the pool alone
        if scorer:
            hits = rt.reranked(hits.drop("reranker_score"), n if mmr is not None else k, scorer).drop("old_rank")
            hits = hits.withColumn("value", F.coalesce("reranker_score", "value"))
        if mmr is not None:
            hits = rt.diversified(hits.withColumn("relevance", F.col("value")), k, mmr, key).drop("rank").withColumnRenamed("mmr_rank", "rank")
        hits = hits.withColumn("score", rt.cohort_score(hits, "value"))
        if min_score is not None:
            hits = hits.where(F.col("score") >= min_score)
        if neighbours:
            hits = rt.expanded(hits, self.chunks)
        method = F.when(F.col("semantic_rank").isNotNull() & F.col("bm25_rank").isNotNull(), "hybrid").when(F.col("semantic_rank").isNotNull(), "semantic").otherwise("keyword")
        return hits.select(
            "query_id", "rank", key, "score", F.col("value").alias("raw_score"), F.when(F.col("reranker_score").isNotNull(), "reranker").otherwise("rrf").alias("score_source"),
            F.round("rrf_score", 6).alias("raw_rrf_score"), F.round("reranker_score", 6).alias("reranker_score"), "semantic_rank", "bm25_rank", method.alias("search_method"), "path", "filename", "category",
            *[c for c in ("content", "context_expanded", "content_length") if c in hits.columns],
        )
