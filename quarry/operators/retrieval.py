"""Retrieval over a table of queries at once: BM25, nearest vectors, fusion, rerank, diversity, scores, neighbours."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType, _parse_datatype_string

from ..functions import patterns as many
from ..functions import text as tx
from ..tables import written
from . import index as ix

RRF, MISSING = 60, 1000
#: Query rows (or query terms) that may be broadcast; beyond, joins shuffle.
BROADCAST = 200_000
#: Routes that go to every task.
ROUTES = 100_000
#: Query vectors that are held as one matrix by each task.
PROBES = 20_000


def small(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """With a broadcast hint if it holds no more than so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_pool(hits: DataFrame, queries: DataFrame, k: int, most: int = BROADCAST) -> DataFrame:
    """The k best rows of each query with a broadcast hint if there can be no more of them than so many; read from the queries alone. What is joined to
    them then stays where it lies, whatever its size."""
    return F.broadcast(hits) if queries.limit(most // k + 1).count() <= most // k else hits


def ranked(df: DataFrame, order: list[Column], k: int, per: str = "query_id", name: str = "rank") -> DataFrame:
    """The first k rows of each query, with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col(name) <= k)


def few_words(queries: DataFrame, text: str, most: int = 4_000_000) -> bool:
    """Whether the queries' texts have so few characters that their words may be broadcast; read from the queries alone."""
    return queries.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n")).first()["n"] <= most


def query_terms(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """query_id, term, qtf: repeated words count again."""
    return queries.select("query_id", F.explode(tx.tokens(F.coalesce(text, F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(queries: DataFrame, index: dict[str, DataFrame], k: int = 20, key: str = "chunk_id", text: str = "query_text", within: DataFrame | None = None) -> DataFrame:
    """query_id, rank, key, score. within: (query_id, key) pairs or keys that may be found; statistics stay those of the whole corpus."""
    terms = query_terms(queries, text).join(index["term_stats"].where("idf <> 0").select("term", "idf"), "term")
    hits = index["postings"].join(F.broadcast(terms) if few_words(queries, text) else terms, "term").join(F.broadcast(index["corpus_stats"].select("avgdl")), F.lit(True))
    part = F.col("qtf") * F.col("idf") * ix.contribution(F.col("tf"), F.col("dl"), F.col("avgdl"))
    scores = hits.groupBy("query_id", key).agg(F.sum(part).alias("score"))
    if within is not None:
        scores = scores.join(within, [c for c in ("query_id", key) if c in within.columns], "left_semi")
    return ranked(scores, [F.desc(F.round("score", 9)), F.asc(key)], k).select("query_id", "rank", key, "score")


def _closest(x: np.ndarray, q: np.ndarray, k: int):
    """(query, row, distance) of each query's k nearest rows, with ties: a matrix product finds who may be among them, differences decide."""
    x2, q2 = np.square(x).sum(1), np.square(q).sum(1)
    whole = np.isfinite(x2)
    d = x2[None, :] + q2[:, None] - 2 * (q @ np.where(whole[:, None], x, 0).T)
    d[:, ~whole] = np.square(x[None, ~whole] - q[:, None]).sum(axis=2)  # infinitely far, or no number and found by nobody
    slack = 1e-8 + 1e-12 * x.shape[1] * (x2[whole].max(initial=0) + q2.max())  # beyond what rounding can do to a product
    last = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(d), 1), np.inf)
    of, at = np.nonzero(d <= last + 2 * slack)
    step = max(1, (1 << 22) // max(1, x.shape[1]))
    exact = [np.square(x[at[i : i + step]] - q[of[i : i + step]]).sum(axis=1) for i in range(0, len(of), step)]
    return of, at, np.concatenate(exact) if exact else np.zeros(0)


def _best_of_batches(probes: list, k: int, key: str):
    """Of each batch of (key, embedding) the rows that may be among a query's k nearest: its k nearest in the batch, with ties."""
    by_size: dict[int, tuple[list, list]] = {}
    for r in probes:
        ids, rows = by_size.setdefault(len(r["embedding"]), ([], []))
        ids.append(r["query_id"])
        rows.append(r["embedding"])
    matrices = {n: (pa.array(ids), np.array(rows, dtype=np.float64)) for n, (ids, rows) in by_size.items()}

    def run(batches):
        for batch in batches:
            for n, (ids, q) in matrices.items():
                fit = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), n))
                flat = fit.column(1).flatten()
                if not fit.num_rows or flat.null_count:
                    whole = [i for i, e in enumerate(fit.column(1).to_pylist()) if None not in e]
                    fit = fit.take(pa.array(whole, pa.int64()))
                    flat = fit.column(1).flatten()
                if not fit.num_rows:
                    continue
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(fit.num_rows, n)
                step = max(1, (1 << 22) // max(1, len(x)))
                for i in range(0, len(q), step):
                    of, at, d = _closest(x, q[i : i + step], k)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of + i)), fit.column(0).take(pa.array(at)), pa.array(d)], names=["query_id", key, "distance"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "chunk_id", probes: int = PROBES) -> DataFrame:
    """R2: query_id, rank, key, distance (squared L2), exact. The queries meet every block of vectors as one matrix, and a block sends on k rows a
    query. More than `probes` queries are dealt into groups of about so many, each of which passes over the vectors; `ann` is the way
    for many queries over many vectors."""
    v = vectors.where(F.col("embedding").isNotNull()).select(key, "embedding")
    q = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, distance double"
    groups = max(1, -(-q.count() // probes))
    d = None
    for g in range(groups):
        mine = q if groups == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        part = v.mapInArrow(_best_of_batches(mine.collect(), k, key), schema)
        d = part if d is None else d.union(part)
    return ranked(d, [F.round("distance", 9), F.asc(key)], k).select("query_id", "rank", key, "distance")


def fused(semantic: DataFrame, lexical: DataFrame, alpha: float = 0.5, key: str = "chunk_id") -> DataFrame:
    """Weighted reciprocal-rank fusion. A side that misses a row has rank 1000 there; at alpha 0 or 1 one side is not asked."""
    s = semantic.select("query_id", key, F.col("rank").alias("semantic_rank"))
    b = lexical.select("query_id", key, F.col("rank").alias("bm25_rank"))
    if alpha <= 0:
        both = b.withColumn("semantic_rank", F.lit(None).cast("int"))
    elif alpha >= 1:
        both = s.withColumn("bm25_rank", F.lit(None).cast("int"))
    else:
        both = s.join(b, ["query_id", key], "full")
    part = lambda w, r: F.lit(float(w)) / (RRF + F.coalesce(F.col(r), F.lit(MISSING)))
    score = part(alpha, "semantic_rank") + part(1 - alpha, "bm25_rank")
    return both.select("query_id", key, "semantic_rank", "bm25_rank", score.alias("rrf_score"))


def cohort_score(df: DataFrame, value: str, per: str = "query_id") -> Column:
    """Min-max over the query's final rows; 1 where all are equal; four decimals."""
    w = Window.partitionBy(per)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, F.round((F.col(value) - low) / (high - low), 4)).otherwise(F.lit(1.0))


def lexical_overlap(query: Column | str, document: Column | str) -> Column:
    """The default scorer of the rerank hook: the share of the query's words that the document holds."""
    q = F.array_distinct(tx.tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tx.tokens(document))) / F.size(q)).otherwise(0.0)


def reranked(hits: DataFrame, k: int, scorer=lexical_overlap, pool: int | None = None) -> DataFrame:
    """The first pool rows by scorer. If any of a query's scores is not finite its rows keep their order."""
    h = hits if pool is None else hits.where(F.col("rank") <= pool)
    h = h.withColumn("reranker_score", tx.finite(scorer("query_text", "content")))
    whole = F.min(F.col("reranker_score").isNotNull()).over(Window.partitionBy("query_id"))
    h = h.withColumn("reranker_score", F.when(whole, F.col("reranker_score"))).withColumnRenamed("rank", "old_rank")
    return ranked(h, [F.desc_nulls_last(F.round("reranker_score", 9)), F.asc("old_rank")], k)


def diversified(hits: DataFrame, k: int, weight: float = 0.7, key: str = "chunk_id") -> DataFrame:
    """Maximal marginal relevance within each query's pool (a few hundred rows at most, cut before). Adds mmr_rank."""

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        taken = picked(table.column("content").to_pylist(), table.column("relevance").to_pandas())
        return table.take(pa.array(taken, pa.int64())).append_column("mmr_rank", pa.array(range(1, len(taken) + 1), pa.int32()))

    def picked(texts: list, value: pd.Series) -> list[int]:
        if len(texts) <= k:
            return list(range(len(texts)))
        sets = [frozenset((t or "").lower().split()) for t in texts]
        low, high = value.min(), value.max()
        relevance = ((value - low) / (high - low) if high > low else value * 0 + 1.0).where(value.notna(), 0.0).fillna(0.0).tolist()
        closest, taken, free = [0.0] * len(sets), [0], list(range(1, len(sets)))
        while len(taken) < k and free:
            new = sets[taken[-1]]
            for i in free:
                if new and sets[i]:
                    closest[i] = max(closest[i], len(new & sets[i]) / len(new | sets[i]))
            best = max(free, key=lambda i: (round(weight * relevance[i] - (1 - weight) * closest[i], 12), -i))
            taken.append(best)
            free.remove(best)
        return taken

    # The rows come with all their columns and leave with them, so the search behind them runs once.
    hits = hits.withColumn("relevance", F.col("relevance").cast("double"))
    schema = StructType([*hits.schema.fields, StructField("mmr_rank", IntegerType())])
    return hits.groupBy("query_id").applyInArrow(choose, schema)


def expanded(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Content with the chunks right before and behind (index - 1 and + 1; gaps stay gaps), and whether there were any."""
    near = lambda name, step: chunks.select("doc_id", (F.col("chunk_index") - step).alias("chunk_index"), F.col("content").alias(name))
    h = hits.join(near("before", -1), ["doc_id", "chunk_index"], "left").join(near("behind", 1), ["doc_id", "chunk_index"], "left")
    h = h.withColumn("context_expanded", F.col("before").isNotNull() | F.col("behind").isNotNull())
    return h.withColumn("content", F.concat_ws("\n\n", "before", "content", "behind")).drop("before", "behind").withColumn("content_length", F.length("content"))


def similar(probes: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """Rows like a document's first vector; k + 20 are fetched, its own and further ones of one source are left out."""
    first = vectors.join(small(probes), "doc_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index"))).where("_n = 1")
    q = first.select(F.col("doc_id").alias("query_id"), "embedding")
    near = nearest(q, vectors.select("doc_id", "chunk_id", "embedding"), k + 20)
    near = near.join(vectors.select("chunk_id", "doc_id", "source"), "chunk_id").where(F.col("doc_id") != F.col("query_id"))
    near = ranked(near.withColumnRenamed("rank", "raw_rank").withColumn("one", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("raw_rank"))).where("one = 1"), [F.asc("raw_rank")], k)
    return near.select("query_id", "rank", "chunk_id", "source", F.round(F.greatest(F.lit(0.0), 1 - F.col("distance")), 4).alias("similarity"))


def expansion_terms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query_id, expanded: the query in lower case, then the synonyms of the whole, of its words and of its word pairs, in that order and once each.
    synonyms: term, synonym, ord."""
    low = F.lower(tx.strip("query_text"))
    t = tx.tokens(low)
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    q = queries.select("query_id", low.alias("low"), F.concat(F.array(low), t, pairs).alias("keys"))
    hit = q.select("query_id", F.posexplode("keys").alias("pos", "term")).join(small(synonyms), "term")
    terms = hit.groupBy("query_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ord", "synonym"))), lambda x: x["synonym"])).alias("terms"))
    return q.join(terms, "query_id", "left").select("query_id", F.concat_ws(" ", F.array("low"), F.coalesce("terms", F.array().cast("array<string>"))).alias("expanded"))


def keyword_route(queries: DataFrame, routes: DataFrame) -> DataFrame:
    """query_id, routed_by: the category with most keywords in the query; the one declared first wins ties. A keyword of several words is
    looked for anywhere, others between word boundaries. routes: category, keyword, cat_ord. Up to ROUTES of them are found in one pass over each query; more are joined."""
    k, q = F.lower("keyword"), F.lower("query_text")
    listed = routes.where("keyword is not null").select(k.alias("keyword"), "category", "cat_ord")
    rows = listed.limit(ROUTES + 1).collect()
    if len(rows) <= ROUTES:
        words = [r["keyword"] for r in rows]
        names = queries.sparkSession.createDataFrame([(i, r["category"], r["cat_ord"]) for i, r in enumerate(rows)], f"i int, category {routes.schema['category'].dataType.simpleString()}, cat_ord {routes.schema['cat_ord'].dataType.simpleString()}")
        hits = queries.select("query_id", F.explode(many.found(q, words, [" " not in w for w in words])).alias("i")).join(F.broadcast(names), "i")
    else:
        word = F.concat(F.lit(r"(?U)\b\Q"), k, F.lit(r"\E\b"))
        hits = queries.join(small(routes), F.when(F.contains(k, F.lit(" ")), F.contains(q, k)).otherwise(F.rlike(q, word)))
    n = hits.groupBy("query_id", "category", "cat_ord").agg(F.count("*").alias("n"))
    best = ranked(n, [F.desc("n"), F.asc("cat_ord")], 1).select("query_id", F.col("category").alias("routed_by"))
    return queries.select("query_id").join(best, "query_id", "left")


def _times(phrase: tuple, toks: list) -> int:
    return sum(t == phrase[0] and tuple(toks[i : i + len(phrase)]) == phrase for i, t in enumerate(toks))


def _held(queries: list):
    """Of each batch of (chunk_id, toks), in one pass, rows (query_id, chunk_id, dl, key, times, tf, n): the phrases of queries whose phrases a chunk all
    holds; for each phrase (key, n) in how many chunks it stands; and one row (dl, n) of all words and chunks."""
    asked = {tuple(p) for r in queries for p in r["phrases"]}
    single, longer = {p[0] for p in asked if len(p) == 1}, [p for p in asked if len(p) > 1]
    by_word: dict[str, list] = {}
    for r in queries:
        by_word.setdefault(max((p[0] for p in r["phrases"]), key=lambda w: (len(w), w)), []).append((r["query_id"], frozenset(t for p in r["phrases"] for t in p), Counter(map(tuple, r["phrases"]))))

    def run(batches):
        for batch in batches:
            found: list[tuple] = []
            df: Counter = Counter()
            total = 0
            for chunk, toks in zip(batch.column(0), batch.column(1), strict=True):
                toks = toks.as_py()
                words, counts = set(toks), None
                total += len(toks)
                df.update(words & single)
                df.update(" ".join(p) for p in longer if words.issuperset(p) and _times(p, toks))
                for query, needed, phrases in (x for w in words & by_word.keys() for x in by_word[w] if x[1] <= words):
                    counts = counts or Counter(toks)
                    tfs = [counts[p[0]] if len(p) == 1 else _times(p, toks) for p in phrases]
                    if all(tfs):
                        found += [(query, chunk.as_py(), len(toks), " ".join(p), n, tf, None) for (p, n), tf in zip(phrases.items(), tfs, strict=True)]
            found += [(None, None, None, p, None, None, n) for p, n in df.items()]
            found.append((None, None, total, None, None, None, batch.num_rows))
            yield [list(x) for x in zip(*found, strict=True)]

    return run


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow of a function that gives lists of columns."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(b, arrow, strict=True)], schema=arrow) for b in run(batches)), schema)


def phrase_hits(queries: DataFrame, chunks: DataFrame, most: int = 4_000_000) -> DataFrame:
    """query_id, chunk_id, score of chunks that hold every phrase of a query, with FTS-like BM25 (k1 1.2, b 0.75); repeated phrases
    score again. Both ids are keys. Queries of at most so many characters meet every chunk's words at once; beyond, they are joined in."""
    c = chunks.select("chunk_id", tx.lexical_tokens(F.concat_ws(" ", "content", "filename", "category")).alias("toks"))
    q = queries.select("query_id", tx.phrases("query_text").alias("phrases")).where(F.size("phrases") > 0)
    if few_words(queries, "query_text", most):
        types = [d.schema[n].dataType.simpleString() for n, d in (("query_id", queries), ("chunk_id", chunks))]
        # Written, as it is read for hits, frequencies and lengths: the texts are cut into words once.
        one = written(mapped(c, _held(q.collect()), f"query_id {types[0]}, chunk_id {types[1]}, dl long, key string, times long, tf long, n long"), "phrases")
        df = one.where("tf is null and key is not null").groupBy("key").agg(F.sum("n").alias("df"))
        held = one.where("tf is not null").drop("n").join(F.broadcast(df), "key")
        stats = one.where("key is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum("dl"), F.sum("n")).cast("double").alias("avgdl"))
    else:
        each = q.select("query_id", F.explode("phrases").alias("phrase")).groupBy("query_id", F.array_join("phrase", " ").alias("key"), "phrase").agg(F.count("*").alias("times"))
        asked = each.select("key", "phrase", F.col("phrase")[0].alias("term")).distinct()
        at = c.select("chunk_id", F.size("toks").alias("dl"), "toks", F.posexplode("toks").alias("i", "term")).join(asked, "term")
        tf = at.where(F.slice("toks", F.col("i") + 1, F.size("phrase")) == F.col("phrase")).groupBy("key", "chunk_id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
        df = tf.groupBy("key").agg(F.count("*").alias("df"))
        need = each.groupBy("query_id").agg(F.count("*").alias("need"))
        held = each.drop("phrase").join(df, "key").join(tf, "key").join(need, "query_id")
        held = held.withColumn("held", F.count("*").over(Window.partitionBy("query_id", "chunk_id"))).where("held = need")
        stats = c.agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avgdl"))
    held = held.join(F.broadcast(stats), F.lit(True))
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = F.col("times") * idf * ix.contribution(F.col("tf"), F.col("dl"), F.col("avgdl"), 1.2, 0.75)
    return held.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def dispatched(queries: DataFrame, hit_counts: DataFrame, min_hits: int = 3, patterns=tuple(tx.LEXICAL_PATTERNS)) -> DataFrame:
    """query_id, method, route. auto goes lexical for lexical queries with enough hits; fts5 with any; all else is hybrid."""
    q = queries.join(hit_counts, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    lexical = (F.col("method") == "auto") & (tx.route("query_text", patterns) == "lexical") & (F.col("hits") >= min_hits) | (F.col("method") == "fts5") & (F.col("hits") > 0)
    return q.select("query_id", "method", "hits", F.when(lexical, "lexical").otherwise("hybrid").alias("route"))


def holding(queries: DataFrame, rows: DataFrame, most: int = ROUTES) -> DataFrame:
    """The rows whose content holds a query's whole text, with its query_id. Up to `most` queries are found in one pass over each text; more are joined."""
    asked = queries.where("query_text is not null").select("query_id", "query_text")
    few = asked.limit(most + 1).collect()
    if len(few) > most:
        return rows.join(small(asked), F.contains("content", F.col("query_text"))).drop("query_text")
    names = queries.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(few)], StructType([StructField("_i", IntegerType()), StructField("query_id", queries.schema["query_id"].dataType)]))
    at = rows.withColumn("_i", F.explode(many.found(F.col("content"), [r["query_text"] for r in few])))
    return at.join(F.broadcast(names), "_i").drop("_i")


def evaluated(cases: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """One row: n, mrr, recall. cases: query_id, expected; results: query_id, rank, source."""
    each = cases.join(results.where(F.col("rank") <= k).select("query_id", "rank", "source"), "query_id", "left")  # one pass over the cases
    c = each.groupBy("query_id").agg(F.min(F.when(tx.path_matches("expected", "source"), F.col("rank"))).alias("hit"))
    return c.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("hit"), F.lit(0.0))), 4).alias("mrr"), F.round(F.avg(F.col("hit").isNotNull().cast("double")), 4).alias("recall"))
