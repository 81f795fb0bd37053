"""The request-level functions over one corpus (13 of them), each a DataFrame or a JSON envelope of one."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as tx
from ..operators import chunking as ch
from ..operators import lexical as lx
from ..operators import maintenance as mt
from ..operators import retrieval as rt
from ..sources import parsers as ps
from .generations import BUCKET, Generations, Part
from .requests import QueryCache
from .search import HybridSearch


def hashed_embedder(dim: int = 64):
    """The default embedder: words hashed into dim signed counts, of unit length. It stands in where no model is at hand and knows no meaning."""

    def embed(df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        words = tx.tokens(F.coalesce(F.col(text), F.lit("")))
        sign = lambda w: F.when(F.xxhash64(w) % 2 == 0, 1.0).otherwise(-1.0)
        counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter("_w", lambda w: F.pmod(F.hash(w), F.lit(dim)) == i), F.lit(0.0), lambda s, w: s + sign(w)))
        d = df.withColumn("_w", words).withColumn("_v", counts)
        norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
        return d.withColumn(out, F.transform("_v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))).drop("_w", "_v")

    embed.dim = dim
    return embed


def contracted(embed, dim: int | None = None):
    """A hook that keeps its contract: a vector that is null, of another length than dim (where given), or holds a component that is no number is
    an error where it is read, never a vector of zeros."""

    def run(df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        v = F.col(out)
        bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        if dim is not None:
            bad = bad | (F.size(v) != dim)
        return embed(df, text, out).withColumn(out, F.when(bad, F.raise_error(F.lit(f"the embedder gave no vector of {dim or 'finite'} components"))).otherwise(v))

    return run


def contained(path: str, root: str) -> str:
    """The normal form of a path below root; anything else is an error. Links are the store's business."""
    if "\0" in path:
        raise ValueError("NUL in path")
    if path.startswith(("/", "\\")) or PurePosixPath(path).is_absolute() or ":" in path.split("/")[0]:
        raise ValueError("absolute path")
    parts: list[str] = []
    for p in path.replace("\\", "/").split("/"):
        if p == ".." and not parts:
            raise ValueError("path leaves the corpus")
        if p == "..":
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return "/".join([root.rstrip("/"), *parts])


class KnowledgeBase:
    """documents (doc_id, source, filename, format, category, content, mtime, size) and what is derived of them, in generations."""

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, embed=None, sanity: tuple[str, ...] = ()):
        """sanity: queries of which a full rebuild has to find four (all, if there are fewer) before it is published."""
        self.spark, self.config, self.store = spark, config or Config(), Generations(spark, folder)
        embed = embed or hashed_embedder()
        self.embed, self.sanity, self.cache = contracted(embed, getattr(embed, "dim", None)), tuple(sanity), QueryCache()

    # --- building ---

    def _categorised(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("category", F.coalesce(F.col("category"), tx.category("source", self.config.category_mappings)) if "category" in docs.columns else tx.category("source", self.config.category_mappings))

    def _publish(self, fresh: DataFrame, gone: DataFrame | None = None, status: DataFrame | None = None, gated: bool = False, origin: str | None = None) -> str:
        """K1 to K5: a new generation of the current one without the documents (source) of gone and fresh, and with those of fresh. Only fresh
        documents are categorised, chunked, embedded and tokenized, and only the buckets that their sources lie in are written; the others are shared
        with the generation before, and statistics change by the difference. Without gone everything is made from fresh. gated: K9, before it is published. origin: what it is made from, so that a build that was
        cut off is taken up (ST5)."""
        from ..operators import index as ix

        c, before = self.config, self.store.current
        old = gone is not None and before is not None
        held = self.store.receipt(before)["tables"] if before is not None else {}
        new = self._categorised(fresh.where("content is not null")).select("doc_id", "source", "filename", "format", "category", "content", "mtime", "size", tx.keywords("content", c.keyword_routes).alias("keywords"))
        sources = fresh.select("source") if gone is None else gone.select("source").union(fresh.select("source"))
        bucket = F.pmod(F.xxhash64("source"), F.lit(c.buckets)).cast("int").alias(BUCKET)
        # A source's rows of all tables lie in one bucket; a change of some sources touches theirs.
        touched = None
        if old and all(held[t].get("of") == c.buckets for t in ("documents", "chunks", "vectors", "postings")):
            touched = sorted(r[BUCKET] for r in sources.select(bucket).distinct().collect())
        stay = lambda t: self.store.read(t, before, touched)

        def chunks(read):
            names = new.select("doc_id", "source", F.col("source").alias("path"), "filename", "category", "format", F.slice("keywords", 1, 10).alias("keywords"))
            return ch.deduplicated(ch.chunks(new.select("doc_id", "content", "format"), c.chunk_size, c.chunk_overlap, "format = '.md'")).join(names, "doc_id")

        def added(read):  # chunks of fresh documents: by their sources, as the table is read back
            return read("chunks", touched).join(fresh.select("source").distinct(), "source", "left_semi") if old else read("chunks")

        def vectors(read):
            return self.embed(added(read).select("chunk_id", "doc_id", "chunk_index", "source", F.concat(F.lit(c.passage_prefix), "content").alias("passage")), "passage").drop("passage")

        def by_source(table, make):
            rows = make if not old else lambda read: mt.merged(stay(table), make(read), sources, "source")
            return Part(lambda read: rows(read).withColumn(BUCKET, bucket), c.buckets, touched, before if old else None)

        def by_chunk(table, make):
            def run(read):
                if not old or table not in held or "buckets" not in held[table]:
                    return make(read("chunks")).join(read("chunks").select("chunk_id", bucket), "chunk_id")
                kept = stay("chunks").join(sources.distinct(), "source", "left_anti").select("chunk_id", bucket)
                return stay(table).join(kept, "chunk_id").unionByName(make(added(read)).join(added(read).select("chunk_id", bucket), "chunk_id"))

            return Part(run, c.buckets, touched if table in held else None, before if old else None)

        def corpus_stats(read):
            if touched is None:
                return ix.corpus_stats_of(read("chunks"), read("postings"))
            return ix.corpus_stats_changed(stay("corpus_stats"), (stay("chunks"), stay("postings")), (read("chunks", touched), read("postings", touched)))

        def term_stats(read):
            if touched is None:
                return ix.term_stats(read("postings"), read("corpus_stats"))
            return ix.term_stats_changed(stay("term_stats"), stay("postings"), read("postings", touched), read("corpus_stats"))

        tables = {
            "documents": by_source("documents", lambda read: new), "chunks": by_source("chunks", chunks), "vectors": by_source("vectors", vectors), "postings": by_chunk("postings", lambda d: ix.postings(ix.tokenized(d))),
            "corpus_stats": corpus_stats, "term_stats": term_stats,
        }
        if c.lexical_enabled:
            tables["places"] = by_chunk("places", lx.entries)
        if status is not None:
            tables["changes"] = status
        name = self.store.build(tables, self._settings(), origin=None if origin is None else f"{before} {origin}")
        made = self.store.receipt(name)["tables"]
        if made["vectors"]["rows"] != made["chunks"]["rows"]:
            raise ValueError(f"{made['vectors']['rows']} vectors of {made['chunks']['rows']} chunks; the old build stays")
        if before is not None:
            rows = made["chunks"]["rows"]
            if rows == 0:
                raise ValueError("the new build is empty; the old one stays")
            if gated:
                self._gates(name, self.store.receipt(before)["tables"]["chunks"]["rows"])
        self.store.activate(name, before, written=touched is not None)
        self.cache.invalidate()
        return name

    def _settings(self) -> dict:
        """What a build depends on besides its documents."""
        c = self.config
        return {"chunk_size": c.chunk_size, "chunk_overlap": c.chunk_overlap, "model": c.embedding_model, "dim": c.embedding_dim}

    def _gates(self, name: str, baseline: int) -> None:
        """K9: a build that fails is dropped, and the old one stays."""
        asked = self.spark.createDataFrame(list(enumerate(self.sanity)), "query_id long, query_text string")
        hits = self._engine(name).lexical(asked, 1).groupBy("query_id").agg(F.count("*").alias("hits"))
        g = mt.gates(self.store.read("chunks", name), baseline, hits, min(4, len(self.sanity))).first()
        if not g["passed"]:
            self.store.drop(name)
            raise ValueError(f"the new build fails its gates: {g['n_rows']} chunks after {baseline}, {g['n_hits']} of {len(self.sanity)} sanity queries; the old one stays")

    def reindex_documents(self, source: str | DataFrame, full: bool = False) -> dict:
        """ST4: files of a folder (or parsed documents) against what is indexed: new and updated ones are parsed, deleted ones go. full: all are
        parsed, and the build has to pass the gates (K9)."""
        now = ps.read_files(self.spark, source, tuple(self.config.exclude)) if isinstance(source, str) else None
        docs = ps.parsed(now) if now is not None else source
        listing = now.select(F.col("path").alias("source"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")) if now is not None else docs.select("source", "mtime", "size")
        if self.store.current is None:
            changes, fresh, gone = listing.select("source", F.lit("new").alias("change")), docs, None
        else:
            changes = mt.classified(listing, self.store.read("documents"))
            wanted = changes.where("change <> 'deleted'" if full else "change in ('new', 'updated')").select("source")
            fresh = ps.parsed(now.join(wanted.withColumnRenamed("source", "path"), "path", "left_semi")) if now is not None else docs.join(wanted, "source", "left_semi")
            gone = None if full else changes.where("change in ('updated', 'deleted')").select("source")
        # The same listing against the same generation is the same work: a run that was cut off goes on with the tables that it had finished.
        origin = mt.set_digest(listing, *listing.columns).first()
        self._publish(fresh, gone, changes, full, f"{origin['n']} {origin['digest_sum']} {full}")
        return self.get_reindex_status()

    def get_reindex_status(self) -> dict:
        """ST8, A8: counts of the last run."""
        name = self.store.current
        if name is None or "changes" not in self.store.receipt(name)["tables"]:
            return {"generation": name}
        return {"generation": name, **mt.indexing_stats(self.store.read("changes")).first().asDict()}

    def add_document(self, source: str, content: str, category: str | None = None) -> dict:
        """K3"""
        path = contained(source, "")
        if not content.strip():
            return {"error": "content is blank"}
        name = path.rpartition("/")[2]
        suffix = PurePosixPath(name).suffix.lower()
        if suffix not in ps.PARSERS:
            return {"error": f"unsupported format: {suffix}"}
        text, _, error = ps.parse(path, raw := content.encode("utf-8", "surrogateescape"))  # as a file of this suffix is read
        if error or text is None:
            return {"error": error or "content is blank"}
        row = self.spark.createDataFrame([(path, name, suffix, category, text)], "source string, filename string, format string, category string, content string")
        row = row.withColumn("mtime", F.lit(datetime.now(UTC)))  # one time for all tables that are written
        row = row.withColumn("size", F.lit(len(raw)).cast("long"))
        row = row.withColumn("doc_id", tx.document_key(F.col("source"), F.col("mtime"), F.col("size")))
        return {"source": path, "generation": self._publish(row, row)}

    def update_document(self, source: str, content: str) -> dict:
        """K4"""
        found = self.get_document(source)
        return {"error": "no such document"} if found is None else self.add_document(source, content, found["category"])

    def remove_document(self, source: str) -> dict:
        """K2, K5"""
        if self.get_document(source) is None:
            return {"error": "no such document"}
        path = contained(source, "")
        mine = self.store.read("documents").where(F.col("source") == path)
        return {"source": path, "generation": self._publish(mine.where("false").drop("keywords"), mine)}

    def add_from_url(self, pages: DataFrame, category: str = "web") -> dict:
        """Fetched pages (page_id, url, html) as documents, defused and fenced."""
        p = ps.pages(pages)
        name = F.concat("slug", F.lit(".md"))
        safe = tx.neutralized("content")
        d = p.select(F.concat(F.lit("/web/"), name).alias("source"), name.alias("filename"), F.lit(".md").alias("format"), F.lit(category).alias("category"), tx.fenced(safe, "url").alias("content"))
        d = d.dropDuplicates(["source"]).withColumn("mtime", F.timestamp_seconds(F.lit(0))).withColumn("size", F.octet_length("content").cast("long"))
        d = d.withColumn("doc_id", tx.document_key(F.col("source"), F.col("mtime"), F.col("size")))
        return {"generation": self._publish(d, d)}

    # --- asking ---

    def _engine(self, name: str | None = None) -> HybridSearch:
        read = lambda t: self.store.read(t, name)
        places = ("places",) if "places" in self.store.receipt(name or self.store.current)["tables"] else ()
        return HybridSearch(read("chunks"), read("vectors").select("chunk_id", "embedding"), "chunk_id", {k: read(k) for k in ("postings", "term_stats", "corpus_stats", *places)})

    def search_knowledge(self, queries: DataFrame, max_results: int | None = None, category: str | None = None, hybrid_alpha: float | None = None, min_score: float | None = None, scorer=None, mmr: bool = True, neighbours: bool = True, search_method: str = "auto") -> DataFrame:
        """R13 over a table of queries (query_id, query_text): hits with snippets, and what each query was routed by. search_method: auto (the lexical path
        for queries that look lexical and have hits, where the configuration enables it), hybrid or fts5."""
        c = self.config
        if search_method not in ("auto", "hybrid", "fts5"):
            raise ValueError(f"unknown search_method: {search_method}")
        if search_method == "fts5" and not c.lexical_enabled:
            raise ValueError("the lexical path is disabled; set search.lexical_fast_path.enabled or use search_method auto")
        if category is not None and not self.list_categories().where(F.col("category") == category).limit(1).count():
            raise ValueError(f"unknown category: {category}")
        synonyms = [(t, s, i) for t, ss in c.synonyms.items() for i, s in enumerate(ss)]
        asked = queries.select("query_id", "query_text")
        if synonyms:
            wide = rt.expansion_terms(asked, self.spark.createDataFrame(synonyms, "term string, synonym string, ord int"))
            asked = asked.join(wide, "query_id").select("query_id", F.col("expanded").alias("query_text"))
        probes = self.embed(queries.select("query_id", F.concat(F.lit(c.query_prefix), "query_text").alias("probe")), "probe").drop("probe")
        k = c.results(max_results)
        alpha = c.hybrid_alpha if hybrid_alpha is None else hybrid_alpha
        least = None if min_score is None else min(1.0, max(0.0, min_score))
        options = {"pool": 3 * k, "alpha": alpha, "scorer": scorer, "mmr": c.mmr_lambda if mmr else None, "min_score": least}
        if c.lexical_enabled and search_method != "hybrid":
            # The lexical path takes queries as they were asked; the others are expanded.
            hits, served = self._engine().by_words(queries.select("query_id", "query_text", F.lit(search_method).alias("method")), k, category, c.min_hits, c.patterns, neighbours)
            hits = hits if least is None else hits.where(F.col("score") >= least)
            rest = self._engine().run(asked.join(served, "query_id", "left_anti"), probes.join(served, "query_id", "left_anti"), k, category=category, neighbours=neighbours, **options)
            hits = rest.unionByName(hits.select(*[x for x in hits.columns if x in rest.columns]), allowMissingColumns=True)
        else:
            hits = self._engine().run(asked, probes, k, category=category, neighbours=neighbours, **options)
        if "content" in hits.columns:
            hits = hits.withColumn("content", tx.snippet("content"))
        routes = [(cat, k2, i) for i, (cat, ks) in enumerate(c.keyword_routes.items()) for k2 in ks]
        if routes:
            hits = hits.join(rt.keyword_route(queries, self.spark.createDataFrame(routes, "category string, keyword string, cat_ord int")), "query_id")
        else:
            hits = hits.withColumn("routed_by", F.lit(None).cast("string"))
        return hits.withColumn("routed_by", F.when(F.col("search_method") == "fts5", "fts5_router").otherwise(F.col("routed_by")))

    def ask(self, query: str, max_results: int | None = None, category: str | None = None, hybrid_alpha: float | None = None, min_score: float | None = None, search_method: str = "auto") -> list[dict]:
        """R13, ST7: the hits of one query, best first. Answers (of max_results rows) are kept in a cache until they are too old or a build is published."""
        key = self.cache.key(self.store.current, query, self.config.results(max_results), category, hybrid_alpha, min_score, search_method)
        found = self.cache.get(key)
        if found is None:
            asked = self.spark.createDataFrame([(0, query)], "query_id long, query_text string")
            hits = self.search_knowledge(asked, max_results, category, hybrid_alpha, min_score, search_method=search_method)
            found = sorted((r.asDict(recursive=True) for r in hits.collect()), key=lambda r: r["rank"])
            self.cache.put(key, found)
        return found

    def get_document(self, source: str) -> dict | None:
        """R16"""
        r = self.store.read("documents").where(F.col("source") == contained(source, "")).first()
        return None if r is None else r.asDict(recursive=True)

    def list_categories(self) -> DataFrame:
        return mt.category_counts(self.store.read("documents"))

    def list_documents(self, category: str | None = None, offset: int | None = None, most: int | None = None) -> DataFrame:
        """R17; W9: by source, where a page is asked for."""
        d = self.store.read("documents")
        d = d if category is None else d.where(F.col("category") == category)
        d = d.select("doc_id", "source", "filename", "format", "category", F.slice("keywords", 1, 5).alias("keywords"))
        return d if offset is None and most is None else d.orderBy("source").offset(max(0, offset or 0)).limit(1000 if most is None else max(0, most))

    def get_index_stats(self) -> dict:
        """A6"""
        r = self.store.metadata()
        if not r:
            return {"generation": None, "total_documents": 0, "total_chunks": 0, "terms": 0, "cache": self.cache.stats()}
        rows = {t: x["rows"] for t, x in r["tables"].items()}
        return {"generation": self.store.current, "total_documents": rows["documents"], "total_chunks": rows["chunks"], "terms": rows["term_stats"], **r["settings"], "cache": self.cache.stats()}

    def search_similar(self, source: str, max_results: int = 5) -> DataFrame:
        """R11"""
        doc = self.store.read("documents").where(F.col("source") == contained(source, "")).select("doc_id")
        near = rt.similar(doc, self.store.read("vectors"), self.config.results(max_results))
        return near.join(self.store.read("chunks").select("chunk_id", F.substring("content", 1, 200).alias("preview")), "chunk_id")

    def evaluate_retrieval(self, cases: DataFrame, k: int = 5) -> DataFrame:
        """Cases: query_id, query_text, expected."""
        bad = cases.where("query_text is null or trim(query_text) = '' or expected is null or trim(expected) = ''")
        if not cases.limit(1).count() or bad.limit(1).count():
            raise ValueError("every case needs a query and an expected path, and there has to be one")
        hits = self.search_knowledge(cases.select("query_id", "query_text").distinct(), k, hybrid_alpha=0.5, mmr=False, neighbours=False)
        return rt.evaluated(cases.select("query_id", "expected"), hits.select("query_id", "rank", F.col("path").alias("source")), k)

    @staticmethod
    def envelope(df: DataFrame) -> DataFrame:
        """One JSON string a row."""
        return df.select(F.to_json(F.struct("*")).alias("json"))
