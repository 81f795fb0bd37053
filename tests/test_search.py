import math
import time

import pytest
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.operators import evidence as ev
from quarry.operators import maintenance as mt
from quarry.operators import retrieval as rt
from quarry.plans.api import KnowledgeBase, hashed_embedder
from quarry.plans.generations import Conflict, Generations
from quarry.streaming import events as es

SEED = [(f"c{i:02}", f"note {i} about {'CVE-2021-4034' if i % 4 == 0 else 'nothing'} {'MDR-AD002' if i == 3 else 'MDR-AD003' if i == 5 else ''}", f"f{i}.md", "general") for i in range(20)]


@pytest.fixture(scope="module")
def seed(spark):
    return spark.createDataFrame(SEED, "chunk_id string, content string, filename string, category string").cache()


def test_phrases_find_exact_identifiers(spark, seed):
    q = spark.createDataFrame([(1, "MDR-AD002"), (2, "CVE-2021-4034"), (3, "CVE-2021-4034 MDR-AD002"), (4, 'about "nothing"')], "query_id long, query_text string")
    hits = {(r["query_id"], r["chunk_id"]) for r in rt.phrase_hits(q, seed).collect()}
    assert {c for i, c in hits if i == 1} == {"c03"}
    assert len({c for i, c in hits if i == 2}) == 5
    assert not {c for i, c in hits if i == 3}
    assert len({c for i, c in hits if i == 4}) == 15


def test_missing_rank_counts_as_1000(spark):
    s = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "b", 1)], "query_id long, chunk_id string, rank int")
    got = {r["chunk_id"]: r["rrf_score"] for r in rt.fused(s, b, 0.3).collect()}
    assert math.isclose(got["a"], 0.3 / 61 + 0.7 / 1060) and math.isclose(got["b"], 0.3 / 62 + 0.7 / 61)
    assert rt.fused(s, b, 1.0).count() == 2 and rt.fused(s, b, 0.0).count() == 1


def test_nearest_is_exact_on_either_path(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(60)] + [(98, None), (99, [1.0]), (97, [None, 1.0])], "chunk_id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, [9.0, 0.0]), (3, None)], "query_id long, embedding array<float>")
    got = sorted(tuple(r) for r in rt.nearest(q, v, 5).collect())
    monkeypatch.setattr(rt, "PROBES", 0)
    assert got == sorted(tuple(r) for r in rt.nearest(q, v, 5).collect()) and len(got) == 10


def test_cohort_scores(spark):
    d = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 3.0), (2, 5.0), (2, 5.0)], "query_id long, v double")
    assert sorted((r[0], r[1]) for r in d.select("query_id", rt.cohort_score(d, "v")).collect()) == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 1.0), (2, 1.0)]


def test_rerank_keeps_order_where_a_score_is_not_finite(spark):
    h = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "b", float("nan")), (2, 1, "c", 1.0), (2, 2, "d", 2.0)], "query_id long, rank int, content string, s double").withColumn("query_text", F.lit("q"))
    got = {(r["query_id"], r["rank"]): r["content"] for r in rt.reranked(h, 2, scorer=lambda q, c: F.col("s")).collect()}
    assert got == {(1, 1): "a", (1, 2): "b", (2, 1): "d", (2, 2): "c"}


def test_mmr_prefers_other_texts(spark):
    h = spark.createDataFrame([(1, 1, "a", "x y z", 3.0), (1, 2, "b", "x y z", 2.9), (1, 3, "c", "u v w", 2.5), (1, 4, "d", "p q", None)], "query_id long, rank int, chunk_id string, content string, relevance double")
    assert [r["chunk_id"] for r in rt.diversified(h, 2, 0.5).orderBy("mmr_rank").collect()] == ["a", "c"]
    assert rt.diversified(h, 9).count() == 4


def test_expansion_and_neighbours(spark):
    q = spark.createDataFrame([(1, " SQLi on web app ")], "query_id long, query_text string")
    s = spark.createDataFrame([("sqli", "sql injection", 0), ("web app", "web application", 0), ("sqli on web app", "whole", 0)], "term string, synonym string, ord int")
    assert rt.expansion_terms(q, s).first()["expanded"] == "sqli on web app whole sql injection web application"
    c = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("d", 3, "e")], "doc_id string, chunk_index int, content string")
    got = {r["chunk_index"]: (r["content"], r["context_expanded"]) for r in rt.expanded(c, c).collect()}
    assert got == {0: ("a\n\nb", True), 1: ("a\n\nb", True), 3: ("e", False)}


def test_evidence(spark):
    text = "---\nt: 1\n---\n# Head\n\n- the zebra stripes are black and white\n\n```\nzebra code block that is long enough\n```\n\n| zebra | table row that is long enough |\n\nnothing to see in this line at all here"
    r = spark.createDataFrame([(1, "zebra stripes", 1, text)], "query_id long, query_text string, rank int, content string")
    u = ev.units(r)
    got = u.collect()
    assert [(x["uid"], x["unit_text"], x["distinct"]) for x in got] == [("E1", "the zebra stripes are black and white", 2)]
    for raw, n in (('{"evidence_ids": ["E1"]}', 1), ('```json\n{"evidence_ids": ["E1"]}\n```', 1), ("prose", 1), ('{"evidence_ids": ["E9"]}', 1)):
        assert ev.selected(u, spark.createDataFrame([(1, raw)], "query_id long, raw string")).count() == n
    assert ev.composed(ev.selected(u, spark.createDataFrame([(1, "x")], "query_id long, raw string"))).first()["answer"].endswith("— the zebra stripes are black and white [1]")


def test_digests(spark):
    a = spark.createDataFrame([("b", "1"), ("a", None)], "k string, v string")
    assert mt.ordered_digest(a, "k", "v") == mt.ordered_digest(a.orderBy("k"), "k", "v")
    with pytest.raises(ValueError):
        mt.ordered_digest(a.union(a), "k", "v")
    assert mt.set_digest(a, "k", "v").first() == mt.set_digest(a.orderBy("k"), "k", "v").first()


def test_limiter():
    assert list(es.allowed([0, 1, 2, 59, 60.5, 61.5], 2)) == [True, True, False, False, True, True]


def test_debounce_first_event_sets_the_deadline(spark):
    e = spark.createDataFrame([("w", 0, "a"), ("w", 6, "b"), ("w", 9, "a"), ("w", 14, "c")], "k string, s long, path string").withColumn("ts", F.timestamp_seconds("s"))
    assert [(r["batch"], r["deadline"], r["paths"]) for r in es.debounced(e, "k").orderBy("batch").collect()] == [(0, 10.0, 2), (1, 24.0, 1)]


def test_caches(spark):
    e = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate([("a", 0), ("a", 200), ("a", 301), ("b", 302), ("a", 303)])], "event_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["hit"] for r in es.ttl_hits(e, "k").orderBy("event_id").collect()] == [False, True, False, False, True]
    assert [r["hit"] for r in es.lru_cache(e, "k", 1).orderBy("event_id").collect()] == [False, True, False, False, False]


def test_watch_and_limit_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.md").write_text("x")
    seen = []
    schema = spark.read.format("binaryFile").load(str(tmp_path / "in")).schema
    es.watch(spark, str(tmp_path / "in"), schema, lambda df, n: seen.extend(r["path"] for r in df.select("path").collect()), str(tmp_path / "ck"), "*.md", once=True).awaitTermination()
    assert len(seen) == 3
    log = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "user_id long, event_id long, s double").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = es.rate_limited_stream(stream, "user_id", 2, 1).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["allowed"] for r in spark.table("limited").collect()) == [False, False, True, True, True]


def test_generations(spark, tmp_path):
    g = Generations(spark, str(tmp_path / "store"))
    d = spark.range(5).withColumn("v", F.lit("x"))
    a = g.build({"t": d}, name="g1")
    assert g.verify(a) == [] and g.current is None
    g.activate(a)
    b = g.build({"t": d.limit(2)}, name="g2")
    with pytest.raises(Conflict):
        g.activate(b, None)
    g.activate(b, a)
    assert g.read("t").count() == 2 and g.rollback() == a and g.read("t").count() == 5
    d.limit(1).write.mode("overwrite").parquet(str(tmp_path / "store/builds/g2/t"))
    assert "t: rows" in g.verify(b)
    with pytest.raises(ValueError):
        g.activate(b, a)
    with pytest.raises(ValueError):
        g.drop(a)
    spark.range(1).write.parquet(str(tmp_path / "store/builds/g1000/t"))
    assert g.stale(1e9) == ["g1000"]
    g.drop("g1000")
    assert g.stale(1e9) == []


def test_lost_publisher_does_not_block(spark, tmp_path):
    g = Generations(spark, str(tmp_path / "store"), claim=1.0)
    a, b = (g.build({"t": spark.range(n), "u": lambda read: read("t").selectExpr("id + 1 as id")}, name=f"g{n}") for n in (3, 4))
    g.activate(a)
    (tmp_path / "store/claims/2").touch()  # claimed and lost
    with pytest.raises(Conflict):
        g.activate(b, a)
    time.sleep(1.2)
    g.activate(b, a)
    assert g.history() == [(1, "g3"), (3, "g4")] and g.read("u").agg(F.max("id")).first()[0] == 4


def test_updates_touch_their_rows_alone(spark, tmp_path):
    """A document that is added, changed or removed gives the tables that a build from nothing gives, and only its chunks are made anew."""
    embedded = []
    embed = hashed_embedder()

    def counted(df, text, out="embedding"):
        embedded.append(df.count())
        return embed(df, text, out)

    files = {f"d{i}.md": f"# Title {i}\n" + f"Words of text number {i} and more. " * 60 for i in range(6)}
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), embed=counted)
    kb.add_document("d0.md", files["d0.md"])
    docs = spark.createDataFrame([(f"/{n}", n, ".md", x) for n, x in files.items()], "source string, filename string, format string, content string")
    docs = docs.withColumn("mtime", F.timestamp_seconds(F.lit(0))).withColumn("size", F.octet_length("content").cast("long")).withColumn("doc_id", F.sha2("source", 256))
    kb.reindex_documents(docs)
    whole = kb.store.read("chunks").count()
    embedded.clear()
    kb.add_document("d3.md", "# Other\nshort text")
    kb.remove_document("d5.md")
    assert embedded == [1, 0] and kb.store.read("chunks").count() < whole
    again = KnowledgeBase(spark, str(tmp_path / "again"))
    again._publish(kb.store.read("documents").drop("keywords", "category"))
    rounded = lambda d: d.select(*[F.round(c, 12).alias(c) if k == "double" else c for c, k in sorted(d.dtypes)])
    for t in ("chunks", "vectors", "postings", "term_stats", "corpus_stats"):
        a, b = (sorted(map(repr, rounded(k.store.read(t)).collect())) for k in (kb, again))
        assert a == b, t


def test_gates_keep_the_old_build(spark, tmp_path):
    def docs(n, word):
        d = spark.createDataFrame([(f"d{i}.md", f"d{i}.md", ".md", f"{word} text number {i}") for i in range(n)], "source string, filename string, format string, content string")
        return d.withColumn("mtime", F.timestamp_seconds(F.lit(0))).withColumn("size", F.octet_length("content").cast("long")).withColumn("doc_id", F.sha2("source", 256))

    kb = KnowledgeBase(spark, str(tmp_path / "kb"), sanity=("alpha", "number"))
    kb.reindex_documents(docs(10, "alpha"), full=True)
    first = kb.store.current
    for bad in (docs(8, "alpha"), docs(10, "beta")):
        with pytest.raises(ValueError, match="gates"):
            kb.reindex_documents(bad, full=True)
        assert kb.store.current == first
    kb.reindex_documents(docs(9, "alpha"), full=True)
    assert kb.store.current != first and kb.get_index_stats()["total_documents"] == 9
    empty = mt.gates(spark.range(0), 0, spark.createDataFrame([], "query_id long, hits long"), 4).first()
    assert empty["passed"]


def test_search_method(spark, tmp_path):
    rows = [(f"d{i}.md", f"Report {i} on MDR-{'AD002' if i < 4 else 'XY9'}: patch CVE-2021-{4034 if i < 2 else 5000 + i} soon") for i in range(6)]
    d = spark.createDataFrame([(n, n, ".md", x) for n, x in rows], "source string, filename string, format string, content string")
    d = d.withColumn("mtime", F.timestamp_seconds(F.lit(0))).withColumn("size", F.octet_length("content").cast("long")).withColumn("doc_id", F.sha2("source", 256))
    q = spark.createDataFrame([(1, "patch soon"), (2, "CVE-2021-4034"), (3, "Report CVE-2021-5004 absent")], "query_id long, query_text string")
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), Config(lexical_enabled=True, min_hits=2))
    kb.reindex_documents(d)
    methods = lambda df: {k: sorted({r["search_method"] == "fts5" for r in g}) for k, g in ((i, [r for r in df.collect() if r["query_id"] == i]) for i in (1, 2, 3)) if g}
    hits = kb.search_knowledge(q, 5)
    assert methods(hits) == {1: [False], 2: [True], 3: [False]}
    served = {r["filename"]: r for r in hits.where("query_id = 2").collect()}
    assert set(served) == {"d0.md", "d1.md"} and all(r["score_source"] == "fts5_bm25" and r["routed_by"] == "fts5_router" and r["semantic_rank"] is None for r in served.values())
    assert methods(kb.search_knowledge(q, 5, search_method="hybrid")) == {1: [False], 2: [False], 3: [False]}
    assert methods(kb.search_knowledge(q, 5, search_method="fts5")) == {1: [True], 2: [True]}  # the third has no hits
    kb.config.min_hits = 3
    assert methods(kb.search_knowledge(q, 5)) == {1: [False], 2: [False], 3: [False]}
    kb.config.lexical_enabled = False
    assert methods(kb.search_knowledge(q, 5)) == {1: [False], 2: [False], 3: [False]}
    for bad in ("fts5", "other"):
        with pytest.raises(ValueError):
            kb.search_knowledge(q, 5, search_method=bad)


def test_knowledge_base(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "net").mkdir(parents=True)
    (folder / "net" / "a.md").write_text("# Firewalls\n" + "A firewall filters packets between networks. " * 5)
    (folder / "b.txt").write_text("Bread is baked from flour and water. " * 5)
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), Config(category_mappings={"net/": "network"}, query_expansions={"fw": ["firewall"]}, keyword_routes={"network": ["packets"]}))
    assert kb.reindex_documents(str(folder))["added"] == 2
    q = spark.createDataFrame([(1, "fw packets"), (2, "flour")], "query_id long, query_text string")
    hits = kb.search_knowledge(q, 1).collect()
    assert {r["query_id"]: r["filename"] for r in hits} == {1: "a.md", 2: "b.txt"}
    assert {r["query_id"]: r["routed_by"] for r in hits} == {1: "network", 2: None}
    (folder / "b.txt").unlink()
    (folder / "c.txt").write_text("Cheese is made of milk. " * 5)
    assert {k: v for k, v in kb.reindex_documents(str(folder)).items() if k != "generation"} == {"total": 3, "added": 1, "updated": 0, "skipped": 1, "deleted": 1}
    assert {r["category"]: r["n"] for r in kb.list_categories().collect()} == {"network": 1, "general": 1, None: 2}
    kb.add_document("notes/x.md", "# Rust\nRust is a language without a collector.", "code")
    doc = kb.get_document("notes/x.md")
    assert doc["category"] == "code"
    kb.update_document("notes/x.md", "# Go\nGo is a language with a collector.")
    assert "Go" in kb.get_document("notes/x.md")["content"] and kb.get_index_stats()["total_documents"] == 3
    assert kb.search_similar("notes/x.md", 2).count() == 2
    kb.add_from_url(spark.createDataFrame([(1, "http://e.test/p", "<title>Page</title><p><|im_start|>text</p>")], "page_id long, url string, html string"))
    assert "<​|im_start|>" in kb.get_document("web/page.md")["content"]
    kb.remove_document("notes/x.md")
    assert kb.get_document("notes/x.md") is None and kb.list_documents("web").count() == 1
    cases = spark.createDataFrame([(1, "cheese milk", "c.txt"), (2, "firewall", "missing.md")], "query_id long, query_text string, expected string")
    assert kb.evaluate_retrieval(cases).first().asDict() == {"n": 2, "mrr": 0.5, "recall": 0.5}
    with pytest.raises(ValueError):
        kb.evaluate_retrieval(cases.where("false"))
    with pytest.raises(ValueError):
        kb.search_knowledge(q, category="none")
