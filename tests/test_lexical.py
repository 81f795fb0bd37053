import json
import math
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.config import PRESETS, Config
from quarry.functions import canonical as cn
from quarry.operators import lexical as lx
from quarry.operators import maintenance as mt
from quarry.operators import retrieval as rt
from quarry.plans.api import KnowledgeBase, contracted, hashed_embedder
from quarry.plans.generations import Freshness, Generations
from quarry.plans.requests import Limiter, Metrics, QueryCache, instrument, rate_limited

ROWS = [("a", "one two one two one", "f.md", "g"), ("b", "two one. x-1 X-1", "f.md", "g"), ("c", "", "", ""), ("d", None, None, None), ("e", "one two", "f.md", "h"), ("f", "two one two", "f.md", "g")]
ASKED = [(1, "one"), (2, "one,two two"), (3, "x-1 x-1"), (4, "nothing one"), (5, ""), (6, None), (7, "one,two,one"), (8, "two f.md")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, "chunk_id string, content string, filename string, category string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id long, query_text string")


def scores(df):
    return {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in df.collect()}


def test_index_finds_what_the_texts_hold(asked, chunks, monkeypatch):
    want = scores(rt.phrase_hits(asked, chunks))
    assert want and scores(lx.phrase_hits(asked, lx.entries(chunks))) == want
    monkeypatch.setattr(lx, "few_words", lambda *_: False)
    monkeypatch.setattr(lx, "FLUSH", 1)
    assert scores(lx.phrase_hits(asked, lx.entries(chunks))) == want


def test_empty_tables(asked, chunks):
    assert not scores(lx.phrase_hits(asked, lx.entries(chunks.limit(0)))) and not scores(lx.phrase_hits(asked.limit(0), lx.entries(chunks)))


def test_edits_of_the_index(asked, chunks):
    half = chunks.where("chunk_id < 'c'")
    index = lx.inserted(lx.entries(half), chunks.where("chunk_id >= 'c'"))
    other = chunks.where("chunk_id in ('a', 'c')").withColumn("content", F.lit("one,two x-1"))
    index = lx.deleted(lx.replaced(index, other), chunks.where("chunk_id = 'b'"))
    now = chunks.where("chunk_id not in ('a', 'b', 'c')").unionByName(other)
    assert scores(lx.phrase_hits(asked, index)) == scores(rt.phrase_hits(asked, now))


def test_canonical_forms(spark):
    assert cn.canonical({"b": [1, "1", True, None, 1.5], "a": {"z": "ü", "y": {}}}) == '{"a":{"y":{},"z":"\\u00fc"},"b":[1,"1",true,null,1.5]}'
    assert cn.canonical("text") == "{}"
    for bad, error in (({"a": math.nan}, ValueError), ({"a": {1, 2}}, TypeError)):
        with pytest.raises(error):
            cn.canonical(bad)
    d = spark.createDataFrame([(1, [1.5, -0.0]), (2, None), (3, [])], "k int, v array<float>")
    assert {r[0]: bytes(r[1]) for r in d.select("k", cn.packed("v")).collect()} == {1: struct.pack(">2d", 1.5, -0.0), 2: b"", 3: b""}
    with pytest.raises(PySparkException):
        spark.createDataFrame([(1, [math.nan])], "k int, v array<float>").select(cn.packed("v")).collect()
    one = {"search": {"max_results": 5}, "keyword_routes": {"a": ["x", "y"]}, "auth": {"token": "s"}, "models": {"embedding": {"artifact_path": "/home/me/model"}}}
    same = json.loads(json.dumps(one)) | {"auth": {}, "models": {"embedding": {"artifact_path": "/srv/model"}}}
    assert cn.retrieval_digest(one) == cn.retrieval_digest(same) != cn.retrieval_digest(one | {"keyword_routes": {"a": ["y", "x"]}})
    assert cn.retrieval_digest(one) != cn.retrieval_digest({k: v for k, v in one.items() if k != "search"})


def test_admission(spark):
    rows = [("a/b.md", "file"), ("a", "directory"), (".git/x.md", "file"), ("a/.gitignore", "file"), ("a/B.MD", "file"), ("t.bin", "file"), ("old/c.md", "file")]
    d = spark.createDataFrame(rows, "path string, kind string")
    assert sorted(r["path"] for r in mt.admitted(d, (".md",), ("old",)).collect()) == ["a/B.MD", "a/b.md"]
    with pytest.raises(PySparkException):
        mt.admitted(d.union(spark.createDataFrame([("l.md", "link")], d.schema)), (".md",)).collect()


def test_report_without_files(spark):
    empty = spark.createDataFrame([], "source string, change string, error string, category string, chunks long, repeats long, old_chunks long")
    got = mt.indexing_report(empty).first().asDict()
    assert got.pop("categories") == {} and set(got.values()) == {0}


def test_cache_limiter_and_counters():
    now = [0.0]
    cache = QueryCache(2, 10.0, lambda: now[0])
    assert cache.stats()["hit_rate"] == "0%"
    cache.put("a", [1])
    cache.get("a").append(2)
    assert cache.get("a") == [1]
    cache.put("b", [2])
    cache.get("a")
    cache.put("c", [3])
    assert cache.get("b") is None and cache.get("a") == [1]
    now[0] = 10.0
    assert cache.get("a") is None and cache.stats()["hit_rate"] == "66.7%"
    limiter, metrics = Limiter(1, 1, clock=lambda: now[0]), Metrics()

    @instrument(metrics, "tool", lambda: now[0])
    @rate_limited(limiter)
    def tool(x):
        now[0] += x
        return 1 / x

    assert tool(1) == 1 and tool(2) == 0.5 and tool(1)["status"] == "error"
    now[0] += 61
    with pytest.raises(ZeroDivisionError):
        tool(0)
    assert metrics.counters["calls", "tool"] == 4 and metrics.counters["errors", "tool"] == 1
    assert metrics.buckets["seconds", "tool", "1.0"] == 3 and metrics.buckets["seconds", "tool", "+Inf"] == 4


def test_contract_of_embedders(spark):
    d = spark.createDataFrame([("some text",)], "text string")
    assert len(contracted(hashed_embedder(8), 8)(d, "text").first()["embedding"]) == 8
    for bad in (lambda df, text, out: df.withColumn(out, F.array(F.lit(1.0))), lambda df, text, out: df.withColumn(out, F.array(F.lit(float("nan")), F.lit(1.0))), lambda df, text, out: df.withColumn(out, F.lit(None).cast("array<double>"))):
        with pytest.raises(PySparkException):
            contracted(bad, 2)(d, "text").collect()


def test_presets_are_configurations():
    assert {p: Config.of(v).category_mappings.get("notes") for p, v in PRESETS.items()} == {"general": None, "cybersecurity": None, "developer": "notes", "research": "notes", "multilingual": None}


def test_cut_off_builds_go_on(spark, tmp_path):
    store, one, two = Generations(spark, f"file://{tmp_path}"), spark.range(3), spark.range(5)

    def lost(read):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.build({"a": one, "b": lost}, {"size": 1}, origin="x")
    (cut,) = store.unsealed()
    assert store.build({"a": two, "b": two}, {"size": 2}, origin="x") != cut  # other settings
    assert store.build({"a": two, "b": two}, {"size": 1}, origin="y") != cut  # other documents
    assert store.build({"a": two, "b": two}, {"size": 1}, origin="x") == cut
    assert store.read("a", cut).count() == 3 and store.read("b", cut).count() == 5


def test_proof_admission_and_recovery(spark, tmp_path):
    store = Generations(spark, f"file://{tmp_path}")
    fresh = Freshness(store)
    assert store.metadata() == {} and fresh.drift() == ["no generation is active"]
    first = store.build({"a": spark.range(3)}, name="first")
    store.activate(first, None)
    second = store.build({"a": spark.range(4)}, name="second")
    store.activate(second, first)
    assert fresh.drift() == [] and fresh.accepted and store.recovered() is None
    proofs = []
    store.verify, verify = lambda n: proofs.append(n) or verify(n), store.verify
    assert fresh.drift() == [] and not proofs  # nothing has changed
    (tmp_path / "builds" / "second" / "more").mkdir()
    with pytest.raises(ValueError, match="more"):
        store.admitted()
    (tmp_path / "builds" / "second" / "more").rmdir()
    assert store.admitted()["a"].count() == 4
    spark.range(9).write.mode("overwrite").parquet(f"file://{tmp_path}/builds/second/a")
    assert fresh.drift() and proofs and fresh.accepted is None
    assert store.recovered() == "first" and store.current == "first" and store.read("a").count() == 3
    spark.range(9).write.mode("overwrite").parquet(f"file://{tmp_path}/builds/first/a")
    with pytest.raises(ValueError, match="anew"):
        store.recovered()


def test_answers_are_kept_until_a_build(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", Config(lexical_enabled=True, min_hits=1))
    assert kb.get_index_stats()["total_documents"] == 0
    kb.add_document("x/a.txt", "notes on ABC-12 and more")
    kb.add_document("x/b.txt", "notes on ABC-13 and more")
    assert kb.store.read("places").select("chunk_id").distinct().count() == 2
    hits = kb.ask("ABC-12")
    assert [h["path"] for h in hits] == ["/x/a.txt"] and hits[0]["search_method"] == "fts5"
    assert kb.ask("ABC-12") == hits and kb.get_index_stats()["cache"]["hit_rate"] == "50.0%"
    assert [r["source"] for r in kb.list_documents(offset=1, most=1).collect()] == ["/x/b.txt"]
    kb.remove_document("x/a.txt")
    assert kb.ask("ABC-12", search_method="fts5") == []
