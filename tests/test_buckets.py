"""Updates write, read back and verify the buckets that they touch."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.plans.api import KnowledgeBase
from quarry.plans.generations import BUCKET, Generations, Part

TABLES = ("documents", "chunks", "vectors", "postings")


def documents(spark, n):
    d = spark.range(n).select(F.concat(F.lit("/kb/d"), "id", F.lit(".md")).alias("source"), F.concat(F.lit("d"), "id", F.lit(".md")).alias("filename"), F.lit(".md").alias("format"), F.concat(F.lit("# Title "), "id", F.lit("\n\nsome words of number "), "id", F.lit(" and the rest "), (F.col("id") % 7).cast("string")).alias("content"))
    d = d.withColumn("mtime", F.timestamp_seconds(F.lit(0))).withColumn("size", F.octet_length("content").cast("long"))
    return d.withColumn("doc_id", F.substring(F.sha2("source", 256), 1, 16))


def written(store, name, table):
    at = Path(store.folder.removeprefix("file://")) / "builds" / name / table
    return {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in at.iterdir() if p.is_dir()}


def content(kb, table):
    df = kb.store.read(table)
    df = df.select(*[F.round(c, 9).alias(c) if t == "double" else F.transform(c, lambda x: F.round(x, 6)).alias(c) if t.startswith("array<float") or t.startswith("array<double") else c for c, t in sorted(df.dtypes) if c not in ("mtime", "doc_id", "chunk_id")])
    return sorted(map(repr, df.collect()))


def test_an_update_writes_its_bucket_and_equals_a_rebuild(spark, tmp_path):
    config = Config(buckets=16)
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", config)
    kb._publish(documents(spark, 120))
    first = kb.store.current
    assert len(written(kb.store, first, "documents")) == 16
    name = kb.add_document("kb/new.md", "# New\n\nwords that are new, and some words of old")["generation"]
    for t in TABLES:
        now, before = written(kb.store, name, t), written(kb.store, first, t)
        assert len(now) == 1 and sum(now.values()) < 0.3 * sum(before.values()), t
        assert {x["at"] for x in kb.store.receipt(name)["tables"][t]["buckets"].values()} == {first, name}
    assert kb.store.read("documents").count() == 121 and not kb.store.verify(name)
    kb.update_document("kb/d5.md", "# Other\n\nquite another text")
    kb.remove_document("kb/d7.md")
    again = KnowledgeBase(spark, f"file://{tmp_path}/again", config)
    again._publish(kb.store.read("documents").drop("keywords", "category"))
    for t in (*TABLES, "corpus_stats", "term_stats"):
        assert content(kb, t) == content(again, t), t
    assert kb.get_document("kb/d7.md") is None and kb.store.rollback() and kb.get_document("kb/d7.md") is not None


def test_a_lost_shared_bucket_is_noticed(spark, tmp_path):
    store = Generations(spark, f"file://{tmp_path}")
    rows = spark.range(40).withColumn(BUCKET, (F.col("id") % 4).cast("int"))
    first = store.build({"a": Part(rows, 4)}, name="first")
    store.activate(first)
    second = store.build({"a": Part(rows.where("id % 4 = 1 and id < 9"), 4, [1], "first")}, name="second")
    store.activate(second, "first", written=True)
    assert store.read("a").count() == 32 and store.read("a", buckets=[1]).count() == 2 and store.verify("second") == []
    third = store.build({"a": Part(rows.where("false"), 4, [2], "second")}, name="third")
    assert store.read("a", third).count() == 22
    empty = store.build({"a": Part(rows.where("false"), 4)}, name="empty")
    assert store.read("a", empty).count() == 0 and store.verify(empty) == []
    before = store.fingerprint()
    for f in Path(tmp_path, "builds", "first", "a", "bucket=3").glob("*.parquet"):
        f.unlink()
    assert store.verify("second", written=True) == [] and store.verify("second") == ["a: bucket 3"] and store.fingerprint() != before


def test_two_builders_never_share_a_folder(spark, tmp_path):
    store, other = (Generations(spark, f"file://{tmp_path}", claim=8) for _ in range(2))
    at_work, go_on = threading.Event(), threading.Event()

    def slow(read):
        at_work.set()
        go_on.wait(60)
        return spark.range(3)

    made = []
    builder = threading.Thread(target=lambda: made.append(store.build({"a": slow}, origin="x")))
    builder.start()
    assert at_work.wait(60)
    mine = other.build({"a": spark.range(3)}, origin="x")
    go_on.set()
    builder.join()
    assert made[0] != mine

    def lost(read):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.build({"a": spark.range(2), "b": lost}, origin="y")
    (cut,) = store.unsealed()
    assert other.build({"a": spark.range(9), "b": spark.range(1)}, origin="y") == cut and other.read("a", cut).count() == 2
