import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import patterns as many
from quarry.functions import text as tx
from quarry.operators import retrieval as rt


@pytest.fixture(scope="module")
def words():
    r = random.Random(3)
    return list(dict.fromkeys("".join(r.choice("abcdeä") for _ in range(r.randint(2, 6))) for _ in range(14000)))[:10000]


@pytest.fixture(scope="module")
def texts(spark, words):
    r = random.Random(5)
    some = [" ".join(r.choices(words, k=30)) + "!" for _ in range(60)] + ["", "ab", "abab" * 5000, None]
    return spark.createDataFrame(list(enumerate(some)), "id int, text string")


def test_found_is_what_contains_finds(texts, words):
    for r in texts.withColumn("held", many.held(F.col("text"), [*words, "", words[0]])).collect():
        assert r["held"] == (None if r["text"] is None else [w for w in [*words, ""] if w in r["text"]])


def test_word_boundaries_are_those_of_the_jvm(spark):
    texts = ["C++ and c", "a.b", "x_a", "für fürs", "é áb", "a-b", "", "٣a", "½a", "Ⓐa", "a b", "the‍re the"]
    pats = ["a", "b", "c++", "für", "c", "the", "+", ".", "áb"]
    df = spark.createDataFrame([(t.lower(),) for t in texts], "t string")
    want = F.array(*[F.rlike("t", F.lit(rf"(?U)\b\Q{p}\E\b")) for p in pats])
    for r in df.select("t", want.alias("want"), many.found(F.col("t"), pats, [True] * len(pats)).alias("got")).collect():
        assert [i for i, w in enumerate(r["want"]) if w] == r["got"], r["t"]


def test_categories_and_keywords_of_many_patterns(texts, words, monkeypatch):
    few, names = words[:60], ["x", "y", "z"]
    cats = {w: names[i % 3] for i, w in enumerate(few)}
    plain = texts.select("id", tx.category("text", cats).alias("c"), tx.keywords("text", {"r": few[:40]}).alias("k")).collect()
    monkeypatch.setattr(many, "FEW", 0)
    assert plain == texts.select("id", tx.category("text", cats).alias("c"), tx.keywords("text", {"r": few[:40]}).alias("k")).collect()


def test_routes_of_many_keywords(spark, texts, words, monkeypatch):
    routes = spark.createDataFrame([(f"c{i % 7}", w.upper() if i % 2 else w, i % 7) for i, w in enumerate(words[:300])] + [("c1", "a b", 1), ("c2", None, 2)], "category string, keyword string, cat_ord int")
    q = texts.select(F.col("id").alias("query_id"), F.col("text").alias("query_text")).where("id < 20 or text is null")
    got = sorted(map(tuple, rt.keyword_route(q, routes).collect()))
    monkeypatch.setattr(rt, "ROUTES", 5)
    assert got == sorted(map(tuple, rt.keyword_route(q, routes).collect()))
    assert rt.keyword_route(q, routes.limit(0)).where("routed_by is not null").count() == 0


def test_time_hardly_grows_with_the_number_of_patterns(words):
    text = "zq " * 200_000

    def seconds(n):
        find = many.Finder([w + "q" for w in words[:n]])
        start = time.perf_counter()
        find(text)
        return time.perf_counter() - start

    assert seconds(10_000) < 20 * seconds(10) + 0.5
