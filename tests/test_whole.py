"""Queries that take whole texts, on data whose ends matter."""

import math
import re

import pytest
from oracle import connection, same

from quarry.operators import retrieval as rt
from quarry.queries import catalog

DOCS = ["one two three four five six", "one two three four five", "one two three", "six one two, three x four five five", "one two three four six", "seven eight", "one nine/ten six", "one ten nine six"]
ASKED = ["one two three four five", "one two three six", "one two three absent", "nine/ten one", "five one five four"]


def lexical(x):
    return re.findall(r"[\w.-]+", x.lower())


def brute(docs, asked):
    """(query_id, doc_id) and score, phrase by phrase."""
    count = lambda p, t: sum(t[i : i + len(p)] == p for i in range(len(t)))
    toks = [lexical(f"{x} doc{i}.md general") for i, x in enumerate(docs)]
    mean, out = sum(map(len, toks)) / len(toks), {}
    for q, x in enumerate(asked):
        phrases = [lexical(p) for p in x.split()]
        for i, t in enumerate(toks):
            if all(count(p, t) for p in phrases):
                dfs = [sum(count(p, u) > 0 for u in toks) for p in phrases]
                out[q, i] = sum(max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6) * count(p, t) * 2.2 / (count(p, t) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for p, df in zip(phrases, dfs, strict=True))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, x, "s", "en", len(x)) for i, x in enumerate(DOCS)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(ASKED)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_fts_search_asks_for_every_word(spark, folder):
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in catalog.fts_search(spark, folder).collect()}
    want = brute(DOCS, ASKED)
    assert set(got) == set(want) == {(0, 0), (0, 1), (0, 3), (1, 0), (1, 3), (1, 4), (3, 6), (4, 0), (4, 1), (4, 3)}
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_phrase_hits_by_joins_are_the_same(spark, folder):
    q, d = catalog.log(spark, folder), catalog.corpus(spark, folder).withColumnRenamed("doc_id", "chunk_id")
    a, b = ({(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in rt.phrase_hits(q, d, n).collect()} for n in (4_000_000, 0))
    assert a == b and len(a) == 10


def test_auto_dispatch_counts_hits_of_whole_queries(spark, folder):
    assert {r["query_id"]: (r["hits"], r["route"]) for r in catalog.auto_dispatch(spark, folder).collect()} == {0: (3, "hybrid"), 1: (3, "lexical"), 2: (0, "hybrid"), 3: (1, "hybrid"), 4: (3, "lexical")}


def test_identifiers_and_path_words_behind_the_prefix_count(spark, tmp_path):
    texts = {2: "x " * 60 + "see CVE-2024-12345", 3: "x " * 60 + "nothing", 6: "x " * 60 + "ABC-12", 7: "y " * 30 + "doc7 md"}
    spark.createDataFrame([(i, x, "s", "en") for i, x in texts.items()], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["route"] for r in catalog.route_lexical(spark, str(tmp_path)).collect()} == {2: "lexical", 3: "semantic", 6: "lexical", 7: "semantic"}
    assert {r["doc_id"]: r["boost"] for r in catalog.path_boost(spark, str(tmp_path)).collect()} == {2: 0.0012, 3: 0.0012, 6: 0.0012, 7: 0.0024}


@pytest.mark.parametrize("name", ["auto_dispatch", "fts_search"])
def test_sql_knows_phrases(spark, folder, name):
    con = connection("/root/testdata/sf0.001")
    for table in ("documents", "benchmark"):
        con.execute(f"create or replace view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    same(catalog.QUERIES[name](spark, folder), con, catalog.SQL[name])


def test_lexical_tokens_fold_letters_as_sqlite_does(spark):
    import sqlite3
    import unicodedata

    from pyspark.sql import functions as F

    from quarry.functions import text as tx

    letters = [c for c in map(chr, range(0x80, 0x2000)) if unicodedata.category(c) == "Ll" and len(unicodedata.normalize("NFD", c)) > 1]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='unicode61 remove_diacritics 2')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.executemany("insert into t(rowid, x) values (?, ?)", [(ord(c), f"q{c}q") for c in letters])
    want = dict(db.execute("select doc, term from v"))
    got = dict(spark.createDataFrame([(ord(c), f"q{c}q") for c in letters], "i int, t string").select("i", F.concat_ws(" ", tx.lexical_tokens("t"))).collect())
    assert len(want) > 400 and got == want
    assert got[ord("č")] == "qcq" and got[ord("ế")] == "qeq" and got[ord("й")] == "qйq"
