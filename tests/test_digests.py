import pytest
from pyspark.sql import functions as F

from quarry.operators import digests as dg


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") * 7 % 13).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("w"))


def rows(t):
    return sorted(map(tuple, t.collect()))


def test_trees_do_not_depend_on_partitioning_and_add_up(table):
    whole = rows(dg.tree(table, "k", "v", "w", depth=2))
    assert whole == rows(dg.tree(table.repartition(7).orderBy(F.desc("v")), "k", "v", "w", depth=2))
    a, b = (dg.tree(table.where(c), "k", "v", "w", depth=2) for c in ("v < 4", "v >= 4"))
    assert whole == rows(dg.merged(a, b))
    assert sum(r[2] for r in whole if r[0] == 2) == 3000 == next(r[2] for r in whole if r[0] == 0)


def test_root_is_the_same_at_any_depth_and_tells_null_from_empty(spark, table):
    assert dg.root(dg.tree(table, "k", "v", depth=0)) == dg.root(dg.tree(table, "k", "v", depth=2)) == dg.ordered_digest(table, "k", "v")
    one = lambda v: dg.ordered_digest(spark.createDataFrame([("a", v)], "k string, v string"), "k", "v")
    assert len({one(None), one(""), one("-;"), one("0:;")}) == 4


def test_one_changed_row_is_found_in_its_range_only(table, monkeypatch):
    other = table.withColumn("v", F.when(F.col("k") == "k77", 99).otherwise(F.col("v")))
    ta, tb = (dg.tree(x, "k", "v", depth=2).cache() for x in (table, other))
    ranges = dg.differing_ranges(ta, tb, 2)
    assert [r["prefix"] for r in ranges.collect()] == [table.where("k = 'k77'").select(dg.place("k", 2)).first()[0]]
    assert table.withColumn("prefix", dg.place("k", 2)).join(ranges, "prefix").count() < 5
    assert rows(dg.differing_rows(table, other, "k", "v", depth=2)) == [("k77", "differing")]
    assert rows(dg.differing_rows(table, table.repartition(3), "k", "v")) == []


@pytest.mark.parametrize("depth", [0, 1, None])
def test_missing_extra_repeated_null_and_empty(spark, depth):
    kind = "k long, prefix string"
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (4, "d"), (None, "n")], kind)
    b = spark.createDataFrame([(1, "a"), (3, ""), (4, "d"), (5, "e"), (None, "m")], kind)
    want = {(2, "missing"), (3, "differing"), (4, "differing"), (5, "extra"), (None, "differing")}
    assert set(map(tuple, dg.differing_rows(a, b, "k", "prefix", depth=depth).collect())) == want
    none = a.limit(0)
    assert {r["difference"] for r in dg.differing_rows(none, a, "k", "prefix", depth=depth).collect()} == {"extra"}
    assert dg.differing_rows(none, none, "k", "prefix", depth=depth).count() == 0
    assert rows(dg.tree(none, "k", "prefix", depth=1).select("level", "n")) == [(0, 0)]


def test_depth_grows_with_the_rows():
    assert [dg.depth_for(n) for n in (0, 1024, 1025, 1024 * 256, 1024 * 256 + 1)] == [0, 0, 1, 1, 2]
