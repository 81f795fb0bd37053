"""Hash trees over ranges of hashed keys: digests that merge, and a comparison that descends only where two tables differ.

A row lies in the range that the sha256 of its key's text begins with: level 0 is everything, level 1 has 256 ranges, each level below 256 times as many.
A range's digest is that of its number of rows and of four sums over its rows' hashes. Sums don't depend on the order or the partitioning of rows, are combined
before the shuffle (so a key that a third of all rows has costs no more than others), and add up: the tree of two tables together is the sum of their trees.

Nulls: a null key lies in the range of all zeros, null columns are told from empty ones. Rows that repeat count as often as they occur. Empty tables have
one range, level 0 with n = 0. Columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .retrieval import small

#: Hex digits to a level, and hex digits of a row's hash in each of its sums.
STEP, LANE, LANES = 2, 12, 4
SUMS = [f"s{i}" for i in range(LANES)]
#: Rows that a range of the last level holds at most on average.
ROWS = 1024


def depth_for(n: int) -> int:
    """The least depth at which ranges hold ROWS rows on average; for comparisons, that of the larger table."""
    depth = 0
    while n > ROWS * 256**depth:
        depth += 1
    return depth


def place(key: str, depth: int) -> Column:
    """The range of the last level that a row lies in."""
    return F.coalesce(F.substring(F.sha2(_text(key), 256), 1, STEP * depth), F.lit("0" * STEP * depth))


def row_hash(*columns: str) -> Column:
    """A hash of a row's length-prefixed fields; null has no length."""
    field = lambda c: F.when(F.col(c).isNull(), F.lit("-;")).otherwise(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"), F.lit(";")))
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _text(column: str) -> Column:
    return F.col(f"`{column}`").cast("string")


def _named(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """key and the fields of the hash under names of our own, so that none clashes."""
    return df.select(_text(key).alias("key"), *[_text(c).alias(f"f{i}") for i, c in enumerate(columns)])


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    parts = [F.sum(F.conv(F.substring("h", 1 + LANE * i, LANE), 16, 10).cast("decimal(38,0)")).alias(s) for i, s in enumerate(SUMS)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *parts)


def _hashed(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    rows = _named(df, key, columns)
    return rows.select("key", row_hash(*rows.columns).alias("h"))


def _levels(leaves: DataFrame, depth: int) -> DataFrame:
    """All levels from the sums of the last one. level 0 is there for empty tables, too."""
    up = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "prefix", "n", *SUMS)
    up = up.select("level", F.substring(F.col("prefix"), F.lit(1), F.col("level") * STEP).alias("prefix"), "n", *SUMS)
    zero = leaves.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("n"), *[F.lit(0).cast("decimal(38,0)").alias(s) for s in SUMS])
    return _added(up.unionByName(zero))


def _added(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("level", "prefix").agg(*[F.sum(c).alias(c) for c in ("n", *SUMS)])
    return out.select("level", "prefix", "n", *SUMS, F.sha2(F.concat_ws(":", "n", *SUMS), 256).alias("digest"))


def tree(df: DataFrame, key: str, *columns: str, depth: int) -> DataFrame:
    """level, prefix, n, s0 to s3, digest: every range that has rows, and the root. Two shuffles: of the ranges of the last level, summed
    before, and of all levels."""
    rows = _hashed(df, key, columns)
    return _levels(_summed(rows.withColumn("prefix", place("key", depth)), "prefix"), depth)


def merged(*trees: DataFrame) -> DataFrame:
    """The tree of all rows together, from trees of the same depth."""
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return _added(out.drop("digest"))


def root(t: DataFrame) -> str:
    """The digest of everything."""
    return t.where("level = 0").first()["digest"]


def ordered_digest(df: DataFrame, key: str, *columns: str) -> str:
    """The digest of a table whose keys are unique: the root of its tree, at any depth. A key's place is part of its row's hash,
    so neither order nor partitioning matter. A key that repeats is an error."""
    again = df.groupBy(_text(key).alias("key")).count().where("count > 1").first()
    if again:
        raise ValueError(f"{key} repeats: {again['key']}")
    return root(tree(df, key, *columns, depth=0))


def differing_ranges(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """prefix: the ranges of the last level that differ. Each level reads only the ranges below those that differed above it; ends at the first level
    without any. a, b: trees of this depth, written tables for preference (by level, so that other levels are not read)."""
    same = a.where("level = 0").select("digest").exceptAll(b.where("level = 0").select("digest")).isEmpty()
    spark = a.sparkSession
    open_ = spark.range(0 if same else 1).select(F.lit("").alias("prefix"))
    for level in range(1, depth + 1):
        if same:
            break
        above = small(open_.withColumnRenamed("prefix", "up"))
        below = lambda t: t.where(F.col("level") == level).withColumn("up", F.substring("prefix", 1, STEP * (level - 1))).join(above, "up", "left_semi").select("prefix", "digest")  # noqa: E731, B023
        sides = below(a).unionByName(below(b)).groupBy("prefix").agg(F.count("*").alias("n"), F.min("digest").alias("least"), F.max("digest").alias("most"))
        open_ = written(sides.where("n <> 2 or least <> most").select("prefix"), f"open{level}")
        same = open_.isEmpty()
    return open_


def differing_rows(a: DataFrame, b: DataFrame, key: str, *columns: str, depth: int | None = None) -> DataFrame:
    """Key, difference: missing (only in a), extra (only in b) or differing (in other columns, or in how often the key's rows occur).
    Both trees are built in one pass each; then only rows of differing ranges are read by key, and no row of other ranges is shuffled."""
    depth = depth_for(max(a.count(), b.count())) if depth is None else depth
    ta, tb = (written(tree(x, key, *columns, depth=depth), "tree", by=["level"]) for x in (a, b))
    ranges = small(differing_ranges(ta, tb, depth))
    near = lambda x, side: _summed(_hashed(x, key, columns).withColumn("prefix", place("key", depth)).join(ranges, "prefix", "left_semi"), "key").withColumn("side", F.lit(side))
    mark = F.concat_ws(":", "n", *SUMS)
    both = near(a, 0).unionByName(near(b, 1)).groupBy("key").agg(F.count("*").alias("sides"), F.min("side").alias("side"), F.min(mark).alias("least"), F.max(mark).alias("most"))
    kind = F.when(F.col("sides") == 2, "differing").when(F.col("side") == 0, "missing").otherwise("extra")
    return both.where("sides = 1 or least <> most").select(F.col("key").cast(a.schema[key].dataType).alias(key), kind.alias("difference"))
