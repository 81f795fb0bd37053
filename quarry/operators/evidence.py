"""Evidence units of fetched documents, their relevance gate and budget, selection and the composed answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

SHORTEST, LONGEST, MOST_UNITS, BUDGET, SELECTED = 30, 500, 12, 16000, 5


def prose(block: Column) -> Column:
    """The natural lines of a block in one line: no headings, tables, rules or fences; list markers taken off."""
    lines = F.transform(F.split(block, r"\r\n|[\n\r\u000b\u000c\u0085  ]"), tx.strip)
    keep = lambda x: (x != "") & ~x.rlike(r"^(?:#|\||```|~~~)") & ~x.rlike(r"^[|\s:+=_-]+$")
    bare = F.transform(F.filter(lines, keep), lambda x: tx.strip(F.regexp_replace(x, r"^(?:[-*•>–—]|\d+[.)])\s+", "")))
    return F.regexp_replace(F.concat_ws(" ", F.filter(bare, lambda x: x != "")), r"(?U)\s+", " ")


def without_frontmatter(text: Column) -> Column:
    end = F.instr(F.substring(text, 4, 1 << 30), "\n---") + 2  # 0-based place of the closing rule
    return F.when(F.startswith(text, F.lit("---")) & (end > 2) & (end < 2000), F.substring(text, end + 5, F.lit(1 << 30))).otherwise(text)


def units(results: DataFrame, stop: Sequence[str] = tuple(tx.ASKING), stop_prefixes: Sequence[str] = tuple(tx.ASKING_PREFIXES)) -> DataFrame:
    """query_id, uid, rank, position, distinct, weighted, unit_text of the units that pass gate and budget.
    results: query_id, query_text, rank, content."""
    text = F.regexp_replace(without_frontmatter(F.col("content")), r"(?ms)^[ \t]*(```|~~~).*?^[ \t]*\1[^\n]*$", "")
    blocks = results.select("query_id", tx.stems("query_text", stop, stop_prefixes).alias("stems"), "rank", F.posexplode(F.split(text, r"\n\s*\n")).alias("position", "block"))
    u = blocks.withColumn("t", prose(F.col("block"))).where(F.length("t") >= SHORTEST)
    cut = F.concat(F.regexp_replace(F.substring("t", 1, LONGEST), r"\s+$", ""), F.lit("…"))
    u = u.withColumn("unit_text", F.when(F.length("t") > LONGEST, cut).otherwise(F.col("t")))
    again = F.row_number().over(Window.partitionBy("query_id", F.lower("unit_text")).orderBy("rank", "position"))
    u = u.withColumn("again", again).where("again = 1")
    low = F.lower("unit_text")
    times = lambda s: F.floor((F.length(low) - F.length(F.replace(low, s, F.lit("")))) / F.length(s)).cast("int")
    u = u.withColumn("distinct", F.size(F.filter("stems", lambda s: F.contains(low, s)))).withColumn("weighted", F.aggregate("stems", F.lit(0), lambda a, s: a + F.length(s) * times(s)))
    u = u.withColumn("best", F.max("distinct").over(Window.partitionBy("query_id"))).where(2 * F.col("distinct") > F.col("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("distinct"), F.desc("weighted"), "rank", "position")
    u = u.withColumn("n", F.row_number().over(order)).withColumn("total", F.sum(F.length("unit_text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    u = u.where((F.col("n") <= MOST_UNITS) & (F.col("total") <= BUDGET))
    uid = F.concat(F.lit("E"), F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "position")).cast("string"))
    return u.select("query_id", uid.alias("uid"), "rank", "position", "distinct", "weighted", "unit_text")


def fallback(u: DataFrame, most: int = SELECTED) -> DataFrame:
    """The strongest units of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("distinct"), F.desc("weighted"), "rank", "position")
    return u.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def selected(u: DataFrame, replies: DataFrame, most: int = SELECTED) -> DataFrame:
    """The units that a reply names, in its order, if it is exactly {"evidence_ids": [1 to 5 known ids, none twice]}; else the fallback. replies: query_id, raw."""
    body = F.regexp_replace(tx.strip("raw"), r"(?s)^```[\w-]*\s*\n(.*?)\n?\s*```$", "$1")
    r = replies.select("query_id", body.alias("body")).withColumn("v", F.from_json("body", "map<string,array<string>>", {"mode": "PERMISSIVE"}))
    r = r.withColumn("ids", F.when((F.size("v") == 1) & F.array_contains(F.map_keys("v"), "evidence_ids") & F.col("body").rlike(r'^\s*\{\s*"evidence_ids"\s*:\s*\[\s*"[^"]*"(\s*,\s*"[^"]*")*\s*\]\s*\}\s*$'), F.element_at("v", "evidence_ids")))
    known = u.groupBy("query_id").agg(F.collect_set("uid").alias("known"))
    r = r.join(known, "query_id").withColumn("ok", F.col("ids").isNotNull() & F.size("ids").between(1, most) & (F.size(F.array_distinct("ids")) == F.size("ids")) & (F.size(F.array_except("ids", "known")) == 0))
    named = u.join(r.where("ok").select("query_id", F.posexplode("ids").alias("place", "uid")), ["query_id", "uid"])
    rest = fallback(u.join(r.where("ok").select("query_id"), "query_id", "left_anti"), most)
    rest = rest.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "position")) - 1)
    return named.unionByName(rest.select(named.columns))


def composed(chosen: DataFrame, heading: str = "Ответ по источникам:") -> DataFrame:
    """query_id, answer: one line a unit with its source's rank."""
    line = F.concat(F.lit("— "), "unit_text", F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return chosen.groupBy("query_id").agg(F.concat_ws("\n", F.array(F.lit(heading)), lines).alias("answer"))
