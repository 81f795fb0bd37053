"""Operator 13, time-ordered target encoding: recipient folds.

History is added up to one row for each value of a key, point of time and fold. Every such row is replicated to each
other fold as its recipient, and the running sums are taken for each recipient fold, value and time slice; what a row sees is
then a direct sum of other folds' earlier rows, and nothing of its own fold is ever added to be taken off again.

Hot values are cut into slices of time, as many as their rows call for (`slices`); what came before a slice enters it as
one row for each recipient. Rows are shuffled by value and slice, and replicated within the task, where a stream of sorted
batches carries the sums on; no group is held. A value's group (an item's kind, say) enters in the same way.
Rates go from the whole history to groups to values by joins, whose skewed sides Spark splits; nothing is collected but
two quantiles of time, and nothing is broadcast by this code.

Cases: rows without a sale or a time are no history and get no result. A null id is a value of its own (the query makes -1 of
null items and clients); ids that are unknown or have no group share one group; an id that repeats in its table takes its least group.
A sale_id that repeats among the sales makes a line for each, and rows for each of their times and clients. Repeated lines count. Empty
tables give no rows. Lines of one point of time never see each other. Further columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import spent, table, written

#: Rows of one value beyond which it is cut into slices of about so many.
ROWS = 1 << 15
FOLDS, UNIT, WEIGHT, PRIOR = 5, 1_000_000, 50, 500_000
#: A value: its id, or its group's number, and which column it is of; NULL is added to the column for a null id.
KEY, NULL = ["key", "col"], 64
PLACE = [*KEY, "slice"]
#: A row's place, its own counts and its history's, and its value's group.
SEEN = "key long, col byte, at {}, fold int, n long, s long, seen long, hits long, owner long"


def fold_of(sale_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(sale_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def seconds(at: Column, kind: str) -> Column:
    """Whole seconds, for slices; of times without a zone as they read, whatever the session's zone."""
    if kind != "timestamp_ntz":
        return F.unix_seconds(at)
    return F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def slices(rows: DataFrame, owners: DataFrame | None, span: tuple[int, int], most: int) -> DataFrame:
    """Rows (PLACE, at, fold, n, s, owner) of history rows (KEY, at, fold, n, s), and at the head of every slice (at null) what it starts with:
    for each recipient fold the sums of the slices before, and the value's owner (fold -1)."""
    counts = rows.groupBy(KEY).count().where(F.col("count") > most)
    hot = written(counts.select(*KEY, F.ceil(F.col("count") / most).cast("int").alias("k")), "hot")
    lo, hi = span
    share = (seconds(F.col("at"), dict(rows.dtypes)["at"]) - lo) / float(hi - lo + 1)
    at = F.least(F.greatest(F.floor(share * F.col("k")).cast("int"), F.lit(0)), F.col("k") - 1)
    dealt = rows.join(hot, KEY, "left").withColumn("slice", F.coalesce(at, F.lit(0)))
    sums = [F.sum("n").alias("n"), F.sum("s").alias("s")]
    each = dealt.where("k is not null").groupBy(*PLACE, "fold").agg(*sums)
    other = F.when(F.col("to") != F.col("fold"), 1).otherwise(0)
    each = each.withColumn("to", F.explode(F.array(*map(F.lit, range(FOLDS))))).select(*PLACE, F.col("to").alias("fold"), (F.col("n") * other).alias("n"), (F.col("s") * other).alias("s")).groupBy(*PLACE, "fold").agg(*sums)
    before = Window.partitionBy(*KEY, "fold").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    started = each.select(*PLACE, "fold", F.sum("n").over(before).alias("n"), F.sum("s").over(before).alias("s")).where("n > 0")
    never, zero = F.lit(None).cast(rows.schema["at"].dataType).alias("at"), F.lit(0).cast("long")
    out = dealt.select(*PLACE, "at", "fold", "n", "s", zero.alias("owner"))
    out = out.unionByName(started.select(*PLACE, never, "fold", "n", "s", zero.alias("owner")))
    if owners is not None:
        whole = owners.join(hot, KEY, "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k"), F.lit(1)) - 1)))
        out = out.unionByName(whole.select(*PLACE, never, F.lit(-1).alias("fold"), zero.alias("n"), zero.alias("s"), "owner"))
    return out


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _running(batches):
    """Sorted rows of slices() with what each has seen: every row counts for all other folds, a head's for its own."""
    place, at_before, owner_before = None, None, 0
    total = np.zeros((2, FOLDS), dtype=np.int64)  # of the slice so far, for each recipient; and of it before its last point of time
    earlier = total.copy()
    for b in batches:
        size = b.num_rows
        if not size:
            continue
        key, col, slice_, fold, owners = (b.column(i).to_numpy() for i in (0, 1, 2, 4, 7))
        head = b.column(3).is_null().to_numpy(zero_copy_only=False)
        at = b.column(3).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        counts = np.stack([b.column(i).to_numpy() for i in (5, 6)])
        first = _changes([key, col, slice_])
        goes_on = (int(key[0]), int(col[0]), int(slice_[0])) == place
        first[0] = not goes_on
        moment = _changes([at]) | first
        moment[0] = not (goes_on and int(at[0]) == at_before)
        index = np.arange(size)
        slice_start = np.maximum.accumulate(np.where(first, index, -1))
        moment_start = np.maximum.accumulate(np.where(moment, index, -1))
        seen = np.zeros((2, size), dtype=np.int64)
        last = np.zeros_like(total), np.zeros_like(total)
        for to in range(FOLDS):
            replica = counts * np.where(head, fold == to, fold != to)
            done = np.cumsum(replica, axis=1)
            ahead = done - replica  # sums of the batch's rows before this one
            base = np.where(slice_start >= 0, -ahead[:, slice_start], total[:, to][:, None])
            upto = np.where(moment_start >= 0, ahead[:, moment_start] + base, earlier[:, to][:, None])
            mine = fold == to
            seen[:, mine] = upto[:, mine]
            last[0][:, to], last[1][:, to] = done[:, -1] + base[:, -1], upto[:, -1]
        marks = head & (fold < 0)
        mark = np.maximum.accumulate(np.where(marks, index, -1))
        owner = np.where((mark >= 0) & (mark >= slice_start), owners[mark], np.where(slice_start < 0, owner_before, 0))
        total, earlier = last
        place = (int(key[-1]), int(col[-1]), int(slice_[-1]))
        at_before, owner_before = int(at[-1]), int(owner[-1])
        columns = [*(b.column(i) for i in (0, 1, 3, 4, 5, 6)), pa.array(seen[0]), pa.array(seen[1]), pa.array(owner)]
        out = pa.RecordBatch.from_arrays(columns, names=["key", "col", "at", "fold", "n", "s", "seen", "hits", "owner"])
        yield out.filter(pa.array(~head))


def running(rows: DataFrame) -> DataFrame:
    """SEEN of rows of slices()."""
    sorted_ = rows.select(*PLACE, "at", "fold", "n", "s", "owner").repartition(*PLACE).sortWithinPartitions(*PLACE, "at")
    return sorted_.mapInArrow(_running, SEEN.format(dict(rows.dtypes)["at"]))


def rate(seen: Column, hits: Column, prior: Column) -> Column:
    """In longs; both are 0 or more, so the division cuts as floor does."""
    smoothed = F.call_function("div", UNIT * hits + WEIGHT * prior, seen + WEIGHT)
    return F.when(seen < 1, prior).otherwise(smoothed)


def _value(code: int, ids: Column) -> list[Column]:
    return [F.coalesce(ids.cast("long"), F.lit(0).cast("long")).alias("key"), F.when(ids.isNull(), code + NULL).otherwise(code).cast("byte").alias("col")]


def _numbered(owners: DataFrame) -> DataFrame:
    """Names of groups as numbers: hashes of a seed under which no two names of one column share one, or have 0 (no group)."""
    names = owners.select("col", "owner").distinct()
    for seed in range(64):
        number = F.xxhash64(F.lit(seed), "owner")
        if not names.select("col", number.alias("owner")).groupBy("col", "owner").count().where("count > 1 or owner = 0").limit(1).count():
            return owners.withColumn("owner", number)
    raise ValueError("no seed tells the groups apart")


def encoded(base: DataFrame, groups: dict[str, DataFrame], rows: int = ROWS) -> DataFrame:
    """base with <name>_n and <name>_rate (longs) for each name of groups.

    base: at, fold (0 to FOLDS - 1), n, s, and an id column for each name. groups[name]: the ids and their groups, in this order.
    """
    codes = {name: i + 1 for i, name in enumerate(groups)}
    own, many = {name: df.columns for name, df in groups.items()}, len(groups)
    at = seconds(F.col("at"), dict(base.dtypes)["at"])
    lo, hi = (base.agg(F.percentile_approx(at, [0.001, 0.999], 1000).alias("q")).first().q or [0, 0])[:2]
    sums = [F.sum("n").alias("n"), F.sum("s").alias("s")]
    values = functools.reduce(DataFrame.union, [base.select(*_value(codes[n], F.col(own[n][0])), "at", "fold", "n", "s") for n in groups])
    values = written(values.groupBy(*KEY, "at", "fold").agg(*sums), "values", "snappy")
    owners = None
    for name, df in groups.items():
        ids, group = own[name]
        one = df.where(F.col(ids).isNotNull()).groupBy(F.col(ids).cast("long").alias("key")).agg(F.min(F.col(group).cast("string")).alias("owner"))
        one = one.where("owner is not null").select("key", F.lit(codes[name]).cast("byte").alias("col"), "owner")
        owners = one if owners is None else owners.unionByName(one)
    low = written(running(slices(values, _numbered(owners), (lo, hi), rows)), "low", "snappy")
    spent(values)

    code = (F.col("col") % NULL).cast("byte")
    lifted = low.select(F.col("owner").alias("key"), (code + many).cast("byte").alias("col"), "at", "fold", "n", "s")
    every = low.where(code == many).select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("byte").alias("col"), "at", "fold", "n", "s")
    above = written(lifted.unionByName(every).groupBy(*KEY, "at", "fold").agg(*sums), "above", "snappy")
    high = written(running(slices(above, None, (lo, hi), rows)).select(*KEY, "at", "fold", "seen", "hits"), "high", "snappy")
    spent(above)

    # The time comes first among the keys of joins, as rows are sorted by their first key fastest. Column and fold are one number there.
    both = lambda col: (col * FOLDS + F.col("fold")).cast("int")
    top = high.where("col = 0").select("at", "fold", rate(F.col("seen"), F.col("hits"), F.lit(PRIOR)).alias("prior"))
    middle = high.where("col > 0").join(top, ["at", "fold"]).select("at", F.col("key").alias("owner"), both(F.col("col") - many).alias("code"), rate(F.col("seen"), F.col("hits"), F.col("prior")).alias("prior"))
    rates = low.select("at", "key", both(F.col("col")).alias("place"), "owner", both(code).alias("code"), "seen", "hits").join(middle, ["at", "owner", "code"]).select("at", "key", "place", "seen", rate(F.col("seen"), F.col("hits"), F.col("prior")).alias("rate"))
    rates = written(rates, "rates", "snappy")
    spent(low, high)

    out = base
    for name, i in codes.items():
        mine = rates.where(F.call_function("div", F.col("place"), F.lit(FOLDS)) % NULL == i).select(F.col("at").alias("t_"), F.col("key").alias("k_"), F.col("place").alias("p_"), F.col("seen").alias(f"{name}_n"), F.col("rate").alias(f"{name}_rate"))
        key, column = _value(i, F.col(own[name][0]))
        out = out.join(mine, (F.col("at") == F.col("t_")) & (key == F.col("k_")) & (both(column) == F.col("p_"))).drop("k_", "p_", "t_")
    return out


def line_counts(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """sale_id, item_id, vendor_id, client_id, at, fold, and n lines with s returned ones among them."""
    none = F.lit(-1).cast("long")
    own = lines.where("sale_id is not null").groupBy("sale_id", F.coalesce(F.col("item_id"), none).alias("item_id"), "vendor_id")
    own = own.agg(F.count("*").alias("n"), F.count(F.when(F.col("flag") == "returned", 1)).alias("s"))
    sold = sales.where("sale_id is not null and sold_at is not null").select("sale_id", F.coalesce(F.col("client_id"), none).alias("client_id"), F.col("sold_at").alias("at"))
    joined = own.join(sold, "sale_id").withColumn("fold", fold_of(F.col("sale_id")))
    return joined.select("sale_id", "item_id", "vendor_id", "client_id", "at", "fold", "n", "s")


def target_rates(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, rows: int = ROWS) -> DataFrame:
    """Of every sale_id, item_id and vendor_id the lines, and history's size and return rate for item, vendor and client."""
    base = written(line_counts(lines, sales), "lines", "snappy")
    groups = {"item": items.select("item_id", "kind"), "vendor": vendors.select("vendor_id", "nation_id"), "client": clients.select("client_id", "segment")}
    out = encoded(base, groups, rows)
    return out.select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate")


def op13_target_encoding(spark, sf_dir: str) -> DataFrame:
    return target_rates(*(table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))


def _over(key: str, grain: str) -> str:
    """SQL of the counts of other folds' earlier lines that share the key: all minus the own fold's."""
    frame = "ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
    parts = {"": f"PARTITION BY {key} {frame}", ", fold": f"PARTITION BY {key}, fold {frame}"}
    one = [f"coalesce(sum({c}) OVER ({parts['']}), 0) - coalesce(sum({c}) OVER ({parts[', fold']}), 0) AS {grain}_{c}" for c in ("n", "s")]
    return ", ".join(one)


def _rate(grain: str, prior: str) -> str:
    return f"CAST(CASE WHEN {grain}_n < 1 THEN {prior} ELSE ({UNIT} * {grain}_s + {WEIGHT} * {prior}) // ({grain}_n + {WEIGHT}) END AS BIGINT)"


OP13_SQL = f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
bytes AS (SELECT sale_id, 4294967295 AS c, CAST(sale_id AS VARCHAR) AS rest FROM (SELECT DISTINCT sale_id FROM sales WHERE sale_id IS NOT NULL)
  UNION ALL SELECT sale_id, xor(c >> 8, t[(xor(c, ascii(rest)) & 255) + 1]), rest[2:] FROM bytes, crc WHERE rest <> ''),
folds AS (SELECT sale_id, xor(c, 4294967295) % {FOLDS} AS fold FROM bytes WHERE rest = ''),
base AS (
  SELECT l.sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, coalesce(s.client_id, -1) AS client_id, s.sold_at, f.fold,
    count(*) AS n, count(*) FILTER (l.flag = 'returned') AS s
  FROM sale_lines l JOIN sales s ON l.sale_id = s.sale_id JOIN folds f ON f.sale_id = s.sale_id WHERE s.sold_at IS NOT NULL GROUP BY ALL),
named AS (
  SELECT b.*, i.kind, v.nation_id, c.segment FROM base b LEFT JOIN items i ON i.item_id = b.item_id
    LEFT JOIN vendors v ON v.vendor_id = b.vendor_id LEFT JOIN clients c ON c.client_id = b.client_id),
seen AS (
  SELECT *, {_over("1", "all")}, {_over("kind", "kind")}, {_over("nation_id", "nation")}, {_over("segment", "segment")},
    {_over("item_id", "item")}, {_over("vendor_id", "vendor")}, {_over("client_id", "client")} FROM named),
top AS (SELECT *, {_rate("all", str(PRIOR))} AS all_rate FROM seen),
groups AS (SELECT *, {_rate("kind", "all_rate")} AS kind_rate, {_rate("nation", "all_rate")} AS nation_rate, {_rate("segment", "all_rate")} AS segment_rate FROM top)
SELECT sale_id, item_id, vendor_id, CAST(n AS BIGINT) AS n_lines, CAST(s AS BIGINT) AS n_returned,
  CAST(item_n AS BIGINT) AS item_n, {_rate("item", "kind_rate")} AS item_rate,
  CAST(vendor_n AS BIGINT) AS vendor_n, {_rate("vendor", "nation_rate")} AS vendor_rate,
  CAST(client_n AS BIGINT) AS client_n, {_rate("client", "segment_rate")} AS client_rate
FROM groups
"""
