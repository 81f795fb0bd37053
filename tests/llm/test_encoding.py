"""Operator 13 against plain Python, in small batches and slices, and on hard input."""

import datetime as dt
import random
import zlib
from collections import defaultdict

import pytest

from oracle import connection, same

from quarry.llm import encoding
from quarry.llm.encoding import op13_target_encoding, target_rates

TABLES = {
    "sale_lines": "sale_id long, item_id long, vendor_id long, flag string, sales_id int",
    "sales": "sale_id long, client_id long, sold_at timestamp_ntz, flag string",
    "items": "item_id long, kind string, name string",
    "vendors": "vendor_id long, nation_id int, name string",
    "clients": "client_id long, segment string, name string",
}


def shop(seed: int, n: int) -> dict[str, list[tuple]]:
    rng = random.Random(seed)
    some = lambda *x: rng.choice([*x, None])
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(40) * 250_000_000) for _ in range(12)] + [dt.datetime(1970, 1, 1), dt.datetime(2030, 1, 1)]
    sales = [(i, rng.choice([1, 1, 1, 2, None, -1]), rng.choice([*times, None]), "returned") for i in range(-2, n // 4)]
    lines = [(rng.choice([7, *range(-2, n // 4 + 2), None]), some(1, 1, 2, 3, -1, 99), some(1, 2, 3), some("returned", "kept"), 1) for _ in range(n)]
    return {
        "sale_lines": lines + lines[:5],
        "sales": sales,
        "items": [(1, "a", "x"), (2, None, "x"), (3, "b", "x"), (-1, "a", "x"), (None, "z", "x")],
        "vendors": [(1, 7, "x"), (2, 7, "x"), (3, None, "x")],
        "clients": [(1, "s", "x"), (2, "t", "x")],
    }


def brute(t: dict[str, list[tuple]]) -> list[tuple]:
    sales = {s[0]: s for s in t["sales"] if s[2] is not None}
    kind, nation, segment = ({r[0]: r[1] for r in t[x]} for x in ("items", "vendors", "clients"))
    lines = []
    for sale, item, vendor, flag, _ in t["sale_lines"]:
        if sale in sales:
            client, at = sales[sale][1:3]
            item, client = -1 if item is None else item, -1 if client is None else client
            fold = zlib.crc32(str(sale).encode()) % 5
            lines.append((sale, item, vendor, client, at, fold, flag == "returned", kind.get(item), nation.get(vendor), segment.get(client)))
    rate = lambda h, p: p if not h else (1_000_000 * sum(x[6] for x in h) + 50 * p) // (len(h) + 50)
    out, own = [], defaultdict(list)
    for x in lines:
        own[x[:3]].append(x)
    for key, mine in own.items():
        x = mine[0]
        past = [y for y in lines if y[5] != x[5] and y[4] < x[4]]
        g, row = rate(past, 500_000), [*key, len(mine), sum(y[6] for y in mine)]
        for i, group in ((1, 7), (2, 8), (3, 9)):
            h = [y for y in past if y[i] == x[i]]
            row += [len(h), rate(h, rate([y for y in past if y[group] == x[group]], g))]
        out.append(tuple(row))
    return sorted(out, key=repr)


def frames(spark, t):
    return [spark.createDataFrame(t[x], TABLES[x]) for x in TABLES]


@pytest.mark.parametrize("seed,batch,rows", [(1, 10_000, 1 << 15), (2, 3, 4), (3, 1, 1)])
def test_rates_equal_brute_force(spark, seed, batch, rows):
    t = shop(seed, 160)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = target_rates(*frames(spark, t), rows=rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=repr) == brute(t)


def test_empty_tables(spark):
    t = shop(4, 40)
    assert target_rates(*frames(spark, t | {"sales": []})).count() == 0
    assert target_rates(*frames(spark, t | {"sale_lines": []})).count() == 0
    none = {"items": [], "vendors": [], "clients": []}
    assert sorted(map(tuple, target_rates(*frames(spark, t | none)).collect()), key=repr) == brute(t | none)


def test_times_with_a_zone_and_repeated_ids(spark):
    t = shop(5, 60)
    f = frames(spark, t | {"items": [*t["items"], (1, "c", "x")]})
    f[1] = f[1].withColumn("sold_at", f[1].sold_at.cast("timestamp"))
    assert sorted(map(tuple, target_rates(*f, rows=8).collect()), key=repr) == brute(t)


def test_the_query_has_a_row_for_each_group_of_lines(spark):
    got = op13_target_encoding(spark, "/root/testdata/sf0.001")
    assert got.count() == got.select("sale_id", "item_id", "vendor_id").distinct().count() > 0


def test_values_are_dealt_out_without_lists(spark, monkeypatch):
    """Each id column is a plain projection, and no list of three structs is made for every line."""
    plans = {}
    monkeypatch.setattr(encoding, "written", lambda df, name, *a, f=encoding.written: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and f(df, name, *a))
    t = shop(5, 60)
    assert sorted(map(tuple, target_rates(*frames(spark, t), rows=8).collect()), key=repr) == brute(t)
    assert "Generate" not in plans["values"]


def test_the_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = connection(sf)
    for name in ("sale_lines", "sales", "items", "vendors", "clients"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    same(op13_target_encoding(spark, sf), con, encoding.OP13_SQL)
