"""Operator 5, mixing sources to target weights: Poisson replication. DataFrame functions only.

A source's mean repetition rate is total rows * target weight / its rows. A uniform number hashed from seed and document
inverts the Poisson distribution of that mean, the document is exploded by the count, and the copies are
shuffled globally by a hash of document and copy. Rates above CHUNK are sums of equal smaller ones, each with a number of its own, as
Poisson variables add up. Counts depend on the document and its source's rate alone, so lost tasks give the same rows again.

The rates are one row a source. Up to MOST sources they are broadcast, which is checked; beyond, the join salts the documents.

Cases: a null source is a source of its own; a null doc_id is replaced by its text's hash; repeated rows draw the same
count; sources without a target weight (where weights are given) have rate 0; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import private, table

CHUNK, MOST, SALTS = 500.0, 4096, 64
SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) with 52 bits from an MD5 of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row a source: mix_source, lam (mean of one draw), draws, cdf. Without weights every source weighs the same."""
    n = docs.groupBy(F.coalesce("source", F.lit("\0")).alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        w = n.withColumn("w", F.lit(1.0))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        w = n.withColumn("w", F.coalesce(F.try_element_at(given, F.col("mix_source")), F.lit(0.0)))
    total = w.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    w = w.join(F.broadcast(total), F.lit(True))  # one row
    lam = F.col("all_n") * (F.col("w") / F.col("all_w")) / F.col("n")
    w = w.select("mix_source", lam.alias("rate")).withColumn("draws", F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int"))
    w = w.withColumn("lam", F.col("rate") / F.col("draws"))
    first = F.exp(-F.col("lam"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("lam") + 12 * F.sqrt("lam") + 30).cast("int"))
    cdf = F.aggregate(
        steps,
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda s, k: F.struct((s["p"] * F.col("lam") / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * F.col("lam") / k)).alias("c")),
        lambda s: s["c"],
    )
    return w.select("mix_source", "rate", "draws", cdf.alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED) -> DataFrame:
    """The documents' columns, copy (from 0) and shuffle_key; rows lie in the order of shuffle_key within partitions dealt by it. Where the
    documents have columns of these names, those are kept and the new ones end in an underscore."""
    r = rates(docs, weights)
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("mix_key"), F.coalesce("source", F.lit("\0")).alias("mix_source"))
    if r.select("mix_source").limit(MOST + 1).count() <= MOST:
        d = d.join(F.broadcast(r), "mix_source")
    else:
        d = d.withColumn("salt", F.pmod(F.hash("mix_key"), F.lit(SALTS)))
        d = d.join(r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["mix_source", "salt"])
    draw = lambda i: F.size(F.filter("cdf", lambda c: c < uniform(F.lit(seed), F.col("mix_key"), i.cast("string"))))
    count = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda s, i: s + draw(i))
    d = d.select("row", "mix_key", count.alias("copies")).where("copies > 0").select("row", "mix_key", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("nth"))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "mix_key", F.col("nth").cast("string"))), 1, 15), 16, 10).cast("long")
    d = d.select("row", "nth", order.alias("place")).repartition("place").sortWithinPartitions("place")
    return d.select("row.*", F.col("nth").alias(private("copy", docs)), F.col("place").alias(private("shuffle_key", docs)))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
with recursive n as (select coalesce(source, chr(0)) as s, count(*) as n from documents group by 1),
t as (select sum(n) as all_n, count(*) as all_w from n),
l as (select s, all_n * (1.0::double / all_w) / n as lam from n, t),
c(s, lam, k, p, c) as (
  select s, lam, 0, exp(-lam), exp(-lam) from l
  union all
  select s, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) from c where k < ceil(lam + 12 * sqrt(lam) + 30)),
cdf as (select s, list(c order by k) as cdf from c group by s),
d as (
  select d.*, cdf, (('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id::varchar, '1')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents d join cdf on cdf.s = coalesce(d.source, chr(0))),
k as (select * exclude (cdf, u), len(list_filter(cdf, lambda x: x < u)) as copies from d)
select doc_id, text, lang, source, n_chars, copy::int as copy,
  ('0x' || substr(md5(concat_ws(':', '{SEED}', 'order', doc_id::varchar, copy::varchar)), 1, 15))::bigint as shuffle_key
from (select * exclude (copies), unnest(range(copies)) as copy from k where copies > 0)
"""
