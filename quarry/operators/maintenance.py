"""Incremental maintenance: change classes, orphans, manifests, parity, digests, gates, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .digests import ordered_digest, row_hash  # noqa: F401
from .retrieval import small

# Names that never belong to a corpus.
JUNK_FOLDERS = [".git"]
JUNK_FILES = [".DS_Store", "Thumbs.db", ".gitignore", ".gitattributes"]


def classified(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Source, change: new, unchanged (mtime and size equal), updated, or deleted. Both sides: source, mtime, size."""
    old = indexed.select("source", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.lit(True).alias("was"))
    both = files.select("source", "mtime", "size", F.lit(True).alias("now")).join(old, "source", "full")
    same = F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("size").eqNullSafe(F.col("old_size"))
    return both.select("source", F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "new").when(same, "unchanged").otherwise("updated").alias("change"))


def orphans(indexed: DataFrame, files: DataFrame) -> DataFrame:
    """J9"""
    return indexed.join(files.select("source"), "source", "left_anti")


def remaining(files: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Files that a resumed run still has to do."""
    return files.join(checkpoint.select("doc_id"), "doc_id", "left_anti")


def indexing_stats(changes: DataFrame) -> DataFrame:
    """A8"""
    n = lambda c: F.count_if(F.col("change") == c)
    return changes.agg(F.count("*").alias("total"), n("new").alias("added"), n("updated").alias("updated"), n("unchanged").alias("skipped"), n("deleted").alias("deleted"))


def indexing_report(files: DataFrame) -> DataFrame:
    """One row of ten counters. files: source, change, error, category, chunks, repeats (chunks left out as copies), old_chunks (chunks it had). What
    a file with an error would have added does not count. The categories (few, as configured) are a map."""
    change = lambda c: F.col("change") == c
    done = F.col("change").isin("new", "updated") & F.col("error").isNull()
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    counters = {
        "total_files": F.count_if(~change("deleted")), "indexed": F.count_if(done & change("new")), "updated": F.count_if(done & change("updated")), "skipped": F.count_if(change("unchanged")),
        "deleted": F.count_if(change("deleted")), "errors": F.count_if(F.col("error").isNotNull()), "chunks_added": total("chunks", done),
        "chunks_removed": total("old_chunks", done & change("updated") | change("deleted")), "dedup_skipped": total("repeats", done),
    }
    by = files.groupBy("category").agg(*[c.alias(n) for n, c in counters.items()], F.count_if(done).alias("n"))
    named = F.collect_list(F.when((F.col("n") > 0) & F.col("category").isNotNull(), F.struct("category", "n")))
    return by.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counters], F.map_from_entries(F.array_sort(named)).alias("categories"))


def progress(samples: DataFrame, per: str, span: int = 30, most: int = 100) -> DataFrame:
    """A7, ST8: after each document of a run: processed, estimate (of the run's chunks, from the mean so far), throughput (chunks a second over the
    last span seconds or most samples), eta (whole seconds). samples: per, n (1, 2, ...), t (seconds), chunks, total (documents of the run)."""
    w = Window.partitionBy(per)
    s = samples.withColumn("processed", F.sum("chunks").over(w.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("estimate", F.greatest("processed", F.floor(F.col("processed") / F.col("n") * F.col("total"))))
    recent, last = w.orderBy("t").rangeBetween(-span, 0), w.orderBy("n").rowsBetween(-(most - 1), 0)
    seconds = F.col("t") - F.greatest(F.min("t").over(recent), F.first("t").over(last))
    chunks = F.col("processed") - F.greatest(F.min("processed").over(recent), F.first("processed").over(last))
    s = s.withColumn("throughput", F.when(seconds > 0, chunks / seconds).otherwise(0.0))
    eta = F.when((F.col("throughput") > 0) & (F.col("estimate") > F.col("processed")), F.floor((F.col("estimate") - F.col("processed")) / F.col("throughput"))).otherwise(0)
    return s.select(per, "n", "processed", "estimate", "throughput", eta.alias("eta"))


def merged(old: DataFrame, fresh: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """K1 to K5: the rows of old without those of the keys in gone or fresh, and those of fresh. Rows that stay are taken as they are."""
    out = gone.select(key).union(fresh.select(key)).distinct()
    return old.join(out, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def manifest(rows: DataFrame, path: Column | str, content: Column | str) -> DataFrame:
    """path, sha256"""
    return rows.select((F.col(path) if isinstance(path, str) else path).alias("path"), F.sha2(F.col(content) if isinstance(content, str) else content, 256).alias("sha256"))


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Path, difference: missing, extra or differing."""
    a = actual.select("path", F.col("sha256").alias("actual"))
    both = expected.join(a, "path", "full")
    return both.where(~F.col("sha256").eqNullSafe(F.col("actual"))).select("path", F.when(F.col("actual").isNull(), "missing").when(F.col("sha256").isNull(), "extra").otherwise("differing").alias("difference"))


def parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: rows on both sides, and how many of each the other lacks."""
    only = lambda x, y, name: x.exceptAll(y.select(x.columns)).agg(F.count("*").alias(name))
    return a.agg(F.count("*").alias("left_rows")).crossJoin(b.agg(F.count("*").alias("right_rows"))).crossJoin(only(a, b, "left_only")).crossJoin(only(b, a, "right_only"))  # one row each


def set_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row: n, digest_sum: the same for any order of rows, computed without bringing them together."""
    part = F.conv(F.substring(row_hash(*columns), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("digest_sum"))


def tree_digest(files: DataFrame, by: str) -> DataFrame:
    """By, files, digest_sum over each file's path, sha256 and size, without bringing the files together. files: by, path, sha256, size."""
    line = F.concat("path", F.lit("\0"), "sha256", F.lit("\0"), F.col("size").cast("string"), F.lit("\n"))
    part = F.conv(F.substring(F.sha2(line, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum(part).cast("string").alias("digest_sum"))


def admitted(listing: DataFrame, suffixes: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """the files of a listing (path, below the root; kind: file, directory, link or other) that belong to a corpus: none below .git, none of the
    junk names, of the suffixes if any are given, none that a pattern excludes. Anything but files and directories is an error."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    safe = F.when(F.col("kind").isin("file", "directory"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("neither file nor directory: "), "path")))
    out = listing.where(~F.exists(parts, lambda p: p.isin(*JUNK_FOLDERS))).withColumn("kind", safe).where(F.col("kind") == "file").where(~name.isin(*JUNK_FILES))
    if suffixes:
        out = out.where(F.regexp_extract(F.lower(name), r"^.+(\.[^.]+)$", 1).isin(*[s.lower() for s in suffixes]))
    return out.where(~tx.excluded("path", patterns)) if patterns else out


def page(rows: DataFrame, key: str, after=None, most: int = 400) -> DataFrame:
    """The next rows in the order of their unique key, after the last one seen. The filter reaches the scan; no row is counted past."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(most)


def gates(staged: DataFrame, baseline: int, sane_hits: DataFrame, needed: int = 4) -> DataFrame:
    """K9: one row: rows, hits, enough_rows (nine tenths of the baseline), enough_hits, passed. sane_hits: query_id, hits. Against an empty
    baseline every build passes, an empty one too."""
    n = staged.agg(F.count("*").alias("n_rows"))
    h = sane_hits.agg(F.count_if(F.col("hits") > 0).alias("n_hits"))
    g = n.crossJoin(h).withColumn("enough_rows", F.col("n_rows") >= 0.9 * baseline).withColumn("enough_hits", F.col("n_hits") >= needed)  # one row each
    return g.withColumn("passed", F.lit(baseline == 0) | F.col("enough_rows") & F.col("enough_hits"))


def category_counts(docs: DataFrame) -> DataFrame:
    """A5: category, n; the total as category null."""
    return docs.rollup("category").agg(F.count("*").alias("n"))


def keys_consistent(rows: DataFrame, key: str) -> DataFrame:
    """One row: n, n_keys, unique."""
    return rows.agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_keys")).withColumn("unique", F.col("n") == F.col("n_keys"))


def dimension_mismatch(vectors: DataFrame, dim: int) -> DataFrame:
    """one row: n, wrong."""
    return vectors.agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != dim).alias("wrong"))


def namespaces(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Namespace, n, digest_sum of the files in it; a name ends at a path boundary. names: namespace (few rows)."""
    hit = paths.join(small(names), (F.col("path") == F.col("namespace")) | F.startswith("path", F.concat("namespace", F.lit("/"))))
    part = F.conv(F.substring(F.sha2(F.concat_ws(":", "path", "sha256"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return hit.groupBy("namespace").agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("digest_sum"))


def regressions(before: DataFrame, after: DataFrame, threshold: float = 0.10, floor: float = 0.001) -> DataFrame:
    """Name, delta, regressed. Medians below the floor (seconds) never regress. Both: name, median."""
    b = before.select("name", F.col("median").alias("was")).join(after.select("name", F.col("median").alias("now")), "name")
    delta = (F.col("now") - F.col("was")) / F.col("was")
    return b.select("name", F.round(delta, 6).alias("delta"), ((delta > threshold) & (F.greatest("was", "now") >= floor)).alias("regressed"))


def marker_credible(markers: DataFrame, live: DataFrame) -> DataFrame:
    """markers of schema 2 that are complete, with equal 64-digit digests and the live row count. live: one row, n."""
    ok = (F.col("schema") == 2) & F.col("complete") & F.col("source_digest").rlike("^[0-9a-f]{64}$") & (F.col("source_digest") == F.col("table_digest"))
    return markers.crossJoin(live).where(ok & (F.col("row_count") == F.col("n"))).drop("n")  # live is one row


def slugged(pages: DataFrame) -> DataFrame:
    return pages.withColumn("slug", tx.slug("title"))
