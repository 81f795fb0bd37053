"""JSON snapshots as a corpus: verified manifests, records as markdown, and the rebuild check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.maintenance import manifest_diff


def verified(files: DataFrame, manifest: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Files whose sha256 is the manifest's; others are left out, and so are excluded names. files: name, content (binary); manifest: name, sha256."""
    return files.where(~F.col("name").isin(*excluded) if excluded else F.lit(True)).withColumn("sha256", F.sha2("content", 256)).join(manifest, ["name", "sha256"], "left_semi")


def mismatched(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """What a run must not go on with: name, difference."""
    actual = files.select(F.col("name").alias("path"), F.sha2("content", 256).alias("sha256"))
    return manifest_diff(manifest.withColumnRenamed("name", "path"), actual).withColumnRenamed("path", "name")


def scalar(value: Column) -> Column:
    """A value for the frontmatter: one line, quotes escaped."""
    return F.concat(F.lit('"'), F.replace(F.regexp_replace(value, r"\s+", " "), F.lit('"'), F.lit('\\"')), F.lit('"'))


def rendered(records: DataFrame, fields: list[str], body: str, always: list[str] = (), shortest: int = 80) -> DataFrame:
    """record_id, markdown: fields as frontmatter (nulls left out), then the body. Records without a body of over shortest characters
    are left out unless two of the always fields are given."""
    text = F.coalesce(F.col(body), F.lit(""))
    given = sum((F.col(a).isNotNull().cast("int") for a in always), F.lit(0))
    head = F.concat_ws("\n", *[F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), scalar(F.col(f).cast("string")))) for f in fields])
    kept = records.where((F.length(tx.strip(text)) > shortest) | (given >= 2))
    return kept.select("record_id", F.concat(F.lit("---\n"), head, F.lit("\n---\n"), text).alias("markdown"))


def counts(records: DataFrame, files: DataFrame) -> DataFrame:
    """Base, rows_in, files_out, skipped. records: base, record_id; files: record_id."""
    f = files.select("record_id", F.lit(1).alias("out"))
    return records.join(f, "record_id", "left").groupBy("base").agg(F.count("*").alias("rows_in"), F.count("out").alias("files_out"), F.count_if(F.col("out").isNull()).alias("skipped"))
