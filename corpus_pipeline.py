"""A training corpus from documents: quality, near duplicates, repeated passages, source mix, packed sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.jaccard import jaccard_classes
from quarry.llm.jaccard import small as few
from quarry.llm.mixing import mix
from quarry.llm.packing import pack
from quarry.llm.quality import learn, scored
from quarry.llm.repeats import deduplicated
from quarry.llm.runtime import private, spent, table, written

#: Near duplicates: words to a shingle, and percent of shingles that two documents share.
WIDTH, PERCENT = 5, 80
#: Bytes of a repeated passage; 50 words are longer.
PASSAGE = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. A document without text is scored like any other."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).where(F.col(private("predicted", docs)) == 1).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: the one of the smallest doc_id; of several texts with the same words under
    that doc_id the one of the smallest hash. Of rows that repeat doc_id and text the least one stays. Rows without doc_id all do, and
    texts that are linked with nothing, though their doc_ids repeat."""
    classes = written(jaccard_classes(docs, WIDTH, PERCENT), "near")
    names = [private("doc_id_", docs), private("text_hash", docs)]
    head = (F.col("doc_id") == F.col("component_id")) & (F.col("node") == F.col("component_node"))
    pairs = classes.where("doc_id is not null and n_shingles > 0")
    gone = pairs.where(~head).select("doc_id", "text_hash")
    again = written(classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    repeats = again.limit(1).count() > 0
    if repeats:
        heads = pairs.where(head).join(few(again), "doc_id", "left_semi")
        least = heads.groupBy("doc_id", "node").agg(F.min("text_hash").alias("least"))
        gone = gone.union(heads.join(least, ["doc_id", "node"]).where("text_hash <> least").select("doc_id", "text_hash"))
    gone = written(gone.distinct().toDF(*names), "gone")
    left = docs.withColumn(names[0], F.col("doc_id").cast("long")).withColumn(names[1], F.xxhash64("text")).join(few(gone), names, "left_anti")
    if repeats:
        several = few(again.toDF(names[0]))
        row = F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")
        once = left.join(several, names[0], "left_semi").groupBy(*names).agg(row).select("row.*")
        return left.join(several, names[0], "left_anti").select(docs.columns).unionByName(once)
    return left.select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat anywhere in the corpus."""
    out = deduplicated(docs, PASSAGE)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("packed", packed)]

#: A learned classifier has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        spent(before)
    return STAGES[-1][1](spark, docs, sf_dir)
