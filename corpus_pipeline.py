"""The corpus pipeline: every stage reads all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.common import written
from cardloom.llm.jaccard_join import jaccard_components
from cardloom.llm.language_id import accepted
from cardloom.llm.line_dedup import dedup_lines
from cardloom.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the table teaches: null texts, those without a letter and those whose n-grams are unknown in all
    of its languages go, whatever their lang says; a null lang, a short or a mixed text is no fault. Texts of any length are read whole."""
    return accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one has; a document of which nothing is left goes.
    Null and empty texts stay. n_chars follows a changed text; null doc_ids are the latest. Texts of any length are compared whole."""
    out = dedup_lines(docs, names=("__before", "__deleted")).where((F.col("__deleted") == 0) | (F.col("__deleted") < F.col("__before")))
    changed = F.col("__deleted") > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest doc_id (null is the largest) and of its rows the one with the
    smallest text hash, whether or not other rows share its doc_id. Rows without words all stay. Texts of any length are compared
    whole."""
    near = jaccard_components(docs).where("n_shingles > 0")
    first = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("__first"))
    stays = first.select(F.col("__first.doc_id").alias("__id"), F.col("__first.text_hash").alias("__hash")).hint("merge")  # grows with the documents
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = docs.where(wordy).withColumn("__h", F.xxhash64("text"))
    found = found.join(stays, found["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left_semi")
    same = Window.partitionBy("doc_id", "__h").orderBy("text")
    one = found.withColumn("__nth", F.row_number().over(same)).where("__nth = 1").drop("__nth", "__h")
    return docs.where(~wordy).unionByName(one)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; the last stage."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("packing", packing)]

#: No stage can be told in SQL: classifiers, patience diff, tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
