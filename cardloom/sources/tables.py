"""Tables in the folder that all machines share, and tolerant readers of text formats."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share. Where the session names none, one of this machine's if it runs everything itself; on a
    cluster that would lose rows, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="cardloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strict_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Fails at a broken line; blank lines are none."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Whole records, and the broken lines, such as a last one that was cut."""
    both = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    good = parsed.where("r._broken is null").select("r.*").drop("_broken")
    return good.select(*[c for c in both.columns if c != "_broken"]), parsed.where("r._broken is not null").select(F.col("r._broken").alias("line"))


def transcripts(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """Lines `id<separator>text`, cut at the first separator only."""
    parts = F.split("value", f"\\Q{separator}\\E", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))


def csv_with_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def many_files(spark: SparkSession, pattern: str, kind: str = "parquet", **options: str) -> DataFrame:
    """All files of a pattern, with the file of each row in `file`."""
    return spark.read.format(kind).options(**options).load(pattern).withColumn("file", F.col("_metadata.file_path"))


def speaker_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """speaker, chapter, name, content of root/**/speaker/chapter/name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    at = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)$", i)
    return files.select(at(1).alias("speaker"), at(2).alias("chapter"), at(3).alias("name"), "content")


def footer_rows(spark: SparkSession, path: str) -> int:
    """Rows of Parquet files; only footers are read."""
    return spark.read.parquet(path).count()


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_chunks(df: DataFrame, chunk: str, path: str) -> None:
    """One folder for each chunk number; the marker of success is written last."""
    df.write.mode("overwrite").partitionBy(chunk).parquet(path)


def put_by_content(df: DataFrame, data: str, path: str) -> DataFrame:
    """Content-addressed store: adds what isn't there yet, under its SHA-256 and that's first two digits. Returns sha, prefix, of
    what was new."""
    spark = df.sparkSession
    rows = df.select(F.sha2(F.col(data), 256).alias("sha"), F.col(data).alias("data")).dropDuplicates(["sha"]).withColumn("prefix", F.left("sha", F.lit(2)))
    try:
        there = spark.read.parquet(path).select("sha")
        rows = rows.join(there, "sha", "left_anti")
    except Exception as e:  # the store's first use
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = staged(rows, "new-content")
    rows.write.mode("append").partitionBy("prefix").parquet(path)
    return rows.select("sha", "prefix")
