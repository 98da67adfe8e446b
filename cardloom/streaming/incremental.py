"""Restartable increments: a file stream that takes what is there and ends, with writes that can be repeated.

The engine's checkpoint takes the place of queues, claims, heartbeats and markers; a batch that is run again writes the same
folder again, so nothing is doubled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.sources.tables import shared_folder


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last."""
    value = F.max_by(F.struct(*[c for c in df.columns if c != key]), F.col(order))
    return df.groupBy(key).agg(value.alias("v")).select(key, "v.*")


def pending(work: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Work whose last log row neither passed nor was too long: errors are tried again."""
    final = last_wins(log, key, "at").where(F.col("state").isin("done", "overlength")).select(key)
    return work.join(final, key, "left_anti")


def ready(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Sources all of whose chunks are done."""
    marked = chunks.join(done.select("source", "chunk", F.lit(1).alias("ok")), ["source", "chunk"], "left")
    return marked.groupBy("source").agg(F.min(F.coalesce("ok", F.lit(0))).alias("ok")).where("ok = 1").select("source")


def drain(spark: SparkSession, source: str, schema: str, checkpoint: str, out: str, transform=lambda df: df, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """Reads all new files of a folder in batches and writes each batch's rows to a folder of its own, then stops. Called again it
    goes on where it stopped; a batch that was cut is written again over itself. Returns all that has been written."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.format(kind).schema(schema)
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    query = transform(stream.load(source)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def windowed_counts(events: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts of a stream by window: rows later than `late` behind the newest are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def once(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def sessions(events: DataFrame, key: str, time: str, gap: Column) -> DataFrame:
    """Batch sessions: a gap of more than `gap` (an interval) begins a new one."""
    w = Window.partitionBy(key).orderBy(time)
    begins = (F.col(time) - F.lag(time).over(w) > gap) | F.lag(time).over(w).isNull()
    return events.withColumn("session", F.sum(begins.cast("int")).over(w))
