"""Joins that bring generated views to their cards, and checks that nothing drifted on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.streaming.incremental import last_wins

MOST_SECONDS, RATE = 30.0, 16000


def spoken_views(log: DataFrame, texts: DataFrame, blocked: DataFrame) -> DataFrame:
    """log (card_id, at, passed, seconds, rate, ...): the last row of each card if its gate passed, its audio is in bounds, the card
    (card_id, task_id, text) has text and its task isn't blocked (task_id)."""
    last = last_wins(log, "card_id", "at").where("passed").where((F.col("seconds") <= MOST_SECONDS) & (F.col("rate") == RATE))
    known = texts.where(F.coalesce("text", F.lit("")) != "").join(blocked.select("task_id").distinct(), "task_id", "left_anti")
    return last.join(known, "card_id")


def ingested(clips: DataFrame, texts: DataFrame) -> DataFrame:
    """Clips with the text that they should say; those of unknown cards are left out."""
    return clips.join(texts.select("card_id", F.col("text").alias("reference")), "card_id")


def realigned(ids: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached rows for the ids; fails if one is missing. Positions are never trusted, only ids."""
    joined = ids.select("id").join(cached.withColumn("__there", F.lit(True)), "id", "left")
    return joined.where(F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no cached row for "), F.col("id").cast("string"))).cast("boolean")).otherwise(True)).drop("__there")


def same_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: drift between items and their vectors."""
    return left.select(key).exceptAll(right.select(key)).withColumn("side", F.lit("left")).union(right.select(key).exceptAll(left.select(key)).withColumn("side", F.lit("right")))


def by_generator(views: DataFrame, model: str) -> DataFrame:
    return views.where(F.col("gen.model") == model)


def paired(archive: DataFrame, left: str, right: str) -> DataFrame:
    """archive (key, suffix, data): both members of a key side by side, wherever they stand."""
    pick = lambda s, name: archive.where(F.col("suffix") == s).select("key", F.col("data").alias(name))
    return pick(left, "left").join(pick(right, "right"), "key")
