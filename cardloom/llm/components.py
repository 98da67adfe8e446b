"""Connected components by alternating large-star and small-star steps, as DataFrame joins.

Every round is written to the shared folder, so it cuts the lineage and a lost executor costs one task; the round before is
deleted then. A node with
very many links is aggregated before the shuffle, and its rows are salted in the joins. These are merge joins at every size: Spark
estimates the repeated rows of a salted join as if they stood once, and would send tables far above its limit through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_join, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b): long. node, root: the smallest node that each linked node reaches. Links of a node with itself
    and repeated links may occur; an empty table gives an empty table."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = written(pairs, "stars")
    seen = None
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if mark == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v")).distinct()
        seen = mark
        both = stars.union(stars.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both, least.hint("merge"), "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least.hint("merge"), "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        stars, before = written(small, "stars"), stars
        discard(before)
