"""Shards of samples: manifests, verification, and tar export by the data source in `sources.archives`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(samples: DataFrame) -> DataFrame:
    """samples (shard, key, data): for each shard its count, bytes, first and last key, and a SHA-256 over the samples' own, in key
    order. Shards have a bounded number of samples."""
    pairs = F.array_sort(F.collect_list(F.struct("key", F.sha2("data", 256).alias("sha"))))
    joined = F.array_join(F.transform(pairs, lambda x: x["sha"]), "")
    return samples.groupBy("shard").agg(F.count("*").alias("samples"), F.sum(F.octet_length("data")).cast("long").alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.sha2(joined, 256).alias("sha256"))


def verified(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """Shards whose content, read again, differs from the manifest, or that only one side has."""
    got = manifest(samples)
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("samples", "bytes", "first_key", "last_key", "sha256")]
    right = same[0]
    for s in same[1:]:
        right = right & s
    joined = got.alias("g").join(expected.alias("e"), "shard", "full")
    return joined.where(~right).select("shard")


def index_report(index: DataFrame) -> DataFrame:
    """index (key, lane): samples of each lane, and their keys in order."""
    return index.groupBy("lane").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("key")).alias("keys"))


def unbalanced(counts: DataFrame, total: int) -> DataFrame:
    """One row if the lanes' counts don't add up to the samples."""
    return counts.agg(F.sum("n").alias("n")).where(F.col("n") != total)
