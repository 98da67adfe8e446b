"""Minimax contiguous partition of groups of equal texts into shards.

Groups stand in the order of a 60-bit key of their text's SHA-256. The smallest feasible capacity is found by
binary search; a greedy pass checks it: fill a shard until the next group would exceed the capacity. The cuts are
made there. A group of at least the mean size of a shard gets a shard of its own and the groups before and after it are
partitioned by the same rule with the shards that are left, if no shard then is larger than that group.

The driver never holds the groups. It holds a histogram over the leading bits of the key, beside groups of a 4096th of all bytes
or more (so 4096 at most), which are items of their own. From it follow bounds on the capacity: an upper one with cuts
between items only, a lower one with cuts anywhere inside buckets; and from these an interval for each cut. Only
buckets that reach into an interval are refined by MORE_BITS bits, all others can hold no cut and are never looked at again, so a
round asks for some hundred buckets whatever the number of groups, until no interval holds a bucket of several groups.

Law: `bytes`, sizes near equal. Null and empty texts are one group of size 1 a row. Repeated rows count as often
as they occur; ties in the key (equal texts) are never split. Only doc_id and text are read; an empty table gives
an empty table. A group may hold any share of the rows: its rows are never brought together in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, written

SHARDS = 16
KEY_BITS, FIRST_BITS, MORE_BITS = 60, 12, 5
OWN_ITEM = 4096  # a group with this fraction of all bytes is an item of its own
MOST_BROADCAST = 20_000


def reach(sums: np.ndarray, free: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """Where the greedy pass ends each shard, as sums. An item is cut only if it is free."""
    at, out = int(sums[0]), []
    for _ in range(shards):
        at = min(at + capacity, int(sums[-1]))
        i = int(np.searchsorted(sums, at, "right")) - 1
        if i < len(free) and not free[i]:
            at = int(sums[i])
        out.append(at)
    return np.array(out, np.int64)


def least_capacity(sums: np.ndarray, free: np.ndarray, shards: int) -> int:
    """The smallest capacity with which the greedy pass reaches the end."""
    total = int(sums[-1] - sums[0])
    low, high = -(-total // shards), total
    while low < high:
        mid = (low + high) // 2
        if reach(sums, free, mid, shards)[-1] == sums[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def dealt(before: int, after: int, shards: int) -> int | None:
    """How many of the shards go to what stands before a group with its own shard: the largest mean size is smallest."""
    fits = [k for k in range(shards) if (k or not before) and (k < shards - 1 or not after)]
    return min(fits, key=lambda k: (max(before / k if before else 0.0, after / (shards - 1 - k) if after else 0.0), k), default=None)


@dataclass
class Cuts:
    """Bounds on the capacity, the sums at which shards end if all is known, and the items in which a cut may lie."""

    low: int
    high: int
    ends: list[int]
    open: set[int]


def cuts_of(sums: np.ndarray, single: np.ndarray, free: np.ndarray, a: int, b: int, shards: int) -> Cuts:
    """Partition of the items a to b. sums: before each item and at the end; single: the item is one group."""
    if a == b:
        return Cuts(0, 0, [int(sums[a])] * shards, set())
    sizes, total, near = np.diff(sums[a : b + 1]), int(sums[b] - sums[a]), set()
    big = a + int(np.where(single[a:b], sizes, -1).argmax())
    size = int(sums[big + 1] - sums[big])
    if shards > 1 and b - a > 1 and single[big] and size * shards >= total:
        k = dealt(int(sums[big] - sums[a]), int(sums[b] - sums[big + 1]), shards)
        if k is not None:
            left, right = (cuts_of(sums, single, free, x, y, n) if n else Cuts(0, 0, [], set()) for x, y, n in ((a, big, k), (big + 1, b, shards - 1 - k)))
            near = left.open | right.open
            if max(left.high, right.high) <= size:
                return Cuts(size, size, [*left.ends, int(sums[big + 1]), *right.ends], near)
            if max(left.low, right.low) > size:
                near = set()
    part, loose, none = sums[a : b + 1], free[a:b], np.zeros(b - a, bool)
    low, high = least_capacity(part, loose, shards), least_capacity(part, none, shards)
    first, last = reach(part, none, low, shards)[:-1], reach(part, loose, high, shards)[:-1]
    marked = np.zeros(b - a, bool)
    for x, y in zip(first, last, strict=True):
        marked |= (part[:-1] < y) & (part[1:] > x)
    return Cuts(low, high, reach(part, none, high, shards).tolist(), near | {a + int(i) for i in np.flatnonzero(marked & loose)})


def cut(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Ends of the shards, as many as shards, for the ordered atomic sizes."""
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    got = cuts_of(sums, np.ones(len(sizes), bool), np.zeros(len(sizes), bool), 0, len(sizes), shards)
    return np.searchsorted(sums, got.ends)


def boundaries(groups: DataFrame, shards: int, asked: list[int] | None = None) -> list[int]:
    """Keys before which shards 1, 2, ... begin. groups: key, size, a row for each. asked: gets the number of rows of each round."""
    spark, asked = groups.sparkSession, [] if asked is None else asked
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = groups.where(F.col("size") * OWN_ITEM >= total).select("key", "size").toArrow()  # OWN_ITEM rows at most
    rest = groups.where(F.col("size") * OWN_ITEM < total).withColumn("rank", F.lit(0))
    if large.num_rows:
        by_bucket: dict[int, list[int]] = {}
        for k in large.column("key").to_pylist():
            by_bucket.setdefault(k >> KEY_BITS - FIRST_BITS, []).append(k)
        known = F.broadcast(spark.createDataFrame(list(by_bucket.items()), "top long, large array<long>"))  # OWN_ITEM rows at most
        joined = rest.join(known, F.shiftright("key", KEY_BITS - FIRST_BITS) == F.col("top"), "left")
        rest = joined.select("key", "size", F.coalesce(F.size(F.filter("large", lambda x: x < F.col("key"))), F.lit(0)).alias("rank"))

    def histogram(rows: DataFrame, bits: int) -> dict[str, np.ndarray]:
        """Buckets of the leading bits; groups before and after a large one are apart."""
        got = rows.groupBy(F.shiftright("key", KEY_BITS - bits).alias("bucket"), "rank").agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).toArrow()
        asked.append(got.num_rows)
        return {c: got.column(c).to_numpy().astype(np.int64) for c in ("size", "low", "high", "rank")}

    bits = FIRST_BITS
    items = histogram(rest, bits)
    own = {"size": large.column("size").to_numpy(), "low": large.column("key").to_numpy(), "high": large.column("key").to_numpy(), "rank": np.zeros(large.num_rows, np.int64)}
    items = {k: np.concatenate([v, own[k]]) for k, v in items.items()} | {"free": np.concatenate([items["low"] < items["high"], np.zeros(large.num_rows, bool)])}
    while True:
        order = np.argsort(items["low"])
        items = {k: v[order] for k, v in items.items()}
        sums = np.concatenate([[0], np.cumsum(items["size"])])
        got = cuts_of(sums, items["low"] == items["high"], items["free"], 0, len(order), shards)
        marked = np.zeros(len(order), bool)
        marked[list(got.open)] = True
        items["free"] &= marked
        if not marked.any():
            break
        if bits >= KEY_BITS:
            raise RuntimeError("keys that are equal in all bits stand in two rows")
        shift = KEY_BITS - bits
        wanted = spark.createDataFrame([(int(x) >> shift, int(r)) for x, r in zip(items["low"][marked], items["rank"][marked], strict=True)], "bucket long, rank int")
        bits = min(KEY_BITS, bits + MORE_BITS)
        wanted = F.broadcast(wanted) if marked.sum() <= MOST_BROADCAST else wanted
        finer = histogram(rest.withColumn("bucket", F.shiftright("key", shift)).join(wanted, ["bucket", "rank"], "left_semi"), bits)
        finer["free"] = finer["low"] < finer["high"]
        items = {k: np.concatenate([v[~marked], finer[k]]) for k, v in items.items()}
    ends = np.searchsorted(sums, got.ends[:-1])
    return [int(items["low"][e]) if e < len(order) else (1 << KEY_BITS) for e in ends]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = written(
        docs.select(
            "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
            F.conv(F.substring(F.sha2(text, 256), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        ),
        "sharding",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    cuts = boundaries(groups, shards)
    discard(groups)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("key") >= c).cast("int")
    dealt = rows.select("doc_id", "size", "text_crc32", number.alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(4 * partitions(spark))).alias("part"))
    counts = dealt.groupBy("shard", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return dealt.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + within - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
