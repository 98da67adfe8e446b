"""Deterministic samples, caps, bins and schedules. Orders are explicit columns, never the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the seed in every sample's key.
SEED = 20260712


def sha1_modulo(key: Column, modulus: int) -> Column:
    """The 160-bit number of SHA-1(key), modulo: five 32-bit words, most significant first."""
    digest = F.sha1(key)
    out = F.lit(0).cast("long")
    for i in range(5):
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        out = (out * (1 << 32) + word) % modulus
    return out


def sample_key(*parts: Column) -> Column:
    return F.concat_ws(":", F.lit(str(SEED)), *[p.cast("string") for p in parts])


def sampled_below(key: Column, share: float, modulus: int = 1_000_000) -> Column:
    """Draw by hash: number < share of the modulus."""
    return sha1_modulo(key, modulus) < int(share * modulus)


def sampled_up_to(key: Column, share: float, modulus: int = 1_000_000) -> Column:
    """The same, but a number that equals the bound is in."""
    return sha1_modulo(key, modulus) <= share * modulus


def shuffled(key: Column) -> Column:
    """A sort key that stands for a seeded shuffle."""
    return F.sha1(F.concat_ws(":", F.lit(str(SEED)), key.cast("string")))


def first_by(df: DataFrame, keys: list[str], order: list, most: int = 1) -> DataFrame:
    """The first rows of each key in the order: caps, first or last of duplicates, first of a label."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where(F.col("__nth") <= most).drop("__nth")


def first_passing(df: DataFrame, keys: list[str], order: str, passed: Column, most: int) -> DataFrame:
    """Reject and advance: the first rows of a key that pass, column `taken` true; and the failures before the last one
    taken, as the log of rejects, false. Only the first rows of a key that pass are sorted; failures are compared with the last of them."""
    marked = df.withColumn("taken", F.coalesce(passed, F.lit(False)))
    taken = first_by(marked.where("taken"), keys, [order], most)
    full = taken.groupBy(*keys).agg(F.max(order).alias("__last"), F.count("*").alias("__k")).where(F.col("__k") == most)
    full = full.select("__last", *[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    failed = marked.where(~F.col("taken")).join(full, same, "left").where(F.col("__last").isNull() | (F.col(order) < F.col("__last")))
    return taken.unionByName(failed.select(*marked.columns))


def first_then_gated(df: DataFrame, keys: list[str], order: str, most: int, gates: dict[str, Column]) -> DataFrame:
    """The first rows of each key whether they pass or not; a view (column) whose gate fails is emptied, its row stays."""
    rows = first_by(df, keys, [order], most)
    return rows.withColumns({view: F.when(F.coalesce(passed, F.lit(False)), F.col(view)) for view, passed in gates.items()})


QUANTILES = 128


def ranges(df: DataFrame, order: str, parts: int) -> Column:
    """A range number of the whole-number column, ascending with it, for about `parts` ranges of like size: quantiles, and equal
    widths between two of them, found by a few comparisons. Null stands in the first range."""
    known = df.select(F.percentile_approx(order, [i / QUANTILES for i in range(QUANTILES + 1)], 10 * QUANTILES)).first()[0]
    cuts = sorted(set(known or [0]))
    inner = max(1, -(-parts // QUANTILES))
    value = F.col(order)

    def leaf(i: int) -> Column:
        low, high = cuts[i], cuts[min(i + 1, len(cuts) - 1)]
        step = F.floor((value.cast("double") - low) * (inner / max(float(high) - float(low), 1.0))).cast("long")
        return F.lit(i * inner).cast("long") + F.greatest(F.lit(0).cast("long"), F.least(step, F.lit(inner - 1).cast("long")))

    def tree(low: int, high: int) -> Column:
        if high - low == 1:
            return leaf(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(cuts[mid]), tree(low, mid)).otherwise(tree(mid, high))

    return F.coalesce(tree(0, len(cuts)), F.lit(0).cast("long"))


def numbered(df: DataFrame, order: str, name: str, key: str | None = None) -> DataFrame:
    """Dense numbers from 0 in the order of a whole-number column, of all rows or of each key's, without one task for all rows:
    ranges of the order are numbered by themselves and begin where the counts of the ranges before them end."""
    keys = [key] if key else []
    rows = df.withColumn("__part", ranges(df, order, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    counts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias("__key") for k in keys], F.col("__part").alias("__of"), before.alias("__before"))  # a row for each range, and key
    same = F.col("__part") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("__key"))
    nth = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(order))
    return rows.join(starts, same).withColumn(name, F.col("__before") + nth - 1).drop("__part", "__of", "__key", "__before")


def binned(number: Column | str, size: int) -> Column:
    """Fixed-size bins of numbered rows: shards, chunks."""
    number = F.col(number) if isinstance(number, str) else number
    return F.floor(number / size).cast("long")


def dealt(number: Column | str, hands: int) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return number % hands


def first_middle_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the rows at places 0, n / 2 and n - 1 of a whole-number order."""
    counts = df.groupBy(F.col(key).alias("__of")).agg(F.count("*").alias("__all"))
    rows = numbered(df, order, "__i", key).join(counts, F.col(key).eqNullSafe(F.col("__of")))
    return rows.where((F.col("__i") == 0) | (F.col("__i") == F.floor(F.col("__all") / 2)) | (F.col("__i") == F.col("__all") - 1)).drop("__i", "__all", "__of")


def front_slice(df: DataFrame, order: str, take: int, start: int = 0) -> DataFrame:
    """The rows from place `start` on in the order, as many as `take`: the form START:COUNT."""
    return df.orderBy(order).offset(start).limit(take)


def lane_of_step(step: Column, lanes: list[str], weights: list[float]) -> Column:
    """A lane for each step by weight, a pure function of the step."""
    draw = sha1_modulo(F.concat_ws(":", F.lit(f"{SEED}:lane"), step.cast("string")), 1_000_000) / 1_000_000
    total, run, out = sum(weights), 0.0, None
    for lane, weight in list(zip(lanes, weights, strict=True))[:-1]:
        run += weight / total
        out = F.when(draw < run, lane) if out is None else out.when(draw < run, lane)
    return F.lit(lanes[-1]) if out is None else out.otherwise(lanes[-1])


def lane_batches(items: DataFrame, epoch: int, world: int, batch: int) -> DataFrame:
    """items (lane, key): the epoch's order of each lane, cut into steps of world x batch items, a slice for each rank. A step
    that the lane can't fill is left out: the next epoch begins there."""
    order = F.sha1(F.concat_ws("/", F.lit(str(SEED)), "lane", F.lit(str(epoch)), F.col("key").cast("string")))
    hashed = items.select("lane", "key", F.conv(F.substring(order, 1, 15), 16, 10).cast("long").alias("__hash"))  # the first 60 bits
    counts = items.groupBy(F.col("lane").alias("__lane")).agg(F.count("*").alias("n"))
    rows = numbered(hashed, "__hash", "pos", "lane").join(counts, F.col("lane").eqNullSafe(F.col("__lane")))
    step = F.floor(F.col("pos") / (world * batch))
    rows = rows.select("lane", "key", step.alias("lane_step"), F.floor((F.col("pos") % (world * batch)) / batch).alias("rank"), (F.col("pos") % batch).alias("slot"), "n")
    return rows.where((F.col("lane_step") + 1) * world * batch <= F.col("n")).drop("n")


def replacement(lane: Column, step: Column, rank: Column, retry: int, items: int) -> Column:
    """Which item stands in for one that can't be read; the shared order is not moved."""
    return sha1_modulo(F.concat_ws("/", F.lit(f"{SEED}/bad"), lane, step.cast("string"), rank.cast("string"), F.lit(str(retry))), items)
