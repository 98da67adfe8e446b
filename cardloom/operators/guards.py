"""Guards against evaluation data, anti joins and duplicate rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.text import basename


def without(df: DataFrame, guard: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key no guard row has. A null key is on no list."""
    return df.join(guard.select(*on).distinct(), on, "left_anti")


def guard_set(*tables: DataFrame) -> DataFrame:
    """The union of guard lists, each value once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def member_guard(df: DataFrame, member: str, names: DataFrame, ids: DataFrame, split: str = "val2014") -> DataFrame:
    """Adds drop_reason of a media member, the first rule that holds: its path names the split, its base name is listed, the
    12-digit id in its base name is listed. names (name), ids (id)."""
    base = df.withColumn("__base", basename(member)).withColumn("__id", F.regexp_extract(basename(member), r"(\d{12})", 1))
    named = names.select(F.col("name").alias("__base"), F.lit(True).alias("__named")).distinct()
    listed = ids.select(F.col("id").alias("__id"), F.lit(True).alias("__listed")).distinct()
    joined = base.join(named, "__base", "left").join(listed, "__id", "left")
    reason = F.when(F.col(member).contains(split), "split").when(F.col("__named"), "basename").when(F.col("__listed"), "id")
    return joined.withColumn("drop_reason", reason).drop("__base", "__id", "__named", "__listed")


def page_dedup(pairs: DataFrame, guard: DataFrame, order: str, by_page: bool = False) -> DataFrame:
    """Pairs (dedup_hash, sha) of several files: the first of each query hash, and none that a guard (dedup_hash) has. by_page
    is the documented variant: the first of each (query hash, page)."""
    nth = F.row_number().over(Window.partitionBy("dedup_hash", *["sha"] * by_page).orderBy(order))
    return without(pairs, guard, ["dedup_hash"]).withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def refuse(df: DataFrame, column: Column, text: str) -> DataFrame:
    """Fails when a row meets the condition, as for reads of splits that must not be read."""
    return df.where(F.when(column, F.raise_error(F.lit(text)).cast("boolean")).otherwise(True))


def drop_counts(df: DataFrame, *keys: str) -> DataFrame:
    """How many rows each reason took, and how many were kept."""
    return df.groupBy(*keys, F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


GRAM = 8


def _tokens(text: str) -> Column:
    return F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")


def _runs(array: str, n: int, name: str) -> Column:
    """All runs of n neighbours in an array, as structs of fields name0, name1, ..."""
    size = F.greatest(F.size(array) - (n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(array, F.lit(i + 1), size).alias(f"{name}{i}") for i in range(n)])


def holding(docs: DataFrame, key: str, items: DataFrame, item_key: str) -> DataFrame:
    """key, item_key of each document (key, text) that holds the text of an item (item_key, text) as a substring, once. Null and
    empty items are held by none.

    Candidates come from what a document must have: words inside an item, between two spaces or line breaks, are whole words of the
    document too, so an item of five words or more is looked for by its longest three inner words in a row; a shorter one by its first
    GRAM characters (or all). Candidates are then compared exactly; no document meets all items."""
    docs, items = docs.select(key, "text"), items.select(item_key, F.col("text").alias("item")).where("item <> ''")
    split = items.withColumn("w", _tokens("item"))
    long = split.where(F.size("w") >= 5).select(item_key, "item", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))).alias("w"))
    width = lambda r: sum((F.length(r[f"w{i}"]) for i in range(1, 3)), F.length(r["w0"]))
    best = F.array_max(F.transform(_runs("w", 3, "w"), lambda r: F.struct(width(r).alias("width"), *[r[f"w{i}"].alias(f"w{i}") for i in range(3)])))
    seeds = long.select(item_key, "item", best.alias("b")).select(item_key, "item", "b.w0", "b.w1", "b.w2")
    placed = docs.select(key, _tokens("text").alias("w")).select(key, F.explode_outer(_runs("w", 3, "w")).alias("r")).select(key, "r.*")
    asked = placed.join(seeds, ["w0", "w1", "w2"]).select(key, item_key, "item")

    short = split.where(F.size("w") < 5).select(item_key, "item", F.least(F.length("item"), F.lit(GRAM)).alias("n"))
    sizes = sorted(r.n for r in short.select("n").distinct().collect())  # GRAM numbers at most
    for n in sizes:
        chars = docs.select(key, F.split("text", "").alias("c")).select(key, F.explode_outer(_runs("c", n, "c")).alias("r"))
        grams = chars.select(key, F.concat(*[f"r.c{i}" for i in range(n)]).alias("gram"))
        begins = short.where(F.col("n") == n).select(item_key, "item", F.left("item", F.lit(n)).alias("gram"))
        asked = asked.union(grams.join(begins, "gram").select(key, item_key, "item"))
    return docs.join(asked.distinct(), key).where(F.contains("text", "item")).select(key, item_key).distinct()
