"""SimHash fingerprints and the search for all of them within a Hamming radius, with DataFrame functions only.

Terms are pairs of neighbouring lower-cased words (the single word of a shorter text), each occurrence with weight 1,
or 2 if its words have more than LONG letters together. A term's 128 hash bits vote with that weight, one of two
counters in each of 64 sums; a bit of the fingerprint is set if more than half of the weight votes for it.
Likeness is the cosine that the share of differing bits stands for, 0 at the least.

Search: RADIUS is set by the distances of texts with a Jaccard similarity of 0.8 on five-word shingles. Bits are split into
TABLES blocks. If RADIUS bits differ, some block differs by no more than its share (shares plus one add up to RADIUS + 1),
so each fingerprint is kept once for each block, and a query asks for all values that differ by the block's share at most. A pair
counts in the first block that finds it. Equal fingerprints are one row with a count, so groups of copies cost one row;
pairs are compared only within a key, for stated queries against all.

The document that follows another by descending doc_id (the first after the last) is found without bringing all
rows together: doc_ids are dealt into ranges between quantiles, and the first row of each range is also sent to the
range before it.

Null text counts as empty, and has the fingerprint of an empty text. Null doc_ids come last; equal doc_ids follow each
other by a hash of their text; repeated rows stay. Only doc_id and text are read. An empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.sampling import ranges

from .common import partitions, written

RADIUS, TABLES = 20, 8
BITS, LONG = 128, 8
WIDTH = BITS // TABLES
QUERY_EVERY = 50
LEAST_KEY = -(1 << 63)


def terms(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")
    return F.when(F.size(words) > 1, F.arrays_zip(F.slice(words, 1, F.size(words) - 1).alias("a"), F.slice(words, 2, F.size(words)).alias("b"))).otherwise(F.array(F.struct(words[0].alias("a"), F.lit("").alias("b"))))


def _votes() -> list[Column]:
    """Sums with two 32-bit counters: of bit i and bit i + 32 of a 64-bit hash."""
    pair = F.lit(0x0000000100000001)
    out = [F.sum(F.col("heavy") + 1).alias("weight")]
    for h in ("h1", "h2"):
        for i in range(32):
            one = F.shiftrightunsigned(h, i).bitwiseAND(pair)
            out.append(F.sum(F.when(F.col("heavy") > 0, one + one).otherwise(one)).alias(f"{h}_{i}"))
    return out


def _word(h: str) -> Column:
    """64 bits of the fingerprint from the votes."""
    bits = []
    for i in range(32):
        low, high = F.col(f"{h}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{h}_{i}", 32)
        for count, at in ((low, i), (high, i + 32)):
            bits.append(F.when(count * 2 > F.col("weight"), F.lit((1 << at) - (1 << 64 if at == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, f1, f2: the two halves of each text's fingerprint. keys name a row."""
    said = rows.select(*keys, F.explode(terms(F.col(text))).alias("t")).select(
        *keys, F.xxhash64("t.a", "t.b").alias("h1"), F.xxhash64("t.b", "t.a", F.lit(1)).alias("h2"), (F.length("t.a") + F.length("t.b") > LONG).cast("long").alias("heavy")
    )
    return said.groupBy(*keys).agg(*_votes()).select(*keys, _word("h1").alias("f1"), _word("h2").alias("f2"))


def distance(a1: str, a2: str, b1: str, b2: str) -> Column:
    return F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) + F.bit_count(F.col(a2).bitwiseXOR(F.col(b2)))


def likeness(differing: Column) -> Column:
    return F.when(differing == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(differing * F.lit(pi / BITS))))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text and the row's place: part, place; rows with late = 1 repeat another range's first row."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LEAST_KEY)).cast("long").alias("k"))
    d = d.withColumn("part", ranges(d.select("k"), "k", 16 * partitions(spark)))
    up = Window.orderBy("part")  # over a row for each range
    tops = d.groupBy("part").agg(F.max("k").alias("top"))
    ghosts = F.broadcast(tops.select(F.col("top").alias("k"), F.coalesce(F.lead("part").over(up), F.first("part").over(up)).alias("to")))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("late"))
    again = F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), F.lit(1).alias("late")))
    dealt = d.join(ghosts, "k", "left").select("doc_id", "text", "k", F.explode(F.array_compact(F.array(own, again))).alias("at"))
    w = Window.partitionBy("part").orderBy("late", F.desc("k"), "tie")
    rows = dealt.select("doc_id", "text", "k", "at.part", "at.late", F.xxhash64("text").alias("tie"))
    return rows.select("doc_id", "text", "part", "late", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("next_text"))


def hexed(f1: str, f2: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def shares(radius: int) -> list[int]:
    """How many bits may differ in each block; blocks with -1 aren't needed."""
    each, more = divmod(radius + 1, TABLES)
    return [each - (i >= more) for i in range(TABLES)]


def _block(i: int, f1: Column, f2: Column) -> Column:
    low = WIDTH * i
    return F.shiftrightunsigned(f1 if low < 64 else f2, low % 64).bitwiseAND(F.lit((1 << WIDTH) - 1))


def tables(prints: DataFrame, radius: int, asked: bool = False) -> DataFrame:
    """prints (f1, f2, ...) once for each block, with its key; once for each key in reach if asked."""
    keys = []
    for i, share in enumerate(shares(radius)):
        masks = [(i << WIDTH) + sum(1 << b for b in bits) for n in range(share + 1 if asked else min(share, 0) + 1) for bits in combinations(range(WIDTH), n)]
        if masks:
            held = _block(i, F.col("f1"), F.col("f2"))
            keys.append(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), held.bitwiseXOR))
    return prints.select("*", F.explode(F.concat(*keys)).alias("key"))


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """queries (f1, f2) and prints (f1, f2, n), both distinct: f1, f2 and how many rows lie within the radius."""
    q = tables(queries.select("f1", "f2"), radius, asked=True).select(F.col("f1").alias("q1"), F.col("f2").alias("q2"), "key")
    x1, x2 = F.col("q1").bitwiseXOR(F.col("f1")), F.col("q2").bitwiseXOR(F.col("f2"))
    first = F.lit(None).cast("long")
    for i, share in reversed(list(enumerate(shares(radius)))):
        first = F.when(F.bit_count(_block(i, x1, x2)) <= share, F.lit(i).cast("long")).otherwise(first)
    # a merge join at every size: hot keys are split
    near = q.join(tables(prints, radius).hint("merge"), "key").where((distance("q1", "q2", "f1", "f2") <= radius) & (first == F.shiftright("key", WIDTH)))
    return near.groupBy(F.col("q1").alias("f1"), F.col("q2").alias("f2")).agg(F.sum("n").alias("n_within"))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS, query_every: int = QUERY_EVERY) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within: rows, itself
    included, within the radius of a row whose doc_id is divisible by query_every, else null."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    texts = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("said")), F.struct(F.lit(1).alias("kind"), edited.alias("said")))
    keys = ["part", "place", "late", "doc_id", "kind", "n_chars", "sha"]
    said = with_next(docs).select("part", "place", "late", "doc_id", F.explode(texts).alias("x")).where("late = 0 or x.kind = 0")
    said = said.select("part", "place", "late", "doc_id", "x.kind", "x.said", F.length("x.said").cast("long").alias("n_chars"), F.when(F.col("x.kind") == 1, F.sha2("x.said", 256)).alias("sha"))
    each = fingerprints(said, keys, "said")
    both = each.groupBy("part", "place", "late", "doc_id").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(c + s) for c in ("n_chars", "sha", "f1", "f2") for k, s in ((0, ""), (1, "e"))])
    w = Window.partitionBy("part").orderBy("place")
    chained = both.withColumns({"f1n": F.lead("f1").over(w), "f2n": F.lead("f2").over(w)}).where("late = 0")
    rows = written(chained.select("doc_id", "n_chars", F.col("shae").alias("edited_sha256"), "f1", "f2", "f1e", "f2e", "f1n", "f2n"), "fingerprints")
    prints = rows.groupBy("f1", "f2").agg(F.count("*").alias("n"), F.max((F.col("doc_id") % query_every == 0).cast("int")).alias("asked"))
    found = within(prints.where("asked = 1"), prints.select("f1", "f2", "n"), radius)
    return rows.join(found, ["f1", "f2"], "left").select(
        "doc_id", "n_chars", "edited_sha256", hexed("f1", "f2").alias("fingerprint"), hexed("f1e", "f2e").alias("edited_fingerprint"),
        likeness(distance("f1", "f2", "f1e", "f2e")).alias("near_edited"), likeness(distance("f1", "f2", "f1n", "f2n")).alias("near_next"),
        F.when(F.col("doc_id") % query_every == 0, F.col("n_within")).alias("n_within"),
    )
