"""Line deduplication by pairwise alignment.

A document is paired with the first holder (smallest doc_id) of each of its windows of lines: from each line on and up to each
line, the fewest consecutive lines that together have BLOCK_WORDS words, or the whole text if it has fewer. A window is what a
rare line is elsewhere: single lines say little where they are short and frequent, and leaving out frequent ones would lose
blocks, the sooner the more copies there are. Every line of a common block of BLOCK_WORDS words is in a window inside the
block, so it leads to a document that holds the block's window, however frequent its lines are; pairs grow
with the lines, not with the square of a group. The two documents are aligned with patience diff:
lines that occur once in both, their longest increasing chain, the same again between them, and equal lines at
both ends. Aligned runs of lines with BLOCK_WORDS words or more are common blocks, as are windows of the later document that
stand in the earlier one, which finds blocks that were moved or whose lines are repeated. They are deleted from the later
document. A text with fewer words is a block if an earlier document has the same lines and no others.

Lines are compared without ASCII white space at their ends. Words stand between ASCII white space; in scripts without spaces two
characters count as one. Blank lines are part of a block but start none. Null and empty
texts stay as they are; so do first holders, and rows that share a doc_id are not compared with each other (of such rows
the one with the smallest text hash stands for the doc_id where others align with it). Rows with null doc_id are the latest, in
the order of a hash of their texts. Texts are handled whole; extra columns of the documents are kept; an empty
table gives an empty table. Hashes have 64 bits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, salted_join, slices, written
from .shingles import mix

BLOCK_WORDS = 20
#: Scripts written without spaces (Thai, Lao, Myanmar, Khmer, Kana, Han); two of their characters count as a word.
UNSPACED = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\U00020000-\U000323af]")
LAST, NULLS = (1 << 63) - 1, 1 << 40
PAIR_BYTES = 4 << 20
BASE, MIXED = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing chain, by patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            top_at.append(i)
        else:
            tops[k], top_at[k] = p, i
        before[i] = top_at[k - 1] if k else -1
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = _once(a, a0, a1), _once(b, b0, b1)
        common = [(j, in_a[x]) for x, j in in_b.items() if j >= 0 and in_a.get(x, -1) >= 0]
        common.sort()
        chain = increasing([i for _, i in common])
        if not chain:
            continue
        at_a, at_b = a0, b0
        for k in chain:
            j, i = common[k]
            out.append((i, j))
            todo.append((at_a, i, at_b, j))
            at_a, at_b = i + 1, j + 1
        todo.append((at_a, a1, at_b, b1))
    return sorted(out)


def _once(lines: list[int], low: int, high: int) -> dict[int, int]:
    """Where each line stands, -1 if in more than one place."""
    at: dict[int, int] = {}
    for i in range(low, high):
        at[lines[i]] = -1 if lines[i] in at else i
    return at


def common_blocks(earlier: list[int], later: list[int], words: list[int], words_earlier: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Positions of the later document's lines to delete. words: of the lines."""
    blocks: list[list[tuple[int, int]]] = []
    for i, j in patience(earlier, later):
        if blocks and (blocks[-1][-1][0] + 1, blocks[-1][-1][1] + 1) == (i, j):
            blocks[-1].append((i, j))
        else:
            blocks.append([(i, j)])
    gone = {j for b in blocks if sum(words[j] for _, j in b) >= least for _, j in b}
    low, high, said = _spans(later, words, least)
    there = np.isin(said, _spans(earlier, words_earlier, least)[2])
    for a, b in zip(low[there].tolist(), high[there].tolist(), strict=True):
        gone.update(range(a, b + 1))
    if not gone and 0 < sum(words) < least and [x for x, w in zip(later, words, strict=True) if w] == [x for x, w in zip(earlier, words_earlier, strict=True) if w]:
        gone = set(range(len(later)))
    if gone and not any(w for p, w in enumerate(words) if p not in gone):
        gone = set(range(len(later)))
    return sorted(gone)


def _spans(lines: list[int], words: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, low, high, said = spans(np.array(lines, np.int64), np.array(words, np.int64), np.array([len(lines)]), least)
    return low, high, said


def spans(lines: np.ndarray, words: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents of so many lines each, whose hashes and words follow each other: of each window the number of the document,
    first and last line, and hash. A window's hash is a polynomial in those of its lines, so all come from sums up to each line."""
    n = len(lines)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    after = np.cumsum(words, dtype=np.int64)
    before = after - words
    said = np.flatnonzero(words > 0)
    last = np.searchsorted(after, before[said] + least, "left")
    down = last < ends[doc[said]]
    first = np.searchsorted(before, after[said] - least, "right") - 1
    up = (first >= (ends - sizes)[doc[said]]) & (words[said] < least)  # a line that is enough by itself is a window once
    low, high = np.concatenate([said[down], first[up]]), np.concatenate([last[down], said[up]])
    power, back = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.view(np.uint64) * power)])
    hashes = ((sums[high + 1] - sums[low]) * back[low]) ^ ((high - low + 1).astype(np.uint64) * np.uint64(MIXED))
    return doc[low], low, high, hashes.view(np.int64)


def windows(lines: np.ndarray, words: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the document and the hash of each window, once; and of the whole text for documents with fewer words."""
    doc, _, _, said = spans(lines, words, sizes, least)
    number = np.repeat(np.arange(len(sizes)), sizes)
    some = words > 0
    total = np.bincount(number, weights=words, minlength=len(sizes))
    short = some & ((total < least) & (total > 0))[number]
    at = np.flatnonzero(short)
    nth = np.concatenate([[0], np.cumsum(short)])[np.concatenate([[0], np.cumsum(sizes)])[number[at]]]
    place = (np.arange(len(at)) - nth).astype(np.uint64)
    whole = np.zeros(len(sizes), np.uint64)
    np.add.at(whole, number[at], mix(lines[at].view(np.uint64) + (place + np.uint64(1)) * np.uint64(MIXED)))
    few = np.flatnonzero((total < least) & (total > 0))
    doc, said = np.concatenate([doc, few]), np.concatenate([said, mix(whole[few]).view(np.int64)])
    once = np.unique(np.rec.fromarrays([doc, said], names="doc,hash"))
    return once["doc"], once["hash"]


def outlined(texts: list[str | None]) -> tuple[list[int], list[int], list[int]]:
    """Hashes and words of the lines of all texts, and how many lines each has."""
    hashes, words, sizes, digest = [], [], [], xxhash.xxh3_64_intdigest
    for text in texts:
        lines = [x.strip() for x in (text or "").encode().split(b"\n")]
        hashes += map(digest, lines)
        sizes.append(len(lines))
        spaced = [len(x.split()) for x in lines]
        if text and not text.isascii() and UNSPACED.search(text):
            spaced = [max(n, len(UNSPACED.findall(x.decode())) // 2) for n, x in zip(spaced, lines, strict=True)]
        words += spaced
    return hashes, words, sizes


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _place() -> list[Column]:
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST) - F.pmod(h, F.lit(NULLS))).alias("k"), h.alias("h")]


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch):
            hashes, words, sizes = outlined(some.column("text").to_pylist())
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.array(hashes, np.uint64).view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(np.array(words, np.int32)))]
            yield pa.RecordBatch.from_arrays([some.column("k"), some.column("h"), *lists], ["k", "h", "lines", "words"])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and the size of each list."""
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def deletions(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """k, h, gone: place and text hash of each document that loses lines, and their positions."""
    outline = written(docs.select(*_place(), "text").mapInArrow(_outlines, "k long, h long, lines array<long>, words array<int>"), "outline")

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, sizes = _flat(batch.column("lines"))
            doc, said = windows(lines, batch.column("words").flatten().to_numpy(), sizes, block_words)
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(doc)), pa.array(said)], ["k", "line"])

    held = outline.select("k", "lines", "words").mapInArrow(windowed, "k long, line long")
    seeds = held.groupBy("line").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").select("line", "first")
    pairs = written(salted_join(held, seeds, "line", "k").where("k <> first").select("first", "k").distinct(), "pairs")

    one = Window.partitionBy("k").orderBy("h")
    holders = outline.join(pairs.select(F.col("first").alias("k")).distinct(), "k", "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    holders = holders.select(F.col("k").alias("first"), F.col("lines").alias("earlier"), F.col("words").alias("words_earlier"))
    # the holders come last, so that a long one of many documents is shuffled once for each salt and not for each pair
    later = pairs.join(outline.hint("merge"), "k")
    both = salted_join(later, holders.hint("merge"), "first", "k").select("k", "h", "earlier", "words_earlier", "lines", "words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.cumsum([8 * (x + y) for x, y in zip(_flat(batch.column("earlier"))[1], _flat(batch.column("lines"))[1], strict=True)])
            cuts = np.unique(np.searchsorted(weight, np.arange(0, int(weight[-1]) if len(weight) else 0, PAIR_BYTES), "left"))
            for low, high in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                some, at, gone = batch.slice(low, high - low), [], []
                for i, (e, we, lines, words) in enumerate(zip(*(some.column(c).to_pylist() for c in ("earlier", "words_earlier", "lines", "words")), strict=True)):
                    if found := common_blocks(e, lines, words, we, block_words):
                        at.append(i)
                        gone.append(found)
                part = some.select(["k", "h"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("h"), pa.array(gone, pa.list_(pa.int32()))], ["k", "h", "gone"])

    lost = both.mapInArrow(align, "k long, h long, gone array<int>")
    lost = lost.groupBy("k", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))  # at most a list for each line of the document
    lost = written(lost, "deleted_lines")
    discard(outline, pairs)
    return lost


COUNTS = ("lines_before", "lines_deleted")


def dedup_lines(docs: DataFrame, block_words: int = BLOCK_WORDS, names: tuple[str, str] = COUNTS) -> DataFrame:
    """The documents with new text, and how many lines each had and lost under the names; columns with these names are replaced."""
    lost = deletions(docs.select("doc_id", "text"), block_words)
    keep = [F.col(f"d.`{c}`") for c in docs.columns if c not in ("text", *names)]
    k, h = _place()
    d = docs.withColumns({"__k": k, "__h": h}).alias("d")
    # a merge join at every size: the losses grow with the documents
    joined = d.join(lost.select("k", F.col("h").alias("lh"), "gone").alias("g").hint("merge"), (F.col("d.__k") == F.col("g.k")) & (F.col("d.__h") == F.col("g.lh")), "left")
    lines = _lines("d.text")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("g.gone"), i))
    return joined.select(
        *keep, F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(lines).cast("long").alias(names[0]), F.coalesce(F.array_size("g.gone"), F.lit(0)).cast("long").alias(names[1]),
    )
