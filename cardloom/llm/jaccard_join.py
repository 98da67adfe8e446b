"""Exact Jaccard join of shingle sets by partitioning the universe (pigeonhole).

Equal sets are one class. Two classes link at Jaccard 0.8 or more, so they differ in at most H = floor(n / 4) elements
for either's size n. Sizes fall into bands [2^b, 2^(b+1)); within a band the universe of hashes is cut into a fixed
number of segments. A class emits a key for each of its first K = ceil(1.6 (H + 1)) segments that hold any of its
elements; a class whose partners may be in the band below emits keys there too. Of its keys, at most H can differ
from a partner's that reaches as far, so a partner shares at least K - H of them. Sets of 4 to 7 elements differ by at most
one element: they emit a key of the whole set and one for each set with one element less (one-deletion
neighbourhood). Smaller sets link with equal ones only.

Cost-based allocation: keys held by one class only cost nothing and rule out partners; a class with fewer than K - H
shared keys asks for no partner, and one that shares fewer keys with asking classes than any of these needs is
no partner. Both rules are applied until they hardly remove anything. Classes that still ask leave out their K - H - 1 most
frequent keys, since a partner must share one of the rest. Classes that meet in these keys form families; the members of a
family are verified against each other exactly. A family of more than BLOCK is dealt into size classes (a partner is in the same or
the next one) and blocks: a family of any size is whole, its pairs of blocks are separate tasks. A task emits no more links
than are needed to connect what it found.

Hashes have 64 bits. Texts are read whole, in slices; null texts and texts without words link with nothing. Repeated
rows are in one class. A class of copies of any size sends its keys once for each task that reads it. Only doc_id
and text are read; an empty table gives an empty table. All joins are merge joins at every size: what they join grows with the
documents, and a broadcast would take it through the driver. If a class has H or fewer segments with elements (odds below 1e-9),
all keys are made with another seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, salted_join, slices, written
from .components import components
from .shingles import mix, set_hash, shingle_sets

NUMERATOR, DENOMINATOR = 4, 5  # Jaccard 0.8
SMALLEST, FIRST_BAND = 4, 3
BLOCK = 512
SEEDS, ROUNDS = 8, 6
FLUSH = 1 << 19


def most_apart(n: int) -> int:
    """Elements in which a set of n can differ from one at Jaccard 0.8 or more: of n + t elements a ninth at most."""
    return n // 4


def segments(band: int) -> int:
    """So many that H or fewer of them holding all elements is beyond chance, for up to 2.5 x 2^band elements, and so few that
    they hold several elements each."""
    return {3: 128, 4: 48, 5: 40}.get(band) or round(2.5 * (1 << band) / 2.9)


def bands(n: int) -> list[int]:
    """The bands in which a set of n emits keys: its own, and the one below if a partner may be there.
    Band 2 is that of the one-deletion neighbourhoods."""
    if n < SMALLEST:
        return []
    own = n.bit_length() - 1
    return [own, own - 1] if own > 2 and -(-NUMERATOR * n // DENOMINATOR) < 1 << own else [own]


def keys(h: np.ndarray, band: int, seed: int) -> tuple[np.ndarray, int]:
    """Keys of a sorted set in a band, and how many of them a partner shares at least. 0: too few segments."""
    tag = np.uint64((band + 64 * seed + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    if band < FIRST_BAND:
        each = mix(h + tag)
        whole = each.sum()
        return mix(np.concatenate([[whole], whole - each]) + tag), 1
    n = len(h)
    apart = most_apart(n)
    if seed:
        h = np.sort(mix(h + np.uint64(seed)))
    at = ((h >> np.uint64(32)) * np.uint64(segments(band))) >> np.uint64(32)
    begins = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    most = -(-8 * (apart + 1) // 5)
    if len(begins) <= apart:
        return np.zeros(0, np.uint64), 0
    end = begins[most] if len(begins) > most else n
    begins = begins[:most]
    total = np.add.reduceat(mix(h[:end] + tag), begins)
    return mix(total + at[begins] * np.uint64(0xD6E8FEB86659FD93) + tag), len(begins) - apart


def _sets(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch):
            n, s, needs = [], [], []
            for h in shingle_sets(some.column("text").to_pylist()):
                n.append(len(h))
                s.append(set_hash(h) if len(h) else None)
                needs.append([keys(h, b, seed)[1] for b in bands(len(h))])
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text_hash"), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(needs, pa.list_(pa.int32()))], ["doc_id", "text_hash", "n", "cls", "needs"])


def _signatures(batches: Iterator[pa.RecordBatch], seed: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Keys dealt into buckets: packed keys and their classes. A class that this task has seen is passed over."""
    seen: set[int] = set()
    held: list[tuple[np.ndarray, int, int]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        key = np.concatenate([k for k, _, _ in held])
        cls = np.repeat(np.array([c for _, c, _ in held], np.int64), [len(k) for k, _, _ in held])
        rank = np.repeat(np.array([r for _, _, r in held], np.uint8), [len(k) for k, _, _ in held])
        to = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(to, kind="stable")
        key, cls, rank, to = key[order], cls[order], rank[order], to[order]
        cuts = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
        rows = [(int(to[a]), key[a:b].tobytes(), cls[a:b].tobytes(), rank[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "classes", "ranks"])

    for batch in batches:
        for some in slices(batch):
            for h in shingle_sets(some.column("text").to_pylist()):
                if len(h) < SMALLEST or (cls := set_hash(h)) in seen:
                    continue
                seen.add(cls)
                for rank, b in enumerate(bands(len(h))):
                    held.append((keys(h, b, seed)[0], cls, rank))
                    count += len(held[-1][0])
            if count >= FLUSH:
                yield flush()
                count = 0
    if held:
        yield flush()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows stand by bucket. Of each bucket the keys that more than one class holds: key, cls, rank."""
    now, parts = None, []

    def found() -> pa.RecordBatch:
        key, cls, rank = (np.concatenate([np.frombuffer(p[i], t) for p in parts]) for i, t in enumerate((np.uint64, np.int64, np.uint8)))
        order = np.argsort(key, kind="stable")
        key, cls, rank = key[order], cls[order], rank[order]
        same = key[1:] == key[:-1]
        multiple = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        key, cls, rank = key[multiple], cls[multiple], rank[multiple]
        order = np.lexsort((cls, key))
        key, cls, rank = key[order], cls[order], rank[order]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])[: len(key)]
        key, cls, rank = key[first], cls[first], rank[first]
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        often = n[at]
        many = often > 1
        return pa.RecordBatch.from_arrays([pa.array(key[many].view(np.int64)), pa.array(cls[many]), pa.array(rank[many].astype(np.int32)), pa.array(often[many].astype(np.int64))], ["key", "cls", "rank", "often"])

    for batch in batches:
        for b, k, c, r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if b != now and parts:
                yield found()
                parts = []
            now = b
            parts.append((k, c, r))
    if parts:
        yield found()


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def links(sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows at Jaccard 0.8 or more, but for those that earlier pairs connect. side: 0 for rows of the first block,
    1 for those of the second; pairs within the second block are another task's."""
    n = np.array([len(s) for s in sets])
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    begins = np.concatenate([[0], np.flatnonzero(element[1:] != element[:-1]) + 1, [len(element)]])
    group = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    of_row = group[np.argsort(owner, kind="stable")]  # each row's elements, row by row
    ends = np.cumsum(n)
    forest, out = Forest(len(sets)), []
    for i in np.flatnonzero(side == side.min()).tolist():
        mine = of_row[ends[i] - n[i] : ends[i]]
        lengths = begins[mine + 1] - begins[mine]
        stop = np.cumsum(lengths)
        places = np.arange(stop[-1]) + np.repeat(begins[mine] - (stop - lengths), lengths)
        common = np.bincount(owner[places], minlength=len(sets))
        hit = common * DENOMINATOR >= NUMERATOR * (n + n[i] - common)
        for j in np.flatnonzero(hit).tolist():
            if j != i and forest.join(i, j):
                out.append((i, j))
    return out


def _verify(key: tuple, table: pa.Table) -> pa.Table:
    cls, side = table.column("cls").to_numpy(), table.column("side").to_numpy()
    texts = table.column("text").to_pylist()
    rows: dict[int, tuple[int, np.ndarray]] = {}
    for at in range(0, len(texts), 64):
        for i, h in enumerate(shingle_sets(texts[at : at + 64]), at):
            if len(h) and set_hash(h) == cls[i] and (cls[i] not in rows or rows[cls[i]][0] > side[i]):  # another row may have the doc_id
                rows[cls[i]] = (side[i], h)
    if len(rows) < 2:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    names = np.array(list(rows), np.int64)
    got = links([h for _, h in rows.values()], np.array([s for s, _ in rows.values()]))
    a, b = (names[[p[k] for p in got]] if got else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def peeled(rows: DataFrame) -> DataFrame:
    """rows (key, cls, rank, need): those of classes that may still have a partner, with `asks` and how often the key stands."""
    held = rows.groupBy("cls", "rank").agg(F.count("*").alias("held"), F.first("need").alias("least"))
    asking = held.where("held >= least").select("cls", "rank", F.lit(True).alias("asks"))
    marked = rows.select("key", "cls", "rank", "need").join(asking.hint("merge"), ["cls", "rank"], "left")
    by_key = marked.groupBy("key").agg(F.count("*").alias("often"), F.min(F.when(F.col("asks"), F.col("need"))).alias("wanted")).where("often > 1 and wanted is not null")
    kept = marked.join(by_key.hint("merge"), "key")
    able = kept.groupBy("cls", "rank").agg(F.count("*").alias("held"), F.first("need").alias("least"), F.min("wanted").alias("wanted"))
    able = able.where("held >= least or held >= wanted").select("cls", "rank", (F.col("held") >= F.col("least")).alias("still"))
    return kept.join(able.hint("merge"), ["cls", "rank"]).select("key", "cls", "rank", "need", "often", (F.coalesce("asks", F.lit(False)) & F.col("still")).alias("asks"))


def dealt_families(member: DataFrame) -> DataFrame:
    """member (cls, rep, n, family): cls, rep, family, and for each task that the class takes part in its name `at` and side."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR)) + 1e-9).cast("int")
    cell = member.withColumn("step", step)
    sizes = cell.groupBy("family", "step").agg(F.count("*").alias("many")).withColumn("own", F.ceil(F.col("many") / BLOCK).cast("int"))
    family = Window.partitionBy("family")  # a row for each size class of a family
    near = lambda by: F.max("own").over(family.orderBy("step").rangeBetween(by, by))
    count = sizes.select(F.struct("family", "step").alias("cell"), "own", F.sum("many").over(family).alias("all"), near(1).alias("above"), near(-1).alias("below"))
    known = salted_join(cell.withColumn("cell", F.struct("family", "step")), count.hint("merge"), "cell", "cls")
    block = F.pmod(F.xxhash64("cls"), F.col("own")).cast("int")

    def rows(others: str, low: Column, first: Column, second: Callable[[Column], tuple[Column, Column]], side: Callable[[Column], Column]) -> Column:
        n = F.coalesce(others, F.lit(0))
        name = lambda o: F.struct(F.concat_ws(":", low, first, *second(o)).alias("at"), side(o).alias("side"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), name)).otherwise(F.array().cast("array<struct<at:string,side:int>>"))

    text = lambda c: c.cast("string")
    same = rows("own", text(F.col("step")), F.lit("="), lambda o: (text(F.least(F.col("block"), o)), text(F.greatest(F.col("block"), o))), lambda o: (F.col("block") > o).cast("int"))
    up = rows("above", text(F.col("step")), F.lit("+"), lambda o: (text(F.col("block")), text(o)), lambda o: F.lit(0))
    down = rows("below", text(F.col("step") - 1), F.lit("+"), lambda o: (text(o), text(F.col("block"))), lambda o: F.lit(1))
    alone = F.array(F.struct(F.lit("all").alias("at"), F.lit(0).alias("side")))
    tasks = F.when(F.col("all") <= BLOCK, alone).otherwise(F.concat(same, up, down))
    return known.withColumn("block", block).select("cls", "rep", "family", F.explode(tasks).alias("t")).select("cls", "rep", "family", "t.at", "t.side")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach), text_hash, and root, which
    names the component where doc_ids are null or repeated; null for texts without words."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    buckets = 4 * partitions(spark)
    for seed in range(SEEDS):
        each = written(docs.mapInArrow(partial(_sets, seed=seed), "doc_id long, text_hash long, n long, cls long, needs array<int>"), "sets")
        if not each.where(F.exists("needs", lambda x: x == 0)).limit(1).count():
            break
        discard(each)
    else:
        raise RuntimeError("no seed spreads all sets over enough segments")
    classes = each.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("needs").alias("needs"))
    dealt = docs.mapInArrow(partial(_signatures, seed=seed, buckets=buckets), "bucket long, keys binary, classes binary, ranks binary")
    shared = dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "key long, cls long, rank int, often long")
    shared = written(shared, "shared")

    need = classes.select("cls", F.posexplode("needs").alias("rank", "need"))
    rows, held = shared.join(need.hint("merge"), ["cls", "rank"]), shared
    count = None
    for _ in range(ROUNDS):
        rows = written(peeled(rows), "peeled")
        discard(held)
        held = rows
        before, count = count, rows.count()
        if not count or before is not None and count > 0.9 * before:
            break
    costly = Window.partitionBy("cls", "rank").orderBy(F.desc("often"), "key")
    probes = rows.where("asks").withColumn("place", F.row_number().over(costly)).where("place >= need")
    met = written(rows.join(probes.select("key").distinct().hint("merge"), "key").select("key", "cls"), "met")
    discard(held)
    leader = met.groupBy("key").agg(F.min("cls").alias("a"))
    families = components(met.join(leader.hint("merge"), "key").select("a", F.col("cls").alias("b")))
    discard(met)

    member = families.join(classes.select("cls", "rep", "n").hint("merge"), families["node"] == F.col("cls"))
    placed = written(dealt_families(member.select("cls", "rep", "n", F.col("root").alias("family"))), "members")
    texts = docs.join(placed.hint("merge"), docs["doc_id"].eqNullSafe(F.col("rep"))).select("cls", "family", "at", "side", "text")
    found = written(texts.groupBy("family", "at").applyInArrow(_verify, "a long, b long"), "links")
    discard(placed)

    roots = components(found)
    discard(found)
    linked = roots.join(classes.select("cls", "rep").hint("merge"), F.col("node") == F.col("cls")).select("cls", "rep", "root")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = salted_join(linked, least.hint("merge"), "root", "cls").select("cls", "component_id", "root")
    alone = classes.join(roots.hint("merge"), F.col("cls") == F.col("node"), "left_anti").select("cls", F.col("rep").alias("component_id"), F.col("cls").alias("root"))
    lowest = linked.union(alone)
    return each.join(lowest.hint("merge"), "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "root")
