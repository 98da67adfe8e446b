import hashlib
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardloom.llm import sharding as S


def least_by_force(sizes, shards):
    n = len(sizes)
    return min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, n), strict=True)) for k in range(min(shards, n)) for c in combinations(range(1, n), k))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 4))
def test_cut_is_minimax(sizes, shards):
    ends = S.cut(np.array(sizes), shards)
    assert len(ends) == shards and ends[-1] == len(sizes) and (np.diff(ends) >= 0).all()
    largest = max(sum(sizes[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True))
    assert largest == least_by_force(sizes, shards)


def best(sizes, shards):
    ends = S.cut(sizes, shards)
    return np.diff(np.concatenate([[0], np.cumsum(sizes)[ends - 1]])).max()


def test_refined_cuts_are_exact(spark):
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 60, 400), (1 << 59) + rng.integers(0, 1 << 20, 600)]))
    for name, sizes in {"even": rng.integers(1, 500, len(keys)), "skewed": (rng.pareto(0.5, len(keys)) * 10 + 1).astype(np.int64), "hot": np.where(np.arange(len(keys)) == 500, 200_000, rng.integers(1, 500, len(keys)))}.items():
        cuts = S.boundaries(spark.createDataFrame(list(zip(keys.tolist(), sizes.tolist(), strict=True)), "key long, size long"), 16)
        shard = np.searchsorted(np.array(cuts), keys, "right")
        assert np.bincount(shard, weights=sizes).max() == best(sizes, 16), name


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_the_driver_sees_few_rows(spark, hot):
    key = F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 15), 16, 10).cast("long")
    groups = spark.range(1_000_000).select(key.alias("key"), F.when(F.col("id") == 77, F.lit(int(hot / (1 - hot) * 300 * 1e6) + 1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(600)) + 1).alias("size"))
    asked = []
    cuts = S.boundaries(groups, 16, asked)
    assert max(asked) <= 20_000 and len(asked) > 2
    got = groups.orderBy("key").toPandas()
    sizes = got["size"].to_numpy()
    assert np.bincount(np.searchsorted(np.array(cuts), got["key"], "right"), weights=sizes).max() == best(sizes, 16)


def test_whole_query(spark):
    """Cuts of the table against the whole list of groups."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = S.shard(docs).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    sizes, shards = {}, {}
    for r in rows:
        key = int(hashlib.sha256(texts[r.doc_id]).hexdigest()[:15], 16)
        assert r.size == len(texts[r.doc_id]) + 1 and shards.setdefault(key, r.shard) == r.shard
        sizes[key] = sizes.get(key, 0) + r.size
    keys = sorted(sizes)
    ends = S.cut(np.array([sizes[k] for k in keys]), 16)
    assert [shards[k] for k in keys] == np.searchsorted(ends, np.arange(len(keys)), "right").tolist()


def test_table(awkward, empty):
    rows, docs = S.shard(awkward).collect(), awkward.collect()
    assert not S.shard(empty).count()
    text = lambda r: (r.text or "").encode()
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len(text(r)) + 1, zlib.crc32(text(r))) for r in docs)
    slots = {}
    for r in rows:
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.text_crc32, r.shard) for r in rows}) == len({r.text_crc32 for r in rows})


def test_a_group_of_a_third(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    sums = S.shard(docs).groupBy("shard").sum("size").toPandas()["sum(size)"].sort_values().tolist()
    assert sums[-1] == 10_000 and len(sums) == 16 and max(sums[:-1]) <= 1.2 * sum(sums[:-1]) / 15  # the group has a shard of its own
