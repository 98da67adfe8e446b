import hashlib
import random

from pyspark.sql import functions as F

from cardloom.llm import fingerprints as P


def test_next_document_and_edit(spark, awkward, empty):
    assert not P.fingerprint_documents(empty).count()
    rng = random.Random(1)
    ids = rng.sample(range(-(10**15), 10**15), 300) + list(range(40))
    rows = [(i, "".join(rng.choice("ab é漢🙂") for _ in range(rng.randrange(30)))) for i in ids]
    got = {r.doc_id: r for r in P.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    down = sorted(rows, reverse=True)
    for (i, t), (_, nxt) in zip(down, down[1:] + down[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert (t != edited) or got[i].near_edited == 1.0
        assert 0 <= got[i].near_next <= 1
    out = P.fingerprint_documents(awkward).collect()
    assert len(out) == awkward.count()
    same = [r.fingerprint for r in out if r.doc_id in (5, 7)]
    assert len(same) == 3 and len(set(same)) == 1
    one = P.fingerprint_documents(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def test_search_finds_all(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(128), rng.randrange(8)):
                x ^= 1 << bit
            prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(x >> 64), signed(x & (1 << 64) - 1), 1 + i % 3) for i, x in enumerate(sorted(prints))]
    n = dict(zip(sorted(prints), [r[2] for r in rows], strict=True))
    df = spark.createDataFrame(rows, "f1 long, f2 long, n long")
    for radius in (0, 3, 4):
        got = {((r.f1 & (1 << 64) - 1) << 64) | r.f2 & (1 << 64) - 1: r.n_within for r in P.within(df.select("f1", "f2"), df, radius).collect()}
        assert got == {x: sum(n[y] for y in prints if (x ^ y).bit_count() <= radius) for x in prints}


def test_search_at_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(6)]
    prints = set(base)
    for b in base:
        for _ in range(60):
            x = b
            for bit in rng.sample(range(128), rng.randrange(P.RADIUS - 4, P.RADIUS + 5)):
                x ^= 1 << bit
            prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x >> 64), signed(x & (1 << 64) - 1), 1) for x in prints], "f1 long, f2 long, n long")
    got = {((r.f1 & (1 << 64) - 1) << 64) | r.f2 & (1 << 64) - 1: r.n_within for r in P.within(df.select("f1", "f2"), df).collect()}
    assert got == {x: sum((x ^ y).bit_count() <= P.RADIUS for y in prints) for x in prints}


def test_near_copies_count(spark):
    """Texts of 100 words with one word changed share 91 of 101 five-word shingles, a similarity of 0.9."""
    rng = random.Random(4)
    rows = []
    for i in range(0, 1000, P.QUERY_EVERY):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(100)]
        rows.append((i, " ".join(words)))
        words[rng.randrange(10, 90)] = "changed"
        rows.append((i + 1, " ".join(words)))
    got = {r.doc_id: r.n_within for r in P.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(0, 1000, P.QUERY_EVERY)] == [2] * 20
    assert all(got[i + 1] is None for i in range(0, 1000, P.QUERY_EVERY))


def test_votes_by_force(spark):
    text = "The quick brown fox jumps over the lazy dog and the quick cat"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    words = text.lower().split()
    pairs = spark.createDataFrame(list(zip(words, words[1:], strict=False)), "a string, b string").select(F.xxhash64("a", "b").alias("h1"), F.xxhash64("b", "a", F.lit(1)).alias("h2"), (1 + (F.length("a") + F.length("b") > P.LONG).cast("int")).alias("w")).collect()
    got = P.fingerprints(df, ["id"], "text").first()
    for name in ("h1", "h2"):
        want = 0
        for bit in range(64):
            vote = sum(p.w if p[name] >> bit & 1 else -p.w for p in pairs)
            want |= (vote > 0) << bit
        assert {"h1": got.f1, "h2": got.f2}[name] & (1 << 64) - 1 == want


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = P.fingerprint_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
