import random

import numpy as np
from pyspark.sql import functions as F

from cardloom.llm import line_dedup as L


def test_longest_increasing_by_force():
    rng = random.Random(1)
    for _ in range(200):
        x = rng.sample(range(20), rng.randrange(9))
        got = L.increasing(x)
        best = 0
        for m in range(1 << len(x)):
            y = [v for i, v in enumerate(x) if m >> i & 1]
            best = max(best, len(y) * (y == sorted(y)))
        assert len(got) == best and [x[i] for i in got] == sorted(x[i] for i in got)


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(30) for _ in range(rng.randrange(40))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(3)] = [rng.randrange(60) for _ in range(rng.randrange(3))]
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
    assert L.patience([1, 2, 3, 4, 5], [1, 9, 3, 4, 8, 5]) == [(0, 0), (2, 2), (3, 3), (4, 5)]


def blocks(earlier, later, words):
    return L.common_blocks(earlier, later, words, [30] * len(earlier))


def test_blocks():
    words = [30] * 6
    assert blocks([1, 2, 3], [9, 2, 3, 8, 7, 6], words) == [1, 2]
    assert blocks([2, 3], [9, 2, 3], [5, 6, 7]) == []  # too short
    assert L.common_blocks([2, 3], [2, 3], [5, 6], [5, 6]) == [0, 1]  # all there is
    assert L.common_blocks([1, 2, 3], [2, 3], [5, 6], [5, 5, 6]) == []  # a part of more
    assert blocks([1, 2, 3, 4], [3, 4, 1, 2], [30] * 4) == [0, 1, 2, 3]  # moved
    assert L.common_blocks([1, 2, 9, 1, 2], [8, 1, 2, 7], [15] * 4, [15] * 5) == [1, 2]  # no line stands once in the earlier one


def line(name, n=25):
    return " ".join(f"{name}{i}" for i in range(n))


def test_documents(spark, awkward, empty):
    rows = [
        (1, f"{line('a')}\n{line('b')}\nshort one here ok\n{line('c')}"), (2, f"{line('x')}\n  {line('b')}\nshort one here ok\n{line('y')}"), (3, f"{line('a')}\n{line('b')}\nshort one here ok\n{line('c')}"),
        (4, f"{line('z')}\nshort one here ok"), (5, line("w")), (6, line("w") + "\n\n"), (7, None), (8, ""), (9, "tiny"), (10, "tiny"),
    ]
    got = {r.doc_id: (r.text, r.lines_deleted) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == (f"{line('x')}\n{line('y')}", 2) and got[3] == ("", 4)
    assert got[4] == (rows[3][1], 0) and got[5][1] == 0 and got[6] == ("", 3) and got[7] == (None, 0) and got[8] == ("", 0) and got[9] == ("tiny", 0) and got[10] == ("", 1) and got[6] == ("", 3)
    out = L.dedup_lines(awkward)
    assert {*awkward.columns} <= {*out.columns} and out.count() == awkward.count()
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert (7, "") in kept and (5, "one two three four five six seven") in kept and not L.dedup_lines(empty).count()


def test_windows_by_force():
    rng = random.Random(3)
    docs = [[(rng.randrange(6) + 1, rng.randrange(8)) for _ in range(rng.randrange(12))] for _ in range(60)]
    want = set()
    for d, doc in enumerate(docs):
        for i in range(len(doc)):
            for j in range(i, len(doc)):
                total = lambda a, b, doc=doc: sum(w for _, w in doc[a:b])
                if total(i, j + 1) >= 20 and ((doc[i][1] and total(i, j) < 20) or (doc[j][1] and total(i + 1, j + 1) < 20)):
                    want.add((d, tuple(x for x, _ in doc[i : j + 1])))
    flat = [x for doc in docs for x in doc]
    short = {d: tuple(x for x, w in doc if w) for d, doc in enumerate(docs) if 0 < sum(w for _, w in doc) < 20}
    doc, said = L.windows(np.array([x * 7**20 for x, _ in flat]), np.array([w for _, w in flat], np.int32), np.array([len(d) for d in docs]), 20)
    assert len(set(said.tolist())) == len({w for _, w in want}) + len(set(short.values())) and sorted(doc.tolist()) == sorted([*(d for d, _ in want), *short])


def lost_by_force(docs, least=20):
    """Lines in runs that an earlier document has too, of as many words at least, by comparing all pairs and all places. Blank lines
    are left out of the comparison's ends."""
    gone = {}
    for d, (later, words) in enumerate(docs):
        for e in range(d):
            earlier = docs[e][0]
            if 0 < sum(words) < least and later == earlier:
                gone.setdefault(d, set()).update(range(len(later)))
            for i in range(len(earlier)):
                for j in range(len(later)):
                    k = 0
                    while i + k < len(earlier) and j + k < len(later) and earlier[i + k] == later[j + k]:
                        k += 1
                    if sum(words[j : j + k]) >= least:
                        gone.setdefault(d, set()).update(range(j, j + k))
    return gone


def test_all_overlaps_by_force(spark):
    """Every line of every block that any earlier document has is deleted, and no other: recall and precision 1."""
    rng = random.Random(11)
    said = {x: " ".join(f"w{x}n{i}" for i in range(rng.choice([1, 3, 6, 9, 15, 25]))) for x in range(60)}
    pool = [[rng.randrange(60) for _ in range(rng.randrange(1, 8))] for _ in range(25)]
    docs = []
    for _ in range(120):
        doc = []
        for _ in range(rng.randrange(1, 4)):
            doc += rng.choice(pool) if rng.random() < 0.6 else [rng.randrange(60) for _ in range(rng.randrange(1, 5))]
        docs.append((doc, [len(said[x].split()) for x in doc]))
    rows = [(i, "\n".join(said[x] for x in doc)) for i, (doc, _) in enumerate(docs)]
    got = {r.k: set(r.gone) for r in L.deletions(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = lost_by_force(docs)
    assert len(want) > 60 and got == want


def test_the_same_at_any_number_of_copies(spark):
    banner = "\n".join(line(f"banner{i}", 9) for i in range(6))
    for copies in (32, 33, 40):
        rows = [(i, f"{line(f'own{i}', 30)}\n{banner}") for i in range(copies)]
        assert sum(r.lines_deleted for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 6 * (copies - 1)


def test_frequent_short_lines(spark):
    verse = "\n".join(line(f"v{i}", 6) for i in range(9))
    rows = [(i, f"{line(f'head{i}')}\n{verse}\n{line(f'tail{i}')}") for i in range(40)]
    got = {r.doc_id: r.lines_deleted for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: 9 * (i > 0) for i in range(40)}


def test_block_whose_lines_an_earlier_document_scatters(spark):
    said = [line(f"s{i}", 10) for i in range(5)]
    apart = "\n".join(f"{x}\n{line(f'between{i}')}" for i, x in enumerate(said[::-1]))
    block = "\n".join(said)
    rows = [(1, apart), (2, f"{line('b')}\n{block}"), (3, f"{block}\n{line('c')}")]
    got = {r.doc_id: (r.text, r.lines_deleted) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (apart, 0), 2: (rows[1][1], 0), 3: (line("c"), 5)}


def test_lines_of_few_words_and_unspaced_text(spark):
    few = "\n".join(line(f"f{i}", 3) for i in range(20))
    unspaced = "\n".join("".join(chr(0x4E00 + 40 * i + j) for j in range(12)) for i in range(5))
    rows = [(1, f"{line('a')}\n{few}"), (2, f"{few}\n{line('b')}"), (3, f"{line('c')}\n{unspaced}"), (4, f"{unspaced}\n{line('d')}")]
    got = {r.doc_id: (r.text, r.lines_deleted) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == (line("b"), 20) and got[4] == (line("d"), 5) and got[1][1] == got[3][1] == 0


def test_first_holder_keeps_every_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.dedup_lines(docs).cache()
    said = lambda df: df.select(F.explode(F.split("text", "\n")).alias("l")).select(F.trim("l").alias("l")).distinct()
    assert not said(docs).exceptAll(said(out)).count()
    assert out.where("lines_deleted = 0").join(docs, ["doc_id", "text"]).count() == out.where("lines_deleted = 0").count()
    long = out.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.size(F.split(F.trim("l"), r"\s+")) >= L.BLOCK_WORDS)
    assert not long.groupBy(F.trim("l")).agg(F.countDistinct("doc_id").alias("n")).where("n > 1").count()
