import random
import re

import numpy as np
import pytest

from cardloom.llm import jaccard_join as J
from cardloom.llm.components import components
from cardloom.llm.shingles import mix, set_hash, shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def by_force(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, (d, s) in enumerate(sets):
        r = root(i)
        low[r] = min(low.get(r, d), d)
    return sorted((d, len(s), low[root(i)]) for i, (d, s) in enumerate(sets))


def test_sets_are_those_of_words():
    rng = random.Random(1)
    texts = [None, "", " \t", "a", "A a A a", "one Two three four five", "É\xa0é x\x0by\x1cz " * 3] + ["".join(rng.choice("aB é\n\x0c漢") for _ in range(rng.randrange(200))) for _ in range(200)]
    got = shingle_sets(texts)
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    hashes = {}
    for t, s in zip(texts, got, strict=True):
        hashes.setdefault(shingles(t), set()).add(set_hash(s))
    assert all(len(v) == 1 for v in hashes.values()) and len({min(v) for v in hashes.values()}) == len(hashes)


def test_long_words_and_blocks(monkeypatch):
    data = np.frombuffer(b"ab " * 300000 + b"x" * 600000 + b" ab", np.uint8)
    h, starts = word_hashes(data)
    assert len(h) == 300002 and len(set(h.tolist())) == 2 and h[0] == h[-1] and len(starts) == len(h)


def test_structured_words_do_not_collide():
    """Words for which every polynomial modulo a power of two gives the same hash (Thue and Morse), and others with a pattern."""
    thue = ["a"]
    for _ in range(12):
        thue.append(thue[-1] + thue[-1].translate(str.maketrans("ab", "ba")))
    words = [w for t in thue[1:] for w in (t, t.translate(str.maketrans("ab", "ba")))] + ["a" * n for n in range(2, 300)] + ["b" * 64 + "a" * n for n in range(200)]
    h, _ = word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8))
    assert len(set(h.tolist())) == len(set(words))


@pytest.mark.parametrize("seed", [0, 3])
def test_partners_share_enough_keys(seed):
    """At the similarity's bound, in every size band: what a partner shares is never less than what is asked for."""
    rng = np.random.default_rng(1)
    for n in [*range(4, 70), 100, 127, 128, 160, 250, 256, 319, 500, 1023, 1024, 1300, 4000]:
        for _ in range(6):
            t = int(rng.integers(n, 5 * n // 4 + 1))
            least = -(-4 * (n + t) // 9)
            if least > n:
                continue
            pool = mix(rng.integers(1, 1 << 63, n + t - least).astype(np.uint64))
            r, s = np.sort(pool[:n]), np.sort(pool[n - least :])
            assert len(np.intersect1d(r, s)) * 5 >= 4 * len(np.union1d(r, s))
            common = [b for b in J.bands(len(r)) if b in J.bands(len(s))]
            assert common
            need, found = [], []
            for b in common:
                (k1, n1), (k2, n2) = J.keys(r, b, seed), J.keys(s, b, seed)
                assert n1 > 0 and n2 > 0
                need.append(min(n1, n2))
                found.append(len(np.intersect1d(k1, k2)))
            assert any(f >= w for f, w in zip(found, need, strict=True))


def families(rng, groups, sizes):
    docs = []
    for g in range(groups):
        base = [f"w{g}x{rng.randrange(40)}" for _ in range(rng.choice(sizes))]
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                if w:
                    i = rng.randrange(len(w))
                    w[i : i + 1] = rng.choice([[], ["new%d" % rng.randrange(99)], [w[i], "more"]])
            docs.append((rng.randrange(10**6), " ".join(w)))
    return docs


@pytest.mark.parametrize("block", [512, 3])
def test_against_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(block)
    passage = " ".join(f"common{i}" for i in range(60))
    docs = families(rng, 70, [1, 3, 5, 6, 8, 9, 10, 12, 14, 20, 35, 60, 150, 400])
    docs += [(2 * 10**6 + i, f"{passage} " + " ".join(f"own{i}y{j}" for j in range(rng.randrange(5, 90)))) for i in range(60)]
    docs += [(3 * 10**6 + i, " ".join(f"t{j}" if rng.random() > 0.03 else f"z{i}{j}" for j in range(150))) for i in range(40)]
    docs = list({i: (i, t) for i, t in docs}.values())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r)[:3] for r in J.jaccard_components(df).collect()) == by_force(docs)


def test_table(awkward, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(awkward).collect()), key=str)
    assert not J.jaccard_components(empty).count()
    assert got == sorted([(None, 1, None), (1, 0, 1), (2, 0, 2), (4, 1, 4), (5, 3, 5), (5, 3, 5), (7, 3, 5), (9, 0, 9), (11, 1, 11), (12, 1, 12)], key=str)


def test_components_by_force(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got.get(x, x) == root(x) for x in up) and all(root(x) == r for x, r in got.items())
    assert not components(spark.createDataFrame([], "a long, b long")).count()


def test_no_join_goes_through_the_driver(spark):
    """Tables that grow with the documents are not broadcast, however small these are."""
    store = spark._jsparkSession.sharedState().statusStore()
    drained = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = lambda: {e.executionId(): e.physicalPlanDescription() for e in (found.apply(i) for found in [store.executionsList()] for i in range(found.size()))}
    drained()
    before = set(plans())
    docs = families(random.Random(2), 10, [6, 20, 60])
    J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    drained()
    ran = [p for i, p in plans().items() if i not in before]
    assert not [p for p in ran if "BroadcastExchange" in p]
    assert sum("SortMergeJoin" in p for p in ran) > 5
