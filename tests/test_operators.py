import itertools
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardloom.functions import vectors as V
from cardloom.operators import cards, evaluate, guards, parsers, reports, sampling, shards, similarity, validate, views
from cardloom.plans import cards as card_plans
from cardloom.plans import vectors as vector_plans

SF = "/root/testdata/sf0.01"


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vec array<float>")


def at_angle(*degrees):
    return [(np.cos(np.radians(d)), np.sin(np.radians(d))) for d in degrees]


def test_greedy_is_not_all_pairs(spark):
    """A chain: 1 is near 0 and 2, but 0 and 2 are apart. 2 stays, as what it is near to was dropped."""
    v = vectors(spark, at_angle(0, 15, 30, 45, 200))
    assert sorted(r.id for r in similarity.greedy_keepers(v, 0.95).collect()) == [0, 2, 4]
    crossed = similarity.cross_source_duplicates(v.withColumns({"src": F.col("id").cast("string"), "priority": F.col("id")}), 0.95)
    assert sorted((r.id, r.dup_of) for r in crossed.collect()) == [(1, 0), (2, 1), (3, 2)]


def test_thresholds_include_or_not(spark):
    v = vectors(spark, [(1, 0), (0.5, 0), (0.25, 0), (1, 0)])
    assert {(r.a, r.b) for r in similarity.pairs_above(v, 0.5).collect()} == {(0, 1), (0, 3), (1, 3)}
    assert {(r.a, r.b) for r in similarity.pairs_above(v, 0.5, inclusive=False).collect()} == {(0, 3)}


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k_by_force(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(40, 4)), 1)
    tags = [[str(x) for x in rng.choice(4, rng.integers(0, 3))] for _ in v]
    q = spark.createDataFrame([(i, v[i].tolist(), i, float(rng.choice([0.5, 2.0])) if i % 3 else None, tags[i], str(i % 3)) for i in range(40)], "qid long, vec array<double>, own long, ceiling double, tags array<string>, grp string")
    c = q.select(F.col("qid").alias("cid"), "vec", "tags", "grp")
    ceiling = {r.qid: r.ceiling for r in q.collect()}
    for disjoint, group in itertools.product((False, True), repeat=2):
        got = {}
        for r in similarity.top_k(q, c, 5, disjoint, group).sort("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.cid, round(r.sim, 4)))
        for i in range(40):
            row = [(int(group and j % 3 != i % 3), -(v[i] @ v[j]), j) for j in range(40) if j != i and (ceiling[i] is None or v[i] @ v[j] < ceiling[i]) and not (disjoint and set(tags[i]) & set(tags[j]))]
            assert [c for c, _ in got.get(i, [])] == [j for _, _, j in sorted(row)[:5]]


def side(ids, vec, own=None, ceiling=None, tags=None, grp=None):
    n = len(ids)
    table = {"id": pa.array(ids, pa.int64()), "vec": pa.array(list(vec)), "own": pa.array(own or [None] * n, pa.int64()), "ceiling": pa.array(ceiling or [None] * n, pa.float64())}
    table |= {"tags": pa.array(tags or [None] * n, pa.list_(pa.string())), "grp": pa.array(grp or [None] * n, pa.string())}
    return similarity._Side(pa.table(table), tags is not None, grp is not None)


@pytest.mark.parametrize("set_pairs", [1 << 20, 0])
def test_single_precision_decides_nothing(monkeypatch, set_pairs):
    """Tiles smaller than the table; copies, similarities that single precision can't tell apart or doesn't hold, and ceilings among them."""
    for name, value in (("ROWS", 7), ("COLUMNS", 16), ("AT_ONCE", 5), ("SET_PAIRS", set_pairs)):
        monkeypatch.setattr(similarity, name, value)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(40, 6)), 1 + 1e-9 * rng.normal(size=(60, 6)), np.ones((40, 6)), np.full((10, 6), 1e-30), np.full((4, 6), 1e25)])
    v = v[rng.permutation(len(v))]
    n, k = len(v), 5
    ids = rng.permutation(n).tolist()
    tags = [[str(x) for x in rng.choice(4, rng.integers(0, 3))] for _ in v]
    groups = [[None, "a", "b", "c"][x] for x in rng.integers(0, 4, n)]
    ceiling = [[None, 6.0, float(v[i] @ v[i]), float(v[i] @ v[i - 1]), -3.0][x] for i, x in enumerate(rng.integers(0, 5, n))]
    for disjoint, group in itertools.product((False, True), repeat=2):
        q, c = (side(ids, v, ids, ceiling, tags if disjoint else None, groups if group else None) for _ in "qc")
        c.without_copies(k + 1)
        got = {}
        for r, j, sims, tier in similarity._matched(q, c, k, disjoint, group):
            for a, b, x in zip(q.id[r].tolist(), c.id[j].tolist(), sims.tolist(), strict=True):
                got.setdefault(a, []).append((tier, -x, b))
        for i in range(n):
            row = [(int(group and groups[i] != groups[j]), -(v[i] @ v[j]), ids[j]) for j in range(n) if j != i and (ceiling[i] is None or v[i] @ v[j] < ceiling[i]) and not (disjoint and set(tags[i]) & set(tags[j]))]
            assert sorted(got.get(ids[i], []))[:k] == sorted(row)[:k]


def test_top_k_takes_little_more_than_its_products():
    """134 million pairs: sorting every row of them took about a minute of CPU time."""
    rng = np.random.default_rng(6)
    q, c = (side(range(n), rng.normal(size=(n, 64)).astype(np.float32), tags=[[str(i % 10)] for i in range(n)]) for n in (8192, 16384))
    begin = time.process_time()
    assert sum(len(r) for r, *_ in similarity._matched(q, c, 8, True, False)) == 8 * 8192
    assert time.process_time() - begin < 10
    assert similarity._sides(600_000, 600_000, 12) == (15, 5) and similarity._sides(500, 500, 12) == (1, 1)


def test_overlap_reads_its_tables_once(spark):
    plan = vector_plans.mutual_knn(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
    a, b = (spark.createDataFrame(x, "qid int, cid int") for x in ([(1, 2), (1, 3), (2, 1)], [(1, 3), (1, 4), (3, 1)]))
    assert evaluate.neighbour_overlap(a, b).first().overlap == 0.25


def test_lengths_are_computed_once_a_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0, 9.0],), ([],), (None,)], "v array<float>").select(V.prefix("v", 2).alias("v"))
    assert [r.v for r in df.collect()] == [[0.6, 0.8], [], None]
    plan = spark.range(1).select(V.normalized(F.array("id")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert "array_repeat(SQRT(aggregate(" in plan


def test_copies_dont_multiply(spark):
    """A candidate's copies: those with the smallest ids count."""
    q = spark.range(3).select(F.col("id").alias("qid"), F.array(F.lit(1.0), F.lit(0.5)).alias("vec"), F.col("id").alias("own"), F.lit(None).cast("double").alias("ceiling"))
    c = spark.range(3000).select(F.col("id").alias("cid"), F.array(F.lit(1.0), F.when(F.col("id") < 2900, 0.5).otherwise(0.25)).alias("vec"))
    got = sorted((r.qid, r["rank"], r.cid) for r in similarity.top_k(q, c, 3).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 0), (1, 2, 2), (1, 3, 3), (2, 1, 0), (2, 2, 1), (2, 3, 3)]


def test_first_passing(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate([0, 1, 0, 1, 1, 0])] + [("b", 9, 0)], "k string, o int, p int")
    got = sampling.first_passing(df, ["k"], "o", F.col("p") == 1, 2)
    assert sorted((r.k, r.o, r.taken) for r in got.collect()) == [("a", 0, False), ("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 9, False)]


def test_substrings_by_force(spark):
    """Items behind quotes and brackets, inside words, short ones, ones with breaks, and frequent openings."""
    rng = np.random.default_rng(3)
    words = ["alpha", "(beta", "gam", "gamma\"", "d", "eps,", "zeta🙂", "ä", "", "the"]
    texts = [(i, "".join(str(rng.choice(words)) + str(rng.choice([" ", "\n", " ", "\t"])) for _ in range(rng.integers(0, 40)))) for i in range(150)] + [(900, None), (901, "")]
    items = []
    for i in range(120):
        t = texts[int(rng.integers(0, 150))][1]
        a = int(rng.integers(0, max(len(t), 1)))
        items.append((i, t[a : a + int(rng.choice([1, 2, 5, 9, 20, 60]))]))
    items += [(500, None), (501, ""), (502, "not there at all in any of them"), (503, "the the the"), (504, "🙂 ä")]
    got = guards.holding(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", spark.createDataFrame(items, "item_id long, text string"), "item_id")
    assert sorted(tuple(r) for r in got.collect()) == sorted((d, i) for d, t in texts for i, x in items if t and x and x in t)


def test_places_in_the_order(spark):
    df = spark.createDataFrame([("a", i * i) for i in range(101)] + [("b", 5), (None, 7), (None, 3)], "k string, o int").repartition(5)
    assert sorted((str(r.k), r.o) for r in sampling.first_middle_last(df, "k", "o").collect()) == [("None", 3), ("None", 7), ("a", 0), ("a", 2500), ("a", 10000), ("b", 5)]
    assert [r.o for r in sampling.front_slice(df.where("k = 'a'"), "o", 3, 4).collect()] == [16, 25, 36]
    got = evaluate.order_statistics(df.withColumn("v", F.col("o") * 0.5), "k", "v", {"m": 0.5, "top": 0.99}).collect()
    assert sorted((str(r.k), r.m, r.top) for r in got) == [("None", 3.5, 3.5), ("a", 1250.0, 4900.5), ("b", 2.5, 2.5)]


def test_symmetric_loss_by_force(spark):
    rng = np.random.default_rng(4)
    a, p, n = rng.normal(size=(12, 8)), rng.normal(size=(12, 8)), rng.normal(size=(5, 8))
    pairs = spark.createDataFrame([(i // 6, i, a[i].tolist(), p[i].tolist()) for i in range(12)], "batch long, id long, anchor array<double>, positive array<double>")
    negatives = spark.createDataFrame([(0, x.tolist()) for x in n], "batch long, vec array<double>")
    got = {r.batch: r.loss for r in evaluate.symmetric_loss(pairs, negatives, (8, 4), 0.1).collect()}
    for batch in (0, 1):
        total = 0.0
        for d in (8, 4):
            unit = lambda v, d=d: v[:d] / np.linalg.norm(v[:d])
            mine = range(6 * batch, 6 * batch + 6)
            for i in mine:
                extra = [unit(x) for x in n] if batch == 0 else []
                out = np.array([unit(a[i]) @ unit(p[j]) for j in mine] + [unit(a[i]) @ x for x in extra]) / 0.1
                back = np.array([unit(p[i]) @ unit(a[j]) for j in mine]) / 0.1
                total += (np.log(np.exp(out).sum()) - out[i % 6] + np.log(np.exp(back).sum()) - back[i % 6]) / 2 / 6
        assert got[batch] == pytest.approx(total / 2)


def test_numbers_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("o"), (F.col("id") % 3).cast("string").alias("k")).repartition(7)
    assert sorted(r.n for r in sampling.numbered(df, "o", "n").collect()) == list(range(1000))
    by = sampling.numbered(df, "o", "n", "k").groupBy("k").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.countDistinct("n").alias("c")).collect()
    assert all(r.a == 0 and r.b == r.c - 1 for r in by)


def test_guards(spark):
    rows = spark.createDataFrame([("images/val2014/x_000000000007.jpg",), ("images/t/eval.jpg",), ("images/t/y_000000000007.jpg",), ("images/t/free.jpg",)], "member string")
    got = guards.member_guard(rows, "member", spark.createDataFrame([("eval.jpg",)], "name string"), spark.createDataFrame([("000000000007",)], "id string"))
    assert sorted(str(r.drop_reason) for r in got.collect()) == ["None", "basename", "id", "split"]
    pages = spark.createDataFrame([(1, "a", "p"), (2, "a", "q"), (3, "b", "p"), (4, "a", "p")], "o int, dedup_hash string, sha string")
    none = spark.createDataFrame([], "dedup_hash string")
    assert sorted(r.o for r in guards.page_dedup(pages, none, "o").collect()) == [1, 3]
    assert sorted(r.o for r in guards.page_dedup(pages, none, "o", by_page=True).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="not this one"):
        guards.refuse(pages, F.col("o") == 4, "not this one").collect()
    assert guards.guard_set(none, pages.select("dedup_hash")).count() == 2


def test_every_subset_has_a_parser():
    assert {p for _, _, _, p, _ in parsers.SUBSETS} == set(parsers.rules()) and {k for _, _, k, _, _ in parsers.SUBSETS} <= {k[0] for k in parsers.KINDS}


def test_parser_lengths_and_misses(spark):
    rows = [("<|image_1|>\nx matches the given caption: " + "c" * 20,), ("x matches the given caption: short",), ("nothing",), ("Retrieve an image of this news caption." + " d" * 12,)]
    df = spark.createDataFrame([(*r, "p", "i", "j") for r in rows], "qry string, pos_text string, qry_image_path string, pos_image_path string")
    assert [r.drop_reason for r in parsers.parsed(df, "text_to_image").collect()] == [None, "length", "parse", None]


def test_each_rule_alone(spark):
    """One card for each rule, which breaks it and no other."""
    got = {}
    for r in validate.violations(card_plans._cards(spark, SF)).collect():
        got.setdefault(r.card_id, []).append(r.rule)
    assert all(len(v) == 1 for v in got.values()) and {v[0] for v in got.values()} == set(card_plans.BROKEN) - {""}


def test_cards_of_documents_without_text(spark, tmp_path):
    """Empty and null texts: a card breaks the rule that its number says, and no other."""
    import duckdb

    texts = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 1, "").when(F.col("id") % 4 == 2, F.concat(F.lit("said "), "id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.execute(card_plans.ORACLES["validate_cards"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in card_plans.validate_cards(spark, str(tmp_path)).collect()) == sorted(want)


def test_content_order_and_band(spark):
    df = spark.createDataFrame([(["x", "y", "z", None, "w"], [0.75, 0.92, 0.93, 0.8, 0.85])], "n array<string>, s array<double>")
    assert [(r["name"], r["nth"]) for r in df.select(cards.in_band(F.col("n"), F.col("s")).alias("b")).first().b] == [("y", 2), ("w", 5), ("x", 1)]
    items = spark.createDataFrame([(["image", "text", "audio"], True), (["text", "image"], False), (["text"], True)], "k array<string>, ok boolean")
    content = F.transform("k", lambda k: F.struct(k.alias("type")))
    assert all(r.a == r.ok for r in items.select(cards.in_order(content).alias("a"), "ok").collect())
    one = df.select(F.array(cards.item("text", F.lit("t")), cards.item("image", F.lit("i"))).alias("c"))
    assert one.select(F.forall("c", cards.one_of).alias("a")).first().a
    assert one.select(cards.with_instruction(F.col("c"), F.lit("Do")).alias("c")).first().c[0].text == "Do"


def test_filling_reaches_k(spark):
    pool = spark.range(30).select(F.col("id").alias("card_id"))
    mined = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "card_id long, neg_id long, rank int")
    got = cards.filled(pool, mined, pool)
    by = {}
    for r in got.collect():
        by.setdefault(r.card_id, []).append((r.rank, r.neg_id, r.random))
    assert len(by) == 30 and all(len({n for _, n, _ in v}) == 8 and c not in {n for _, n, _ in v} for c, v in by.items())
    assert [n for _, n, _ in sorted(by[1])[:2]] == [5, 6]


def test_ratchet_and_tripwire(spark):
    scores = spark.createDataFrame(list(enumerate([0.01, 0.011, 0.0121, 0.02, 0.019, 0.022])), "step int, r1 double")
    assert [r.kept for r in evaluate.ratchet(scores, "step", "r1").sort("step").collect()] == [True, False, True, True, False, False]
    both = scores.withColumn("r2", F.when(F.col("step") == 3, 0.0).otherwise(F.col("r1")))
    assert [r.kept for r in evaluate.lanes_ratchet(both, "step", ["r1", "r2"]).sort("step").collect()] == [True, False, True, False, True, True]
    series = [1.0] * 30 + [50.0] * 12
    nan = [1.0, float("nan"), 1.0]
    losses = spark.createDataFrame([("a", i, v) for i, v in enumerate(series)] + [("b", i, v) for i, v in enumerate(nan)] + [("c", i, 1.0) for i in range(40)], "k string, i int, v double")

    def by_rule(values):
        ema, run = None, 0
        for n, v in enumerate(values, 1):
            if not np.isfinite(v):
                return n
            ema = v if ema is None else 0.98 * ema + 0.02 * v
            run = run + 1 if n > 20 and v > 3 * ema + 2 else 0
            if run >= 10:
                return n
        return None

    got = {r.k: r.halt for r in evaluate.ema_tripwire(losses, "k", "i", "v").collect()}
    assert got == {"a": by_rule(series), "b": 2, "c": None} and got["a"]


def test_contrastive_loss(spark):
    sims = [(1, True, 0.9), (1, False, 0.1), (1, False, 0.5), (2, True, 0.2)]
    got = {r.qid: r.loss for r in evaluate.contrastive_loss(spark.createDataFrame(sims, "qid int, positive boolean, sim double"), 0.1).collect()}
    x = np.array([9.0, 1.0, 5.0])
    assert got[1] == pytest.approx(np.log(np.exp(x).sum()) - 9) and got[2] == pytest.approx(0)


def test_shards_are_verified(spark):
    samples = spark.createDataFrame([(i % 2, f"k{i}", bytes([i])) for i in range(6)], "shard int, key string, data binary")
    expected = shards.manifest(samples)
    assert not shards.verified(samples, expected).count()
    changed = samples.withColumn("data", F.when(F.col("key") == "k3", F.lit(b"x")).otherwise(F.col("data")))
    assert [r.shard for r in shards.verified(changed, expected).collect()] == [1]
    assert [r.shard for r in shards.verified(samples.where("shard = 0"), expected).collect()] == [1]


def test_views(spark):
    log = spark.createDataFrame([("a", 1, False, 5.0, 16000), ("a", 2, True, 5.0, 16000), ("b", 1, True, 31.0, 16000), ("c", 1, True, 5.0, 8000), ("d", 1, True, 5.0, 16000), ("e", 1, True, 5.0, 16000)], "card_id string, at int, passed boolean, seconds double, rate int")
    texts = spark.createDataFrame([(x, f"t{x}", "said" if x != "e" else "") for x in "abcde"], "card_id string, task_id string, text string")
    got = views.spoken_views(log, texts, spark.createDataFrame([("td",)], "task_id string"))
    assert [r.card_id for r in got.collect()] == ["a"]
    ids = spark.range(3)
    assert views.realigned(ids, ids.withColumn("v", F.col("id") * 2)).count() == 3
    with pytest.raises(Exception, match="no cached row for 2"):
        views.realigned(ids, spark.range(2)).collect()
    assert {(r.id, r.side) for r in views.same_rows(ids, spark.range(1, 4), "id").collect()} == {(0, "left"), (3, "right")}


def test_reports(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "lane string, card_id int")
    text = reports.data_card("Set", reports.lane_totals(rows), "CC0")
    assert "| x | 1 | 2 |" in text and "| all | 2 | 3 |" in text
    pin = reports.fingerprint(rows)
    assert reports.pinned(rows.repartition(3), pin).count() == 3
    with pytest.raises(ValueError):
        reports.pinned(rows.limit(2), pin)
    assert "&lt;b&gt;" in reports.spot_check(spark.createDataFrame([("<b>",)], "t string"), ["t"])
    assert reports.report(rows, F.count("*").alias("n")) == '{"n": 3}'
