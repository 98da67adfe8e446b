"""Plans over vectors: neighbours, near duplicates, calibration, retrieval scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions import vectors as V
from cardloom.operators import evaluate, sampling, similarity

from .common import table

LOW_THRESHOLD = 0.40  # the test vectors have no pairs near 0.95


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector and the next of its label as its positive, with their similarity."""
    w = Window.partitionBy("label").orderBy("id")
    v = _vectors(spark, d)
    both = v.withColumns({"pid": F.lead("id").over(w), "pvec": F.lead("vec").over(w)}).where("pid is not null")
    return both.select("id", "vec", "label", "pid", V.dot("vec", "pvec").alias("pos"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select(F.col("id").alias("cid"), "vec", F.array(F.col("label").cast("string")).alias("tags"), F.col("label").cast("string").alias("grp"))


def _queries(spark: SparkSession, d: str, ceiling: float | None) -> DataFrame:
    bound = F.lit(ceiling).cast("double")
    return _vectors(spark, d).select(F.col("id").alias("qid"), "vec", F.col("id").alias("own"), bound.alias("ceiling"), F.array(F.col("label").cast("string")).alias("tags"), F.col("label").cast("string").alias("grp"))


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return similarity.top_k(_queries(spark, d, None), _candidates(spark, d), 8).select("qid", "cid", "sim", "rank")


def knn_single(spark: SparkSession, d: str) -> DataFrame:
    """Few neighbours, and of these the first that qualifies: one of another label."""
    few = similarity.top_k(_queries(spark, d, None), _candidates(spark, d), 4).select("qid", "cid", "sim", "rank")
    label = _vectors(spark, d).select("id", "label")
    named = few.join(label.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid").join(label.select(F.col("id").alias("cid"), F.col("label").alias("cl")), "cid")
    return sampling.first_by(named.where("ql <> cl"), ["qid"], ["rank"]).select("qid", "cid", "sim")


def knn_percpos(spark: SparkSession, d: str) -> DataFrame:
    """Hard negatives under 0.95 of each query's similarity to its positive, which is left out itself."""
    q = _pairs(spark, d).select(F.col("id").alias("qid"), "vec", F.col("pid").alias("own"), (F.col("pos") * similarity.CEILING).alias("ceiling"))
    return similarity.top_k(q, _candidates(spark, d)).select("qid", "cid", "sim", "rank")


def knn_disjoint_label(spark: SparkSession, d: str) -> DataFrame:
    return similarity.top_k(_queries(spark, d, 0.95), _candidates(spark, d), 8, disjoint_tags=True).select("qid", "cid", "sim", "rank")


def knn_two_tier(spark: SparkSession, d: str) -> DataFrame:
    return similarity.top_k(_queries(spark, d, 0.30), _candidates(spark, d), 3, prefer_same_group=True).select("qid", "cid", "sim", "rank", "tier")


def knn_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    """Pairs (even vector, its odd successor), mined both ways: each side's items among the other side's."""
    v = _vectors(spark, d)
    pairs = v.where("id % 2 = 0").alias("a").join(v.where("id % 2 = 1").alias("b"), F.col("b.id") == F.col("a.id") + 1)
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.vec").alias("av"), F.col("b.vec").alias("bv"), (V.dot("a.vec", "b.vec") * similarity.CEILING).alias("ceiling"))
    outs = []
    for way, (q, qv, c, cv) in {"forward": ("a", "av", "b", "bv"), "back": ("b", "bv", "a", "av")}.items():
        asked = pairs.select(F.col(q).alias("qid"), F.col(qv).alias("vec"), F.col(c).alias("own"), "ceiling")
        among = pairs.select(F.col(c).alias("cid"), F.col(cv).alias("vec"))
        outs.append(similarity.top_k(asked, among, 8).select(F.lit(way).alias("way"), "qid", "cid", "sim", "rank"))
    return outs[0].union(outs[1])


def unique_space(spark: SparkSession, d: str) -> DataFrame:
    """Equal items once, with the first card that has it: labels stand in for items."""
    return _vectors(spark, d).groupBy("label").agg(F.min("id").alias("first"), F.count("*").alias("cards"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """The space of unique items: an item that several cards have stands once, with the vector of its first card. Two neighbours in number
    share an item here, and its id is a hash, as ids of content are."""
    cards = _cards(spark, d)
    first = cards.groupBy("item").agg(F.min("id").alias("first"), F.count("*").alias("cards"))
    return first.join(cards.select(F.col("id").alias("first"), "vec"), "first").select("item", "first", "cards", "vec")


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards with the id of their own item and of their positive's."""
    named = lambda n: F.substring(F.sha2(F.concat(F.lit("item||"), n.cast("string")), 256), 1, 32)
    n = F.floor(F.col("id") / 2)
    return _vectors(spark, d).select("id", "vec", named(n).alias("item"), named(n + 1).alias("positive"))


def item_space(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item", "first", "cards")


def knn_item_space(spark: SparkSession, d: str) -> DataFrame:
    """Cards joined with their positives by the item's id, and mined among unique items: neither the positive itself nor an item as near
    as 0.95 of it."""
    items = _items(spark, d)
    pairs = _cards(spark, d).join(items.select(F.col("item").alias("positive"), F.col("first").alias("own"), F.col("vec").alias("pvec")), "positive")
    asked = pairs.select(F.col("id").alias("qid"), "vec", "own", (V.dot("vec", "pvec") * similarity.CEILING).alias("ceiling"))
    got = similarity.top_k(asked, items.select(F.col("first").alias("cid"), "vec"))
    return got.join(items.select(F.col("first").alias("cid"), "item"), "cid").select("qid", "item", "sim", "rank")


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """The vectors, and near copies of some under other sources: the first number is moved a little."""
    v = _vectors(spark, d).select("id", "vec", "label")
    moved = F.transform("vec", lambda x, i: F.when(i == 0, x.cast("double") + 0.01).otherwise(x.cast("double")))
    copies = v.where("id % 25 = 0").select((F.col("id") + 1_000_000).alias("id"), moved.alias("vec"), (F.col("label") + 1).alias("label"))
    both = v.select("id", F.col("vec").cast("array<double>").alias("vec"), "label").union(copies)
    return both.select("id", "vec", F.col("label").cast("string").alias("src"), F.col("label").alias("priority"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("id", "vec", F.col("label").cast("string").alias("src"), F.col("label").alias("priority"))


def near_dup_cross(spark: SparkSession, d: str) -> DataFrame:
    return similarity.cross_source_duplicates(_sources(spark, d), LOW_THRESHOLD)


def near_dup_cross_default(spark: SparkSession, d: str) -> DataFrame:
    return similarity.cross_source_duplicates(_planted(spark, d))


def near_dup_greedy(spark: SparkSession, d: str) -> DataFrame:
    return similarity.greedy_keepers(_vectors(spark, d), LOW_THRESHOLD)


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.calibration(_pairs(spark, d), "pos", "label")


def decile_filter(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.above_quantile(_pairs(spark, d), "pos", 0.10, "label").select("id", "label", F.round("pos", 4).alias("pos"))


def quartile_gate(spark: SparkSession, d: str) -> DataFrame:
    """Pairs at the floor that the calibration sets, its lower quartile, which must pass often enough."""
    return evaluate.passes_calibrated(_pairs(spark, d), "pos", 0.25).select("id", F.round("pos", 4).alias("pos"))


def neg_hist(spark: SparkSession, d: str) -> DataFrame:
    """How many negatives queries got; those without any count too."""
    mined = knn_percpos(spark, d).groupBy("qid").agg(F.count("*").alias("k"))
    return _pairs(spark, d).select(F.col("id").alias("qid")).join(mined, "qid", "left").groupBy(F.coalesce("k", F.lit(0)).alias("k")).agg(F.count("*").alias("queries"))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of vectors with one of their label among the first neighbours."""
    labels = _vectors(spark, d).select("id", "label")
    ranked = similarity.top_k(_queries(spark, d, None), _candidates(spark, d), 5)
    named = ranked.join(labels.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid").join(labels.select(F.col("id").alias("cid"), F.col("label").alias("cl")), "cid")
    return evaluate.recall(named, F.col("ql") == F.col("cl"))


def recall_both_ways(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    even, odd = v.where("id % 2 = 0"), v.where("id % 2 = 1").withColumn("pair", F.col("id") - 1)
    q1 = even.select(F.col("id").alias("qid"), "vec", F.lit(None).cast("long").alias("own"), F.lit(None).cast("double").alias("ceiling"))
    q2 = odd.select(F.col("pair").alias("qid"), "vec", F.lit(None).cast("long").alias("own"), F.lit(None).cast("double").alias("ceiling"))
    forward = similarity.top_k(q1, odd.select(F.col("pair").alias("cid"), "vec"), 5)
    back = similarity.top_k(q2, even.select(F.col("id").alias("cid"), "vec"), 5)
    hit = F.col("qid") == F.col("cid")
    return evaluate.recall(forward, hit).withColumn("way", F.lit("forward")).union(evaluate.recall(back, hit).withColumn("way", F.lit("back")))


def mrl_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall with leading dimensions only."""
    outs = None
    for size in (32, 16, 8):
        v = _vectors(spark, d).select("id", "label", V.prefix("vec", size).alias("vec"))
        q = v.select(F.col("id").alias("qid"), "vec", F.col("id").alias("own"), F.lit(None).cast("double").alias("ceiling"))
        ranked = similarity.top_k(q, v.select(F.col("id").alias("cid"), "vec"), 5)
        named = ranked.join(v.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid").join(v.select(F.col("id").alias("cid"), F.col("label").alias("cl")), "cid")
        one = evaluate.recall(named, F.col("ql") == F.col("cl")).withColumn("dims", F.lit(size))
        outs = one if outs is None else outs.union(one)
    return outs


def infonce(spark: SparkSession, d: str) -> DataFrame:
    """Each pair's loss among its own negatives: the positive against the mined ones."""
    pos = _pairs(spark, d).select(F.col("id").alias("qid"), F.lit(True).alias("positive"), F.round("pos", 4).alias("sim"))
    neg = knn_percpos(spark, d).select("qid", F.lit(False).alias("positive"), "sim")
    return evaluate.contrastive_loss(pos.union(neg)).select("qid", F.round("loss", 3).alias("loss"))


RUNGS, BATCH = (64, 32, 16, 8), 32


def infonce_symmetric(spark: SparkSession, d: str) -> DataFrame:
    """The loss both ways and at every rung, of batches of pairs with the best negative of each."""
    v = _vectors(spark, d).select("id", "vec")
    pairs = _pairs(spark, d).select("id", "pid").join(v.select("id", F.col("vec").alias("anchor")), "id").join(v.select(F.col("id").alias("pid"), F.col("vec").alias("positive")), "pid")
    batch = F.floor(F.col("id") / BATCH).alias("batch")
    mined = knn_percpos(spark, d).where("rank = 1").select(F.col("qid").alias("id"), F.col("cid").alias("nid")).join(v.select(F.col("id").alias("nid"), "vec"), "nid")
    out = evaluate.symmetric_loss(pairs.select(batch, "id", "anchor", "positive"), mined.select(batch, "vec"), RUNGS)
    return out.select("batch", "pairs", F.round("loss", 3).alias("loss"))


def mutual_knn(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of neighbours in all dimensions and in the first half."""
    v = _vectors(spark, d)
    half = v.select("id", V.prefix("vec", 32).alias("vec"))
    full = similarity.top_k(_queries(spark, d, None), _candidates(spark, d), 10)
    q = half.select(F.col("id").alias("qid"), "vec", F.col("id").alias("own"), F.lit(None).cast("double").alias("ceiling"))
    return evaluate.neighbour_overlap(full, similarity.top_k(q, half.select(F.col("id").alias("cid"), "vec"), 10))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return v.select("id", F.round(V.norm("vec"), 4).alias("norm"), F.round(V.cosine("vec", F.reverse("vec")), 4).alias("mirror"), F.round(V.normalized("vec", 1e-8)[0], 4).alias("first"))


def embedding_checksum(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.checksum(_vectors(spark, d), "vec")


def run_spread(spark: SparkSession, d: str) -> DataFrame:
    runs = _vectors(spark, d).groupBy("label").agg(F.avg(F.col("vec")[0].cast("double")).alias("score"))
    return evaluate.spread(runs, "score")


QUERIES = {
    f.__name__: f
    for f in (knn_topk, knn_single, knn_percpos, knn_disjoint_label, knn_two_tier, knn_bidirectional, unique_space, near_dup_cross, near_dup_cross_default, near_dup_greedy, calibration, decile_filter, quartile_gate, neg_hist, recall_at_k, recall_both_ways, mrl_recall, infonce, infonce_symmetric, item_space, knn_item_space, mutual_knn, vector_norms, embedding_checksum, run_spread)
}

_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
_P = "p AS (SELECT id, vec, label, pid, list_dot_product(vec, pvec) AS pos FROM (SELECT *, lead(id) OVER w AS pid, lead(vec) OVER w AS pvec FROM v WINDOW w AS (PARTITION BY label ORDER BY id)) WHERE pid IS NOT NULL)"
_S = "s AS (SELECT a.id AS qid, b.id AS cid, a.label AS ql, b.label AS cl, list_dot_product(a.vec, b.vec) AS sim FROM v a, v b)"
_RANK = "row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid)"
_MINED = f"m AS (SELECT qid, cid, round(sim, 4) AS sim, rank FROM (SELECT s.*, {_RANK} AS rank FROM s JOIN p ON p.id = s.qid WHERE cid <> p.pid AND sim < 0.95 * p.pos) WHERE rank <= 8)"
_DUPS = """SELECT CASE WHEN (a.label, a.id) < (b.label, b.id) THEN b.label ELSE a.label END::VARCHAR AS source, CASE WHEN (a.label, a.id) < (b.label, b.id) THEN b.id ELSE a.id END AS id,
 CASE WHEN (a.label, a.id) < (b.label, b.id) THEN a.label ELSE b.label END::VARCHAR AS dup_of_source, CASE WHEN (a.label, a.id) < (b.label, b.id) THEN a.id ELSE b.id END AS dup_of, round(list_dot_product(a.vec, b.vec), 4) AS sim
 FROM v a JOIN v b ON a.id < b.id AND a.label <> b.label WHERE list_dot_product(a.vec, b.vec) >= {}"""
_UNIT = "list_transform(list_slice(vec, 1, {0}), lambda x: x / sqrt(list_dot_product(list_slice(vec, 1, {0}), list_slice(vec, 1, {0}))))"


def _recall_sql(ranked: str, hit: str) -> str:
    return f"SELECT count(*) AS n_queries, round(avg(r1), 4) AS r1, round(avg(r5), 4) AS r5 FROM (SELECT qid, max(({hit} AND rank <= 1)::INT) AS r1, max(({hit} AND rank <= 5)::INT) AS r5 FROM ({ranked}) GROUP BY qid)"


def _way(q: str, c: str) -> str:
    return f"SELECT qid, cid, round(sim, 4) AS sim, rank FROM (SELECT a.{q} AS qid, b.{c} AS cid, list_dot_product(a.{q}v, b.{c}v) AS sim, row_number() OVER (PARTITION BY a.{q} ORDER BY list_dot_product(a.{q}v, b.{c}v) DESC, b.{c}) AS rank FROM pr a JOIN pr b ON b.{c} <> a.{c} AND list_dot_product(a.{q}v, b.{c}v) < a.ceiling) WHERE rank <= 8"


_CARDS = "c AS (SELECT id, vec, left(sha256('item||' || (id // 2)), 32) AS item, left(sha256('item||' || (id // 2 + 1)), 32) AS positive FROM v)"


def _symmetric_sql() -> str:
    rungs = ", ".join(f"({r})" for r in RUNGS)
    unit = lambda x: f"list_transform(list_slice({x}, 1, d), lambda y: y / sqrt(list_dot_product(list_slice({x}, 1, d), list_slice({x}, 1, d))))"
    entropy = lambda name, other: f"SELECT d, batch, id, ln(sum(exp(x - top))) + any_value(top) - any_value(own) AS l FROM (SELECT *, max(x) OVER (PARTITION BY d, id) AS top, max(CASE WHEN id = oid THEN x END) OVER (PARTITION BY d, id) AS own FROM {other}) GROUP BY d, batch, id"
    return f"""WITH {_V}, {_P}, {_S}, {_MINED}, g(d) AS (VALUES {rungs}),
 e AS (SELECT g.d, p.id, p.id // {BATCH} AS batch, {unit('p.vec')} AS a, {unit('w.vec')} AS b FROM p JOIN v w ON w.id = p.pid, g),
 n AS (SELECT g.d, m.qid // {BATCH} AS batch, {unit('w.vec')} AS b FROM m JOIN v w ON w.id = m.cid, g WHERE m.rank = 1),
 f AS (SELECT x.d, x.batch, x.id, y.id AS oid, list_dot_product(x.a, y.b) / 0.05 AS x FROM e x JOIN e y ON x.d = y.d AND x.batch = y.batch UNION ALL SELECT x.d, x.batch, x.id, NULL, list_dot_product(x.a, n.b) / 0.05 FROM e x JOIN n ON x.d = n.d AND x.batch = n.batch),
 h AS (SELECT x.d, x.batch, x.id, y.id AS oid, list_dot_product(x.b, y.a) / 0.05 AS x FROM e x JOIN e y ON x.d = y.d AND x.batch = y.batch)
 SELECT batch, count(DISTINCT id) AS pairs, round(avg(l), 3) AS loss FROM ({entropy('out', 'f')} UNION ALL {entropy('back', 'h')}) GROUP BY batch"""


ORACLES = {
    "knn_topk": f"WITH {_V}, {_S} SELECT qid, cid, round(sim, 4) AS sim, rank FROM (SELECT *, {_RANK} AS rank FROM s WHERE qid <> cid) WHERE rank <= 8",
    "knn_single": f"WITH {_V}, {_S} SELECT qid, cid, round(sim, 4) AS sim FROM (SELECT *, {_RANK} AS rank FROM s WHERE qid <> cid) WHERE rank <= 4 AND ql <> cl QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) = 1",
    "knn_percpos": f"WITH {_V}, {_P}, {_S}, {_MINED} SELECT * FROM m",
    "knn_disjoint_label": f"WITH {_V}, {_S} SELECT qid, cid, round(sim, 4) AS sim, rank FROM (SELECT *, {_RANK} AS rank FROM s WHERE qid <> cid AND ql <> cl AND sim < 0.95) WHERE rank <= 8",
    "knn_two_tier": f"WITH {_V}, {_S} SELECT qid, cid, round(sim, 4) AS sim, rank, tier FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, sim DESC, cid) AS rank FROM (SELECT *, (ql <> cl)::INT AS tier FROM s WHERE qid <> cid AND sim < 0.3)) WHERE rank <= 3",
    "knn_bidirectional": f"WITH {_V}, pr AS (SELECT a.id AS a, b.id AS b, a.vec AS av, b.vec AS bv, 0.95 * list_dot_product(a.vec, b.vec) AS ceiling FROM v a JOIN v b ON b.id = a.id + 1 WHERE a.id % 2 = 0) SELECT 'forward' AS way, * FROM ({_way('a', 'b')}) UNION ALL SELECT 'back' AS way, * FROM ({_way('b', 'a')})",
    "unique_space": "SELECT label, min(vec_id) AS first, count(*) AS cards FROM embeddings GROUP BY label",
    "near_dup_cross": f"WITH {_V} {_DUPS.format(LOW_THRESHOLD)}",
    "near_dup_cross_default": f"WITH v0 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings), v AS (SELECT * FROM v0 UNION ALL SELECT id + 1000000, list_concat([vec[1] + 0.01], vec[2:]), label + 1 FROM v0 WHERE id % 25 = 0) {_DUPS.format(0.95)}",
    "near_dup_greedy": f"""WITH RECURSIVE {_V}, near AS (SELECT b.id, coalesce(list(a.id) FILTER (WHERE a.id IS NOT NULL), []) AS early FROM v b LEFT JOIN v a ON a.id < b.id AND list_dot_product(a.vec, b.vec) > {LOW_THRESHOLD} GROUP BY b.id),
 o AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM near),
 r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN list_has_any(o.early, r.kept) THEN r.kept ELSE list_append(r.kept, o.id) END FROM r JOIN o ON o.i = r.i + 1)
 SELECT unnest(kept) AS id FROM (SELECT kept FROM r ORDER BY i DESC LIMIT 1)""",
    "item_space": f"WITH {_V}, {_CARDS} SELECT item, min(id) AS first, count(*) AS cards FROM c GROUP BY item",
    "knn_item_space": f"""WITH {_V}, {_CARDS}, i AS (SELECT item, min(id) AS first, arg_min(vec, id) AS vec FROM c GROUP BY item), q AS (SELECT c.id, c.vec, i.first AS own, 0.95 * list_dot_product(c.vec, i.vec) AS ceiling FROM c JOIN i ON i.item = c.positive)
 SELECT id AS qid, item, round(sim, 4) AS sim, rank FROM (SELECT q.id, i.item, list_dot_product(q.vec, i.vec) AS sim, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.vec, i.vec) DESC, i.first) AS rank FROM q JOIN i ON i.first <> q.own AND list_dot_product(q.vec, i.vec) < q.ceiling) WHERE rank <= 8""",
    "infonce_symmetric": _symmetric_sql(),
    "calibration": f"WITH {_V}, {_P} SELECT label, count(*) AS n, " + ", ".join(f"round(quantile_cont(pos, {q}), 4) AS {k}" for k, q in evaluate.QUANTILES.items()) + ", round(avg(pos), 4) AS mean, round(quantile_cont(pos, 0.5) * 0.95, 4) AS ceiling FROM p GROUP BY label",
    "decile_filter": f"WITH {_V}, {_P} SELECT id, p.label, round(pos, 4) AS pos FROM p JOIN (SELECT label, quantile_cont(pos, 0.1) AS b FROM p GROUP BY label) q ON p.label = q.label WHERE pos >= b",
    "quartile_gate": f"WITH {_V}, {_P} SELECT id, round(pos, 4) AS pos FROM p WHERE pos >= (SELECT round(quantile_cont(pos, 0.25), 4) FROM p)",
    "neg_hist": f"WITH {_V}, {_P}, {_S}, {_MINED} SELECT k, count(*) AS queries FROM (SELECT p.id, count(m.cid) AS k FROM p LEFT JOIN m ON m.qid = p.id GROUP BY p.id) GROUP BY k",
    "recall_at_k": f"WITH {_V}, {_S} " + _recall_sql(f"SELECT *, {_RANK} AS rank FROM s WHERE qid <> cid", "ql = cl"),
    "recall_both_ways": f"WITH {_V}, e AS (SELECT id AS pair, vec FROM v WHERE id % 2 = 0), o AS (SELECT id - 1 AS pair, vec FROM v WHERE id % 2 = 1) "
    + " UNION ALL ".join(
        f"SELECT *, '{way}' AS way FROM ({_recall_sql(f'SELECT *, {_RANK} AS rank FROM (SELECT a.pair AS qid, b.pair AS cid, list_dot_product(a.vec, b.vec) AS sim FROM {x} a, {y} b)', 'qid = cid')})" for way, x, y in (("forward", "e", "o"), ("back", "o", "e"))
    ),
    "mrl_recall": f"WITH {_V} "
    + " UNION ALL ".join(
        f"SELECT *, {k} AS dims FROM ({_recall_sql(f'SELECT *, {_RANK} AS rank FROM (SELECT a.id AS qid, b.id AS cid, a.label AS ql, b.label AS cl, list_dot_product(a.u, b.u) AS sim FROM (SELECT id, label, {_UNIT.format(k)} AS u FROM v) a, (SELECT id, label, {_UNIT.format(k)} AS u FROM v) b WHERE a.id <> b.id)', 'ql = cl')})" for k in (32, 16, 8)
    ),
    "infonce": f"WITH {_V}, {_P}, {_S}, {_MINED}, c AS (SELECT id AS qid, true AS positive, round(pos, 4) / 0.05 AS x FROM p UNION ALL SELECT qid, false, sim / 0.05 FROM m), t AS (SELECT qid, max(x) AS top, max(CASE WHEN positive THEN x END) AS own FROM c GROUP BY qid) SELECT c.qid, round(ln(sum(exp(x - top))) + top - own, 3) AS loss FROM c JOIN t ON c.qid = t.qid GROUP BY c.qid, top, own",
    "mutual_knn": f"WITH {_V}, {_S}, f AS (SELECT qid, cid FROM s WHERE qid <> cid QUALIFY {_RANK} <= 10), h AS (SELECT qid, cid FROM (SELECT a.id AS qid, b.id AS cid, list_dot_product(a.u, b.u) AS sim FROM (SELECT id, {_UNIT.format(32)} AS u FROM v) a, (SELECT id, {_UNIT.format(32)} AS u FROM v) b WHERE a.id <> b.id) QUALIFY {_RANK} <= 10) SELECT round(avg(c), 4) AS overlap FROM (SELECT f.qid, count(h.cid) / 10.0 AS c FROM f LEFT JOIN h ON f.qid = h.qid AND f.cid = h.cid GROUP BY f.qid)",
    "vector_norms": f"WITH {_V}, n AS (SELECT *, sqrt(list_dot_product(vec, vec)) AS l FROM v) SELECT id, round(l, 4) AS norm, round(list_dot_product(vec, list_reverse(vec)) / (l * l), 4) AS mirror, round(vec[1] / greatest(l, 1e-8), 4) AS first FROM n",
    "embedding_checksum": "SELECT round(sum(x::DOUBLE), 3) AS checksum FROM (SELECT unnest(embedding) AS x FROM embeddings)",
    "run_spread": "SELECT round(stddev_pop(score), 6) AS sigma, round(greatest(2 * stddev_pop(score), 0.002), 6) AS eps FROM (SELECT label, avg(embedding[1]::DOUBLE) AS score FROM embeddings GROUP BY label)",
}
