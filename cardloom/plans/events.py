"""Plans over event logs, gate outcomes and the generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import evaluate, sampling
from cardloom.operators.guards import drop_counts
from cardloom.streaming import incremental

from .common import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def dedup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("user_id", "event_id", "event_type", "value")
    return incremental.last_wins(rows, "user_id", "event_id")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """One score for each hour, as evaluations of checkpoints."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return _events(spark, d).groupBy(hour.alias("step")).agg(F.round(F.avg("value"), 4).alias("score"), F.round(F.max("value"), 4).alias("other"))


def ratchet_fold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ratchet(_scores(spark, d), "step", "score", 1.0)


def ratchet_lanes(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.lanes_ratchet(_scores(spark, d), "step", ["score", "other"], 1.0)


def ema_tripwire(spark: SparkSession, d: str) -> DataFrame:
    """A user's events stand for the losses of one run."""
    return evaluate.ema_tripwire(_events(spark, d), "user_id", "event_id", "value", patience=2, times=2.0, plus=0.0)


def flat_lines(spark: SparkSession, d: str) -> DataFrame:
    """Users whose values stayed low for the first hours of the log."""
    hours = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600.0
    return evaluate.flat_lines(_events(spark, d).select("user_id", hours.alias("hour"), "value"), "user_id", "hour", "value", 40.0, 36.0)


def retention(spark: SparkSession, d: str) -> DataFrame:
    saved = F.unix_timestamp(F.col("ts").cast("timestamp"))
    points = _events(spark, d).where("event_type = 'signup'").select(F.col("event_id").alias("step"), saved.alias("saved"), (F.col("event_id") % 100 == 0).alias("kept"))
    return evaluate.retained(points).select("step")


def gate_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.gate_rates(rows, (F.col("quality") == 1) & (F.col("toxic") == 0), "lang")


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    points = _events(spark, d).select("event_type", "value", F.explode(F.array(*[F.lit(float(x)) for x in (5, 10, 50, 100)])).alias("threshold"))
    return evaluate.gate_rates(points, F.col("value") <= F.col("threshold"), "event_type", "threshold")


def order_stat(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.order_statistics(_events(spark, d), "event_type", "value", {"median": 0.5, "p90": 0.9, "p10": 0.1})


def resume_filter(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last event is no end: errors are tried again."""
    states = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "overlength").otherwise("error")
    log = _events(spark, d).select("user_id", F.col("event_id").alias("at"), states.alias("state"))
    return incremental.pending(log.select("user_id").distinct(), log, "user_id")


def ready_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    chunks = docs.select("source", (F.col("doc_id") % 3).alias("chunk")).distinct()
    done = docs.join(table(spark, d, "labels"), "doc_id", "left_semi").select("source", (F.col("doc_id") % 3).alias("chunk")).distinct()
    return incremental.ready(chunks, done)


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = incremental.sessions(_events(spark, d), "user_id", "ts", F.expr("interval 6 hours"))
    return rows.groupBy("user_id").agg(F.max("session").alias("sessions"), F.count("*").alias("events"))


def stream_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The same as dedup_last_wins over a drained file stream."""
    src = incremental.scratch(spark, "stream-in")
    rows = _events(spark, d).select("event_id", "user_id", "value")
    rows.repartition(4, "user_id").write.parquet(src)
    out = incremental.drain(spark, src, "event_id long, user_id long, value double", incremental.scratch(spark, "stream-state"), incremental.scratch(spark, "stream-out"), files=1)
    return incremental.last_wins(out.select("event_id", "user_id", "value"), "user_id", "event_id")


def speaker_bins(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer stand for a speaker's clips: bins along shuffled customers."""
    from cardloom.operators.cards import grouped_bins

    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("speaker"), F.col("o_orderkey").alias("clip"))
    return grouped_bins(rows, "speaker", "clip", 1000).groupBy("bin").agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("speakers"))


def segment_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals by segment and nation, by segment, and of all; a check on the generic tables."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("c_mktsegment", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def line_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums over lines by flag and status."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.count("*").alias("lines"))


def capped_parts(spark: SparkSession, d: str) -> DataFrame:
    """The first lines of each part in hashed order."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return sampling.first_by(rows, ["l_partkey"], [sampling.shuffled(F.concat_ws("-", "l_orderkey", "l_linenumber")), "l_orderkey", "l_linenumber"], 3)


def event_drops(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 100, "high")
    return drop_counts(_events(spark, d).withColumn("drop_reason", reason), "user_id")


QUERIES = {
    f.__name__: f
    for f in (dedup_last_wins, ratchet_fold, ratchet_lanes, ema_tripwire, flat_lines, retention, gate_rates, threshold_sweep, order_stat, resume_filter, ready_sources, event_sessions, stream_last_wins, speaker_bins, segment_rollup, line_totals, capped_parts, event_drops)
}

_SCORES = "s AS (SELECT floor(epoch(ts) / 3600)::BIGINT AS step, round(avg(value), 4) AS score, round(max(value), 4) AS other FROM events GROUP BY 1)"
_EMA = """CASE WHEN a.halt IS NOT NULL THEN a ELSE {'ema': CASE WHEN a.ema IS NULL THEN x.v ELSE 0.98 * a.ema + 0.02 * x.v END,
 'run': CASE WHEN a.n + 1 > 20 AND x.v > 2.0 * CASE WHEN a.ema IS NULL THEN x.v ELSE 0.98 * a.ema + 0.02 * x.v END THEN a.run + 1 ELSE 0 END, 'n': a.n + 1,
 'halt': CASE WHEN (CASE WHEN a.n + 1 > 20 AND x.v > 2.0 * CASE WHEN a.ema IS NULL THEN x.v ELSE 0.98 * a.ema + 0.02 * x.v END THEN a.run + 1 ELSE 0 END) >= 2 THEN a.n + 1 END, 'v': x.v} END"""

ORACLES = {
    "dedup_last_wins": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "ratchet_fold": f"""WITH RECURSIVE {_SCORES}, o AS (SELECT *, row_number() OVER (ORDER BY step) AS i FROM s),
 r AS (SELECT i, step, score, score > 1.0 AS kept, CASE WHEN score > 1.0 THEN score ELSE 0.0 END AS best FROM o WHERE i = 1
 UNION ALL SELECT o.i, o.step, o.score, o.score - r.best > 1.0, CASE WHEN o.score - r.best > 1.0 THEN o.score ELSE r.best END FROM r JOIN o ON o.i = r.i + 1)
 SELECT step, score AS value, kept, best FROM r""",
    "ratchet_lanes": f"""WITH RECURSIVE {_SCORES}, o AS (SELECT *, row_number() OVER (ORDER BY step) AS i FROM s),
 r AS (SELECT i, step, score > 1.0 AND other > 1.0 AS kept, CASE WHEN score > 1.0 AND other > 1.0 THEN score ELSE 0.0 END AS b1, CASE WHEN score > 1.0 AND other > 1.0 THEN other ELSE 0.0 END AS b2 FROM o WHERE i = 1
 UNION ALL SELECT o.i, o.step, o.score - b1 > 1.0 AND o.other - b2 > 1.0, CASE WHEN o.score - b1 > 1.0 AND o.other - b2 > 1.0 THEN o.score ELSE b1 END, CASE WHEN o.score - b1 > 1.0 AND o.other - b2 > 1.0 THEN o.other ELSE b2 END FROM r JOIN o ON o.i = r.i + 1)
 SELECT step, kept FROM r""",
    "ema_tripwire": f"SELECT user_id, round(z.ema, 4) AS ema, z.n AS steps, z.halt AS halt FROM (SELECT user_id, list_reduce(list_prepend({{'ema': NULL::DOUBLE, 'run': 0, 'n': 0, 'halt': NULL::INT, 'v': 0.0::DOUBLE}}, list({{'ema': NULL::DOUBLE, 'run': 0, 'n': 0, 'halt': NULL::INT, 'v': value}} ORDER BY event_id)), lambda a, x: {_EMA}) AS z FROM events GROUP BY user_id)",
    "flat_lines": "SELECT user_id, best FROM (SELECT user_id, max(CASE WHEN h <= 36 THEN value END) AS best, max(h) AS last FROM (SELECT user_id, value, (floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-01')) / 3600.0 AS h FROM events) GROUP BY user_id) WHERE last >= 36 AND coalesce(best, 0) < 40",
    "retention": "SELECT step FROM (SELECT event_id AS step, event_id % 100 = 0 AS kept, row_number() OVER (ORDER BY event_id DESC) AS new, row_number() OVER (PARTITION BY floor(epoch(ts) / 43200) ORDER BY event_id) AS old FROM events WHERE event_type = 'signup') WHERE new <= 3 OR kept OR old = 1",
    "gate_rates": "SELECT lang, count(*) AS n, sum((quality = 1 AND toxic = 0)::BIGINT)::BIGINT AS passed, round(avg((quality = 1 AND toxic = 0)::INT), 4) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY lang",
    "threshold_sweep": "SELECT event_type, threshold, count(*) AS n, sum((value <= threshold)::BIGINT)::BIGINT AS passed, round(avg((value <= threshold)::INT), 4) AS rate FROM events, (SELECT unnest([5.0, 10.0, 50.0, 100.0])::DOUBLE AS threshold) GROUP BY ALL",
    "order_stat": "SELECT event_type, v[len(v) // 2 + 1] AS median, v[floor(0.9 * len(v))::INT + 1] AS p90, v[floor(0.1 * len(v))::INT + 1] AS p10 FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type)",
    "resume_filter": "SELECT user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) WHERE last NOT IN ('purchase', 'signup')",
    "ready_sources": "SELECT source FROM (SELECT source, doc_id % 3 AS chunk, max((doc_id IN (SELECT doc_id FROM labels))::INT) AS ok FROM documents GROUP BY ALL) GROUP BY source HAVING min(ok) = 1",
    "event_sessions": "SELECT user_id, sum(b)::BIGINT AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) GROUP BY user_id",
    "stream_last_wins": "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "speaker_bins": "SELECT bin, count(*) AS n, count(DISTINCT o_custkey) AS speakers FROM (SELECT o_custkey, (row_number() OVER (ORDER BY left(sha1(o_custkey::VARCHAR), 6), o_orderkey) - 1) // 1000 AS bin FROM orders) GROUP BY bin",
    "segment_rollup": "SELECT c_mktsegment, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)",
    "line_totals": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem GROUP BY ALL",
    "capped_parts": "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY sha1('20260712:' || l_orderkey || '-' || l_linenumber), l_orderkey, l_linenumber) <= 3",
    "event_drops": "SELECT user_id, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 100 THEN 'high' ELSE 'kept' END AS drop_reason, count(*) AS n FROM events GROUP BY ALL",
}
