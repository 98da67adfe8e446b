"""Calibration, retrieval scores, ratchet, moving averages and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 0.002
QUANTILES = {"min": 0.0, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}


def calibration(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, quantiles (linear between ranks), mean, and the ceiling that the median implies."""
    q = F.percentile(value, list(QUANTILES.values()))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), q.alias("q"), F.avg(value).alias("mean"))
    return out.select(*keys, "n", *[F.round(F.col("q")[i], 4).alias(k) for i, k in enumerate(QUANTILES)], F.round("mean", 4).alias("mean"), F.round(F.col("q")[3] * 0.95, 4).alias("ceiling"))


def above_quantile(df: DataFrame, value: str, share: float, *keys: str) -> DataFrame:
    """Rows at or above the quantile of their key."""
    bound = df.groupBy(*keys).agg(F.percentile(value, share).alias("__bound")) if keys else df.agg(F.percentile(value, share).alias("__bound"))
    joined = df.join(bound, list(keys)) if keys else df.crossJoin(F.broadcast(bound))  # one row
    return joined.where(F.col(value) >= F.col("__bound")).drop("__bound")


def passes_calibrated(df: DataFrame, value: str, share: float = 0.25, least_rate: float = 0.3) -> DataFrame:
    """The same with the floor that the calibration of these rows sets: a quantile, to four digits."""
    floor = df.agg(F.round(F.percentile(value, share), 4).alias("__floor"))
    return passes_floor(df.crossJoin(F.broadcast(floor)), value, F.col("__floor"), least_rate).drop("__floor")  # one row


def passes_floor(df: DataFrame, value: str, floor: float | Column, least_rate: float = 0.3) -> DataFrame:
    """Rows at the floor or above; fails if fewer than the least rate pass."""
    rate = df.agg(F.avg((F.col(value) >= floor).cast("double")).alias("__rate"))
    checked = df.crossJoin(F.broadcast(rate))  # one row
    return checked.where(F.when(F.col("__rate") < least_rate, F.raise_error(F.lit("pass rate too low")).cast("boolean")).otherwise(F.col(value) >= floor)).drop("__rate")


def recall(ranked: DataFrame, hit: Column, at: tuple[int, ...] = (1, 5)) -> DataFrame:
    """ranked (qid, rank, ...): the share of queries with a hit among the first ranks."""
    by_query = ranked.groupBy("qid").agg(*[F.max((hit & (F.col("rank") <= k)).cast("int")).alias(f"r{k}") for k in at])
    return by_query.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(f"r{k}"), 4).alias(f"r{k}") for k in at])


def spread(df: DataFrame, value: str) -> DataFrame:
    """Population deviation over runs, and the step that counts as progress."""
    return df.agg(F.round(F.stddev_pop(value), 6).alias("sigma"), F.round(F.greatest(2 * F.stddev_pop(value), F.lit(EPSILON)), 6).alias("eps"))


def _folded(scores: DataFrame, order: str, lanes: list[str], epsilon: float, start: float) -> DataFrame:
    """order, a score for each lane, kept, best: in one pass over the series in its order."""
    import pyarrow as pa

    def fold(table: pa.Table) -> pa.Table:
        table = table.drop_columns("__series").sort_by(order)
        best, kept, tops = [start] * len(lanes), [], []
        for row in zip(*(table.column(x).to_pylist() for x in lanes), strict=True):
            won = all(x is not None and x - b > epsilon for x, b in zip(row, best, strict=True))
            best = list(row) if won else best
            kept.append(won)
            tops.append(best[0])
        return table.append_column("kept", pa.array(kept, pa.bool_())).append_column("best", pa.array(tops, pa.float64()))

    typed = scores.select(F.col(order).cast("long").alias(order), *[F.col(x).cast("double").alias(x) for x in lanes])
    return typed.withColumn("__series", F.lit(0)).groupBy("__series").applyInArrow(fold, f"`{order}` long, {', '.join(f'`{x}` double' for x in lanes)}, kept boolean, best double")


def ratchet(scores: DataFrame, order: str, value: str, epsilon: float = EPSILON, start: float = 0.0) -> DataFrame:
    """Each score in the order with `kept`: whether it beats the best so far by more than epsilon, and then is the best.
    A fold over the scores of one series, one row an evaluation: it holds that series, and takes time in proportion to it."""
    return _folded(scores, order, [value], epsilon, start).select(order, F.col(value).alias("value"), "kept", "best")


def lanes_ratchet(scores: DataFrame, order: str, lanes: list[str], epsilon: float = EPSILON) -> DataFrame:
    """The same where a score has to beat the best in every lane: the pointer moves in all lanes or in none."""
    return _folded(scores, order, lanes, epsilon, 0.0).select(order, "kept")


def flat_lines(scores: DataFrame, key: str, hour: str, value: str, least: float = 0.05, at: float = 36.0) -> DataFrame:
    """Series whose best score is still below the least one at the hour by which they must have reached it."""
    by = scores.groupBy(key).agg(F.max(F.when(F.col(hour) <= at, F.col(value))).alias("best"), F.max(hour).alias("last"))
    return by.where((F.col("last") >= at) & (F.coalesce("best", F.lit(0.0)) < least)).select(key, "best")


def ema_tripwire(losses: DataFrame, key: str, order: str, value: str, warm: int = 20, patience: int = 10, times: float = 3.0, plus: float = 2.0, keep: float = 0.98) -> DataFrame:
    """Moving average of each series at its end, and the first step at which the wire trips: a value that is no number, or
    `patience` steps in a row above times x average + plus. The first `warm` steps don't count as spikes."""
    begin = F.struct(F.lit(None).cast("double").alias("ema"), F.lit(0).alias("run"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("halt"))

    def step(acc: Column, x: Column) -> Column:
        v = x["v"]
        broken = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        ema = F.when(broken, acc["ema"]).when(acc["ema"].isNull(), v).otherwise(keep * acc["ema"] + (1 - keep) * v)
        spike = ~broken & (acc["n"] + 1 > warm) & (v > times * ema + plus)
        run = F.when(spike, acc["run"] + 1).otherwise(0)
        trips = broken | (run >= patience)
        moved = F.struct(ema.alias("ema"), run.alias("run"), (acc["n"] + 1).alias("n"), F.when(trips, acc["n"] + 1).alias("halt"))
        return F.when(acc["halt"].isNotNull(), acc).otherwise(moved)

    return losses.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), begin, step).alias("s")).select(key, F.round("s.ema", 4).alias("ema"), F.col("s.n").alias("steps"), F.col("s.halt").alias("halt"))


def retained(checkpoints: DataFrame, last: int = 3, hours: int = 12) -> DataFrame:
    """checkpoints (step, saved, kept), a row for each step: those kept by the ratchet, the last few, and the oldest of each bucket of
    hours; all if there are few."""
    bucket = F.floor(F.col("saved") / (hours * 3600))
    newest = checkpoints.select("step").orderBy(F.desc("step")).limit(last)
    oldest = checkpoints.groupBy(bucket.alias("bucket")).agg(F.min("step").alias("step")).select("step")
    named = newest.union(oldest).distinct().withColumn("__named", F.lit(True))
    return checkpoints.join(named, "step", "left").where(F.col("kept") | F.col("__named")).drop("__named")


def contrastive_loss(sims: DataFrame, temperature: float = 0.05) -> DataFrame:
    """sims (qid, positive boolean, sim): each query's cross entropy of its positive among its candidates."""
    scaled = F.col("sim") / temperature
    top = sims.groupBy("qid").agg(F.max(scaled).alias("m"), F.max(F.when(F.col("positive"), scaled)).alias("p"))
    total = sims.join(top, "qid").groupBy("qid", "m", "p").agg(F.sum(F.exp(scaled - F.col("m"))).alias("z"))
    return total.select("qid", (F.log("z") + F.col("m") - F.col("p")).alias("loss"))


def symmetric_loss(pairs: DataFrame, negatives: DataFrame, rungs: tuple[int, ...], temperature: float = 0.05) -> DataFrame:
    """pairs (batch, id, anchor, positive), negatives (batch, vec): batch, pairs, loss. At every rung the leading dimensions of all
    vectors are scaled to length 1; an anchor's candidates are the positives and the negatives of its batch, a positive's the anchors
    alone. The loss is the mean cross entropy of the own partner over both ways, and over the rungs. A batch is one task, so batches have a fixed size."""
    import numpy as np
    import pyarrow as pa

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        return np.array(table.column(name).to_pylist(), np.float64).reshape(table.num_rows, -1 if table.num_rows else 0)

    def entropy(sims: np.ndarray) -> float:
        x = sims / temperature
        top = x.max(1, keepdims=True)
        return float((np.log(np.exp(x - top).sum(1)) + top[:, 0] - x.diagonal()).mean())

    def loss(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n, total = left.num_rows, 0.0
        if not n:
            return pa.table({"batch": pa.array([], pa.int64()), "pairs": pa.array([], pa.int64()), "loss": pa.array([], pa.float64())})
        a, p, extra = matrix(left, "anchor"), matrix(left, "positive"), matrix(right, "vec")
        for d in rungs:
            x, y, z = (m[:, :d] / np.maximum(np.linalg.norm(m[:, :d], axis=1, keepdims=True), 1e-12) for m in (a, p, extra))
            total += (entropy(x @ (np.concatenate([y, z]) if len(z) else y).T) + entropy(y @ x.T)) / 2
        return pa.table({"batch": pa.array([key[0].as_py()], pa.int64()), "pairs": pa.array([n], pa.int64()), "loss": pa.array([total / len(rungs)])})

    both = pairs.select("batch", "anchor", "positive").groupBy("batch").cogroup(negatives.select("batch", "vec").groupBy("batch"))
    return both.applyInArrow(loss, "batch long, pairs long, loss double")


def order_statistics(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each key the elements at floor(share x n) of its sorted values, counted from 0, without interpolation. Null values don't
    count. Values are numbered over ranges, so no key's values stand in one row or one task."""
    from .sampling import numbered

    rows = df.where(F.col(value).isNotNull()).select(key, value)
    counts = rows.groupBy(key).agg(F.count("*").alias("__all")).withColumnRenamed(key, "__key")
    placed = numbered(rows, value, "__n", key).join(counts, F.col(key).eqNullSafe(F.col("__key")))
    at = lambda share: F.col("__n") == F.floor(F.lit(share) * F.col("__all"))
    return placed.groupBy(key).agg(*[F.max(F.when(at(q), F.col(value))).alias(name) for name, q in shares.items()])


def gate_rates(df: DataFrame, passed: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(passed.cast("long")).alias("passed"), F.round(F.avg(passed.cast("double")), 4).alias("rate"))


def checksum(df: DataFrame, vector: str) -> DataFrame:
    """Sum over all components, to tell whether two encodings are the same."""
    return df.select(F.explode(vector).alias("x")).agg(F.round(F.sum(F.col("x").cast("double")), 3).alias("checksum"))


def neighbour_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two neighbour tables (qid, cid): the mean share of neighbours that they have in common."""
    both = a.select("qid", "cid").join(b.select("qid", "cid", F.lit(True).alias("common")), ["qid", "cid"], "left")  # a is read once
    shares = both.groupBy("qid").agg((F.count("common") / F.count("*")).alias("share"))
    return shares.agg(F.round(F.avg("share"), 4).alias("overlap"))
