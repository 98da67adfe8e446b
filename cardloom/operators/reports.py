"""Reports: one-row summaries, data cards, frozen sets, pages to look at. Only aggregates and stated samples reach the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(df: DataFrame, *aggregates) -> str:
    """One row of aggregates as JSON."""
    return json.dumps(df.agg(*aggregates).first().asDict(recursive=True), ensure_ascii=False, sort_keys=True, default=str)


def lane_totals(exposures: DataFrame, cards: str = "card_id") -> DataFrame:
    """Exposures and cards of each lane, and of all (lane null); exact, not divided out of totals."""
    return exposures.rollup("lane").agg(F.count("*").alias("exposures"), F.countDistinct(cards).alias("cards"))


def full_share(histogram: DataFrame, k: int = 8) -> DataFrame:
    """histogram (k, queries): the share with all k negatives."""
    return histogram.agg(F.round(F.sum(F.when(F.col("k") == k, F.col("queries")).otherwise(0)) / F.sum("queries"), 4).alias("full"))


def data_card(title: str, totals: DataFrame, license_name: str) -> str:
    """Markdown of a data set's totals; a row for each lane."""
    rows = sorted(totals.collect(), key=lambda r: (r["lane"] is None, r["lane"] or ""))
    lines = [f"# {title}", "", f"License: {license_name}", "", "| lane | cards | exposures |", "| --- | ---: | ---: |"]
    return "\n".join([*lines, *[f"| {r['lane'] or 'all'} | {r['cards']:,} | {r['exposures']:,} |" for r in rows]]) + "\n"


def fingerprint(df: DataFrame) -> str:
    """A checksum of all rows, whatever their order, to pin a frozen set."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256)
    part = [F.sum(F.conv(F.substring(row, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    got = df.agg(F.count("*").alias("n"), *part).first()
    return ":".join(str(x) for x in got)


def pinned(df: DataFrame, pin: str) -> DataFrame:
    """df, if it is what was frozen."""
    found = fingerprint(df)
    if found != pin:
        raise ValueError(f"frozen set differs: {found}, not {pin}")
    return df


def spot_check(df: DataFrame, columns: list[str], most: int = 60) -> str:
    """A page with a few rows, the feature being its limit."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    rows = df.select(*columns).limit(most).collect()
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><table><tr>{head}</tr>{body}</table>"
