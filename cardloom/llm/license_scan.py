"""License scan: base phrases and an exact set-similarity join of text blocks with license templates.

Base: the places where a phrase's words stand one after the other.
Method: tokens are runs of SHINGLE words, wherever lines break. A template's set holds its distinct tokens. Text blocks are windows of
words: for a template of so many words, windows twice as long that begin at every multiple of them, so every copy lies whole in
one. A block matches if it holds at least CONTAINMENT of the template's tokens, and all tokens of its mandatory phrase, which tells
relatives apart.

Tokens are ordered by how often they occur in all documents, rarest first. Prefix filter: a block without any of the template's
first |T| - need + 1 tokens can't match; only places of these tokens make candidates. Length filter: nor can one with fewer
tokens than need. Positional filter: nor can one that has SLACK or fewer of the first |T| - need + 1 + SLACK tokens, as those behind
don't suffice. The candidates' tokens are then counted exactly. Templates are a table of the code or the caller, joined like the
documents, so the plan is the same for any number of them; documents are never joined with each other.

Null and empty texts have no words and no labels. Rows are grouped by a 64-bit hash of doc_id and text, so repeated rows get the same
result, and ties and null doc_ids don't matter; extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .license_templates import templates as known_templates

CONTAINMENT = 0.8
SHINGLE, SLACK = 3, 2

#: Phrases of the base and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = known_templates()

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and all beyond ASCII, of a lower-cased text."""
    return F.filter(F.split(F.regexp_replace(text, NO_WORD, " "), " "), lambda w: w != "")


def shingles(ws: Column) -> Column:
    """A hash of each run of SHINGLE words, in order."""
    last = F.size(ws) - SHINGLE
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(SHINGLE)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: list[tuple[str, str, str]], containment: float) -> DataFrame:
    """template, label, span (words), n (tokens), need, needed tokens of the mandatory phrase, token, must: a row for each token."""
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("template"), *map(F.lit, t)) for i, t in enumerate(templates)]))).toDF("template", "label", "wording", "phrase")
    said = rows.select("template", "label", words(lowered(F.col("wording"))).alias("ws"), shingles(words(lowered(F.col("phrase")))).alias("phrase"))
    sets = said.select("template", "label", F.size("ws").alias("span"), F.array_distinct(shingles(F.col("ws"))).alias("tokens"), F.array_distinct("phrase").alias("phrase"))
    sets = sets.withColumn("tokens", F.array_union("tokens", "phrase"))
    need = F.ceil(F.lit(containment) * F.size("tokens") - 1e-9).cast("int")
    each = sets.select("template", "label", "span", F.size("tokens").alias("n"), need.alias("need"), F.size("phrase").alias("musts"), "phrase", F.explode_outer("tokens").alias("token"))
    return written(each.withColumn("must", F.array_contains("phrase", F.col("token"))).drop("phrase"), "templates")


def matches(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (key, flat): key, labels, share of those whose text holds templates. table: template_table's."""
    ws = rows.select("key", F.split("flat", " ").alias("ws")).where(F.size("ws") >= SHINGLE)
    run = F.arrays_zip(*[F.slice("ws", F.lit(k + 1), F.size("ws") - (SHINGLE - 1)).alias(f"w{k}") for k in range(SHINGLE)])
    each = ws.select("key", F.size("ws").alias("many"), F.posexplode_outer(run).alias("pos", "run"))  # outer: no filter that makes the runs a second time
    said = each.select("key", F.col("many") - (SHINGLE - 1), "pos", F.xxhash64(*[f"run.w{k}" for k in range(SHINGLE)]).alias("token")).toDF("key", "many", "pos", "token")
    vocabulary = F.broadcast(table.select("token").distinct())  # as many rows as the templates have words at most
    hits = written(said.join(vocabulary, "token"), "license_hits")

    often = written(hits.groupBy("token").agg(F.count("*").alias("often")), "license_counts")  # a row for each token of the templates at most
    rarest = Window.partitionBy("template").orderBy(F.coalesce("often", F.lit(0)), "token")
    ranked = table.join(often, "token", "left").coalesce(1).withColumn("rank", F.row_number().over(rarest))
    prefix = F.col("n") - F.col("need") + 1
    ranked = written(ranked.select("template", "label", "span", "n", "need", "musts", "token", "must", "rank", prefix.alias("prefix")), "license_tokens")

    def placed(tokens: DataFrame) -> DataFrame:
        """Hits with the templates that have the token, once for each of the two blocks around the place."""
        at = F.floor(F.col("pos") / F.col("span"))
        both = hits.join(F.broadcast(tokens), "token")  # a row for each token of the templates at most
        return both.withColumn("block", F.explode(F.when(at > 0, F.array(at, at - 1)).otherwise(F.array(at))))

    block = ["key", "template", "block"]
    early = placed(ranked.where(F.col("rank") <= F.col("prefix") + SLACK)).withColumn("tokens", F.least("many", (F.col("block") + 2) * F.col("span")) - F.col("block") * F.col("span"))
    held = early.groupBy(*block).agg(F.first("tokens").alias("tokens"), F.first("need").alias("need"), F.first("prefix").alias("prefix"), F.first("n").alias("n"), F.min("rank").alias("low"), F.countDistinct("token").alias("some"))
    candidates = held.where((F.col("low") <= F.col("prefix")) & (F.col("tokens") >= F.col("need")) & (F.col("some") > F.least(F.lit(SLACK), F.col("n") - F.col("prefix")))).select(*block)
    counts = placed(ranked).join(candidates, block, "left_semi").groupBy(*block).agg(
        F.first("label").alias("label"), F.first("n").alias("n"), F.first("need").alias("need"), F.first("musts").alias("musts"),
        F.countDistinct("token").alias("common"), F.countDistinct(F.when(F.col("must"), F.col("token"))).alias("kept"),
    )
    found = counts.where((F.col("common") >= F.col("need")) & (F.col("kept") >= F.col("musts")))
    return found.groupBy("key").agg(F.collect_set("label").alias("matched"), F.max(F.col("common") / F.col("n")).alias("share"))  # no more labels than templates have


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _stands_at(parts: list[str]) -> Callable[[Column], Column]:
    def at(i: Column) -> Column:
        hit = F.lit(True)
        for k, p in enumerate(parts):
            hit = hit & (F.get("ws", i + k) == p)
        return F.coalesce(hit, F.lit(False))

    return at


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: the best containment, 1 with a base label.
    templates: label, wording, mandatory phrase of at least SHINGLE words."""
    rows = docs.select("doc_id", lowered(F.coalesce("text", F.lit(""))).alias("low"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "low").alias("key"), F.trim(F.regexp_replace("low", NO_WORD, " ")).alias("flat"))
    found = matches(rows.select("key", "flat"), template_table(docs.sparkSession, templates, containment))

    rows = rows.withColumn("n_words", F.when(F.col("flat") == "", 0).otherwise(F.length("flat") - F.length(F.replace("flat", F.lit(" "))) + 1).cast("long"))
    starts, held = F.array().cast("array<int>"), F.array().cast("array<string>")
    for phrase, label in phrases.items():
        at = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), _stands_at(phrase.split()))
        starts = F.concat(starts, at)
        held = F.concat(held, F.when(F.size(at) > 0, _strings([label])).otherwise(F.array().cast("array<string>")))
    padded = F.concat(F.lit(" "), F.col("flat"), F.lit(" "))
    any_phrase = F.lit(False)
    for phrase in phrases:
        any_phrase = any_phrase | F.contains(padded, F.lit(f" {phrase} "))
    rows = rows.withColumn("ws", F.when(any_phrase, F.split("flat", " ")))
    rows = rows.select("doc_id", "key", "n_words", F.when(F.col("ws").isNotNull(), starts).alias("starts"), F.when(F.col("ws").isNotNull(), F.array_sort(F.array_distinct(held))).alias("held"))

    none = F.array().cast("array<string>")
    base, method = F.coalesce("held", none), F.coalesce("matched", none)
    return rows.join(found, "key", "left").select(
        "doc_id", "n_words", F.when(F.col("starts").isNull(), 0).otherwise(F.size("starts")).cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"), F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base, method)))).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
