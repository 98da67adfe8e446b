"""Cards, their views and negatives, and exposures built from them, over nested types.

View tables are long: (card_id, view, content, source, origin). Content is an array of (type, text, image, audio).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.text import collapse

from .sampling import numbered, shuffled

CONTENT = "array<struct<type:string,text:string,image:string,audio:string>>"
#: The band of near misses and the names that its negatives carry.
BAND = (0.75, 0.92)
BAND_RULE, BAND_MINER = "v1-inband-0.75-0.92", "teacher-band-v1"
INSTRUCTION = "Retrieve the matching description."
KINDS_OF_CONTENT = ["image", "text", "audio"]  # in the order that content must have

#: The instruction of each task type.
INSTRUCTIONS = {
    "general_match": "Retrieve the matching description.",
    "qa_passage": "Given a question, retrieve the passage that answers it.",
    "title_doc": "Given a title, retrieve the document it belongs to.",
    "web_query_doc": "Given a web search query, retrieve the most relevant document.",
    "entity_desc": "Given an entity name, retrieve its encyclopedic description.",
    "code_search": "Given a description of what code does, retrieve the matching code.",
    "crosslingual": "Given a query, retrieve the relevant passage in any language.",
    "semantic_sim": "Retrieve a text with the same meaning as this one.",
    "nli_entail": "Given a premise, retrieve a hypothesis it entails.",
    "caption_image": "Retrieve the image described by this caption.",
    "image_caption": "Retrieve the caption that describes this image.",
    "page_query": "Given a query, retrieve the document page that answers it.",
    "class_label": "Classify by retrieving the matching category label.",
}


def item(kind: str, value: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), *[(value if k == kind else null).alias(k) for k in ("text", "image", "audio")])


def content(*items: Column) -> Column:
    return F.array(*items)


def rank_of(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS_OF_CONTENT)), kind)


def in_order(items: Column) -> Column:
    """Whether all images stand before all text, and that before all audio."""
    ranks = F.transform(items, lambda x: rank_of(x["type"]))
    return ranks == F.array_sort(ranks)


def one_of(x: Column) -> Column:
    """Whether an item has exactly the payload of its type."""
    filled = sum((x[k].isNotNull().cast("int") for k in ("text", "image", "audio")), F.lit(0))
    own = F.when(x["type"] == "text", x["text"]).when(x["type"] == "image", x["image"]).when(x["type"] == "audio", x["audio"])
    return (filled == 1) & own.isNotNull() & (own != "")


def with_instruction(items: Column, instruction: Column) -> Column:
    """The anchor's content with the instruction in front, at reading time; none where it is empty."""
    return F.when(F.coalesce(instruction, F.lit("")) == "", items).otherwise(F.concat(F.array(item("text", instruction)), items))


def restamped(df: DataFrame) -> DataFrame:
    """Sets `instruction` by `task_type`; an unknown type keeps what it has."""
    known = F.create_map(*[F.lit(x) for kv in INSTRUCTIONS.items() for x in kv])
    return df.withColumn("instruction", F.coalesce(known[F.col("task_type")], F.col("instruction")))


def in_band(names: Column, sims: Column, low: float = BAND[0], high: float = BAND[1]) -> Column:
    """Near misses (name, sim) of two parallel arrays inside the band, hardest first, then by place."""
    both = F.transform(F.arrays_zip(names.alias("name"), sims.alias("sim")), lambda x, i: F.struct((-x["sim"]).alias("key"), i.alias("at"), x["name"].alias("name"), x["sim"].alias("sim")))
    fits = F.filter(both, lambda x: x["sim"].between(low, high) & (F.coalesce(x["name"], F.lit("")) != ""))
    return F.transform(F.array_sort(fits), lambda x: F.struct(x["name"].alias("name"), x["sim"].alias("sim"), (x["at"] + 1).alias("nth")))


def positives(paraphrases: Column, intent: Column, qa_pairs: Column) -> Column:
    """(view, text): paraphrases, the intent, the first two questions with their answers."""
    named = lambda view, text: F.struct(view.alias("view"), text.alias("text"))
    none = F.array().cast("array<struct<view:string,text:string>>")
    paras = F.transform(F.coalesce(paraphrases, F.array().cast("array<string>")), lambda p, i: named(F.format_string("text-para-%d", i + 1), p))
    paras = F.filter(paras, lambda x: x["text"].isNotNull())
    wish = F.when(F.coalesce(intent, F.lit("")) != "", F.array(named(F.lit("text-intent"), intent))).otherwise(none)
    asked = F.transform(F.slice(qa_pairs, 1, 2), lambda x, i: named(F.format_string("text-qa-%d", i + 1), F.when(F.coalesce(x["q"], F.lit("")) != "", F.concat(x["q"], F.lit(" "), F.coalesce(x["a"], F.lit(""))))))
    return F.concat(paras, wish, F.coalesce(F.filter(asked, lambda x: x["text"].isNotNull()), none))


def source_cards(rows: DataFrame) -> DataFrame:
    """Rows of text cards (card_id, canonical_text, paraphrases, intent_text, qa_pairs, near_misses, nm_sims) to card_id,
    anchor_text, positives, negatives."""
    return rows.select(
        F.concat(F.lit("flf-"), "card_id").alias("card_id"), F.col("canonical_text").alias("anchor_text"),
        positives(F.col("paraphrases"), F.col("intent_text"), F.col("qa_pairs")).alias("positives"),
        in_band(F.col("near_misses"), F.col("nm_sims")).alias("negatives"),
    )


def negatives_of(mined: DataFrame, miner: str, rule: str, view: str = "text") -> DataFrame:
    """Mined rows (card_id, neg_id, sim, rank) to one array for each card, in rank order. At most K_MAX a card, so groups are bounded."""
    ref = F.struct("rank", F.struct(F.col("neg_id").alias("card_id"), F.lit(miner).alias("miner"), F.lit(view).alias("view"), F.round("sim", 4).alias("sim"), F.lit(rule).alias("band_rule")).alias("ref"))
    return mined.groupBy("card_id").agg(F.transform(F.array_sort(F.collect_list(ref)), lambda x: x["ref"]).alias("negatives"))


def prepended(first: Column, mined: Column, k: int = 8) -> Column:
    """A given negative in front of mined ones, which give way at the end."""
    return F.when(first.isNull(), F.slice(mined, 1, k)).otherwise(F.slice(F.concat(F.array(first), mined), 1, k))


def filled(queries: DataFrame, mined: DataFrame, pool: DataFrame, k: int = 8, seed: str = "fill") -> DataFrame:
    """Pads each query's mined negatives (card_id, neg_id, rank) to k with cards of the pool (card_id), in a hashed order that starts
    at a place of the query's own: a ring, so k neighbours are looked at and never all pairs."""
    n = pool.count()
    hashed = pool.select(F.col("card_id").alias("neg_id"), F.xxhash64(F.lit(seed), F.lit("ring"), "card_id").alias("__hash"))
    ring = numbered(hashed, "__hash", "place").select("neg_id", "place")
    start = F.pmod(F.xxhash64(F.lit(seed), "card_id"), F.lit(max(n, 1)))
    asked = queries.select("card_id", F.explode(F.sequence(F.lit(0), F.lit(min(n, 2 * k + 1) - 1))).alias("step"), start.alias("start")).withColumn("place", (F.col("start") + F.col("step")) % max(n, 1))
    offered = asked.join(ring, "place").where("neg_id <> card_id").join(mined.select("card_id", "neg_id"), ["card_id", "neg_id"], "left_anti")
    both = mined.select("card_id", "neg_id", F.lit(0).alias("late"), F.col("rank").cast("long").alias("at")).union(offered.select("card_id", "neg_id", F.lit(1), F.col("step").cast("long")))
    rank = F.row_number().over(Window.partitionBy("card_id").orderBy("late", "at"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("card_id", "neg_id", "rank", (F.col("late") == 1).alias("random"))


def interleaved(views: DataFrame) -> DataFrame:
    """Cards with an image, a text and an audio view get one content of the three, in the order that content must have."""
    of = lambda v: F.max(F.when(F.col("view") == v, F.col("content")))
    by_card = views.where(F.col("view").isin("image", "text", "audio")).groupBy("card_id").agg(*[F.first(F.when(F.col("view") == v, F.col("content")), ignorenulls=True).alias(v) for v in KINDS_OF_CONTENT])
    return by_card.where("image is not null and text is not null and audio is not null").select("card_id", F.lit("image-text-audio").alias("recipe"), F.concat("image", "text", "audio").alias("content"))


def two_way(cards: DataFrame) -> DataFrame:
    """Exposures in both directions of cards (card_id, anchor_view, positive_view, lanes): the second lane swaps the sides."""
    return cards.select("card_id", F.posexplode("lanes").alias("way", "lane"), "anchor_view", "positive_view").select(
        "card_id", "lane", F.when(F.col("way") == 0, F.col("anchor_view")).otherwise(F.col("positive_view")).alias("anchor"),
        F.when(F.col("way") == 0, F.col("positive_view")).otherwise(F.col("anchor_view")).alias("positive"),
    )


def resolved(refs: DataFrame, views: DataFrame, fallback: str = "text") -> DataFrame:
    """refs (exposure, role, rank, card_id, view): content of the view, or of the fallback view where the card lacks it."""
    have = views.select("card_id", "view", "content")
    spare = have.where(F.col("view") == fallback).select("card_id", F.col("content").alias("spare"))
    got = refs.join(have, ["card_id", "view"], "left").join(spare, "card_id", "left")
    return got.withColumn("view", F.when(F.col("content").isNull(), fallback).otherwise(F.col("view"))).withColumn("content", F.coalesce("content", "spare")).drop("spare")


def content_of(inline: Column, by_name: Column, card: Column, view: Column) -> Column:
    """Content of a reference in either layout: in the reference itself, or in the sample's map under card/view."""
    return F.coalesce(inline, by_name[F.concat_ws("/", card, view)])


def resolved_map(views: DataFrame, key: str) -> DataFrame:
    """The second layout: one map of card/view to content for each value of the key, whose views are few."""
    entry = F.struct(F.concat_ws("/", "card_id", "view").alias("name"), "content")
    return views.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("resolved"))


def materialized(items: Column, media: Column, most_chars: int = 4000) -> Column:
    """Content with text cut to its first characters and media as bytes out of a map of member names."""
    prefix = "member://"
    name = lambda x: F.coalesce(x["image"], x["audio"])
    data = lambda x: F.when(x["type"] != "text", media[F.substring(name(x), F.lit(len(prefix) + 1), F.length(name(x)))])
    return F.transform(items, lambda x: F.struct(x["type"].alias("type"), F.left(x["text"], F.lit(most_chars)).alias("text"), data(x).alias("data")))


def exposures(rows: DataFrame) -> DataFrame:
    """Resolved rows (exposure, lane, instruction, role, rank, card_id, view, content) to one row for each exposure; negatives in
    rank order. An exposure has a bounded number of rows."""
    ref = F.struct(F.col("card_id").alias("card"), "view", "content")
    side = lambda role: F.first(F.when(F.col("role") == role, ref), ignorenulls=True).alias(role)
    negatives = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "negative", F.struct("rank", ref.alias("ref"))))), lambda x: x["ref"])
    return rows.groupBy("exposure", "lane", "instruction").agg(side("anchor"), side("positive"), negatives.alias("negatives"))


def smoke_mix(items: DataFrame, counts: dict[str, int], prefix: str = "smk") -> DataFrame:
    """items (lane, item): a small sample for trying a loader, the first of each lane in hashed order, as many as counts says; keys are
    dense, lane after lane. The sample is bounded by the counts."""
    lanes = F.array(*map(F.lit, counts))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("lane"))
    order = Window.partitionBy("lane").orderBy(shuffled(F.col("item")), "item")
    some = items.where(F.col("lane").isin(list(counts))).select("lane", "item", F.row_number().over(order).alias("place")).where(F.col("place") <= max(counts.values()))
    some = some.where(F.col("place") <= most)
    nth = F.row_number().over(Window.orderBy(F.array_position(lanes, F.col("lane")), "place")) - 1  # of the few rows that are left
    return some.select(F.format_string(f"{prefix}-%06d", nth.cast("long")).alias("key"), "lane", "item")


def mix_by_tokens(lanes: DataFrame, budget: float) -> DataFrame:
    """lanes (lane, weight, mean_tokens): exposures of each lane so that tokens, not exposures, stand in the ratio of the weights."""
    total = F.sum("weight").over(Window.partitionBy(F.lit(0)))
    return lanes.withColumn("exposures", F.floor(F.lit(budget) * F.col("weight") / total / F.col("mean_tokens")).cast("long"))


def grouped_bins(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Bins of `size` rows along shuffled groups: the running count decides, so a group may straddle two bins. The order is one key:
    the group's hash and the row's."""
    keyed = rows.withColumn("__order", F.concat(shuffled(F.col(group)), F.lit(":"), F.format_string("%020d", F.col(order).cast("long"))))
    code = F.conv(F.substring(F.sha1(F.col(group).cast("string")), 1, 6), 16, 10).cast("long")
    placed = keyed.withColumn("__key", code * (1 << 36) + F.col(order).cast("long"))
    return numbered(placed, "__key", "__n").withColumn("bin", F.floor(F.col("__n") / size).cast("long")).drop("__order", "__key", "__n")


def title_text(title: Column, labels: Column) -> Column:
    return F.concat_ws(": ", collapse(title), F.array_join(F.transform(labels, lambda x: F.replace(x, F.lit("_"), F.lit(" "))), ", "))
