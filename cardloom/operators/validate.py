"""Card rules, each with a name: one violation row for each rule that a card breaks.

cards: card_id, anchor_text, views (map of name to struct(content, source, origin, gen, gate)), interleaved (array of
struct(recipe, content)), negatives (map of modality to array of struct(card_id, view, miner, sim)), rights, dedup.
A card that breaks a rule of the schema is judged by no other rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.text import dedup_hash

from .cards import in_order, one_of

#: Fixed values of the card format.
CARD_ID = r"^flf-[a-z0-9][a-z0-9-]{2,30}$"
VIEW = r"^(text|image|audio)(-[a-z0-9-]+)?$"
CONTENT_REF = r"^cas://[0-9a-f]{64}$"
SHA256 = r"^[0-9a-f]{64}$"
SOURCES = ["real", "synthetic", "rendered", "tts", "genai", "captioned", "asr"]
GENERATED = ["rendered", "tts", "genai", "captioned", "asr"]
ORIGINS = ["v001", "mmeb", "colpali", "visrag", "librispeech", "mls", "fsd50k", "commonvoice", "laion-audio", "kalm", "allnli"]
TIERS = ["commercial", "commercial_after_attribution", "source_audit_required", "research_only", "evaluation_only", "quarantine"]
AUDITS = ["pending", "clear"]
PROTOCOL = "anchor-sha256-v1"
CAPTION_SHARE = (0.10, 0.20)
MOST_SECONDS, RATE = 30.05, 16000

SCHEMA = """card_id string, anchor_text string,
 views map<string, struct<content: array<struct<type: string, text: string, image: string, audio: string>>, source: string, origin: string,
  gen: struct<model: string, caption_frac: double>, gate: struct<pass: boolean>>>,
 interleaved array<struct<recipe: string, content: array<struct<type: string, text: string, image: string, audio: string>>>>,
 negatives map<string, array<struct<card_id: string, view: string, miner: string, sim: double>>>,
 rights struct<tier: string, audit: string>, dedup struct<protocol: string, hash: string>"""


def _views() -> Column:
    return F.coalesce(F.map_entries("views"), F.array().cast("array<struct<key:string,value:struct<content:array<struct<type:string,text:string,image:string,audio:string>>,source:string,origin:string,gen:struct<model:string,caption_frac:double>,gate:struct<pass:boolean>>>>"))


def _negatives() -> Column:
    return F.coalesce(F.flatten(F.map_values("negatives")), F.array().cast("array<struct<card_id:string,view:string,miner:string,sim:double>>"))


def _contents() -> Column:
    parts = F.transform(F.coalesce("interleaved", F.array().cast("array<struct<recipe:string,content:array<struct<type:string,text:string,image:string,audio:string>>>>")), lambda x: x["content"])
    return F.concat(F.transform(_views(), lambda v: v["value"]["content"]), parts)


def no(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def in_schema() -> dict[str, Column]:
    """Rules of the schema, true where a card breaks them."""
    generated = lambda v: v["value"]["source"].isin(GENERATED)
    return {
        "required": F.col("card_id").isNull() | (F.coalesce("anchor_text", F.lit("")) == "") | F.col("rights.tier").isNull() | F.col("dedup.protocol").isNull() | F.col("dedup.hash").isNull() | (F.size(_views()) < 1),
        "card_id": no(F.col("card_id").rlike(CARD_ID)),
        "view_name": no(F.forall(_views(), lambda v: v["key"].rlike(VIEW))),
        "enums": no(F.forall(_views(), lambda v: v["value"]["source"].isin(SOURCES) & v["value"]["origin"].isin(ORIGINS))) | no(F.col("rights.tier").isin(TIERS)) | no(F.col("rights.audit").isNull() | F.col("rights.audit").isin(AUDITS)),
        "content": no(F.forall(_contents(), lambda c: (F.size(c) > 0) & F.forall(c, one_of))),
        "content_ref": no(F.forall(F.flatten(_contents()), lambda x: (x["type"] == "text") | F.coalesce(x["image"], x["audio"]).rlike(CONTENT_REF))),
        "generated_fields": no(F.forall(_views(), lambda v: ~generated(v) | (v["value"]["gen"]["model"].isNotNull() & v["value"]["gate"]["pass"].isNotNull()))),
        "negative_ref": no(F.forall(_negatives(), lambda n: n["card_id"].rlike(CARD_ID) & n["miner"].isNotNull() & (n["view"].isNull() | n["view"].rlike(VIEW)))),
        "hash_form": no(F.col("dedup.hash").rlike(SHA256)),
    }


def in_card() -> dict[str, Column]:
    """Other rules on one card."""
    low, high = CAPTION_SHARE
    return {
        "gate": no(F.forall(_views(), lambda v: ~v["value"]["source"].isin(GENERATED) | F.coalesce(v["value"]["gate"]["pass"], F.lit(False)))),
        "caption_share": no(F.forall(_views(), lambda v: (v["key"] != "image-captioned") | F.coalesce(v["value"]["gen"]["caption_frac"].between(low, high), F.lit(False)))),
        "order": no(F.forall(F.coalesce("interleaved", F.array().cast("array<struct<recipe:string,content:array<struct<type:string,text:string,image:string,audio:string>>>>")), lambda x: in_order(x["content"]))),
        "self_negative": F.exists(_negatives(), lambda n: (n["card_id"] == F.col("card_id")) & n["view"].isNull()),
        "dedup_hash": (F.col("dedup.protocol") == PROTOCOL) & (F.col("dedup.hash") != dedup_hash("anchor_text")),
    }


def violations(cards: DataFrame) -> DataFrame:
    """card_id, rule: of each card by itself."""
    named = lambda rules: F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    first = cards.withColumn("__schema", named(in_schema()))
    both = F.when(F.size("__schema") > 0, F.col("__schema")).otherwise(named(in_card()))
    return first.select("card_id", F.explode(both).alias("rule"))


def unknown_negatives(cards: DataFrame) -> DataFrame:
    """card_id, neg_id: negatives that name no card of the table."""
    refs = cards.select("card_id", F.explode(_negatives()).alias("n")).select("card_id", F.col("n.card_id").alias("neg_id")).where("neg_id <> card_id")
    return refs.join(cards.select(F.col("card_id").alias("neg_id")).distinct(), "neg_id", "left_anti").select("card_id", "neg_id")


def repeated_ids(cards: DataFrame) -> DataFrame:
    return cards.groupBy("card_id").agg(F.count("*").alias("n")).where("n > 1")


def broken_media(cards: DataFrame, store: DataFrame) -> DataFrame:
    """card_id, ref, problem: references that the store (sha, data) lacks, images that are broken, and audio that isn't 16 kHz mono of 30 s at most."""
    from cardloom.functions.arrow import image_problem, wav_info

    refs = cards.select("card_id", F.explode(F.flatten(_contents())).alias("x")).where("x.type <> 'text'").select("card_id", F.col("x.type").alias("kind"), F.coalesce("x.image", "x.audio").alias("ref"))
    found = refs.withColumn("sha", F.substring("ref", 7, 64)).join(store.select("sha", "data"), "sha", "left")
    info = found.withColumn("info", F.when((F.col("kind") == "audio") & F.col("data").isNotNull(), wav_info("data")))
    info = info.withColumn("fault", F.when((F.col("kind") == "image") & F.col("data").isNotNull(), image_problem("data")))
    wrong = (F.col("info.rate") != RATE) | (F.col("info.channels") != 1) | (F.col("info.seconds") > MOST_SECONDS)
    problem = F.when(F.col("data").isNull(), "missing").when(F.col("info.error").isNotNull(), "unreadable").when(wrong, "format").when(F.col("fault").isNotNull(), "unreadable")
    return info.select("card_id", "ref", problem.alias("problem")).where("problem is not null")


def sample_gate(cards: DataFrame, size: int = 250) -> DataFrame:
    """Violations of a hashed sample, to be looked at before all cards are written."""
    order = F.sha2(F.concat_ws(":", F.lit("gate"), "card_id"), 256)
    return violations(cards.orderBy(order).limit(size))


def media_refs_checked(cards: DataFrame) -> DataFrame:
    """Items of content that a check looks at, text among them."""
    return cards.agg(F.coalesce(F.sum(F.size(F.flatten(_contents()))), F.lit(0)).alias("n"))
