"""Row parsers of image-text pairs: each gives a record or a drop reason.

A record has anchor and positive (kind, member, text), anchor_text, the parts that make it unique, and a class key. A table of
rules by kind of pair feeds one expression; the data's own negatives are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.text import collapse

#: The marker of an image in a query, and the phrases that stand before the text that counts.
IMAGE_MARK = "<|image_1|>\n"
QUESTION = "Represent the given image with the following question: "
CAPTION, NEWS_CAPTION = "matches the given caption: ", "Retrieve an image of this news caption."
DOMAIN, CHANGES = "for domain classification: ", "with the described changes: "
DIALOG, ANSWERS, RELATED = "used for image retrieval: ", "answers this question: ", "related text information: "
LABELED = r'labeled as "([^"]+)"'

QUERY_IMAGE, POSITIVE_IMAGE = "qry_image_path", "pos_image_path"


#: Collapsed texts that the rules read, made once for each row, and the parsers that read them.
BASES = {
    "__query": (lambda: collapse(F.replace("qry", F.lit(IMAGE_MARK), F.lit(""))), ("text_to_image", "news", "question", "composed")),
    "__asked": (lambda: collapse("qry"), ("dialog", "web_question")),
    "__answer": (lambda: collapse("pos_text"), ("image_to_text", "question", "class", "web_question")),
}


def _with_bases(df: DataFrame, parser: Column) -> DataFrame:
    return df.withColumns({name: F.when(parser.isin(*readers), made()) for name, (made, readers) in BASES.items()})


def _tail(collapsed: Column, separator: str) -> Column:
    """What follows the first separator of a collapsed text; null without one."""
    at = F.instr(collapsed, separator)
    return F.when(at > 0, F.trim(F.substring(collapsed, at + len(separator), F.length(collapsed))))


@dataclass(frozen=True)
class Side:
    kind: str
    member: str | None
    text: Column | None

    def column(self) -> Column:
        member = F.col(self.member) if self.member else F.lit(None).cast("string")
        text = self.text if self.text is not None else F.lit(None).cast("string")
        return F.struct(F.lit(self.kind).alias("kind"), member.alias("member"), text.alias("text"))


@dataclass(frozen=True)
class Rule:
    anchor: Side
    positive: Side
    anchor_text: Column
    unique: tuple[str, ...]
    lengths: tuple[tuple[Column, int, int], ...] = ()
    class_key: Column | None = None


def rules() -> dict[str, Rule]:
    """Rules over the columns of BASES and the pair's own."""
    query = F.col("__query")
    caption = label = F.coalesce("__answer", F.lit(""))
    question = _tail(query, QUESTION)
    wanted = F.coalesce(F.nullif(_tail(query, CAPTION), F.lit("")), _tail(query, NEWS_CAPTION))
    news, change = _tail(query, DOMAIN), _tail(query, CHANGES)
    named = collapse(F.nullif(F.regexp_extract("qry", LABELED, 1), F.lit("")))
    dialog, asked, related = _tail(F.col("__asked"), DIALOG), _tail(F.col("__asked"), ANSWERS), _tail(F.col("__answer"), RELATED)
    image, target = Side("image", QUERY_IMAGE, None), Side("image", POSITIVE_IMAGE, None)
    return {
        "image_to_text": Rule(image, Side("text", None, caption), caption, ("text",), ((caption, 20, 600),)),
        "text_to_image": Rule(Side("text", None, wanted), target, wanted, ("text",), ((wanted, 20, 600),)),
        "news": Rule(image, Side("text", None, news), news, ("text",), ((news, 20, 600),)),
        "question": Rule(Side("imagetext", QUERY_IMAGE, question), Side("text", None, caption), F.concat(question, F.lit("\n"), caption), ("text", "anchor_image"), ((question, 10, 500), (caption, 1, 300))),
        "class": Rule(image, Side("text", None, label), label, ("text", "anchor_image"), ((label, 2, 120),), label),
        "grounding": Rule(Side("imagetext", QUERY_IMAGE, named), target, named, ("text", "anchor_image", "positive_image"), ((named, 2, 120),)),
        "composed": Rule(Side("imagetext", QUERY_IMAGE, change), target, change, ("text", "anchor_image"), ((change, 10, 600),)),
        "similar": Rule(image, target, F.concat(F.lit("similar-image "), F.col(QUERY_IMAGE)), ("anchor_image", "positive_image")),
        "dialog": Rule(Side("text", None, dialog), target, dialog, ("text",), ((dialog, 20, 2500),)),
        "web_question": Rule(Side("text", None, asked), Side("imagetext", POSITIVE_IMAGE, related), asked, ("text",), ((asked, 10, 500), (related, 3, 600))),
    }


#: Dataset, tag, kind of pair, parser, cap for each class.
SUBSETS = [
    ("MSCOCO_i2t", "mci2", "retrieval", "image_to_text", None), ("VisualNews_i2t", "vni2", "retrieval", "image_to_text", None),
    ("N24News", "n24", "retrieval", "news", None), ("MSCOCO_t2i", "mct2", "retrieval", "text_to_image", None),
    ("VisualNews_t2i", "vnt2", "retrieval", "text_to_image", None), ("VisDial", "vdial", "dialog", "dialog", None),
    ("WebQA", "webqa", "webqa", "web_question", None), ("CIRR", "cirr", "composed", "composed", None),
    ("NIGHTS", "nights", "i2i", "similar", None), ("MSCOCO", "mgrnd", "grounding", "grounding", None),
    ("ImageNet_1K", "in1k", "cls", "class", 50), ("SUN397", "sun", "cls", "class", 60), ("VOC2007", "voc", "cls", "class", 100),
    ("A-OKVQA", "aokvq", "vqa", "question", None), ("OK-VQA", "okvq", "vqa", "question", None), ("DocVQA", "dvqa", "vqa", "question", None),
    ("InfographicsVQA", "ivqa", "vqa", "question", None), ("ChartQA", "cqa", "vqa", "question", None), ("Visual7W", "v7w", "vqa", "question", None),
]

#: Kind of pair, anchor view, positive view, lanes, task.
KINDS = [
    ("retrieval", "image", "text", ["image2text", "text2image"], "retrieval"), ("cls", "image", "text", ["image2label"], "classification"),
    ("vqa", "image-question", "text", ["vqa2text"], "vqa"), ("grounding", "image-query", "image-crop", ["imagetext2image"], "grounding"),
    ("composed", "image-query", "image", ["imagetext2image"], "composed-retrieval"), ("i2i", "image", "image-target", ["image2image"], "similarity"),
    ("dialog", "text", "image", ["text2image"], "dialog-retrieval"), ("webqa", "text", "image-info", ["text2imagetext"], "multimodal-qa"),
    ("docmatch", "image", "text", ["page2query", "query2page"], "doc-retrieval"),
]


def _outcome(rule: Rule) -> tuple[Column, Column]:
    """Drop reason (parse, length or null) and record of a row."""
    missing, wrong = F.lit(False), F.lit(False)
    for text, low, high in rule.lengths:
        missing = missing | text.isNull()
        wrong = wrong | ~F.length(text).between(low, high)
    key = rule.class_key if rule.class_key is not None else F.lit(None).cast("string")
    record = F.struct(rule.anchor.column().alias("anchor"), rule.positive.column().alias("positive"), rule.anchor_text.alias("anchor_text"), F.array(*map(F.lit, rule.unique)).alias("unique"), key.alias("class_key"))
    return F.when(missing, "parse").when(wrong, "length"), record


def parsed(df: DataFrame, parser: str) -> DataFrame:
    """Adds record and drop_reason (parse, length or null)."""
    reason, record = _outcome(rules()[parser])
    read = _with_bases(df, F.lit(parser)).withColumn("drop_reason", reason)
    return read.withColumn("record", F.when(F.col("drop_reason").isNull(), record)).drop(*BASES)


def parsed_by(df: DataFrame, parser: str) -> DataFrame:
    """The same for rows of several parsers, in one pass: the column names each row's. A row's texts are made once, then judged."""
    texts, reasons, records = None, F.lit(None).cast("string"), None
    for name, rule in rules().items():
        mine, made = F.col(parser) == name, []

        def held(text: Column | None, made: list = made) -> Column | None:
            if text is None:
                return None
            for i, known in enumerate(made):
                if known is text:
                    return F.get("__texts", F.lit(i))
            made.append(text)
            return F.get("__texts", F.lit(len(made) - 1))

        side = lambda s, held=held: Side(s.kind, s.member, held(s.text))
        after = Rule(side(rule.anchor), side(rule.positive), held(rule.anchor_text), rule.unique, tuple((held(t), low, high) for t, low, high in rule.lengths), held(rule.class_key))
        reason, record = _outcome(after)
        texts = F.when(mine, F.array(*made)) if texts is None else texts.when(mine, F.array(*made))
        reasons = F.when(mine, reason).otherwise(reasons)
        records = F.when(mine, record) if records is None else records.when(mine, record)
    read = _with_bases(df, F.col(parser)).withColumn("__texts", texts).withColumn("drop_reason", reasons)
    return read.withColumn("record", F.when(F.col("drop_reason").isNull(), records)).drop("__texts", *BASES)


def kinds(df: DataFrame) -> DataFrame:
    """Adds the views, lanes and task of column `kind`."""
    table = df.sparkSession.createDataFrame(KINDS, "kind string, anchor_view string, positive_view string, lanes array<string>, task string")
    return df.join(F.broadcast(table), "kind")  # nine rows


def modality(view: Column) -> Column:
    return F.split(view, "-")[0]
