"""Plans over texts: cleaning, samples, duplicates, guards, parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import guards, parsers, sampling
from cardloom.operators.sampling import SEED

from .common import WS, collapse_sql, hash_sql, modulo_sql, table

KEY = f"'{SEED}:documents:' || (doc_id + 1)"
LOW, HIGH = T.PASSAGE_LENGTH


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _key() -> Column:
    return sampling.sample_key(F.lit("documents"), F.col("doc_id") + 1)


def ingest(spark: SparkSession, d: str) -> DataFrame:
    """Sample, clean, length, duplicates: what each step takes, by source. Rows are counted by hash and source before they meet, and of
    each hash one row for each source decides which has the first, so no hash, frequent or null, gathers its rows in one task."""
    rows = _docs(spark, d).select("doc_id", "source", T.clean("text", LOW, HIGH).alias("said"), sampling.sampled_below(_key(), 0.5).alias("drawn"))
    rows = rows.select("doc_id", "source", "drawn", F.col("said").isNull().alias("unfit"), F.when(F.col("drawn"), T.dedup_hash("said")).alias("hash"))
    groups = rows.groupBy("source", "drawn", "unfit", "hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    kept = (F.col("hash").isNotNull() & (F.row_number().over(Window.partitionBy("hash").orderBy("first")) == 1)).cast("long")
    said = lambda reason, n: F.struct(F.lit(reason).alias("drop_reason"), n.alias("n"))
    parts = F.when(~F.col("drawn"), F.array(said("not_sampled", F.col("n")))).when(F.col("unfit"), F.array(said("length", F.col("n"))))
    parts = parts.otherwise(F.array(said("kept", F.col("kept")), said("duplicate", F.col("n") - F.col("kept"))))
    each = groups.withColumn("kept", kept).select("source", F.inline(parts)).where("n > 0")
    return each.groupBy("source", "drop_reason").agg(F.sum("n").alias("n"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.clean("text", LOW, HIGH).alias("cleaned"), T.clean_window("text").alias("windowed"))


def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(T.collapse("text"))
    rows = _docs(spark, d).withColumn("drop_reason", F.when(n < LOW, "short").when(n > HIGH, "long"))
    return guards.drop_counts(rows, "lang")


BANDS = [(20, 600), (10, 500), (1, 300), (2, 120), (20, 2500), (3, 600)]


def len_bands(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return _docs(spark, d).groupBy("source").agg(*[F.sum(n.between(a, b).cast("long")).alias(f"in_{a}_{b}") for a, b in BANDS])


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", T.dedup_hash("text").alias("hash"))
    return sampling.first_by(rows, ["hash"], ["doc_id"])


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return guards.duplicate_ids(_docs(spark, d).select(T.dedup_hash("text").alias("hash")), "hash")


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(
        "doc_id", T.dedup_hash("text").alias("dedup_hash"), T.query_key("text").alias("query_key"), T.item_id(F.lit("text"), F.col("text"), F.lit(None).cast("string")).alias("item_id"),
        T.media_name(F.col("text").cast("binary"), "wav").alias("media_name"), T.capitalized("text").alias("capitalized"), T.after("text", ", ").alias("after_comma"),
        T.clipped("text", 100).alias("clipped"), T.first_line("text").alias("first_line"),
    )


def hash_sample_lt(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(sampling.sampled_below(_key(), 0.37)).select("doc_id", "source")


def hash_sample_le(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(sampling.sampled_up_to(_key(), 0.37)).select("doc_id", "source")


def hash_sample_10000(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(sampling.sampled_below(sampling.sample_key(F.col("doc_id")), 0.25, 10_000)).select("doc_id")


def hash_subset20(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(sampling.sampled_below(sampling.sample_key(F.lit("t2a"), F.col("doc_id")), 0.2, 100)).select("doc_id")


def ordered_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of fixed size by hash order, the feature being its limit."""
    return _docs(spark, d).select("doc_id", "lang").orderBy(sampling.shuffled(F.col("doc_id")), "doc_id").limit(250)


def stratified_cap(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_by(_docs(spark, d).select("doc_id", "source"), ["source"], [sampling.shuffled(F.col("doc_id")), "doc_id"], 8)


def first_per_label(spark: SparkSession, d: str) -> DataFrame:
    label = F.split(T.collapse("text"), " ")[0]
    return sampling.first_by(_docs(spark, d).select("doc_id", label.alias("label")), ["label"], ["doc_id"])


def first_mid_last(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_middle_last(_docs(spark, d).select("doc_id", "source"), "source", "doc_id")


def reject_and_advance(spark: SparkSession, d: str) -> DataFrame:
    ok = F.length(T.collapse("text")).between(LOW, HIGH)
    return sampling.first_passing(_docs(spark, d), ["source"], "doc_id", ok, 3).select("doc_id", "source", "taken")


def first_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first documents of each source; a text of the wrong length is emptied, its row stays."""
    rows = _docs(spark, d).select("doc_id", "source", T.collapse("text").alias("said"))
    return sampling.first_then_gated(rows, ["source"], "doc_id", 5, {"said": F.length("said").between(LOW, HIGH)})


def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.numbered(_docs(spark, d).select("doc_id", "lang"), "doc_id", "n", "lang")
    return rows.select("doc_id", F.format_string("%s-%07d", "lang", "n").alias("card"), sampling.dealt("n", 4).alias("worker"), sampling.binned("n", 128).alias("chunk"))


def grouped_bins(spark: SparkSession, d: str) -> DataFrame:
    from cardloom.operators.cards import grouped_bins as bins

    return bins(_docs(spark, d).select("doc_id", "source"), "source", "doc_id", 100).groupBy("bin", "source").agg(F.count("*").alias("n"))


def guard_anti_hash(spark: SparkSession, d: str) -> DataFrame:
    guard = table(spark, d, "benchmark").select(T.dedup_hash("text").alias("hash"))
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return guards.without(lines.select("doc_id", "pos", T.dedup_hash("line").alias("hash")), guard, ["hash"]).groupBy("doc_id").agg(F.count("*").alias("lines_left"))


def _member() -> Column:
    split = F.when(F.col("lang") == "de", "val2014").otherwise("train2014")
    return F.concat(F.lit("images/"), split, F.lit("/"), F.col("source"), F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".jpg"))


def guard_first_reason(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", "source", _member().alias("member"))
    names = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select(T.basename("member").alias("name"))
    ids = table(spark, d, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 12, "0").alias("id"))
    return guards.drop_counts(guards.member_guard(docs, "member", names, ids), "source")


def decontaminate_substring(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a whole benchmark item as a substring."""
    return guards.holding(_docs(spark, d), "doc_id", table(spark, d, "benchmark"), "item_id").groupBy("doc_id").agg(F.countDistinct("item_id").alias("items"))


def front_slice(spark: SparkSession, d: str) -> DataFrame:
    """A slice of fixed place and size, the feature being its limits."""
    return sampling.front_slice(_docs(spark, d).select("doc_id", "lang"), "doc_id", 120, 40)


#: For each parser, what stands before the text in a query.
_LEAD = {
    "image_to_text": "", "text_to_image": "<|image_1|>\nFind it; it matches the given caption: ", "news": "<|image_1|>\nUse this for domain classification: ",
    "question": "<|image_1|>\nRepresent the given image with the following question: ", "class": "", "grounding": 'Select the part labeled as "cat" now', "composed": "<|image_1|>\nFind one with the described changes: ",
    "similar": "", "dialog": "Here is a dialog used for image retrieval: ", "web_question": "Find what answers this question: ",
}


def parse_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every document by every parser, in one scan."""
    leads = F.explode(F.array(*[F.struct(F.lit(name).alias("parser"), F.lit(lead).alias("lead")) for name, lead in _LEAD.items()]))
    docs = _docs(spark, d).select("doc_id", "text", leads.alias("p")).select("doc_id", "text", "p.*")
    qry = F.when(F.col("doc_id") % 9 == 0, F.col("text")).otherwise(F.concat("lead", "text"))
    pos = F.concat(F.when(F.col("parser") == "web_question", "related text information: ").otherwise(""), F.col("text"))
    rows = parsers.parsed_by(docs.withColumns({"qry": qry, "pos_text": pos, "qry_image_path": F.concat(F.lit("images/q"), "doc_id"), "pos_image_path": F.concat(F.lit("images/p"), "doc_id")}), "parser")
    return rows.select("doc_id", "parser", F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason"), F.col("record.anchor_text").alias("anchor_text"), F.col("record.anchor.kind").alias("anchor_kind"), F.col("record.positive.member").alias("positive_member"))


def _parse_sql() -> str:
    ws = lambda x: collapse_sql(x)
    query = ws("replace(qry, '<|image_1|>' || chr(10), '')")
    tail = lambda x, sep: f"CASE WHEN strpos({x}, '{sep}') > 0 THEN {ws(f'substr({x}, strpos({x}, {chr(39)}{sep}{chr(39)}) + {len(sep)})')} END"
    p = ws("pos_text")
    text = {
        "image_to_text": p, "text_to_image": tail(query, parsers.CAPTION), "news": tail(query, parsers.DOMAIN), "question": tail(query, parsers.QUESTION), "class": p,
        "grounding": "NULLIF(regexp_extract(qry, 'labeled as \"([^\"]+)\"', 1), '')", "composed": tail(query, parsers.CHANGES), "similar": "'similar-image ' || qi", "dialog": tail(ws("qry"), parsers.DIALOG), "web_question": tail(ws("qry"), parsers.ANSWERS),
    }
    bounds = {"image_to_text": (20, 600), "text_to_image": (20, 600), "news": (20, 600), "question": (10, 500), "class": (2, 120), "grounding": (2, 120), "composed": (10, 600), "dialog": (20, 2500), "web_question": (10, 500)}
    second = {"question": (p, 1, 300), "web_question": (tail(p, parsers.RELATED), 3, 600)}
    kind = {"text_to_image": "text", "dialog": "text", "web_question": "text", "question": "imagetext", "grounding": "imagetext", "composed": "imagetext"}
    member = ("text_to_image", "grounding", "composed", "similar", "dialog", "web_question")
    parts = []
    for name, lead in _LEAD.items():
        lead_sql = lead.replace("\n", "' || chr(10) || '")
        base = f"SELECT doc_id, 'images/q' || doc_id AS qi, 'images/p' || doc_id AS pi, CASE WHEN doc_id % 9 = 0 THEN text ELSE '{lead_sql}' || text END AS qry, '{'related text information: ' if name == 'web_question' else ''}' || text AS pos_text FROM documents"
        t, (p2, low2, high2) = text[name], second.get(name, ("'x'", 1, 1))
        low, high = bounds.get(name, (0, 10**9))
        reason = f"CASE WHEN t IS NULL OR p2 IS NULL THEN 'parse' WHEN length(t) NOT BETWEEN {low} AND {high} OR length(p2) NOT BETWEEN {low2} AND {high2} THEN 'length' ELSE 'kept' END"
        said = "t || chr(10) || p2" if name == "question" else "t"
        parts.append(
            f"SELECT doc_id, '{name}' AS parser, drop_reason, CASE WHEN drop_reason = 'kept' THEN {said} END AS anchor_text, CASE WHEN drop_reason = 'kept' THEN '{kind.get(name, 'image')}' END AS anchor_kind, CASE WHEN drop_reason = 'kept' THEN {'pi' if name in member else 'NULL'} END AS positive_member FROM (SELECT *, {reason} AS drop_reason FROM (SELECT *, {t} AS t, {p2} AS p2 FROM ({base})))"
        )
    return " UNION ALL ".join(parts)


_LICENSES = ["http://creativecommons.org/publicdomain/zero/1.0/", "http://creativecommons.org/licenses/by-nc/3.0/", "http://creativecommons.org/licenses/by/3.0/", "http://creativecommons.org/licenses/sampling+/1.0/", "", "Own Terms"]


def rights_tiers(spark: SparkSession, d: str) -> DataFrame:
    address = F.element_at(F.array(*map(F.lit, _LICENSES)), (F.col("doc_id") % len(_LICENSES) + 1).cast("int"))
    return _docs(spark, d).select("doc_id", T.rights_tier(address).alias("r")).select("doc_id", "r.tier", "r.license", "r.audit")


def boilerplate(spark: SparkSession, d: str) -> DataFrame:
    asked = F.concat(T.first_line("text"), F.when(F.col("doc_id") % 3 == 0, F.lit("\nAnswer in ONE word. ")).otherwise(F.lit("")))
    return _docs(spark, d).select("doc_id", T.without_boilerplate(asked).alias("query"))


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """Title as a query: markup's references stay as they are, the first line counts."""
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return table(spark, d, "pages").select("page_id", T.first_line(title).alias("query"), T.basename("url").alias("last_part"))


def page_queries_dedup(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", T.dedup_hash(F.split(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), " ")[0]).alias("dedup_hash"), F.sha2("html", 256).alias("sha"))
    guard = table(spark, d, "benchmark").select(T.dedup_hash(F.split("text", " ")[0]).alias("dedup_hash"))
    return guards.page_dedup(pages, guard, "page_id").select("page_id", "dedup_hash")


def source_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).cube("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def html_unescape(spark: SparkSession, d: str) -> DataFrame:
    from cardloom.functions.arrow import html_escape, html_unescape

    text = html_unescape(F.regexp_replace("html", "<[^>]*>", " "))
    return table(spark, d, "pages").select("page_id", T.collapse(text).alias("text"), (html_unescape(html_escape("url")) == F.col("url")).alias("round_trip"))


def model_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries out of a model's answer, which is JSON inside prose."""
    answer = F.concat(F.lit("Sure: "), F.to_json(F.split("text", "\n")), F.lit(" done"))
    return _docs(spark, d).select("doc_id", T.json_queries(answer, 3).alias("queries"))


_SAMPLE = "SELECT doc_id, source FROM documents WHERE {} {} {}"
QUERIES = {
    f.__name__: f
    for f in (ingest, clean_text, drop_reasons, len_bands, dedup_first, duplicate_groups, text_keys, hash_sample_lt, hash_sample_le, hash_sample_10000, hash_subset20, ordered_sample, stratified_cap, first_per_label, first_mid_last, reject_and_advance, first_candidates, dense_ids, grouped_bins, guard_anti_hash, guard_first_reason, decontaminate_substring, front_slice, parse_pairs, rights_tiers, boilerplate, page_titles, page_queries_dedup, source_rollup, html_unescape, model_queries)
}

_CLEAN = f"""WITH c AS (SELECT *, {collapse_sql('text')} AS s FROM documents), d AS (SELECT *, left(s, {HIGH}) AS cut FROM c),
 e AS (SELECT *, strpos(reverse(cut), ' ') AS back, length(cut) - strpos(reverse(cut), ' ') AS sp FROM d),
 f AS (SELECT *, CASE WHEN length(s) < {LOW} THEN NULL WHEN length(s) <= {HIGH} THEN s WHEN back > 0 AND sp > {0.7 * HIGH} THEN left(cut, sp) ELSE cut END AS cleaned FROM e)"""

ORACLES = {
    "ingest": f"""{_CLEAN}, g AS (SELECT *, {modulo_sql(KEY, 1000000)} < 500000 AS drawn FROM f), h AS (SELECT *, CASE WHEN drawn THEN {hash_sql('cleaned')} END AS hash FROM g),
 i AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS nth FROM h)
 SELECT source, CASE WHEN NOT drawn THEN 'not_sampled' WHEN cleaned IS NULL THEN 'length' WHEN hash IS NOT NULL AND nth > 1 THEN 'duplicate' ELSE 'kept' END AS drop_reason, count(*) AS n FROM i GROUP BY ALL""",
    "clean_text": f"{_CLEAN} SELECT doc_id, cleaned, CASE WHEN length(s) BETWEEN 8 AND 600 THEN s END AS windowed FROM f",
    "drop_reasons": f"SELECT lang, CASE WHEN length({collapse_sql('text')}) < {LOW} THEN 'short' WHEN length({collapse_sql('text')}) > {HIGH} THEN 'long' ELSE 'kept' END AS drop_reason, count(*) AS n FROM documents GROUP BY ALL",
    "len_bands": "SELECT source, " + ", ".join(f"sum((length(text) BETWEEN {a} AND {b})::BIGINT)::BIGINT AS in_{a}_{b}" for a, b in BANDS) + " FROM documents GROUP BY source",
    "dedup_first": f"SELECT min(doc_id) AS doc_id, hash FROM (SELECT doc_id, {hash_sql('text')} AS hash FROM documents) GROUP BY hash",
    "duplicate_groups": f"SELECT {hash_sql('text')} AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "text_keys": f"""SELECT doc_id, {hash_sql('text')} AS dedup_hash, sha256(lower(text)) AS query_key, left(sha256('text||' || text), 32) AS item_id, left(sha256(text), 16) || '.wav' AS media_name,
 upper(left(text, 1)) || lower(substr(text, 2)) AS capitalized, CASE WHEN strpos(text, ', ') > 0 THEN {collapse_sql("substr(text, strpos(text, ', ') + 2)")} END AS after_comma, left(text, 100) AS clipped,
 {collapse_sql(f"split_part(regexp_replace(text, '^{WS}|{WS}$', '', 'g'), chr(10), 1)")} AS first_line FROM documents""",
    "hash_sample_lt": _SAMPLE.format(modulo_sql(KEY, 1000000), "<", 370000),
    "hash_sample_le": _SAMPLE.format(modulo_sql(KEY, 1000000), "<=", 370000),
    "hash_sample_10000": f"SELECT doc_id FROM documents WHERE {modulo_sql(f'{chr(39)}{SEED}:{chr(39)} || doc_id', 10000)} < 2500",
    "hash_subset20": f"SELECT doc_id FROM documents WHERE {modulo_sql(f'{chr(39)}{SEED}:t2a:{chr(39)} || doc_id', 100)} < 20",
    "ordered_sample": f"SELECT doc_id, lang FROM documents ORDER BY sha1('{SEED}:' || doc_id), doc_id LIMIT 250",
    "stratified_cap": f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha1('{SEED}:' || doc_id), doc_id) <= 8",
    "first_per_label": f"SELECT min(doc_id) AS doc_id, label FROM (SELECT doc_id, split_part({collapse_sql('text')}, ' ', 1) AS label FROM documents) GROUP BY label",
    "first_mid_last": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE i = 0 OR i = n // 2 OR i = n - 1",
    "reject_and_advance": f"""WITH p AS (SELECT *, length({collapse_sql('text')}) BETWEEN {LOW} AND {HIGH} AS ok FROM documents), q AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS k FROM p)
 SELECT doc_id, source, ok AS taken FROM q WHERE (ok AND k <= 3) OR (NOT ok AND k < 3)""",
    "first_candidates": f"SELECT doc_id, source, CASE WHEN length(s) BETWEEN {LOW} AND {HIGH} THEN s END AS said FROM (SELECT *, {collapse_sql('text')} AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5",
    "dense_ids": "SELECT doc_id, lang || '-' || lpad(n::VARCHAR, 7, '0') AS card, n % 4 AS worker, n // 128 AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS n FROM documents)",
    "grouped_bins": "SELECT bin, source, count(*) AS n FROM (SELECT *, (row_number() OVER (ORDER BY left(sha1(source), 6), doc_id) - 1) // 100 AS bin FROM documents) GROUP BY ALL",
    "guard_anti_hash": f"SELECT doc_id, count(*) AS lines_left FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {hash_sql('line')} NOT IN (SELECT {hash_sql('text')} FROM benchmark) GROUP BY doc_id",
    "guard_first_reason": """WITH m AS (SELECT doc_id, source, CASE WHEN lang = 'de' THEN 'val2014' ELSE 'train2014' END AS split, lpad(doc_id::VARCHAR, 12, '0') AS id FROM documents)
 SELECT source, CASE WHEN split = 'val2014' THEN 'split' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'basename' WHEN id IN (SELECT lpad(item_id::VARCHAR, 12, '0') FROM benchmark) THEN 'id' ELSE 'kept' END AS drop_reason, count(*) AS n FROM m GROUP BY ALL""",
    "decontaminate_substring": "SELECT doc_id, count(DISTINCT item_id) AS items FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text) GROUP BY doc_id",
    "front_slice": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 120 OFFSET 40",
    "parse_pairs": _parse_sql(),
    "rights_tiers": "SELECT doc_id, ['commercial', 'research_only', 'commercial_after_attribution', 'research_only', 'source_audit_required', 'source_audit_required'][doc_id % 6 + 1] AS tier, "
    f"['CC0 1.0', '{_LICENSES[1]}', 'CC BY', '{_LICENSES[3]}', 'unknown', 'own terms'][doc_id % 6 + 1] AS license, ['clear', 'pending', 'clear', 'pending', 'pending', 'pending'][doc_id % 6 + 1] AS audit FROM documents",
    "boilerplate": f"SELECT doc_id, {collapse_sql(f'split_part(regexp_replace(text, {chr(39)}^{WS}|{WS}${chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)}), chr(10), 1)')} AS query FROM documents",
    "page_titles": f"SELECT page_id, {collapse_sql('regexp_extract(html, {q}(?is)<title>(.*?)</title>{q}, 1)'.format(q=chr(39)))} AS query, split_part(url, '/', -1) AS last_part FROM pages",
    "page_queries_dedup": f"""WITH p AS (SELECT page_id, {hash_sql("split_part(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ' ', 1)")} AS dedup_hash FROM pages)
 SELECT min(page_id) AS page_id, dedup_hash FROM p WHERE dedup_hash NOT IN (SELECT {hash_sql("split_part(text, ' ', 1)")} FROM benchmark) GROUP BY dedup_hash""",
    "source_rollup": "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (source, lang)",
}
