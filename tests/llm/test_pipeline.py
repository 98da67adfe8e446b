from pyspark.sql import functions as F

import corpus_pipeline as P
from cardloom.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, count = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == names and 0 < docs.count() <= count
        count = docs.count()
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == count


def test_copies_and_empty_texts(spark):
    a, b = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    rows = [(1, a, "en", "s", len(a)), (2, a, "en", "s", len(a)), (2, a, "en", "s", len(a)), (3, b, "en", "s", len(b)), (4, b.replace("beta59", "x"), "en", "s", 0), (5, None, None, None, None), (6, "1234", "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
    assert sorted(r.doc_id for r in docs.collect()) == [1, 3]
    clashing = docs.withColumns({n: F.lit(n) for n in ("lines_deleted", "lines_before", "kept_id", "score", "lang_pred", "k", "h", "gone", "n", "cls", "rep")})
    for _, stage in P.STAGES[:-1]:
        same = stage(spark, clashing, SF)
        assert same.columns == clashing.columns and all(r.lines_deleted == "lines_deleted" and r.score == "score" and r.gone == "gone" for r in same.collect())
    none = docs.where("false")
    for _, stage in P.STAGES:
        assert not stage(spark, none, SF).count()


GREEK = "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. " * 2


def test_language_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    other = docs.limit(1).withColumns({"doc_id": F.lit(900_001).cast("long"), "text": F.lit(GREEK), "lang": F.lit("en")})
    kept = P.language(spark, docs.union(other), SF)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_copy_that_shares_its_doc_id(spark):
    a, c = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"gamma{i}" for i in range(60))
    rows = [(1, a), (5, c), (5, a.replace("alpha59", "x")), (None, a), (None, c), (None, "only here and nowhere else at all"), (None, None), (None, None), (7, " "), (7, " ")]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([rows[i] for i in (0, 1, 5, 6, 7, 8, 9)], "doc_id long, text string").collect()))


def test_very_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(r.text for r in docs.where("text is not null and lang = 'en'").orderBy("doc_id").collect()) * 3
    rows = docs.limit(1).withColumns({"doc_id": F.lit(900_001).cast("long"), "text": F.lit(long), "lang": F.lit("en")})
    many = docs.union(rows).union(rows.withColumn("doc_id", F.lit(900_002).cast("long")))
    for name, stage in P.STAGES[:-1]:
        many = written(stage(spark, many, SF), name)
    ids = {r.doc_id for r in many.select("doc_id").collect()}
    assert len(long) > 300_000 and 900_002 not in ids


def by_force(rows):
    """The first three stages, step by step: rows (doc_id, text) with distinct doc_ids and texts in a learned language."""
    from test_jaccard import by_force as components
    from test_lines import lost_by_force

    rows = sorted(r for r in rows if r[1] and any(map(str.isalpha, r[1])))
    split = [[x.strip() for x in t.split("\n")] for _, t in rows]
    lost = lost_by_force([(x, [len(y.split()) for y in x]) for x in split])
    left = []
    for d, (i, t) in enumerate(rows):
        gone = lost.get(d, set())
        whole = gone and not any(x for p, x in enumerate(split[d]) if p not in gone)
        if not whole:
            left.append((i, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)))
    first = {d for d, _, low in components(left) if d == low}
    return {i: t for i, t in left if i in first}


def test_stages_by_force(spark):
    """What the pipeline keeps of a small table, and every kept text, against comparing all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").orderBy("doc_id").limit(160)
    want = by_force([(r.doc_id, r.text) for r in docs.collect()])
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
    assert {r.doc_id: r.text for r in docs.collect()} == want
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(want)


def test_queries_are_registered():
    import __spark_entry__ as e

    names = [n.split("_")[0] for n in e.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 11)) and "pipeline" in e.queries() and not set(e.oracle_sql()) - set(e.queries())
