import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.llm import language_id as L

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(n):
    code = L.codewords(n)
    assert code.shape[0] == n and not (abs(code.sum(0)) == n).any()
    apart = [int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]]
    assert min(apart) >= (1 if n == 2 else code.shape[1] // 4)


def test_one_wrong_bit_is_corrected():
    code = L.codewords(5)
    model = L.Model(list("abcde"), code, np.zeros((1, 1)), np.ones(code.shape[1]))
    for lang in range(5):
        for bit in range(code.shape[1]):
            margins = code[lang].astype(float)[None].copy()
            margins[0, bit] *= -1
            assert model.decide(np.c_[margins, 1.0])[0][0] == lang


def test_margins_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    model = L.Model(["a"], np.ones((1, 3), np.int8), rng.normal(size=(L.N_FEATURES, 3)).astype(np.float32), np.ones(3))
    texts = [rng.integers(97, 122, n).astype(np.uint8).tobytes() for n in (1, 5, 300, 2, 77)]
    whole = model.margins(texts)
    monkeypatch.setattr(L, "BLOCK", 37)
    assert np.allclose(model.margins(texts), whole, atol=1e-4)
    assert np.allclose(model.margins([texts[2]])[0], whole[2], atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 250 and right >= 0.97
    again = L.identify(docs.withColumn("lang", F.when(L.remainder() == 1, "xx").otherwise(F.col("lang"))))
    assert not again.where("lang_pred = 'xx'").count()


def test_table(spark, awkward, empty):
    docs = awkward.withColumn("lang", F.when(F.col("doc_id") == 5, "en").when(F.col("doc_id") == 11, "de"))
    rows = {r.doc_id: r for r in L.identify(docs).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[9].lang_pred == "und" and rows[1].score == 0
    assert rows[4].lang_pred in ("en", "de") and 0 <= rows[4].score <= 1 and rows[None].held_out is False
    assert not L.identify(empty.withColumn("lang", F.lit("en"))).count()
    unlabelled = L.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in unlabelled] == ["und"]
    kept = L.accepted(docs)
    assert kept.columns == docs.columns and all(r.score == 0.5 for r in kept.collect()) and {r.doc_id for r in kept.collect()} == {5, 4, 7, None, 11, 12}


GREEK = "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. " * 2
RANDOM = "xqzj vkwp qqjx zzkv wqpx jjqz xvkq kkwz pqxj " * 4


def test_what_is_accepted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    others = spark.createDataFrame([(900_001, GREEK), (900_002, RANDOM), (900_003, "12 34 -- !"), (900_004, None), (900_005, "a")], "doc_id long, text string")
    every = docs.unionByName(others, allowMissingColumns=True)
    kept = L.accepted(every)
    assert kept.columns == every.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()} | {900_005}  # no clean document goes
    some = {r.lang for r in L.accepted(docs, languages=("de", "fr")).select("lang").distinct().collect()}
    assert some == {"de", "fr"}
    assert {r.doc_id for r in L.accepted(every.withColumn("lang", F.lit(None).cast("string"))).select("doc_id").collect()} == ids | {900_001, 900_002}


def test_ambiguity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.learn(docs)
    text = {k: docs.where((F.col("lang") == k) & (F.length("text") > 600)).orderBy("doc_id").first().text[:600] for k in ("de", "es", "fr")}
    rows = [(0, text["de"]), (1, text["fr"]), (2, text["fr"] + " " + text["es"]), (3, text["de"] + " " + text["fr"] + " " + text["es"])]
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert not got[0].ambiguous and not got[1].ambiguous and (got[2].ambiguous or got[3].ambiguous)
    assert min(r.known for r in got.values()) > 0.9
