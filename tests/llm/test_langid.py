"""Language identification: held-out accuracy, the parts of training, and defined results for awkward input."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import langid as L


def test_held_out_accuracy(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(big).join(big.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right / n > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_labels_of_held_out_rows_are_not_used(spark, docs):
    lied = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    a, b = L.fit(docs), L.fit(lied)
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature
    assert (a.weights == 0).mean() > 0.5  # sparse


def test_grams():
    assert len(L.grams(None)) == len(L.grams("")) == len(L.grams("12 34 !?")) == 0
    one = L.grams("Ab, cd!")
    assert np.array_equal(one, L.grams("ab...CD "))
    old, L.SPAN = L.SPAN, 3
    try:
        assert sorted(L.grams("Ab, cd! efg hi")) == sorted(_whole("Ab, cd! efg hi", old))
    finally:
        L.SPAN = old


def _whole(text, span):
    was, L.SPAN = L.SPAN, span
    try:
        return L.grams(text).tolist()
    finally:
        L.SPAN = was


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 500)
    logits = rng.normal(size=(500, 3)) * 3
    logits[np.arange(500), y] += 1
    t = L.fit_temperature(logits, y)
    loss = lambda t: -np.log(L.softmax(logits / t)[np.arange(500), y]).mean()
    assert t > 1 and loss(t) < min(loss(1), loss(t * 1.2), loss(t / 1.2))


def test_awkward_input(spark, awkward, nothing):
    got = {r.doc_id: r for r in L.identify(awkward).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 9)] == ["und"] * 4 and got[1].score == 0
    assert L.identify(awkward).count() == awkward.count() and got[None].held_out is False
    assert L.identify(nothing).count() == 0 and L.keep_identified(nothing).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}
    kept = L.keep_identified(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id in (1, 2, 3, 9)").count() == 0
