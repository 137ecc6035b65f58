from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prefixlake.llm import catalog, quality
from prefixlake.llm.subword import Buckets, softmax, sparse_bags, train
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    rows = catalog.op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, s = rows.quality.to_numpy(), rows.score.to_numpy()
    rank = s.argsort().argsort()
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert auc > 0.95 and ((s >= 0.5) == rows.predicted.astype(bool)).all() and ((s >= 0) & (s <= 1)).all()


def test_held_out_language(spark):
    rows = catalog.op3_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("accepted").cast("double"))).first()
    assert r[0] > 0.98 and r[1] > 0.98


def test_odd_texts(spark, documents):
    docs = documents([*ODD, *["the cat sat on the mat"] * 5], source="x").withColumn("label", F.lit("clash"))
    model = quality.fit_language(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr")))
    got = {r["doc_id"]: r for r in quality.score_language(docs, model).collect()}
    assert len(got) == len(ODD) + 5 and [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and not got[0]["accepted"]
    assert got[3]["score"] == got[4]["score"] and got[5]["lang_pred"] == got[6]["lang_pred"]
    labels = spark.createDataFrame([(0, 1), (3, 0), (5, 1), (6, 1), (99, 0)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()}
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores.values())


def test_nothing_to_learn(spark, documents):
    docs = documents(["a b c"], lang=None)
    model = quality.fit_language(docs)
    assert [r["lang_pred"] for r in quality.score_language(docs, model).collect()] == ["und"]
    assert quality.accepted_language(docs, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()] == [0.5]
    assert quality.score_quality(documents([]), quality.fit_quality(documents([]), none)).count() == 0


def test_folded_table_equals_the_network():
    """Scoring by summed logits is the trained function: compare with bags times table, one by one."""
    texts = pa.array(["The cat sat.", "Le chat était assis là", "x x x x", ""])
    spec = Buckets(grams=1 << 10, words=1 << 8, pairs=1 << 8)
    bags = [(i, w) for _, i, w in sparse_bags(texts, spec)]
    model = train(bags, np.array([0, 1, 0, 1]), ["a", "b"], spec, held=0.0)
    direct = np.stack([model.table[:, i] @ w.astype(np.float64) + model.bias for i, w in bags])
    assert np.allclose(model.probabilities(texts), softmax(direct), atol=1e-5)


STRANGE = [
    "これは日本語の文章です。今日は天気がいいので散歩に行きます。",
    "Het weer is vandaag erg mooi en wij gaan met de kinderen naar het strand om te zwemmen.",
    "Dette er en norsk setning om været i dag og alt som skjer i byen.",
    "Это предложение на русском языке о погоде и прогулке.",
    "Ez egy magyar mondat az időjárásról és a városban történtekről.",
]


def test_languages_never_learnt_are_rejected(spark):
    """Real languages outside the sample, and each language of the sample left out in turn."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = spark.createDataFrame(list(enumerate(STRANGE)), "doc_id long, text string")
    assert quality.accepted_language(strange, quality.fit_language(docs)).count() == 0
    for left_out in ("de", "es"):
        model = quality.fit_language(docs.where(F.col("lang") != left_out))
        share = quality.score_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").groupBy(F.col("lang") == left_out).agg(F.avg(F.col("accepted").cast("double"))).collect()
        accepted = dict(tuple(r) for r in share)
        assert accepted[True] < 0.3 and accepted[False] > 0.98, (left_out, accepted)


def test_of_two_labels_the_least_counts(spark, documents):
    labels = spark.createDataFrame([(i, x) for i in range(30) for x in (str(i % 3), "9")], "doc_id long, label string")
    rows = quality.sampled_bags(documents(["a b"] * 30), labels.repartition(7), quality.QUALITY, quality.Sample()).collect()
    assert {r["doc_id"]: r["label"] for r in rows} == {i: str(i % 3) for i in range(30)}
