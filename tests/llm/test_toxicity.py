from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefixlake.llm import catalog, quality, toxicity
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(quality.fold_of(F.col("doc_id"), 3) != 1)
    return toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)


def test_held_out_toxicity(spark):
    rows = catalog.op13_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, s = rows.toxic.to_numpy(), rows.score.to_numpy()
    rank = s.argsort().argsort()
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert auc > 0.9 and ((s >= 0.7) == rows.predicted.astype(bool)).all() and ((s >= 0) & (s <= 1)).all()
    assert rows.predicted[y == 1].mean() > 0.5 and rows.predicted[y == 0].mean() < 0.03  # of 95


def test_held_out_toxicity_of_more_rows(spark):
    """At sf0.1; a fifth of its toxic texts are marked by syllables that clean texts hold by chance too."""
    sf = "/root/testdata/sf0.1"
    rows = catalog.op13_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert rows.predicted[rows.toxic == 1].mean() > 0.75 and rows.predicted[rows.toxic == 0].mean() < 0.005


def test_few_words_in_a_long_text(model, spark):
    """Toxic words count as much in a long clean text as in a short one, wherever they stand."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0"), "doc_id").select("text").collect()]
    long = " ".join(texts[:40])
    words = long.split()
    half = len(words) // 2
    mixed = " ".join([*words[:half], "you", "stupid", "worthless", "idiot,", "pathetic", "scum", *words[half:]])
    p, begin, size = model.judged(pa.array([long, mixed]))
    assert p[0] < 0.5 < 0.7 <= p[1] and half <= begin[1] <= half + 5 and size[1] == toxicity.WORDS


def test_unseen_misspellings_share_vectors(model):
    plain = "the thing and the other"
    for wrong in ("stupiid", "idiott", "worthles", "patheticc", "morron", "disgustingg"):
        near, far = (model.judged(pa.array([f"{plain} {w} {plain} {w}"]))[0][0] for w in (wrong, "quarterly"))
        assert near > far


def test_scores_are_the_network_on_the_worst_passage():
    """Folded odds equal bags times vectors; passages are the best of all stretches that share no word."""
    texts = pa.array(["one two three four five six seven", "", "x", "ab cd ab cd", None, "a b c d e f g h i j k"])
    rng = np.random.default_rng(0)
    model = toxicity.ToxicityModel(rng.normal(size=toxicity.SUBWORDS.grams).astype(np.float32), 0.25, slope=2.0, shift=-0.5, width=3, most=2)
    p, begin, size = model.judged(texts)
    for i, d in enumerate(toxicity._documents(texts, [0] * 6, toxicity.SUBWORDS)):
        stretches = [(b, min(3, d.words)) for b in range(max(1, d.words - 2))]
        odds = {s: float(model.odds[ids] @ w) if d.words else 0.0 for s in stretches for ids, w in [d.passage(*s)]}
        first = max(stretches, key=lambda s: odds[s])
        apart = [s for s in stretches if abs(s[0] - first[0]) >= 3]
        z = np.mean([odds[first], *([max(odds[s] for s in apart)] if apart else [])])
        assert np.isclose(p[i], 1 / (1 + np.exp(-(2 * (z + 0.25) - 0.5))), atol=1e-6)
        assert (begin[i], size[i]) == first


def test_odd_texts_and_labels(spark, documents):
    docs = documents([*ODD, *["you stupid thing"] * 12, *["a kind word"] * 12]).selectExpr("*", "1 as label", "2 as toxic", "3 as score")
    n = len(ODD)
    labels = spark.createDataFrame([*[(n + i, int(i < 12)) for i in range(24)], (n, 0), (0, None), (None, 1), (999, 1), (3, 7)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(rows) == n + 24 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[0]["score"] == rows[1]["score"] == rows[2]["score"] and rows[0]["passage_words"] == 0
    assert rows[n]["score"] == rows[n + 11]["score"] > rows[n + 12]["score"]


def test_nothing_to_learn(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents(["a b"]), none)
    assert [r["score"] for r in toxicity.score(documents(["a b", None]), model).collect()] == [0.5, 0.5]
    assert toxicity.score(documents([]), model).count() == 0
    only = toxicity.fit(documents(["a b", "c"]), spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, toxic int"))
    assert [r["score"] > 0.5 for r in toxicity.score(documents(["a b"]), only).collect()] == [True]
