from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefixlake.llm import lm
from tests.llm.conftest import ODD


def texts():
    rng = np.random.default_rng(5)
    follow = {i: rng.integers(0, 50, 2) for i in range(50)}
    out = []
    for _ in range(400):
        w, words = int(rng.integers(50)), []
        for _ in range(60):
            words.append(f"t{w}")
            w = int(rng.choice(follow[w]))
        out.append(" ".join(words))
    return out


def test_training_beats_unigrams_and_order_matters(spark, documents):
    docs = documents([*texts(), *ODD])
    vocabulary, net = lm.fit(docs)
    plain = lm.score(docs, vocabulary, lm.initial(vocabulary)).toPandas().set_index("doc_id").sort_index()
    trained = lm.score(docs, vocabulary, net).toPandas().set_index("doc_id").sort_index()
    assert trained.log_prob[:400].sum() > plain.log_prob[:400].sum() + 0.2 * plain.n_tokens[:400].sum()
    assert (trained.n_tokens[:400] == 60).all()
    first = 400
    assert list(trained.n_tokens[first : first + 5]) == [0, 0, 0, 1, 1] and trained.log_prob[first] == 0 and np.isnan(trained.mean_log_prob[first])
    assert trained.log_prob[first + 5] == trained.log_prob[first + 6]


def test_scores_are_probabilities():
    """Over all ids the network's probabilities at a place add up to one."""
    vocabulary = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(lm.IDS))
    net = lm.initial(vocabulary)
    rng = np.random.default_rng(1)
    net = {k: v + rng.normal(0, 0.1, v.shape).astype(np.float32) for k, v in net.items()}
    scorer, around = lm.Scorer(net), np.array([5, 9, 0, 7, 3])
    total = 0.0
    for word in range(lm.IDS):
        ids = around.copy()
        ids[2] = word
        total += float(np.exp(scorer.log_probabilities(ids, np.array([2]))[0]))
    assert abs(total - 1) < 1e-3


def test_tokens_keep_texts_apart():
    vocabulary = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(lm.IDS))
    ((_, ids, begins),) = lm.tokens(pa.array(["a b", None, "c"]), vocabulary)
    assert [int((ids[b:e] != lm.EDGE).sum()) for b, e in zip(begins[:-1], begins[1:], strict=True)] == [2, 0, 1]
    assert all((ids[b - lm.REACH : b] == lm.EDGE).all() for b in begins)


def test_empty(documents):
    docs = documents([])
    assert lm.score(docs, *lm.fit(docs)).count() == 0


@pytest.mark.parametrize("tokens", [1 << 23, 64])
def test_every_distinct_word_has_its_own_probability(spark, documents, monkeypatch, tokens):
    """Rarer words share ids in the network, but not their probability, however their shards are dealt to groups."""
    monkeypatch.setattr(lm, "SHARE_TOKENS", tokens)
    count = {f"common{i}": 5 for i in range(lm.TOP - 1)} | {f"rare{i}": 1 + i % 3 for i in range(5000)}
    vocabulary = lm.fit_vocabulary(documents([" ".join([w] * n) for w, n in count.items()]))
    words = list(count)
    asked = documents([*words, "rare1 rare1 unheard"]).repartition(8)
    if tokens == 64:  # one word in a third of all texts: its shard is many groups
        asked = asked.unionByName(documents(["rare2"] * 2000).withColumn("doc_id", F.col("doc_id") + 1_000_000).repartition(40))
    got = lm.score(asked, vocabulary, lm.initial(vocabulary)).toPandas().set_index("doc_id").sort_index().log_prob
    ((_, ids, begins, _),) = lm.hashed_tokens(pa.array(words), vocabulary)
    net = lm.Scorer(lm.initial(vocabulary)).log_probabilities(ids, begins[:-1])
    own = ids[begins[:-1]]
    part = np.array([np.log(count[w] / vocabulary.counts[i]) for w, i in zip(words, own, strict=True)])
    if tokens == 64:
        assert np.allclose(got[got.index >= 1_000_000], got[words.index("rare2")], atol=1e-6)
        got = got[got.index < 1_000_000]
    assert np.allclose(got[: len(words)], net + part, atol=1e-6)
    assert (part[: lm.TOP - 1] == 0).all() and part.min() < -1
    assert abs(np.exp(got[: len(words)]).sum() - np.exp(net[np.unique(own, return_index=True)[1]]).sum()) < 1e-6
    assert got[len(words)] < 2 * got[words.index("rare1")] < 0


def test_every_token_is_a_target():
    vocabulary = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(lm.IDS))
    ((_, ids, _),) = lm.tokens(pa.array(["a b c", None, "d " * 500]), vocabulary)

    class Recorder(lm.Trainer):
        seen: list = []

        def step(self, context, ids):
            self.seen.append((context, ids))

    recorder = Recorder(lm.initial(vocabulary))
    recorder.drain(ids, np.random.default_rng(0))
    targets = np.concatenate([x[1] for x in recorder.seen])
    assert sorted(targets) == sorted(ids[ids != lm.EDGE]) and len(targets) == 503
    assert all(x[0].shape[1] == len(lm.SIDES) for x in recorder.seen)


def test_training_does_not_depend_on_partitions(documents, monkeypatch):
    monkeypatch.setattr(lm, "PART_TOKENS", 1500)  # many parts, and more than one level of merging
    monkeypatch.setattr(lm, "FAN", 3)
    docs = documents(texts())
    _, one = lm.fit(docs.repartition(2))
    _, two = lm.fit(docs.repartition(5))
    assert all(np.array_equal(one[k], two[k]) for k in one)
