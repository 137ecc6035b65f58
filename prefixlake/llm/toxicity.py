"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly by numpy SGD.

A word is the mean of the vectors of its hashed character n-grams, borders included, so a misspelling
that training never met still shares vectors with the word it stands for. A passage is the mean of its
words, and a linear softmax reads the two classes from it. Every stretch of ``WORDS`` consecutive words
of the whole text is scored (or all of a shorter text), and a document is judged by the mean log odds of
its ``PASSAGES`` worst ones that share no word, so a few words count as much in a long text as in a short
one, and one word that is toxic by chance does not decide. Training fits vectors and output layer
together; a toxic document is represented by the passages that the current model finds worst, a clean
one by its worst and one drawn at random, so that clean texts are clean everywhere.

The fit reads a bounded sample of labelled documents (``Sample.rows``) and runs in one task; the table
that scoring needs, one number a bucket, has a fixed size.

Defined results: a null, empty or blank text counts as no words and has the bias alone; repeated rows
get equal scores; of repeated or contradictory labels of one document the least counts; an empty table
gives an empty result; without labels every score is 0.5. Columns beyond those named are ignored,
whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.quality import Sample
from prefixlake.llm.subword import Buckets, _characters, _grams, softmax
from prefixlake.llm.textarrays import chunks

SUBWORDS = Buckets(grams=1 << 18, words=0, pairs=0, orders=(3, 4, 5), fold_case=True)
WORDS = 3
PASSAGES = 2


def word_grams(texts: pa.Array, spec: Buckets = SUBWORDS) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, word offsets of the rows, n-grams) in chunks; n-grams are, for each order, (bucket, word number)."""
    framed = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()).fill_null(""), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    for first, data, offsets in chunks(framed):
        points, docs = _characters(data, offsets, spec.fold_case)
        blank = points == 0x20
        begins = ~blank & np.concatenate([[True], blank[:-1]])
        number = np.cumsum(begins) - 1
        words = np.concatenate([[0], np.cumsum(begins)])[docs]
        grams = []
        for buckets, good in _grams(points, docs, spec):
            at = np.flatnonzero(good)
            grams.append((buckets[at].astype(np.int64), number[at + 1]))  # the second character is never a border
        yield first, words, grams


def worst_passages(values: np.ndarray, words: np.ndarray, width: int = WORDS, most: int = PASSAGES) -> list[list[tuple[float, int, int]]]:
    """For each row of word values, its ``most`` stretches of ``width`` words with the greatest means that
    share no word, worst first: (mean, first word, words). A shorter row is one stretch, an empty one has mean 0."""
    upto = np.concatenate([[0.0], np.cumsum(values)])
    out: list[list[tuple[float, int, int]]] = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        n = b - a
        if n <= width:
            out.append([(float(upto[b] - upto[a]) / n if n else 0.0, 0, n)])
            continue
        means = (upto[a + width : b + 1] - upto[a : b - width + 1]) / width
        found = []
        while len(found) < most and means[i := int(means.argmax())] > -np.inf:
            found.append((float(means[i]), i, width))
            means[max(0, i - width + 1) : i + width] = -np.inf
        out.append(found)
    return out


@dataclass
class ToxicityModel:
    """The log odds that each bucket adds, the bias, and the calibration (slope, shift) of a document's log odds."""

    odds: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    spec: Buckets = SUBWORDS
    width: int = WORDS
    most: int = PASSAGES

    def judged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's probability of label 1, and its worst passage (first word, number of words)."""
        z, begin, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for first, words, grams in word_grams(texts, self.spec):
            total = int(words[-1])
            each, n = np.zeros(total), np.zeros(total, np.int64)
            for bucket, word in grams:
                each += np.bincount(word, self.odds[bucket], total)
                n += np.bincount(word, minlength=total)
            for i, found in enumerate(worst_passages(each / np.maximum(n, 1), words, self.width, self.most), first):
                z[i], begin[i], size[i] = sum(x[0] for x in found) / len(found), *found[0][1:]
        return 1 / (1 + np.exp(-np.clip(self.slope * (z + self.bias) + self.shift, -700, 700))), begin, size


@dataclass
class _Document:
    """A labelled document's n-grams by word: buckets, and where each word's begin."""

    label: int
    buckets: np.ndarray
    at: np.ndarray

    @property
    def words(self) -> int:
        return len(self.at) - 1

    def values(self, odds: np.ndarray) -> np.ndarray:
        return np.add.reduceat(odds[self.buckets], self.at[:-1]) / np.diff(self.at) if self.words else np.zeros(0)

    def passage(self, begin: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of consecutive words with their weights, which add to one."""
        n = np.diff(self.at[begin : begin + size + 1])
        return self.buckets[self.at[begin] : self.at[begin + size]], np.repeat(1.0 / (n * max(1, size)), n).astype(np.float32)


def _documents(texts: pa.Array, labels: list[int], spec: Buckets) -> list[_Document]:
    out: list[_Document] = []
    for _, words, grams in word_grams(texts, spec):
        bucket, word = np.concatenate([g[0] for g in grams]).astype(np.int32), np.concatenate([g[1] for g in grams])
        order = np.argsort(word, kind="stable")
        bucket, at = bucket[order], np.searchsorted(word[order], np.arange(int(words[-1]) + 1))
        for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
            out.append(_Document(labels[len(out)], bucket[at[a] : at[b]], at[a : b + 1] - at[a]))
    return out


def train(documents: list[_Document], spec: Buckets = SUBWORDS, *, width: int = WORDS, most: int = PASSAGES, dims: int = 8, epochs: int = 16, rate: float = 0.6, drop: float = 0.2, seed: int = 7, held: float = 0.15) -> ToxicityModel:
    """Fit vectors and output layer together by stochastic gradient descent with adaptive steps, then calibrate.

    The first epoch reads whole documents, the others the worst passages under the model so far (of the
    toxic ``most``, of the clean one) and one random passage of the clean. A share ``drop`` of a passage's n-grams is left out at each
    step, so that no single n-gram carries a word. A ``held`` share of the documents stays out of the fit
    and sets slope and shift by logistic regression with smoothed targets.
    """
    rng = np.random.default_rng(seed)
    labels = np.array([d.label for d in documents], np.int64)
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return ToxicityModel(np.zeros(spec.grams, np.float32), float(np.log(share / (1 - share))), spec=spec, width=width, most=most)
    vectors = rng.normal(0, 0.5 / np.sqrt(dims), (spec.grams, dims)).astype(np.float32)
    output, bias = np.zeros((dims, 2), np.float32), np.zeros(2, np.float32)
    steps, out_steps, bias_steps = np.full(spec.grams, 1e-6, np.float32), np.full_like(output, 1e-6), np.full_like(bias, 1e-6)

    def learn(ids: np.ndarray, weights: np.ndarray, label: int) -> None:
        nonlocal output, bias
        keep = rng.random(len(ids)) >= drop
        ids, back = np.unique(ids[keep], return_inverse=True)
        w = np.bincount(back, weights[keep], len(ids)).astype(np.float32) / (1 - drop)
        own = vectors[ids]
        hidden = w @ own
        grad = softmax(hidden @ output + bias)
        grad[label] -= 1
        by_vector, by_output = output @ grad, np.outer(hidden, grad)
        out_steps.__iadd__(by_output**2)
        bias_steps.__iadd__(grad**2)
        output -= 0.1 * by_output / np.sqrt(out_steps)
        bias -= 0.02 * grad / np.sqrt(bias_steps)
        steps[ids] += w * w * float(by_vector @ by_vector)
        vectors[ids] = own - (pace * w / np.sqrt(steps[ids]))[:, None] * by_vector

    def odds() -> np.ndarray:
        """What training never met says nothing."""
        return np.where(steps > 1e-6, vectors @ (output[:, 1] - output[:, 0]), 0).astype(np.float32)

    def worst(d: _Document, by: np.ndarray, most: int) -> list[tuple[float, int, int]]:
        return worst_passages(d.values(by), np.array([0, d.words]), width, most)[0]

    pace = rate
    order = rng.permutation(len(documents))
    check, fit = order[: int(held * len(order))], order[int(held * len(order)) :]
    for epoch in range(epochs):
        by, pace = odds(), rate * (1 - epoch / epochs)
        for j in rng.permutation(fit).tolist():
            d = documents[j]
            if not epoch:
                learn(*d.passage(0, d.words), d.label)
                continue
            for _, begin, size in worst(d, by, most if d.label else 1):
                learn(*d.passage(begin, size), d.label)
            if not d.label and d.words > width:
                learn(*d.passage(int(rng.integers(d.words - width + 1)), width), 0)
    model = ToxicityModel(odds(), float(bias[1] - bias[0]), spec=spec, width=width, most=most)
    y = labels[check]
    if len(y) and y.min() < y.max():
        z = np.array([np.mean([x[0] for x in worst(documents[j], model.odds, most)]) for j in check.tolist()]) + model.bias
        model.slope, model.shift = calibration(z, y)
    return model


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression of ``y`` on ``z`` by damped Newton steps, targets smoothed by class size.

    Both classes weigh the same, so the probability is that of a text as likely to be toxic as not.
    """
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    x = np.stack([z, np.ones_like(z)], 1)
    prior = np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        odds = x @ at
        return float((weight * (np.logaddexp(0, odds) - target * odds)).sum() + 0.005 * ((at - prior) ** 2).sum())

    fitted = prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ fitted, -700, 700)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (weight * (p - target)) + 0.01 * (fitted - prior))
        while loss(fitted - step) > loss(fitted) and np.abs(step).max() > 1e-9:
            step = step / 2
        fitted = fitted - step
    return max(1e-3, float(fitted[0])), float(fitted[1])


def fit(documents: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> ToxicityModel:  # noqa: B008
    """A model of ``labels`` (doc_id, toxic 0 or 1) from the texts of ``documents`` (doc_id, text).

    The sample is the ``sample.rows`` labelled ids of least hash of (seed, doc_id). Its texts go to one
    task, which trains; only the model comes to the driver. A lost executor runs that task again on the
    same rows.
    """
    order = F.xxhash64(F.lit(sample.seed), "doc_id")
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    drawn = marked.orderBy(order, "doc_id", "label").limit(sample.rows).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            labelled = batch.column("label").to_pylist()
            rows += zip(batch.column("doc_id").to_pylist(), _documents(batch.column("text"), labelled, SUBWORDS), strict=True)
        rows.sort(key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([d for _, d in rows]))], pa.binary())], names=["model"])

    made = texts.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([])


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, passage_start, passage_words) of every row of ``documents``: its calibrated
    probability of label 1 and its worst passage, in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, begin, size = model.judged(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(begin), pa.array(size)], names=["doc_id", "score", "passage_start", "passage_words"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passage_start long, passage_words long")
