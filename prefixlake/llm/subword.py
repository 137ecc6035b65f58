"""Averaged hashed subword embeddings under a linear softmax, trained by numpy SGD.

A document is three bags of features: character n-grams inside words (with one border character),
words, and pairs of neighbouring words. Each feature hashes to a bucket that owns a learned vector;
a document's vector is the mean over the bags of the mean vector of each bag, and a linear softmax
reads the classes from it. The pair feature is symmetric, so a word repeated over and over lands in
one bucket whatever the word is.

Features are taken in the executors, straight from Arrow buffers; only the bounded sparse bags of a
bounded training sample reach the driver. For scoring, every bucket's vector is multiplied with the
output layer once, which leaves one number per class and bucket to add up: the same function at a
fraction of the cost. That table is the only thing shipped to tasks, and its size is fixed by
``Buckets``, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from prefixlake.llm.textarrays import chunks, span_hashes, word_spans

_FOLD = np.array([ord(c) if len(c := chr(i).lower()) == 1 and not 0xD800 <= i < 0xE000 else i for i in range(1 << 16)], np.uint32)
_KEYS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


@dataclass(frozen=True)
class Buckets:
    """Sizes of the hashed tables (powers of two) and the n-gram orders."""

    grams: int = 1 << 17
    words: int = 1 << 16
    pairs: int = 1 << 15
    orders: tuple[int, ...] = (2, 3, 4)
    fold_case: bool = False

    @property
    def total(self) -> int:
        return self.grams + self.words + self.pairs


def _characters(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points (white space as one blank) and document offsets in them."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if fold:
        points = np.where(points < (1 << 16), _FOLD[points & 0xFFFF], points)
    return np.where((points <= 0x20) | (points == 0xA0), np.uint32(0x20), points), lead[offsets]


def _grams(points: np.ndarray, docs: np.ndarray, spec: Buckets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each place, and a mask of the places that count."""
    blank = points == 0x20
    last = np.repeat(docs[1:], np.diff(docs))
    places = np.arange(len(points))
    for n in spec.orders:
        m = max(0, len(points) - n + 1)
        h = np.full(m, n, np.uint32)
        good = places[:m] + n <= last[:m]
        for k in range(n):
            h += points[k : k + m] * _KEYS[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            if 0 < k < n - 1:
                good &= ~blank[k : k + m]
        if n == 2:
            good &= ~(blank[:m] & blank[1 : 1 + m])
        yield (h ^ (h >> np.uint32(13))) & np.uint32(spec.grams - 1), good


def _bags(texts: pa.Array, spec: Buckets) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, code points of each row, bags); a bag is (bucket of each feature, offsets of each row's features)."""
    for first, data, offsets in chunks(texts):
        points, docs = _characters(data, offsets, spec.fold_case)
        found, where = [], []
        for buckets, good in _grams(points, docs, spec):
            at = np.flatnonzero(good)
            found.append(buckets[at])
            where.append(np.searchsorted(at, docs))
        starts, ends, word = word_spans(data, offsets)
        folded = (data | np.uint8(0x20)) if spec.fold_case else data
        h = span_hashes(folded, starts, ends)
        words = (h >> np.uint64(40)).astype(np.uint32) & np.uint32(spec.words - 1)
        both = (h[:-1] ^ h[1:]) * np.uint64(0x9E3779B97F4A7C15)
        pairs = (both >> np.uint64(40)).astype(np.uint32) & np.uint32(spec.pairs - 1)
        last_word = np.zeros(len(h) + 1, bool)
        last_word[word[1:][word[1:] > 0] - 1] = True
        inside = np.flatnonzero(~last_word[: len(pairs)])
        bags = [(b, w) for b, w in zip(found, where, strict=True)]
        bags.append((words + np.uint32(spec.grams), word))
        bags.append((pairs[inside] + np.uint32(spec.grams + spec.words), np.searchsorted(inside, word)))
        yield first, np.diff(docs), bags


def sparse_bags(texts: pa.Array, spec: Buckets) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(code points, distinct buckets, weights adding to at most 1): the training form of a document."""
    for _, points, bags in _bags(texts, spec):
        share = 1.0 / len(bags)
        for i, n_points in enumerate(points.tolist()):
            ids, weights = [], []
            for buckets, at in bags:
                own = buckets[at[i] : at[i + 1]]
                if len(own):
                    distinct, n = np.unique(own, return_counts=True)
                    ids.append(distinct)
                    weights.append(n * (share / len(own)))
            if ids:
                yield n_points, np.concatenate(ids).astype(np.int32), np.concatenate(weights).astype(np.float32)
            else:
                yield n_points, np.zeros(0, np.int32), np.zeros(0, np.float32)


@dataclass
class SubwordModel:
    """A trained classifier folded to one logit per bucket and class.

    ``familiar`` holds, per class and bucket, the log share of the class's training features that fall
    there; a document's mean of it says how much its features are those of the class. A document is
    accepted if its calibrated probability reaches ``threshold`` and that mean, with ``slack`` over the
    root of its length, reaches ``least_familiar``.
    """

    classes: list[str]
    spec: Buckets
    table: np.ndarray  # classes x buckets
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    familiar: np.ndarray | None = None  # classes x buckets
    slack: float = 0.0
    least_familiar: float = -np.inf
    notes: dict = field(default_factory=dict)

    def _read(self, texts: pa.Array, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows x tables, the mean over the bags of each bag's mean entry; and each row's code points."""
        out, length = np.zeros((len(texts), len(tables)), np.float64), np.zeros(len(texts), np.int64)
        for first, points, bags in _bags(texts, self.spec):
            length[first : first + len(points)] = points
            for buckets, at in bags:
                n = np.diff(at)
                if not len(buckets):
                    continue
                full = np.flatnonzero(n)
                for k, table in enumerate(tables):
                    out[first + full, k] += np.add.reduceat(table.take(buckets), at[full], dtype=np.float64) / n[full] / len(bags)
        return out, length

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Rows x classes; a text without features has the bias alone."""
        return softmax((self._read(texts, list(self.table))[0] + self.bias) / self.temperature)

    def judged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's best class, its probability, and whether that is accepted."""
        both = [*self.table, *(self.familiar if self.familiar is not None else ())]
        read, length = self._read(texts, both)
        p = softmax((read[:, : len(self.classes)] + self.bias) / self.temperature)
        best, score = p.argmax(1), p.max(1)
        fine = score >= self.threshold
        if self.familiar is not None:
            fine &= familiarity(read[np.arange(len(best)), len(self.classes) + best], length, self.slack) >= self.least_familiar
        return best, score, fine


def familiarity(mean: np.ndarray, length: np.ndarray, slack: float) -> np.ndarray:
    """Mean log share of a document's features, raised by what chance alone may take from one of its length."""
    return mean + slack / np.sqrt(np.maximum(length, 1))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    bags: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    classes: list[str],
    spec: Buckets,
    *,
    dims: int = 8,
    epochs: int = 12,
    rate: float = 0.5,
    seed: int = 7,
    held: float = 0.15,
    keep: float = 0.999,
    lengths: np.ndarray | None = None,
) -> SubwordModel:
    """Fit by stochastic gradient descent (per-bucket adaptive steps), then calibrate.

    ``bags`` are :func:`sparse_bags` rows, ``labels`` class numbers. A ``held`` share of the sample
    is kept from the fit and sets the temperature (least negative log-likelihood) and the rejection
    threshold: the confidence that a share ``keep`` of its rightly classified documents exceeds.
    With ``lengths`` (code points) it also sets what a document must share with its class: every
    class is left out in turn, its held-out documents are judged by the best of the other classes, and
    the bound lies a third of the way from those to the share ``keep`` of rightly judged documents
    where the two are apart, else at that share. With no rows, or one class, the model is constant.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.5 / np.sqrt(dims), (spec.total, dims)).astype(np.float32)
    output = np.zeros((dims, len(classes)), np.float32)
    bias = np.zeros(len(classes), np.float32)
    steps, out_steps, bias_steps = np.full(spec.total, 1e-6, np.float32), np.full_like(output, 1e-6), np.full_like(bias, 1e-6)
    order = rng.permutation(len(bags))
    check, fit = order[: int(held * len(bags))], order[int(held * len(bags)) :]
    for _ in range(epochs if len(bags) else 0):
        for j in rng.permutation(fit):
            ids, w = bags[j]
            own = vectors[ids]
            hidden = w @ own
            grad = softmax(hidden @ output + bias)
            grad[labels[j]] -= 1
            back = output @ grad
            by_output = np.outer(hidden, grad)
            out_steps += by_output**2
            bias_steps += grad**2
            output -= 0.1 * by_output / np.sqrt(out_steps)
            bias -= 0.02 * grad / np.sqrt(bias_steps)
            # One step size per bucket, from the squared gradients its vector has met.
            steps[ids] += w * w * float(back @ back)
            vectors[ids] = own - (rate * 0.2 * w / np.sqrt(steps[ids]))[:, None] * back
    used = steps > 1e-6  # a bucket that training never met says nothing
    table = np.ascontiguousarray(np.where(used[:, None], vectors @ output, 0).astype(np.float32).T)
    model = SubwordModel(classes, spec, table, bias.astype(np.float64))
    if len(check):
        z = np.stack([table[:, ids] @ w + bias for ids, w in (bags[j] for j in check)]).astype(np.float64)
        y = labels[check]
        grid = np.geomspace(0.25, 8, 41)
        loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        right = p.argmax(1) == y
        model.notes = {"held": len(y), "accuracy": float(right.mean())}
        if right.any():
            model.threshold = float(min(0.5, np.quantile(p.max(1)[right], 1 - keep)))
        if lengths is not None:
            _fit_familiar(model, bags, labels, lengths, fit, check, z, keep)
    return model


def _fit_familiar(model: SubwordModel, bags: list, labels: np.ndarray, lengths: np.ndarray, fit: np.ndarray, check: np.ndarray, z: np.ndarray, keep: float) -> None:
    """Set ``familiar``, ``slack`` and ``least_familiar`` from the rows ``fit`` and ``check``."""
    mass = np.full((len(model.classes), model.spec.total), 1e-3, np.float64)
    for j in fit.tolist():
        np.add.at(mass[labels[j]], bags[j][0], bags[j][1])
    share = mass / mass.sum(1, keepdims=True)
    model.familiar = np.log(share).astype(np.float32)
    mean = (share * model.familiar).sum(1, keepdims=True)
    model.slack = float(np.sqrt((share * (model.familiar - mean) ** 2).sum(1)).max())
    own = np.stack([model.familiar[:, bags[j][0]] @ bags[j][1] for j in check])
    right = z.argmax(1) == labels[check]
    known = familiarity(own[np.arange(len(check)), labels[check]], lengths[check], model.slack)[right]
    if not len(known):
        return
    low = float(np.quantile(known, 1 - keep))
    if len(model.classes) > 1:
        other = z.copy()
        other[np.arange(len(check)), labels[check]] = -np.inf
        strange = familiarity(own[np.arange(len(check)), other.argmax(1)], lengths[check], model.slack)
        high = float(np.quantile(strange, 0.95))
        model.notes |= {"familiar": low, "strange": high, "strange_under_bound": float((strange < min(low, low / 3 + high * 2 / 3)).mean())}
        low = min(low, low / 3 + high * 2 / 3)
    model.least_familiar = low
