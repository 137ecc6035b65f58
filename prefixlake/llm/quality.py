"""Quality classifier and language identification: two uses of averaged subword embeddings.

Both learn from a bounded sample of labelled documents (``Sample.rows``, drawn evenly by hash over
the whole table) and score every whole text. Defined results: a null text counts as empty; an empty
text gets the score of the bias alone; repeated rows get equal scores; an empty table gives an empty
result; with no learnable label every quality score is 0.5 and every language is ``und``. Input
columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.shared import packed, unpacked
from prefixlake.llm.subword import Buckets, SubwordModel, sparse_bags, train

UNDETERMINED = "und"


@dataclass(frozen=True)
class Sample:
    """The bound on the training sample: rows, and the share of them that sets the calibration."""

    rows: int = 6000
    seed: int = 11


LANGUAGE_SAMPLE = Sample(rows=6000)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sampled_bags(documents: DataFrame, labels: DataFrame, spec: Buckets, sample: Sample) -> DataFrame:
    """(doc_id, label, length, ids, weights): sparse bags of at most ``sample.rows`` documents that ``labels`` (doc_id, label) marks.

    The rows are those of least hash of (seed, doc_id), so the draw is even and repeatable; of several
    labels of one document the least counts. Only ids are ordered: texts are met in one scan behind a broadcast of the drawn ids, whose number is the
    bound, and only drawn documents are shuffled (to take one of each id).
    """
    order = F.xxhash64(F.lit(sample.seed), "doc_id")
    drawn = labels.select("doc_id", F.col("label").cast("string").alias("label")).dropna().orderBy(order, "doc_id", "label").limit(sample.rows)
    drawn = drawn.groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sparse_bags(batch.column("text"), spec))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1].tobytes() for x in found], pa.binary()), pa.array([x[2].tobytes() for x in found], pa.binary())],
                names=["doc_id", "label", "length", "ids", "weights"],
            )

    return texts.mapInArrow(bags, "doc_id long, label string, length long, ids binary, weights binary")


def _views(column: pa.Array, kind: type) -> list[np.ndarray]:
    """Each row's values, four bytes each, as views of the column's buffer."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4 if len(column) else np.zeros(1, np.int32)
    values = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    values = values[: len(values) // 4 * 4].view(kind)
    return [values[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def fit(documents: DataFrame, labels: DataFrame, spec: Buckets, sample: Sample = Sample(), rejects: bool = False) -> SubwordModel:  # noqa: B008
    """A model of ``labels`` (doc_id, label) from the texts of ``documents`` (doc_id, text).

    With ``rejects`` it also learns how familiar a text must be to belong to any class. The sample's bags
    go to one task, which trains; only the finished model, whose size ``spec`` and the classes fix, comes
    to the driver, and a lost executor means that the task runs again on the same rows.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray, np.ndarray, str, int]] = []
        for batch in batches:  # views of what arrived: the sample is held once
            ids, weights = _views(batch.column("ids"), np.int32), _views(batch.column("weights"), np.float32)
            rows += zip(batch.column("doc_id").to_pylist(), ids, weights, batch.column("label").to_pylist(), batch.column("length").to_pylist(), strict=True)
        rows.sort(key=lambda x: x[0])
        classes = sorted({x[3] for x in rows})
        numbers = np.array([classes.index(x[3]) for x in rows], np.int64)
        lengths = np.array([x[4] for x in rows], np.int64)
        model = train([(x[1], x[2]) for x in rows], numbers, classes, spec, lengths=lengths if rejects else None)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = sampled_bags(documents, labels, spec, sample).repartition(1).mapInArrow(learn, "model binary").collect()
    if not made:  # no partition at all: nothing to learn from
        return train([], np.zeros(0, np.int64), [], spec)
    return pickle.loads(made[0]["model"])


QUALITY = Buckets(grams=1 << 17, words=1 << 15, pairs=1 << 15, orders=(2, 3, 4))
LANGUAGE = Buckets(grams=1 << 16, words=1 << 15, pairs=1 << 10, orders=(2, 3, 4), fold_case=True)


def fit_quality(documents: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> SubwordModel:  # noqa: B008
    """Learn label 1 against 0 from ``labels`` (doc_id, quality) joined to whole texts."""
    marked = labels.select("doc_id", F.col("quality").alias("label")).where("label in (0, 1)")
    return fit(documents, marked, QUALITY, sample)


def score_quality(documents: DataFrame, model: SubwordModel) -> DataFrame:
    """doc_id and the calibrated probability of label 1 for every row of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = model.classes.index("1") if "1" in model.classes else -1
        for batch in batches:
            if good < 0:
                p = np.full(batch.num_rows, 0.0 if model.classes else 0.5)
            else:
                p = model.probabilities(batch.column("text"))[:, good]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def fit_language(documents: DataFrame, sample: Sample = LANGUAGE_SAMPLE) -> SubwordModel:
    """Learn the non-null ``lang`` of ``documents`` from its texts."""
    return fit(documents, documents.select("doc_id", F.col("lang").alias("label")), LANGUAGE, sample, rejects=True)


def score_language(documents: DataFrame, model: SubwordModel) -> DataFrame:
    """doc_id, lang_pred, score and accepted for every row of ``documents``.

    ``lang_pred`` is ``und`` and ``score`` 0 if the text is null or has no letter; those rows, and
    rows whose calibrated confidence is under the model's threshold, or whose features are too
    little those of the language predicted, are not ``accepted``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.classes, UNDETERMINED], object)
        for batch in batches:
            letters = np.asarray(batch.column("letters"))
            if model.classes:
                best, score, fine = model.judged(batch.column("text"))
            else:
                best, score, fine = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            best = np.where(letters, best, len(model.classes))
            score = np.where(letters & bool(model.classes), score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(fine & (best < len(model.classes)))],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return documents.select("doc_id", "text", letters.alias("letters")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def accepted_language(documents: DataFrame, model: SubwordModel) -> DataFrame:
    """The rows of ``documents``, all columns, whose language the model accepts: one pass, no join."""
    schema = documents.schema
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.asarray(batch.column("letters"))
            batch = unpacked(batch.column("row"), names)
            if model.classes:
                keep = keep & model.judged(batch.column(names.index("text")))[2]
            else:
                keep = np.zeros(batch.num_rows, bool)
            yield batch.filter(pa.array(keep))

    letters = F.coalesce(F.col("row.text").rlike(r"\p{L}"), F.lit(False))
    return packed(documents).select("row", letters.alias("letters")).mapInArrow(run, schema)
