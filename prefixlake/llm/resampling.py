"""Importance resampling towards a target distribution, over hashed word n-grams.

Features are runs of one to three consecutive words; a feature's bucket is the CRC-32 of its text modulo
the number of buckets. CRC-32 is linear over GF(2) apart from its ends, so a concatenation's CRC follows
from the CRCs of its parts: ``crc(ab) = shift(crc(a), len(b)) ^ crc(b)``, where ``shift`` multiplies by the
matrix that appending one zero byte stands for, raised to the length. Each word's CRC is taken once, pairs
and triples are composed from it, and no n-gram is ever built as text.

Two scans: the first counts buckets over the whole table and the whole target (a task gives one partial
histogram), the second adds each document's gains. The draw ranks by a range-partitioned sort, so no task
holds more than its range.

Defined results: a null or wordless text has no features, weight 0 and no rank; repeated rows are
documents of their own; a null ``doc_id`` takes its chance from the seed alone and loses ties; ties go to
the smaller ``doc_id``, then to the row met first; empty tables give empty results, an empty target leaves
every bucket at its prior. Input columns beyond ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.shared import written
from prefixlake.llm.textarrays import chunks, word_spans

BUCKETS = 10_000
WIDTH = 3
#: Lengths with a matrix of their own; longer ones are sums of powers of two.
SHORT = 64

_BYTE_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
_NOT_WORD = np.array([not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])


def _zero_byte(v: np.ndarray) -> np.ndarray:
    """The linear part of appending one zero byte to what has the CRC ``v``."""
    return _BYTE_STEP[v & 0xFF] ^ (v >> np.uint32(8))


def _times(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), given as what it makes of each byte at each of four places, times vectors."""
    return matrix[0, v & 0xFF] ^ matrix[1, (v >> np.uint32(8)) & 0xFF] ^ matrix[2, (v >> np.uint32(16)) & 0xFF] ^ matrix[3, v >> np.uint32(24)]


def _matrices() -> tuple[np.ndarray, list[np.ndarray]]:
    """Length-shift matrices: for each length under ``SHORT``, and for its doublings up to 2 ** 31 bytes."""
    one = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    short = [one]
    for _ in range(SHORT):
        short.append(_zero_byte(short[-1]))
    doubled = [short.pop()]
    while len(doubled) < 26:
        doubled.append(_times(doubled[-1], doubled[-1]))
    return np.stack(short), doubled


_SHORT, _DOUBLED = _matrices()
_BLANK = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as its length says, without the ends' inversions."""
    near = lengths % SHORT
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= _SHORT[near, k, (crc >> np.uint32(8 * k)) & 0xFF]
    far = lengths // SHORT
    for matrix in _DOUBLED:
        if not far.any():
            break
        odd = np.flatnonzero(far & 1)
        if len(odd):
            out[odd] = _times(matrix, out[odd])
        far = far >> 1
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every span: all spans advance by a byte at a time, long ones one by one."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-size, -SHORT))
    for j in range(int(size[long]) if long < len(size) else 0):
        some = slice(long, int(np.searchsorted(-size, -j)))
        crc[some] = _BYTE_STEP[(crc[some] ^ data[at[some] + j]) & 0xFF] ^ (crc[some] >> np.uint32(8))
    crc = ~crc
    for k in range(long):
        crc[k] = zlib.crc32(data[at[k] : at[k] + size[k]])
    out = np.empty(len(at), np.uint32)
    out[order] = crc
    return out


def bucketed(texts: pa.Array, buckets: int = BUCKETS, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, word offsets of the rows, features) in chunks; features hold, for each number of
    words, the bucket at each first word, and whether the n-gram stays within its row."""
    for first, data, offsets in chunks(texts, lower=True):
        data = np.where(_NOT_WORD[data], np.uint8(0x20), data)
        starts, ends, word = word_spans(data, offsets)
        length, crc = ends - starts, word_crcs(data, starts, ends)
        after_blank = shifted(np.full(len(crc), _BLANK), length) ^ crc
        last = np.repeat(word[1:], np.diff(word))
        grams, found = crc, []
        for n in range(1, width + 1):
            if n > 1:
                tail = slice(n - 1, None)
                grams = shifted(grams[: max(0, len(length) - n + 1)], length[tail] + 1) ^ after_blank[tail]
            found.append(((grams % np.uint32(buckets)).astype(np.int64), np.arange(len(grams)) + n <= last[: len(grams)]))
        yield first, word, found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, width: int = WIDTH) -> np.ndarray:
    """How often each bucket is hit by all rows of ``texts`` (text): partial histograms by task, then by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in bucketed(batch.column(0), buckets, width):
                for bucket, inside in found:
                    total += np.bincount(bucket[inside], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, target over source, rounded down."""
    k = len(source)
    up = (target + 1).astype(np.float64) * float(int(source.sum()) + k)
    down = (source + 1).astype(np.float64) * float(int(target.sum()) + k)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weighed(documents: DataFrame, gain: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``documents`` (doc_id, text)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, word, found in bucketed(batch.column("text"), len(gain), width):
                rows = slice(first, first + len(word) - 1)
                words[rows] = np.diff(word)
                for bucket, inside in found:
                    # A document's n-grams start at its words; those that would leave it count nothing.
                    for out, value in ((features, inside.astype(np.int64)), (weight, np.where(inside, gain[bucket], 0))):
                        upto = np.concatenate([[0], np.cumsum(value)])
                        at = np.minimum(word, len(value))
                        out[rows] += upto[at[1:]] - upto[at[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def chance(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that seed and id fix, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """Every document's features, weight, score and, for the drawn ``percent`` of those with ``least_words``, rank.

    ``documents`` (doc_id, text) are resampled towards ``target`` (text). The highest scores, weight plus
    chance, are a draw without replacement in proportion to the importance weights.
    """
    gain = gains(bucket_counts(documents, buckets, width), bucket_counts(target, buckets, width))
    scored = weighed(documents, gain, width).withColumn("score", F.col("weight") + chance(F.col("doc_id"), seed))
    scored = written(scored.withColumn("_row", F.monotonically_increasing_id()), "weighed")
    able = scored.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    # The place in a range-partitioned sort is the partition and the row's number in it.
    placed = written(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = sizes.select(F.col("_part"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    most = able.count() * percent // 100
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.when(rank <= most, rank))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(names).unionByName(others.select(names))
