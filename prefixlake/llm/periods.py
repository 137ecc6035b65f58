"""Periodic runs of words: where a text repeats itself four times or more, at any period.

A run is a maximal stretch of words that has a smallest period. For every lag the matching pairs are
counted first, exactly: a frequent word by the autocorrelation of its places (a Fourier transform whose
sums are integers, so rounding restores them), a rare one by the differences of its places. A run of
period q holds at least three times q matches at lag q, so only lags with that many are looked at. There
an island of matches covers whole blocks of q words; blocks are probed at a few places, the survivors
compared as a whole and extended to both sides. Lags go upwards, and blocks inside a run of a smaller
period are left out, as no run whose smallest period is the lag can hold them. The work is about the
words to the power 1.5 for the counts, and the words times the logarithm of the lags for the probes.

Defined results: a null, empty or blank text has no words and no runs; rows are independent, so repeated
rows give equal results; an empty table gives an empty one. Input columns beyond ``doc_id`` and ``text``
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.textarrays import chunks

TIMES = 4
LEAST = 6
RUN = "struct<start:long,length:long,period:long>"
#: Lags up to this one are scanned whole, beyond it by blocks; both give every island.
SCANNED = 16
_PROBES = np.random.default_rng(5).random(32)


def _need(lag: np.ndarray | int) -> np.ndarray:
    """The least number of consecutive matches at a lag that makes a run."""
    return np.maximum(LEAST - lag, (TIMES - 1) * lag)


def lag_matches(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of word numbers: the count of equal pairs at every lag up to a quarter of a row's words.

    Returns the counts, one row's lags behind the other's, and where each row's lag 0 stands.
    """
    n = np.diff(offsets)
    furthest = n // TIMES
    base = np.concatenate([[0], np.cumsum(furthest + 1)])
    counts = np.zeros(base[-1], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words, row))
    place, row, sorted_words = order - offsets[row[order]], row[order], words[order]
    edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (sorted_words[1:] != sorted_words[:-1])])) if len(words) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(words)))
    # Rare words: place differences, the k-th next occurrence at a time.
    heavy = size > np.maximum(16, np.sqrt(n * np.log2(n + 2.0)))[row[edge]] if len(edge) else np.zeros(0, bool)
    end = np.repeat(edge + size, size)
    left, k = np.flatnonzero(~np.repeat(heavy, size)), 1
    while len(left):
        left = left[left + k < end[left]]
        lag = place[left + k] - place[left]
        near = lag <= furthest[row[left]]
        left, lag = left[near], lag[near]
        counts += np.bincount(base[row[left]] + lag, minlength=len(counts))
        k += 1
    # Frequent words: power spectra add up, one inverse transform a row.
    for r in np.unique(row[edge[heavy]]).tolist() if heavy.any() else []:
        points = 1 << int(n[r] + furthest[r]).bit_length()
        power = np.zeros(points // 2 + 1)
        for g in np.flatnonzero(heavy & (row[edge] == r)).tolist():
            there = np.zeros(points)
            there[place[edge[g] : edge[g] + size[g]]] = 1
            spectrum = np.fft.rfft(there)
            power += spectrum.real**2 + spectrum.imag**2
        pairs = np.rint(np.fft.irfft(power, points)[: furthest[r] + 1]).astype(np.int64)
        counts[base[r] : base[r + 1]] += pairs
    return counts, base


def _reach(w: np.ndarray, at: int, lag: int, step: int) -> int:
    """The end of the matches at ``lag`` that begin at ``at`` and go by ``step`` (1 or -1); ``at`` itself matches."""
    size = 64
    while True:
        if step > 0:
            stop = min(at + size, len(w) - lag)
            off = np.flatnonzero(w[at:stop] != w[at + lag : stop + lag])
            if len(off):
                return at + int(off[0])
            if stop == len(w) - lag:
                return stop
        else:
            stop = max(at - size, 0)
            off = np.flatnonzero(w[stop:at] != w[stop + lag : at + lag])
            if len(off):
                return stop + int(off[-1]) + 1
            if stop == 0:
                return 0
        at, size = stop, size * 2


def islands(w: np.ndarray, lag: int, inside: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches that make runs of period ``lag`` and are no part of a run of a smaller one.

    ``inside`` holds, for each word, the furthest end of the known runs that contain it.
    """
    need = int(_need(lag))
    if lag <= SCANNED:
        same = np.zeros(len(w) - lag + 2, np.int8)
        same[1:-1] = w[:-lag] == w[lag:]
        turn = np.flatnonzero(np.diff(same))
        found = [(s, e + lag) for s, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True) if e - s >= need]
        return [(s, e) for s, e in found if inside[s] < e]
    block = np.arange(0, len(w) - 2 * lag + 1, lag)
    block = block[inside[block] < block + 2 * lag]
    for probe in (_PROBES * lag).astype(np.int64).tolist():
        block = block[w[block + probe] == w[block + probe + lag]]
        if not len(block):
            return []
    found, done = [], -1
    for b in block.tolist():
        if b < done or not np.array_equal(w[b : b + lag], w[b + lag : b + 2 * lag]):
            continue
        start, done = _reach(w, b, lag, -1), _reach(w, b + lag, lag, 1)
        if done - start >= need and inside[start] < done + lag:
            found.append((start, done + lag))
    return found


def runs_of(w: np.ndarray, matches: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of the word numbers ``w``, by start, then period.

    ``matches`` holds the equal pairs at each lag from 0.
    """
    lags = np.arange(len(matches))
    found: list[tuple[int, int, int]] = []
    inside = np.zeros(len(w), np.int64)
    for lag in np.flatnonzero((matches >= _need(lags)) & (lags > 0)).tolist():
        new = islands(w, lag, inside)
        for start, end in new:
            found.append((start, end - start, lag))
        for start, end in new:
            np.maximum(inside[start:end], end, out=inside[start:end])
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def find_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of ``documents`` (doc_id, text).

    ``runs`` lists start, length and period in words, by start, then period; ``collapsed`` is the text
    with each run cut to its first period, words joined by one space.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flat, texts = [0], [], []
            for _, data, offsets in chunks(batch.column("text")):
                raw = data.tobytes()
                rows = [raw[i:j].split() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                numbers = np.asarray(pa.array([x for r in rows for x in r], pa.large_binary()).dictionary_encode().indices, np.int64)
                counts, base = lag_matches(numbers, ends)
                for i, words in enumerate(rows):
                    runs = runs_of(numbers[ends[i] : ends[i + 1]], counts[base[i] : base[i + 1]])
                    if len(runs):
                        words = [words[k] for k in np.flatnonzero(_kept(len(words), runs)).tolist()]
                    texts.append(b" ".join(words))
                    flat.append(runs)
                    at.append(at[-1] + len(runs))
            each = np.concatenate([np.zeros((0, 3), np.int64), *flat])
            fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(each[:, k])) for k in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, f"doc_id long, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest length over period, compared exactly; the first such by start, then period."""
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(1))), F.get(runs, F.lit(0)), lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))


def looped(doc_id: Column, text: Column) -> Column:
    """``text`` with a loop of words planted in one of ten documents, by the id's CRC; a null id has none.

    From word a on, its n words become a repetition of the next p, where a and p follow from the CRC.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(text)
