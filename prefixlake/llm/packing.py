"""Best-fit packing of tokenised documents into fixed sequences, finished by swap-based local search.

Tokenising works word by word: the tokeniser drops white space before it splits, so a text's ids are
its words' ids in order, and a bounded per-worker table of words already met, looked up by 64-bit
hash for whole chunks of text at once, does most of the work.
Documents longer than a sequence are cut into pieces. Pieces are dealt by a hash of their contents
to shards of about ``SHARD_PIECES``; each shard starts from best-fit decreasing and then exchanges
pieces between underfull sequences (a move, one for one, two for one, one for two) whenever that
makes the fuller one fuller, which raises the sum of squared fills, until sequences empty or no
exchange is left. A shard loses less than one sequence against the bound, so larger shards only
trade parallelism for the last fraction of a percent.

Defined results: a null or empty text is the one id ``END``; repeated rows are separate documents;
pieces of equal length go in the order of their columns, so ties don't depend on partitions; an empty
table gives an empty result. ``tokenized`` reads doc_id and text alone, whatever else the table holds;
``pack`` keeps the columns of its pieces, but ``sequence_id`` and ``offset`` are its own.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.textarrays import chunks, span_hashes, word_spans

CAPACITY = 4096
END = 1
SHARD_PIECES = 16_384
WORDS_KEPT = 3_000_000
RECENT = 1 << 17
READ = 2 << 20
TOKENIZER = "word_bpe_49k.json"

_met: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """The table of a tokeniser file, kept by the Python worker from task to task."""
    if path not in _met:
        _met[path] = WordTable(path)
    return _met[path]


class WordTable:
    """The ids of words already met by one Python worker: sorted hashes over one pool of ids.

    New words go to a small sorted run first, which is merged into the large one when it is full.
    About 30 bytes a word; past ``WORDS_KEPT`` words the table starts afresh.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.runs = [none, none]  # (hashes, starts, lengths): the large run, the recent one
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode new words; ``hashes`` are distinct and not yet known."""
        if sum(len(r[0]) for r in self.runs) + len(words) > WORDS_KEPT:
            self.clear()
        lengths, parts = [], []
        for at in range(0, len(words), 20_000):
            for found in self.tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False):
                parts.extend(found.ids)
                lengths.append(len(found.ids))
        ids, lengths = np.array(parts, np.uint32), np.array(lengths, np.int64)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.runs[1] = self._merged(self.runs[1], (hashes, starts, lengths))
        if len(self.runs[1][0]) > RECENT:
            self.runs = [self._merged(*self.runs), tuple(x[:0] for x in self.runs[1])]

    @staticmethod
    def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each hash's ids in the pool, and whether it is known."""
        start, length, known = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        for held, starts, lengths in self.runs:
            rest = np.flatnonzero(~known)
            if len(held) and len(rest):
                at = np.minimum(np.searchsorted(held, hashes[rest]), len(held) - 1)
                hit = held[at] == hashes[rest]
                start[rest[hit]], length[rest[hit]], known[rest[hit]] = starts[at[hit]], lengths[at[hit]], True
        return start, length, known

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and where each text's ids begin (with the end).

        Words are runs without white space; a single full stop or comma after a letter at a word's
        end is a word of its own, as the tokeniser splits there too.
        """
        starts, ends, word = word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        cut = ((last == 0x2E) | (last == 0x2C)) & (ends - starts > 1) & (before >= 0x61) & (before <= 0x7A)
        index = np.repeat(np.arange(len(starts)), 1 + cut)
        second = np.zeros(len(index), bool)
        second[1:] = index[1:] == index[:-1]
        ends, starts = np.where(cut[index] & ~second, ends[index] - 1, ends[index]), np.where(second, ends[index] - 1, starts[index])
        word = np.concatenate([[0], np.cumsum(1 + cut)])[word]
        codes, distinct = pd.factorize(span_hashes(data, starts, ends))
        start, size, known = self.find(distinct)
        if not known.all():
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            raw = data.tobytes()

            def texts(which: np.ndarray) -> list[str]:
                return [raw[a:b].decode() for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]

            new = np.flatnonzero(~known)
            self.learn(distinct[new], texts(first[new]))
            start, size, known = self.find(distinct)
            if not known.all():  # the table started afresh
                new = np.flatnonzero(~known)
                self.learn(distinct[new], texts(first[new]))
                start, size, known = self.find(distinct)
        begin, length = start[codes], size[codes]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        return ids, total[word]


def tokenized(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document; ids are little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        table, end = word_table(tokenizer_path), np.array([END], np.uint32).tobytes()
        for batch in batches:
            for (first, plain, offsets), (_, folded, _) in zip(chunks(batch.column("text"), size=READ), chunks(batch.column("text"), lower=True, size=READ), strict=True):
                # The tokeniser folds case itself; folding A-Z before makes fewer distinct words. Only
                # where the text may name a special token, which is matched as written, is it left.
                ids, begins = table.encode(plain if b"<|" in plain.tobytes() else folded, offsets)
                row, piece, length, parts = [], [], [], []
                for i in range(len(offsets) - 1):
                    own = ids[begins[i] : begins[i + 1]].tobytes() + end
                    for k in range(0, len(own), 4 * capacity):
                        part = own[k : k + 4 * capacity]
                        row.append(first + i)
                        piece.append(k // (4 * capacity))
                        length.append(len(part) // 4)
                        parts.append(part)
                numbers = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(numbers), pa.array(numbers.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(parts, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers by bin."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        k = bisect.bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free > n:
            bisect.insort(room, (free - n, b))
    return bins


def _exchange(victim: list[int], other: list[int], slack: int, lengths: list[int]) -> bool:
    """One exchange that fills ``other`` further at ``victim``'s cost; False if there is none."""
    best, take, give = 0, (), ()
    mine = sorted(victim, key=lambda i: -lengths[i])
    theirs = sorted(((lengths[j], j) for j in other))
    sizes = [n for n, _ in theirs]
    for x in mine:  # a move, or one for one
        if best < lengths[x] <= slack:
            best, take, give = lengths[x], (x,), ()
        k = bisect.bisect_left(sizes, lengths[x] - slack)
        if k < len(sizes) and best < lengths[x] - sizes[k]:
            best, take, give = lengths[x] - sizes[k], (x,), (theirs[k][1],)
    if best < slack:
        for a in range(len(mine)):  # two for one
            for b in range(a + 1, len(mine)):
                both = lengths[mine[a]] + lengths[mine[b]]
                k = bisect.bisect_left(sizes, both - slack)
                if k < len(sizes) and best < both - sizes[k]:
                    best, take, give = both - sizes[k], (mine[a], mine[b]), (theirs[k][1],)
        for a in range(len(theirs)):  # one for two
            for b in range(a + 1, len(theirs)):
                both = sizes[a] + sizes[b]
                for x in mine:
                    if best < lengths[x] - both <= slack:
                        best, take, give = lengths[x] - both, (x,), (theirs[a][1], theirs[b][1])
    if not best:
        return False
    for x in take:
        victim.remove(x)
        other.append(x)
    for y in give:
        other.remove(y)
        victim.append(y)
    return True


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty the least filled bins into the others' room for as long as exchanges are found."""
    fills = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fills) // capacity)
    alive = sorted((k for k in range(len(bins)) if fills[k] < capacity), key=lambda k: fills[k])
    count, done = len(bins), []
    while count > least and len(alive) > 1:
        victim = alive.pop(0)
        found = True
        while bins[victim] and found:
            found = False
            for k in sorted(alive, key=lambda k: -fills[k]):
                if fills[k] < capacity and fills[k] >= fills[victim] and bins[victim] and _exchange(bins[victim], bins[k], capacity - fills[k], lengths):
                    moved = sum(lengths[i] for i in bins[k]) - fills[k]
                    fills[k] += moved
                    fills[victim] -= moved
                    found = True
        if bins[victim]:
            done.append(victim)
            break
        count -= 1
        alive = sorted((k for k in alive if fills[k] < capacity), key=lambda k: fills[k])
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item."""
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            where[i], offset[i] = b, at
            at += lengths[i]
    return where, offset


def pack(pieces: DataFrame, n_rows: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any more columns) with sequence_id and offset.

    ``n_rows`` is about the number of pieces and sets the number of shards.
    """
    shards = max(1, round(n_rows / SHARD_PIECES))
    clash = [c for c in pieces.columns if c in ("sequence_id", "offset", "_shard")]
    dealt = pieces.drop(*clash)
    dealt = dealt.withColumn("_shard", F.pmod(F.xxhash64(*[c for c in dealt.columns if c != "ids"]), F.lit(shards)))
    names = [c for c in dealt.columns if c != "_shard"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([c for c in names if c != "ids"], kind="stable")
        where, offset = pack_lengths(rows.length.tolist(), capacity)
        return rows[names].assign(sequence_id=where + (int(key[0]) << 32), offset=offset)

    schema = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes if n != "_shard") + ", sequence_id long, offset long"
    return dealt.groupBy("_shard").applyInPandas(run, schema)
