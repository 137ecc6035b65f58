"""Line deduplication: documents probe a sharded minimal perfect hash instead of joining their lines.

1. Every task reduces its lines to (64-bit key hash, documents) counts; Spark adds them up, with
   map-side combining, so a line that every document holds costs one row per task.
2. Hashes found in at least ``min_docs`` documents are dealt to shards of about ``SHARD_KEYS``; each
   shard becomes a cascade of bit arrays (a minimal perfect hash: the rank of a key's bit is its
   place) over a fingerprint array and a count array. Rarer lines can drop nothing, so they are not
   indexed: a probe for one either meets no bit or a fingerprint that differs.
3. If all shards together stay under ``BROADCAST_BYTES`` they are broadcast, and one pass over the
   documents rewrites them. Beyond that, the distinct (document, line hash) pairs go to the shards,
   salted so that no group grows with the data, probe the same arrays there, and the hits return.

The fingerprint is the whole 64-bit hash, so probing is as exact as counting was.

Defined results: a null or empty text is one empty line, and comes back empty; empty keys are never
dropped; repeated rows are separate documents; an empty table gives an empty table; other columns
pass through unchanged, whatever their names: where one is called ``n_lines`` or ``n_dropped``, the count
of that name gets an underscore before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from prefixlake.llm.shared import free_name, packed, unpacked, written
from prefixlake.llm.textarrays import _LOWER, _SPACE, chunks, mix, span_hashes

SHARD_KEYS = 1 << 16
BROADCAST_BYTES = 64 << 20
PROBES_PER_GROUP = 1 << 20


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line: start, end, document, key hash, key length in code points. A document without bytes has one line."""
    breaks = np.flatnonzero(data == 10)
    lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    doc = np.repeat(np.arange(len(lines)), lines)
    first = np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(np.int64)
    starts, ends = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    rest = np.ones(len(doc), bool)
    rest[first] = False
    starts[first], starts[rest] = offsets[:-1], breaks + 1
    final = np.ones(len(doc), bool)
    final[first + lines - 1] = False
    ends[first + lines - 1], ends[final] = offsets[1:], breaks
    solid = np.flatnonzero(~_SPACE[data])
    if not len(solid):
        return starts, ends, doc, np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.int64)
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    left = np.where(some, solid[np.minimum(a, len(solid) - 1)], 0)
    right = np.where(some, solid[np.maximum(b - 1, 0)] + 1, 0)
    folded = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return starts, ends, doc, span_hashes(folded, left, right), points[right] - points[left]


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without repeats, ordered by hash."""
    order = np.lexsort((doc, h))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def line_counts(documents: DataFrame, min_chars: int) -> DataFrame:
    """(h, n): in how many rows of ``documents`` each line key of at least ``min_chars`` code points occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, data, offsets in chunks(batch.column("text")):
                _, _, doc, h, length = line_keys(data, offsets)
                found.append(_distinct(doc[length >= min_chars], h[length >= min_chars])[1])
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return documents.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _level_places(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


def build_shard(h: np.ndarray, counts: np.ndarray) -> dict[str, bytes]:
    """The arrays of one shard: level sizes, bits, fingerprints, counts."""
    levels, sizes, rest, place, filled = [], [], h, np.full(len(h), -1, np.int64), 0
    waiting = np.arange(len(h))
    while len(rest):
        size = -(-2 * len(rest) // 64) * 64
        at = _level_places(rest, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        bits = np.zeros(size, bool)
        ok = alone[at]
        bits[at[ok]] = True
        place[waiting[ok]] = filled + (np.cumsum(bits) - 1)[at[ok]]
        filled += int(ok.sum())
        levels.append(np.packbits(bits))
        sizes.append(size)
        rest, waiting = rest[~ok], waiting[~ok]
    fingerprints, n = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint32)
    fingerprints[place], n[place] = h, np.minimum(counts, (1 << 32) - 1)
    return {"sizes": np.array(sizes, np.int64).tobytes(), "bits": b"".join(x.tobytes() for x in levels), "fingerprints": fingerprints.tobytes(), "counts": n.tobytes()}


class Shard:
    """A built shard, ready to probe."""

    def __init__(self, sizes: bytes, bits: bytes, fingerprints: bytes, counts: bytes) -> None:
        self.sizes = np.frombuffer(sizes, np.int64).tolist()
        packed, self.levels, self.ranks, start, filled = np.frombuffer(bits, np.uint8), [], [], 0, 0
        for size in self.sizes:
            on = np.unpackbits(packed[start : start + size // 8]).astype(bool)
            self.levels.append(on)
            self.ranks.append((np.cumsum(on) - 1 + filled).astype(np.int32))
            start, filled = start + size // 8, filled + int(on.sum())
        self.fingerprints, self.counts = np.frombuffer(fingerprints, np.uint64), np.frombuffer(counts, np.uint32)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """In how many documents each hash was counted; 0 if it is not in the shard."""
        out, rest = np.zeros(len(h), np.uint32), np.arange(len(h))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = _level_places(h[rest], level, size)
            hit = self.levels[level][at]
            mine, index = rest[hit], self.ranks[level][at[hit]]
            same = self.fingerprints[index] == h[mine]
            out[mine[same]] = self.counts[index[same]]
            rest = rest[~hit]
        return out


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> np.uint64(1)).astype(np.int64) % shards


def _column_shard(h: Column, shards: int) -> Column:
    return F.shiftrightunsigned(h, 1) % shards


def build_index(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int, int]:
    """(shard, sizes, bits, fingerprints, counts) rows, the number of shards, and their bytes."""
    frequent = written(counts.where(F.col("n") >= min_docs), "line-counts")
    shards = max(1, -(-frequent.count() // SHARD_KEYS))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        arrays = build_shard(rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in arrays.items()}})

    index = frequent.withColumn("shard", _column_shard(F.col("h"), shards)).groupBy("shard").applyInArrow(build, "shard long, sizes binary, bits binary, fingerprints binary, counts binary")
    index = written(index, "line-index")
    total = index.agg(F.sum(F.length("sizes") + F.length("bits") + F.length("fingerprints") + F.length("counts"))).first()[0] or 0
    return index, shards, total


def _rewritten(batch: pa.RecordBatch, names: list[str], dropped: list[np.ndarray | None], parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """``batch`` with the marked lines cut out of its texts, and the two counts after its columns, all called ``names``."""
    texts: list[bytes] = []
    n_lines, n_dropped = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
    for (first, data, offsets), drop in zip(parts, dropped, strict=True):
        starts, ends, doc, _, _ = line_keys(data, offsets)
        rows = len(offsets) - 1
        n_lines[first : first + rows] = np.bincount(doc, minlength=rows)
        n_dropped[first : first + rows] = np.bincount(doc, weights=drop, minlength=rows).astype(np.int64)
        raw, line = data.tobytes(), np.searchsorted(doc, np.arange(rows + 1))
        for i in range(rows):
            if n_dropped[first + i]:
                own = np.flatnonzero(~drop[line[i] : line[i + 1]]) + line[i]
                texts.append(b"\n".join([raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]))
            else:
                texts.append(raw[offsets[i] : offsets[i + 1]])
    at = batch.schema.get_field_index("text")
    columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_dropped)], names=names)


def drop_repeated_lines(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``documents`` (with a ``text``) without lines whose key at least ``min_docs`` documents hold.

    A line's key is the line without white space at its ends, A-Z folded; keys shorter than
    ``min_chars`` code points stay. Adds n_lines (before) and n_dropped behind the other columns.
    ``doc_id`` is used only beyond the broadcast bound.
    """
    spark = documents.sparkSession
    index, shards, size = build_index(line_counts(documents, min_chars), min_docs)
    own_names = documents.columns
    names = [*own_names, *(free_name(own_names, n) for n in ("n_lines", "n_dropped"))]
    schema = StructType([*documents.schema.fields, *(StructField(n, LongType()) for n in names[-2:])])
    if size <= broadcast_bytes:
        arrays = spark.sparkContext.broadcast({r["shard"]: (bytes(r["sizes"]), bytes(r["bits"]), bytes(r["fingerprints"]), bytes(r["counts"])) for r in index.toLocalIterator()})

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built = {k: Shard(*v) for k, v in arrays.value.items()}
            for batch in batches:
                batch = unpacked(batch.column("row"), own_names)
                parts, dropped = list(chunks(batch.column("text"))), []
                for _, data, offsets in parts:
                    _, _, _, h, length = line_keys(data, offsets)
                    found, shard = np.zeros(len(h), np.uint32), _shard_of(h, shards)
                    for k in np.unique(shard).tolist():
                        if k in built:
                            found[shard == k] = built[k].probe(h[shard == k])
                    dropped.append((found >= min_docs) & (length >= min_chars))
                yield _rewritten(batch, names, dropped, parts)

        return packed(documents).mapInArrow(rewrite, schema)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text")):
                _, _, doc, h, length = line_keys(data, offsets)
                doc, h = _distinct(doc[length >= min_chars], h[length >= min_chars])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc + first)), pa.array(h.view(np.int64))], names=["doc_id", "h"])

    probes = documents.select("doc_id", "text").mapInArrow(pairs, "doc_id long, h long")
    salts = max(1, -(-probes.count() // (shards * PROBES_PER_GROUP)))
    probes = probes.withColumn("shard", _column_shard(F.col("h"), shards)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    arrays = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return left.select(["doc_id", "h"]).slice(0, 0)
        row = right.slice(0, 1).to_pylist()[0]
        n = Shard(row["sizes"], row["bits"], row["fingerprints"], row["counts"]).probe(left["h"].to_numpy().view(np.uint64))
        return left.select(["doc_id", "h"]).filter(pa.array(n >= min_docs))

    hits = probes.groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt")).applyInArrow(look, "doc_id long, h long")
    hits = hits.groupBy("doc_id").agg(F.collect_set("h").alias("hits"))
    joined = packed(documents).join(hits, F.col("row.doc_id").eqNullSafe(F.col("doc_id")), "left").select("row", "hits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, hit = unpacked(batch.column("row"), own_names), batch.column("hits").to_pylist()
            parts, dropped = list(chunks(own.column("text"))), []
            for first, data, offsets in parts:
                _, _, doc, h, length = line_keys(data, offsets)
                drop, line = np.zeros(len(h), bool), np.searchsorted(doc, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    if hit[first + i]:
                        drop[line[i] : line[i + 1]] = np.isin(h[line[i] : line[i + 1]], np.array(hit[first + i], np.int64).view(np.uint64))
                dropped.append(drop & (length >= min_chars))
            yield _rewritten(own, names, dropped, parts)

    return joined.mapInArrow(cut, schema)
