"""Masked pseudo-likelihood: a bidirectional window network scores every token from both sides.

The vocabulary comes from word counts over all documents (A-Z folded): the ``TOP`` most frequent
words have ids of their own, all others share hashed ids for the network. The network embeds the ``REACH`` words on
each side of a hidden place, one linear map per relative position, a tanh layer, and a two-step
softmax (a class of 64, then a word of 64 within it), whose biases start as the corpus's unigram
log-probabilities. Training hides every place of every document once, in shuffled batches.

A word that shares its id has the id's probability times the word's part of the id's count, so the
probabilities of all distinct words of the corpus add up to one. These parts come from the full word
counts: the rarer words of the texts are dealt to shards by hash, packed, and meet the counts there.

Training is distributed: the documents, as ids, are dealt by hash to parts of about ``PART_TOKENS``
words in two halves; each part trains a copy in numpy in an order of its own, copies are averaged by
words seen in a tree of bounded fan-in, and the second half goes on from that average. Nothing of it
depends on files, tasks or executors. Only the averaged network, whose size is fixed, reaches the driver.
A document's score is the sum over all its tokens of log P(token | both sides).

Defined results: a null text counts as empty; a text without words scores 0 over 0 tokens, with a null
mean; repeated rows, and so ties, score alike; a word that the corpus doesn't hold counts as seen once; an
empty table gives an empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.shared import written
from prefixlake.operators.components import spread_join
from prefixlake.llm.textarrays import chunks, span_hashes, word_spans

CLASSES, MEMBERS = 64, 64
IDS = CLASSES * MEMBERS
TOP = IDS // 2
REACH, DIMS, HIDDEN = 2, 16, 32
SIDES = tuple(d for d in range(-REACH, REACH + 1) if d)
BATCH = 8192
SHARD = 8192
FAN = 32  # copies merged at once
PART_TOKENS = 1 << 21  # words a copy is trained on in a round
BROADCAST_ROWS = 1_000_000
SHARES, SHARE_TOKENS, PACK = 16, 1 << 23, 1 << 20  # least shards of rarer words, tokens a shard, tokens packed at once
SCALE = 1 << 24  # parts are summed as whole numbers, so that no order of rows changes a sum
EDGE = 0  # the id of what lies beyond a text's ends; never predicted

SHAPES = {
    "embed": (IDS, DIMS),
    "side": (len(SIDES), DIMS, HIDDEN),
    "bias": (HIDDEN,),
    "klass": (HIDDEN, CLASSES),
    "klass_bias": (CLASSES,),
    "member": (CLASSES, HIDDEN, MEMBERS),
    "member_bias": (CLASSES, MEMBERS),
}


@dataclass
class Vocabulary:
    """Sorted hashes of the frequent words with their ids, the count of every id, and where the counts of all words are."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    words: tuple[str, ...] = ()

    def encode(self, h: np.ndarray) -> np.ndarray:
        """Ids of word hashes: 1 to TOP - 1 for frequent words, TOP and up for the rest."""
        out = TOP + (h % np.uint64(IDS - TOP)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, self.ids[at], out)
        return out


def word_counts(documents: DataFrame) -> DataFrame:
    """(h, n) of every distinct word of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [span_hashes(data, *word_spans(data, offsets)[:2]) for _, data, offsets in chunks(batch.column("text"), lower=True)]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return documents.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def fit_vocabulary(documents: DataFrame) -> Vocabulary:
    """The frequent words by corpus count (ties by hash), and the mass of each hashed id."""
    counts = written(word_counts(documents), "words")
    top = counts.orderBy(F.desc("n"), "h").limit(TOP - 1).toPandas()
    unsigned = F.pmod(F.pmod(F.col("h"), F.lit(IDS - TOP)) + F.lit((1 << 64) % (IDS - TOP)), F.lit(IDS - TOP))
    rest = counts.groupBy(unsigned.alias("k")).agg(F.sum("n").alias("n")).toPandas()
    mass = np.zeros(IDS, np.float64)
    mass[TOP + rest.k.to_numpy(np.int64)] = rest.n.to_numpy()
    hashes = top.h.to_numpy(np.int64).view(np.uint64)
    mass[1 : 1 + len(top)] = top.n.to_numpy()
    np.subtract.at(mass, TOP + (hashes % np.uint64(IDS - TOP)).astype(np.int64), top.n.to_numpy(np.float64))
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], 1 + order, mass, tuple(counts.inputFiles()))


def initial(vocabulary: Vocabulary, seed: int = 23) -> dict[str, np.ndarray]:
    """The untrained network: the unigram model."""
    rng = np.random.default_rng(seed)
    out = {n: np.zeros(s, np.float32) for n, s in SHAPES.items()}
    out["embed"] = rng.normal(0, 0.3, SHAPES["embed"]).astype(np.float32)
    out["side"] = rng.normal(0, 0.5 / np.sqrt(DIMS), SHAPES["side"]).astype(np.float32)
    counts = vocabulary.counts.copy()
    counts[EDGE] = 0
    counts = (counts + 0.5).reshape(CLASSES, MEMBERS)
    out["klass_bias"] = np.log(counts.sum(1) / counts.sum()).astype(np.float32)
    out["member_bias"] = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
    return out


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[n].ravel() for n in SHAPES])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n, s in SHAPES.items():
        size = int(np.prod(s))
        out[n] = values[at : at + size].reshape(s).astype(np.float32)
        at += size
    return out


def tokens(texts: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids with REACH edges before each text and after the last, where each text's words begin)."""
    for first, padded, begins, _ in hashed_tokens(texts, vocabulary):
        yield first, padded, begins


def hashed_tokens(texts: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """What :func:`tokens` gives, and the hashes of the words, without edges."""
    for first, data, offsets in chunks(texts, lower=True):
        starts, ends, word = word_spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        ids = vocabulary.encode(hashes)
        rows = len(offsets) - 1
        shift = REACH * (np.arange(rows) + 1)
        padded = np.full(len(ids) + REACH * (rows + 1), EDGE, np.int64)
        padded[np.arange(len(ids)) + np.repeat(shift, np.diff(word))] = ids
        yield first, padded, word + REACH * (np.arange(rows + 1) + 1), hashes


_ONES = np.ones(max(CLASSES, MEMBERS), np.float32)


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | np.float32]:
    """exp(z - shift), its row sums and the shift; rows of ``z`` are consumed.

    One shift serves all rows while no row can vanish under it.
    """
    top, low = z.max(), z.min()
    shift = z.max(axis=1, keepdims=True) if top - low > 60 else top
    z -= shift
    np.exp(z, out=z)
    return z, z @ _ONES[: z.shape[1]], shift[:, 0] if np.ndim(shift) else shift


def _softmax(z: np.ndarray) -> np.ndarray:
    """Probabilities; rows of ``z`` are consumed."""
    z, total, _ = _exponentials(z)
    z /= total[:, None]
    return z


def _log_sum(z: np.ndarray) -> np.ndarray:
    """Log of the normaliser; rows of ``z`` are consumed."""
    _, total, shift = _exponentials(z)
    return np.log(total) + shift


def _class_order(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts each class's ids together, and (class, begin, end) of those met."""
    klass = (ids // MEMBERS).astype(np.uint8)
    order = np.argsort(klass, kind="stable")
    cuts = np.searchsorted(klass[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, cuts[c], cuts[c + 1]) for c in range(CLASSES) if cuts[c + 1] > cuts[c]]


class Trainer:
    """Adaptive-step gradient descent on one copy of the network."""

    def __init__(self, net: dict[str, np.ndarray], rate: float = 0.1) -> None:
        self.net, self.rate = {n: v.copy() for n, v in net.items()}, rate
        self.squares = {n: np.full(s, 0.1, np.float32) for n, s in SHAPES.items()}

    def step(self, context: np.ndarray, ids: np.ndarray) -> None:
        """One batch: ``context`` (n, sides) ids around the hidden ``ids``."""
        net, n = self.net, len(ids)
        order, runs = _class_order(ids)
        context, ids = context.take(order, axis=0), ids.take(order)
        side = net["side"].reshape(-1, HIDDEN)
        seen = net["embed"].take(context.ravel(), axis=0).reshape(n, -1)
        hidden = seen @ side
        hidden += net["bias"]
        np.tanh(hidden, out=hidden)
        p = _softmax(hidden @ net["klass"] + net["klass_bias"])
        member, member_bias = np.zeros(SHAPES["member"], np.float32), np.zeros(SHAPES["member_bias"], np.float32)
        places, inside = np.arange(n), ids % MEMBERS
        p[places, ids // MEMBERS] -= 1
        back = p @ net["klass"].T
        for c, a, b in runs:
            own = hidden[a:b]
            q = own @ net["member"][c]
            q += net["member_bias"][c]
            q = _softmax(q)
            q[places[: b - a], inside[a:b]] -= 1
            member[c], member_bias[c] = own.T @ q, q.sum(0)
            back[a:b] += q @ net["member"][c].T
        back *= 1 - hidden * hidden
        to = (back @ side.T).reshape(-1, DIMS)
        met = context.ravel()
        order = np.argsort(met.astype(np.uint16), kind="stable")
        met = met.take(order)
        starts = np.flatnonzero(np.concatenate([[True], met[1:] > met[:-1]]))
        self._move("klass", slice(None), hidden.T @ p, n)
        self._move("klass_bias", slice(None), p.sum(0), n)
        self._move("member", slice(None), member, n)
        self._move("member_bias", slice(None), member_bias, n)
        self._move("bias", slice(None), back.sum(0), n)
        self._move("side", slice(None), (seen.T @ back).reshape(SHAPES["side"]), n)
        self._move("embed", met[starts], np.add.reduceat(np.ascontiguousarray(to.take(order, axis=0).T), starts, axis=1).T, n)

    def _move(self, name: str, at: slice | np.ndarray, grad: np.ndarray, n: int) -> None:
        """One step along ``grad``, summed over ``n`` places, for the rows ``at`` of a table."""
        grad = grad * np.float32(1 / np.sqrt(n))
        squares = self.squares[name][at] + grad * grad
        self.squares[name][at] = squares
        self.net[name][at] -= np.float32(self.rate) * grad / np.sqrt(squares)

    def drain(self, padded: np.ndarray, rng: np.random.Generator) -> None:
        """Train on every place of ``padded`` once, in shuffled batches."""
        places = rng.permutation(np.flatnonzero(padded != EDGE))
        for at in range(0, len(places), BATCH):
            own = places[at : at + BATCH]
            self.step(np.stack([padded[own + d] for d in SIDES], axis=1), padded[own])


def training_parts(vocabulary: Vocabulary) -> int:
    """How many parts a half of the documents is dealt to."""
    return max(1, -(-int(vocabulary.counts.sum()) // (2 * PART_TOKENS)))


def encoded(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(half, part, key, ids) of every document: its words' ids, two bytes each, with the edges after it.

    Halves and parts come from a hash of id and text, and the number of parts from the number of
    words, so what is trained together does not depend on how the table is split into files or tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[bytes] = []
            for _, ids, begins in tokens(batch.column("text"), vocabulary):
                raw = ids.astype(np.uint16).tobytes()
                rows += [raw[2 * a : 2 * b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, pa.binary())], names=["key", "ids"])

    parts = training_parts(vocabulary)
    coded = documents.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, "key long, ids binary")
    return coded.select(F.pmod("key", F.lit(2)).cast("int").alias("half"), F.pmod(F.xxhash64(F.lit(41), "key"), F.lit(parts)).alias("part"), "key", "ids")


def train_round(coded: DataFrame, parts: int, net: dict[str, np.ndarray], seed: int) -> dict[str, np.ndarray]:
    """One pass over ``coded`` rows: a copy of ``net`` for each part, averaged by words in a tree of ``FAN``."""

    def run(rows: pa.Table) -> pa.Table:
        part, trainer, seen, slab = rows["part"][0].as_py(), Trainer(net), 0, [b"\x00\x00" * REACH]
        rng, texts, held = np.random.default_rng([seed, part]), rows["ids"], 0
        for i in np.lexsort((rows["key"].to_numpy(),)).tolist():
            own = texts[i].as_py()
            slab.append(own)
            held += len(own)
            if held >= 32 * BATCH:
                trainer.drain(np.frombuffer(b"".join(slab), np.uint16).astype(np.int64), rng)
                slab, seen, held = [b"\x00\x00" * REACH], seen + held, 0
        trainer.drain(np.frombuffer(b"".join(slab), np.uint16).astype(np.int64), rng)
        values = flat(trainer.net)
        shards = [values[i : i + SHARD].tobytes() for i in range(0, len(values), SHARD)]
        return pa.table({"shard": pa.array(range(len(shards)), pa.int32()), "node": pa.array([part] * len(shards), pa.int64()), "n": pa.array([float(seen + held)] * len(shards)), "w": pa.array(shards, pa.binary())})

    def merge(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["node"].to_numpy(), kind="stable")
        n, mean = rows["n"].to_numpy()[order], 0.0
        for share, i in zip(n / max(n.sum(), 1.0), order.tolist(), strict=True):
            mean = mean + share * np.frombuffer(rows["w"][i].as_py(), np.float32).astype(np.float64)
        return pa.table({"shard": rows["shard"].slice(0, 1), "node": rows["up"].slice(0, 1), "n": pa.array([n.sum()]), "w": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    schema = "shard int, node long, n double, w binary"
    copies = coded.repartition(parts, "part").groupBy("part").applyInArrow(run, schema)
    while parts > 1:
        parts = -(-parts // FAN)
        copies = copies.withColumn("up", F.floor(F.col("node") / FAN)).groupBy("shard", "up").applyInArrow(merge, schema)
    found = copies.toPandas().sort_values("shard")
    return unflat(np.concatenate([np.frombuffer(w, np.float32) for w in found.w])) if len(found) else net


def fit(documents: DataFrame) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    """Vocabulary and trained network of ``documents`` (doc_id, text)."""
    vocabulary = fit_vocabulary(documents)
    net = initial(vocabulary)
    coded = written(encoded(documents, vocabulary), "coded")
    for k in range(2):
        net = train_round(coded.where(F.col("half") == k), training_parts(vocabulary), net, seed=k)
    return vocabulary, net


class Scorer:
    """The network with embeddings and maps multiplied out: one table per side."""

    def __init__(self, net: dict[str, np.ndarray]) -> None:
        self.net = net
        self.sides = [net["embed"] @ net["side"][s] for s in range(len(SIDES))]
        self.sides[0] = self.sides[0] + net["bias"]

    def log_probabilities(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log P(ids[place] | both sides) for each place."""
        net, out = self.net, np.empty(len(places))
        for at in range(0, len(places), 2 * BATCH):
            own = places[at : at + 2 * BATCH]
            order, runs = _class_order(ids[own])
            own = own[order]
            target, rows = ids[own], np.arange(len(own))
            hidden = self.sides[0].take(ids.take(own + SIDES[0]), axis=0)
            for table, d in zip(self.sides[1:], SIDES[1:], strict=True):
                hidden += table.take(ids.take(own + d), axis=0)
            np.tanh(hidden, out=hidden)
            z = hidden @ net["klass"]
            z += net["klass_bias"]
            part = z[rows, target // MEMBERS].astype(np.float64)
            part -= _log_sum(z)
            for c, a, b in runs:
                z = hidden[a:b] @ net["member"][c]
                z += net["member_bias"][c]
                part[a:b] += z[rows[: b - a], target[a:b] % MEMBERS]
                part[a:b] -= _log_sum(z)
            out[at + order] = part
        return out


def shards_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each word hash; it grows with the hash."""
    return ((hashes >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def pack(hashes: np.ndarray, rows: np.ndarray, shards: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(shard, distinct hashes, how often each occurs, the rows it occurs in) of each shard that has any."""
    order = np.argsort(hashes, kind="stable")
    hashes, rows = hashes[order], rows[order].astype(np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    words, times = hashes[starts], np.diff(np.append(starts, len(hashes))).astype(np.uint32)
    cuts = np.searchsorted(shards_of(words, shards), np.arange(shards + 1))
    edges = np.append(starts, len(hashes))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[k], cuts[k + 1]
        yield k, words[a:b].tobytes(), times[a:b].tobytes(), rows[edges[a] : edges[b]].tobytes()


SCORED = "key long, doc_id long, digest string, n_tokens long, log_prob double, shard int, words binary, times binary, rows binary"


def score(documents: DataFrame, vocabulary: Vocabulary, net: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of every document's whole text."""
    spark = documents.sparkSession
    shards = max(SHARES, -(-int(vocabulary.counts[TOP:].sum()) // SHARE_TOKENS))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, key = Scorer(net), TaskContext.get().partitionId() << 40

        def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            found = list(pack(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), shards))
            held.clear()
            none = [None] * len(found)
            own = [[key] * len(found), none, none, [len(x[3]) // 4 for x in found], none, *([x[k] for x in found] for k in range(4))]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(own, kinds, strict=True)], names=names)

        for batch in batches:
            n, total, held = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), []
            for first, ids, begins, hashes in hashed_tokens(batch.column("text"), vocabulary):
                places, rows = np.flatnonzero(ids != EDGE), len(begins) - 1
                sums = np.concatenate([[0.0], np.cumsum(scorer.log_probabilities(ids, places))])
                at = np.searchsorted(places, begins)
                n[first : first + rows] = np.diff(at)
                total[first : first + rows] = sums[at[1:]] - sums[at[:-1]]
                rare = ids[places] >= TOP
                held.append((hashes[rare], np.repeat(first + np.arange(rows), np.diff(at))[rare]))
                if sum(len(x[0]) for x in held) >= PACK:
                    yield packed(held)
            if held:
                yield packed(held)
            own = [pa.array(key + np.arange(batch.num_rows)), batch.column("doc_id"), batch.column("digest"), pa.array(n), pa.array(total), *(pa.nulls(batch.num_rows, k) for k in kinds[5:])]
            yield pa.RecordBatch.from_arrays(own, names=names)
            key += batch.num_rows

    def parts(rows: pa.Table, known: pa.Table) -> pa.Table:
        """The summed parts of one shard's words, by document."""
        hashes, n = known["h"].to_numpy().view(np.uint64), known["n"].to_numpy()
        order = np.argsort(hashes)
        hashes, n, keys, sums = np.append(hashes[order], np.uint64(0)), np.append(n[order], 1), [], []
        for key, words, times, places in zip(rows["key"].to_pylist(), rows["words"].to_pylist(), rows["times"].to_pylist(), rows["rows"].to_pylist(), strict=True):
            words, times, places = np.frombuffer(words, np.uint64), np.frombuffer(times, np.uint32), np.frombuffer(places, np.uint32)
            at = np.searchsorted(hashes[:-1], words)
            own = np.where(hashes[at] == words, n[at], 1)
            shared = np.maximum(vocabulary.counts[TOP + (words % np.uint64(IDS - TOP)).astype(np.int64)], own)
            part = np.rint((np.log(own) - np.log(shared)) * SCALE)
            total = np.bincount(places, weights=np.repeat(part, times))
            found = np.flatnonzero(total)
            keys.append(key + found)
            sums.append(total[found].astype(np.int64))
        none = [np.zeros(0, np.int64)]
        return pa.table({"key": pa.array(np.concatenate(keys or none)), "part": pa.array(np.concatenate(sums or none))})

    found = written(documents.select("doc_id", "text", F.md5("text").alias("digest")).mapInArrow(run, SCORED), "scored")
    known = spark.read.schema("h long, n long").parquet(*vocabulary.words) if vocabulary.words else spark.createDataFrame([], "h long, n long")
    shard = F.shiftright(F.shiftrightunsigned("h", 40) * shards, 24).cast("int")
    packs = found.where("shard is not null")
    # A shard with a frequent word is dealt to several groups by pack; each gets the shard's counts, nothing else is copied.
    salts = packs.groupBy("shard").agg(F.ceil(F.sum("n_tokens") / (2 * SHARE_TOKENS)).alias("salts"))
    if shards <= BROADCAST_ROWS:  # one row a shard; more than that are joined as the planner likes
        salts = F.broadcast(salts)
    packs = packs.select("shard", "key", "words", "times", "rows").join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("key"), "salts")).drop("salts")
    counted = known.select(shard.alias("shard"), "h", "n").join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    sums = packs.groupBy("shard", "salt").cogroup(counted.groupBy("shard", "salt")).applyInArrow(parts, "key long, part long")
    sums = sums.groupBy("key").agg((F.sum("part") / SCALE).alias("part"))
    out = found.where("shard is null").select("key", "doc_id", "digest", "n_tokens", "log_prob").join(sums, "key", "left")
    out = out.withColumn("log_prob", F.col("log_prob") + F.coalesce("part", F.lit(0.0)))
    # Single-precision products differ in the last digits with a row's place in its batch.
    same = out.groupBy("digest").agg(F.min("log_prob").alias("_same"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    out = spread_join(out, same, "digest", "_n", found.where("shard is null").count(), how="left").select("doc_id", "n_tokens", F.coalesce("_same", "log_prob").alias("log_prob"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
