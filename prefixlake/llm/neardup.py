"""Near-duplicate documents by an LSH forest over MinHash signatures, with every link confirmed.

1. Each document becomes the set of its word shingles (64-bit hashes), a 128-bit key of the set and
   ``LABELS`` minima. Documents with equal sets are one class; only the class's least
   document goes on, so a third of the table being copies costs one row.
2. The forest has ``TREES`` trees. A tree is one sorted order of all signatures: its own ``DEPTH`` whole
   minima, then its own permutation of all ``LABELS`` 4-bit labels. The orders are range-partitioned
   and walked as sorted streams, so a region, which is a run with a common prefix, is never gathered.
   Neighbours with the longest common prefix are candidates first. A region starts at ``DEPTH``
   minima; where its neighbours leave parts apart, the parts are compared if that takes no more than
   ``WORK`` comparisons, else the region deepens by one label, each subregion for itself. A region of
   more than ``HELD`` rows deepens likewise, as the stream passes; its subregions are runs of the order.
3. Depth costs recall, so a document whose regions deepened in ``DEEP_TREES`` trees or more goes into
   ``MORE_TREES`` further trees, which start at ``MORE_DEPTH`` labels and deepen alike. Two documents at
   Jaccard 0.8 share no region with probability (1 - 0.8 ** 3) ** 20 < 1e-6 in the first trees, and
   with all trees under 1e-6 at a depth of 6, 1e-5 at 8 and 1e-3 at 10; at 0.85 under 1e-8, 1e-8 and 1e-5.
4. Comparing means: of ``LABELS`` 4-bit labels at least ``LIKELY`` agree, which a pair at Jaccard
   0.8 fails in about three cases of a million, one at 0.85 in fewer than one of ten million. The components of these likely links are clusters:
   every true link lies inside one.
5. Inside each cluster links are confirmed on the full shingle sets, by a breadth-first search that
   leaves a member only when it was compared with all that may still link. Components of confirmed
   links are the answer.

A cluster above ``BLOCK`` members is dealt to blocks, each with the same few leaders, those nearest to
the cluster's modal signature. What doesn't connect to a leader in its block is then compared with
every block of its group, and so is what hangs on leaders that the blocks together leave apart from
the group's main component of leaders. So no task holds an unbounded group, and no link of a cluster
is lost to the dealing.

Defined results: null, empty or wordless texts have no shingles and link with nothing; fewer words
than a shingle make one shingle; repeated rows are one class; an empty table gives an empty result;
columns other than doc_id and text are ignored. Ids must identify texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.operators.components import connected_components
from prefixlake.llm.shared import written
from prefixlake.llm.textarrays import mix, shingle_sets

TREES, DEPTH = 20, 3
DEEP_TREES, MORE_TREES, MORE_DEPTH = 3, 44, 6
LABELS = 64
LIKELY = 38
WORK = 1 << 20
HELD = 1 << 16  # rows of one region that a task holds at once; a longer region deepens by its next label
BLOCK = 2048
LEADERS = 16
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(5)
_MULTIPLY = (_rng.integers(0, 1 << 31, LABELS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_XOR = _rng.integers(0, 1 << 32, LABELS, dtype=np.uint32)[:, None]
# Each tree's order of labels; the first trees begin with the labels of their own minima.
_ORDERS = []
for _t in range(TREES + MORE_TREES):
    _own = list(range(_t * DEPTH, _t * DEPTH + DEPTH)) if _t < TREES else []
    _ORDERS.append(np.array(_own + [int(x) for x in _rng.permutation(LABELS) if x not in _own]))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of ``LABELS`` orders of a non-empty set."""
    h, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(LABELS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        out = np.minimum(out, ((h[at : at + 4096][None, :] ^ _XOR) * _MULTIPLY).min(axis=1))
    return out


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, regions, labels): the forest's places and 4-bit labels of each document."""
    tree = np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, regions, labels = [], [], [], []
            for _, shingles in shingle_sets(batch.column("text"), width):
                n.append(len(shingles))
                if not len(shingles):
                    keys.append(None)
                    regions.append(None)
                    labels.append(None)
                    continue
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                own = signature(shingles)
                place = tree.copy()
                for k in range(DEPTH):
                    place = mix(place + own[k : TREES * DEPTH : DEPTH].astype(np.uint64))
                regions.append(place.view(np.int64))
                low = (mix(own.astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
                labels.append((low[::2] << 4 | low[1::2]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regions, pa.list_(pa.int64())), pa.array(labels, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "regions", "labels"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, regions array<long>, labels binary")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut at group borders of sorted rows, and where each group begins (with the end)."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            values = batch.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        held = batch.slice(starts[-1])
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _search(n: int, like: Callable[[int, np.ndarray], np.ndarray], part: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect what ``like`` connects, and each member's component.

    ``part`` says which members are known to be linked already. A component leaves the search only
    when each of its members was compared with everything outside it.
    """
    component, links, waiting, count = np.full(n, -1), [], np.arange(n), 0
    while len(waiting):
        queue = [int(waiting[0])] if part is None else waiting[part[waiting] == part[waiting[0]]].tolist()
        waiting = waiting[len(queue) :] if part is None else waiting[part[waiting] != part[waiting[0]]]
        at = 0
        while at < len(queue):
            x = queue[at]
            at += 1
            if len(waiting):
                hit = like(x, waiting)
                if hit.any():
                    found = waiting[hit]
                    links += [(x, int(y)) for y in found]
                    if part is not None:
                        hit = np.isin(part[waiting], part[found])
                        found = waiting[hit]
                    queue += found.tolist()
                    waiting = waiting[~hit]
        component[queue] = count
        count += 1
    return links, component


def _label_matrix(payload: pa.Array) -> np.ndarray:
    packed = np.frombuffer(b"".join(payload.to_pylist()), np.uint8).reshape(-1, LABELS // 2)
    out = np.empty((len(packed), LABELS), np.uint8)
    out[:, ::2], out[:, 1::2] = packed >> 4, packed & 15
    return out


class _Labels:
    """Likeness of label rows."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows

    def __call__(self, x: int, others: np.ndarray) -> np.ndarray:
        return (self.rows[others] == self.rows[x]).sum(axis=1) >= LIKELY


def _packed(labels: np.ndarray) -> pa.Array:
    """Rows of 4-bit labels as binary values that sort like the rows."""
    raw = np.ascontiguousarray(labels[:, ::2] << 4 | labels[:, 1::2])
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * (LABELS // 2)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


ORDERED = "tree int, grp long, seq binary, id long"


def first_trees(classes: DataFrame) -> DataFrame:
    """The rows ``ORDERED`` of the first trees for (id, regions, labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regions = batch.column("regions").flatten().to_numpy().reshape(-1, TREES)
                labels = _label_matrix(batch.column("labels"))
                for t in range(TREES):
                    tree = pa.array(np.full(batch.num_rows, t, np.int32))
                    yield pa.RecordBatch.from_arrays([tree, pa.array(np.ascontiguousarray(regions[:, t])), _packed(labels[:, _ORDERS[t]]), batch.column("id")], names=["tree", "grp", "seq", "id"])

    return classes.select("id", "regions", "labels").mapInArrow(run, ORDERED)


def more_trees(classes: DataFrame) -> DataFrame:
    """The rows ``ORDERED`` of the further trees for (id, labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                labels = _label_matrix(batch.column("labels"))
                for t in range(TREES, TREES + MORE_TREES):
                    own = labels[:, _ORDERS[t]]
                    grp = np.zeros(len(own), np.int64)
                    for k in range(MORE_DEPTH):
                        grp = grp << 4 | own[:, k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(grp), _packed(own), batch.column("id")], names=["tree", "grp", "seq", "id"])

    return classes.select("id", "labels").mapInArrow(run, ORDERED)


def _walk(ids: np.ndarray, labels: np.ndarray, parts: np.ndarray, depth: int, work: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(row, its component's least id) for one row of each part that joins others, and each row's depth.

    ``labels`` are the region's rows in sorted order, equal in the first ``depth`` labels; ``work`` bounds
    the comparisons of one region.
    """
    links, deepest, waiting = [], np.full(len(labels), depth), [(0, len(labels), depth)]
    while waiting:
        a, b, at = waiting.pop()
        own = parts[a:b] - parts[a]
        sizes = np.bincount(own)
        if len(sizes) < 2:
            continue
        if ((b - a) ** 2 - (sizes.astype(np.int64) ** 2).sum()) // 2 <= work or at == LABELS:
            _, component = _search(b - a, _Labels(labels[a:b]), own)
            heads = np.minimum.reduceat(ids[a:b], np.flatnonzero(np.diff(own, prepend=-1)))
            joined = component[np.flatnonzero(np.diff(own, prepend=-1))]
            least = np.full(joined.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, joined, heads)
            links.append((heads, least[joined]))
            continue
        deepest[a:b] = at + 1
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(labels[a:b, at].astype(np.int64)))).tolist(), b]
        waiting += [(x, y, at + 1) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return links, deepest


def forest_links(ordered: DataFrame, depth: int) -> DataFrame:
    """(kind, a, b): links that join what is likely (kind 0), and rows whose regions deepened (kind 1: id, tree).

    A part is linked as a star on its least id, so a row has at most two links a tree.
    Where a partition of the sorted order ends inside a region, its last row and the next one's first
    are compared as well; what else such a border cuts apart meets in the other trees.
    """
    keys = ["tree", "grp", "seq", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        last, first_row = None, True
        # The region that the stream is in, and how many labels its rows must share to be walked together.
        region, level = None, depth

        def walked(rows: pa.RecordBatch, starts: np.ndarray, levels: np.ndarray) -> pa.RecordBatch:
            ids, labels = rows.column("id").to_numpy(), _label_matrix(rows.column("seq"))
            inside = np.ones(rows.num_rows, bool)
            inside[starts[:-1]] = False
            near = np.zeros(rows.num_rows, bool)
            near[1:] = (labels[1:] == labels[:-1]).sum(axis=1) >= LIKELY
            near &= inside
            parts = np.cumsum(~near)
            least = np.minimum.reduceat(ids, np.flatnonzero(~near))[parts - 1]
            a, b, deep, trees = [ids[ids != least]], [least[ids != least]], [], []
            loose = np.add.reduceat((inside & ~near).astype(np.int64), starts[:-1]) > 0
            for g in np.flatnonzero(loose | (levels > depth)).tolist():
                i, j = int(starts[g]), int(starts[g + 1])
                links, deepest = _walk(ids[i:j], labels[i:j], parts[i:j], int(levels[g]), WORK)
                for x, y in links:
                    a.append(x[x != y])
                    b.append(y[x != y])
                went = np.flatnonzero(deepest > depth)
                if len(went):
                    deep.append(ids[i + went])
                    trees.append(np.full(len(went), rows.column("tree")[i].as_py()))
            found = [_found(0, np.concatenate(a), np.concatenate(b), None)]
            if deep:
                found.append(_found(1, np.concatenate(deep), np.concatenate(trees), None))
            return pa.concat_batches(found)

        for batch in batches:
            if not batch.num_rows:
                continue
            if first_row:
                yield _found(2, batch.column("id").to_numpy()[:1], np.zeros(1, np.int64), batch.slice(0, 1))
                first_row = False
            last = batch.slice(batch.num_rows - 1)
            if held is not None:
                batch = pa.concat_batches([held, batch])
            tree, grp = batch.column("tree").to_numpy(), batch.column("grp").to_numpy()
            while True:
                own = (tree[0], grp[0])
                if own != region:
                    region, level = own, depth
                fresh = (tree[1:] != tree[:-1]) | (grp[1:] != grp[:-1])
                deeper = np.zeros(len(fresh), bool)
                if level > depth:
                    labels = _label_matrix(batch.column("seq"))[:, :level]
                    deeper = ((tree[1:] == own[0]) & (grp[1:] == own[1])) & (labels[1:] != labels[:-1]).any(axis=1)
                starts = np.flatnonzero(np.concatenate([[True], fresh | deeper]))
                if batch.num_rows - int(starts[-1]) <= HELD or level == LABELS or (tree[-1], grp[-1]) != own:
                    break
                level += 1  # too long to hold: its rows part by the next label
            if len(starts) > 1:
                levels = np.where((tree[starts] == own[0]) & (grp[starts] == own[1]), level, depth)
                yield walked(batch.slice(0, int(starts[-1])), starts, levels[:-1])
            held = batch.slice(int(starts[-1]))
            if level == LABELS and held.num_rows > HELD:  # all labels alike: one part, whatever its length
                yield walked(held, np.array([0, held.num_rows]), np.array([level]))
                held = held.slice(held.num_rows - 1)
        if held is not None:
            yield walked(held, np.array([0, held.num_rows]), np.array([level if (held.column("tree")[0].as_py(), held.column("grp")[0].as_py()) == region else depth]))
            yield _found(2, last.column("id").to_numpy(), np.zeros(1, np.int64), last)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None
        for batch in batches:
            rows = batch if before is None else pa.concat_batches([before, batch])
            if rows.num_rows:
                tree, grp, labels, ids = rows.column("tree").to_numpy(), rows.column("grp").to_numpy(), _label_matrix(rows.column("seq")), rows.column("a").to_numpy()
                same = (tree[1:] == tree[:-1]) & (grp[1:] == grp[:-1]) & ((labels[1:] == labels[:-1]).sum(axis=1) >= LIKELY) & (ids[1:] != ids[:-1])
                at = np.flatnonzero(same)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[at + 1])], names=["a", "b"])
                before = rows.slice(rows.num_rows - 1)

    spark = ordered.sparkSession
    pieces = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    walks = ordered.repartitionByRange(pieces, *keys).sortWithinPartitions(*keys).mapInArrow(run, "kind int, a long, b long, tree int, grp long, seq binary")
    found = written(walks, "forest")
    # Two rows a partition: the sorted borders of all of them are one small stream.
    ends = found.where("kind = 2").select("tree", "grp", "seq", "a").repartition(1).sortWithinPartitions("tree", "grp", "seq", "a")
    tied = ends.mapInArrow(borders, "a long, b long").select(F.lit(0).alias("kind"), "a", "b")
    return found.where("kind < 2").select("kind", "a", "b").union(tied)


def contracted(links: DataFrame) -> DataFrame:
    """(a, b) links with the same components: each row hangs on its least neighbour alone, and its other
    neighbours hang there too, which in a group of copies are the same few rows for all.
    """
    stars = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = stars.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("all"))
    stars = written(stars, "stars")
    return stars.select("a", F.col("m").alias("b")).union(stars.select(F.explode("all").alias("a"), F.col("m").alias("b")).where("a != b").distinct())


def _found(kind: int, a: np.ndarray, b: np.ndarray, at: pa.RecordBatch | None) -> pa.RecordBatch:
    place = [at.column(n) for n in ("tree", "grp", "seq")] if at is not None else [pa.nulls(len(a), t) for t in (pa.int32(), pa.int64(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), *place], names=["kind", "a", "b", "tree", "grp", "seq"])


class _Sets:
    """Likeness of full shingle sets: 100 * common >= percent * together."""

    def __init__(self, payload: pa.Array, percent: int) -> None:
        self.sets = [np.frombuffer(x, np.uint64) for x in payload.to_pylist()]
        self.sizes, self.percent = np.array([len(x) for x in self.sets]), percent

    def __call__(self, x: int, others: np.ndarray) -> np.ndarray:
        out, own, n = np.zeros(len(others), bool), self.sets[x], self.sizes[others]
        near = np.flatnonzero(100 * np.minimum(n, len(own)) >= self.percent * np.maximum(n, len(own)))
        if not len(near):
            return out
        rows = [self.sets[i] for i in others[near]]
        every = np.concatenate(rows)
        at = np.minimum(np.searchsorted(own, every), len(own) - 1)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
        common = np.add.reduceat((own[at] == every).astype(np.int64), starts)
        out[near] = 100 * common >= self.percent * (n[near] + len(own) - common)
        return out


def _links(members: DataFrame, counts: DataFrame, leaders: DataFrame, likeness: Callable[[pa.Array], Callable]) -> DataFrame:
    """(a, b) links that connect, within every group, exactly what ``likeness`` connects.

    ``members`` (grp, id, payload), ``counts`` (grp, blocks) for the groups of more than one block,
    ``leaders`` (grp, id, payload) for the same groups.
    """
    members = members.join(counts.select(F.col("grp").alias("_g"), "blocks"), F.col("grp") == F.col("_g"), "left").drop("_g")
    members = members.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    members = members.select("grp", "block", "id", "blocks", F.lit(False).alias("leads"), "payload")
    spread = leaders.join(counts, "grp").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "blocks", F.lit(True).alias("leads"), "payload")
    dealt = members.union(spread)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, ["grp", "block"]):
            ids, many, leads = batch.column("id").to_numpy(), batch.column("blocks").to_numpy(), batch.column("leads").to_numpy(zero_copy_only=False)
            a, b, group, rest, heads, kinds = [], [], [], [], [], []
            for g in range(len(starts) - 1):
                i, j = starts[g], starts[g + 1]
                if j - i < 2 and many[i] == 1:
                    continue
                own = batch.column("payload").slice(i, j - i)
                links, component = _search(j - i, likeness(own))
                if links:
                    x, y = np.array(links).T
                    a.append(ids[i + x])
                    b.append(ids[i + y])
                if many[i] > 1:
                    own, lead = ids[i:j], leads[i:j]
                    head = np.full(component.max() + 1, -1)
                    np.maximum.at(head, component[lead], own[lead])
                    led = np.isin(component, component[lead])
                    rest.append(own)
                    heads.append(head[component])
                    kinds.append(np.where(lead, 3, np.where(led, 2, 1)))
                    group.append(np.full(j - i, batch.column("grp")[int(i)].as_py()))
            a, b, rest, heads, kinds, group = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b, rest, heads, kinds, group))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(len(a), np.int64), kinds])),
                    pa.concat_arrays([pa.array(a), pa.array(rest)]),
                    pa.concat_arrays([pa.array(b), pa.array(heads)]),
                    pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(group)]),
                ],
                names=["kind", "a", "b", "grp"],
            )

    def outside(rows: pa.Table) -> pa.Table:
        """The heads of one group that blocks don't connect with its main component, the one with most members."""
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        pairs = list(zip(rows["a"].to_pylist(), rows["b"].to_pylist(), rows["n"].to_pylist(), strict=True))
        for x, y, _ in pairs:
            parent[root(x)] = root(y)
        sizes: dict[int, int] = {}
        for _, y, n in pairs:
            sizes[root(y)] = sizes.get(root(y), 0) + n
        main = max(sizes, key=lambda r: (sizes[r], r))
        found = [x for x in list(parent) if root(x) != main]
        return pa.table({"grp": pa.array([rows["grp"][0].as_py()] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    found = written(dealt.repartition("grp", "block").sortWithinPartitions("grp", "block").mapInArrow(search, "kind long, a long, b long, grp long"), "links")
    links = found.where("kind = 0").select("a", "b")
    led = found.where("kind = 2")
    ties = found.where("kind = 3").select("grp", "a", "b", F.lit(0).cast("long").alias("n")).distinct()
    ties = ties.union(led.groupBy("grp", "b").agg(F.count(F.lit(1)).alias("n")).select("grp", F.col("b").alias("a"), "b", "n"))
    apart = led.join(ties.groupBy("grp").applyInArrow(outside, "grp long, b long"), ["grp", "b"], "left_semi")
    left = found.where("kind = 1").select("grp", "a").union(apart.select("grp", "a")).toDF("grp", "id").distinct()
    left = written(left, "left")
    if left.isEmpty():
        return links
    # What no leader reached, or only one outside the main component, is compared with every block of its group, in bounded pieces of both.
    pieces = left.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("pieces"))
    wide = dealt.where("not leads").join(pieces, "grp").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    wide = wide.select("grp", "block", "piece", "id", F.lit(False).alias("asks"), "payload")
    asking = dealt.where("not leads").join(left, ["grp", "id"]).join(pieces, "grp").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")))
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asking = asking.select("grp", "block", "piece", "id", F.lit(True).alias("asks"), "payload")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, ["grp", "block", "piece"]):
            ids, asks, a, b = batch.column("id").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False), [], []
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                like, own = likeness(batch.column("payload").slice(i, j - i)), asks[i:j]
                others = np.flatnonzero(~own)
                for x in np.flatnonzero(own).tolist() if len(others) else ():
                    hit = others[like(x, others)]
                    a.append(np.full(len(hit), ids[i + x]))
                    b.append(ids[i + hit])
            a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    second = wide.union(asking).repartition("grp", "block", "piece").sortWithinPartitions("grp", "block", "piece").mapInArrow(ask, "a long, b long")
    return links.union(second)


def _blocks(members: DataFrame) -> DataFrame:
    """(grp, blocks) of the groups above one block."""
    return members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("grp", F.ceil(F.col("n") / BLOCK).alias("blocks"))


def _modal_leaders(members: DataFrame, counts: DataFrame) -> DataFrame:
    """(grp, id): in each of ``LEADERS`` hash classes of a large group, the member nearest to the group's modal labels.

    ``members`` (grp, id, labels). Label counts combine map-side to at most 16 per label and group.
    """
    large = members.join(counts.select("grp"), "grp", "left_semi")
    digits = F.hex("labels")
    each = large.select("grp", F.posexplode(F.split(digits, "(?<=.)(?=.)")).alias("at", "label"))
    modal = each.groupBy("grp", "at", "label").count().groupBy("grp", "at").agg(F.max_by("label", F.struct("count", "label")).alias("label"))
    modal = modal.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), "").alias("mode"))
    near = F.aggregate(F.zip_with(F.split(digits, "(?<=.)(?=.)"), F.split("mode", "(?<=.)(?=.)"), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    ranked = large.join(modal, "grp").select("grp", "id", F.pmod(F.xxhash64("id"), F.lit(LEADERS)).alias("part"), near.alias("near"))
    return ranked.groupBy("grp", "part").agg(F.max_by("id", F.struct("near", -F.col("id"))).alias("id")).select("grp", "id")


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents link when 100 * |common shingles| >= ``percent`` * |all shingles of both|;
    ``component_id`` is the least doc_id reachable over links, and that document is ``kept``.
    """
    marks = written(sketches(documents, width), "sketches")
    classes = marks.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("regions").alias("regions"), F.first("labels").alias("labels"))
    classes = written(classes, "classes")

    found = forest_links(first_trees(classes), DEPTH)
    deep = found.where("kind = 1").groupBy(F.col("a").alias("id")).agg(F.count_distinct("b").alias("n")).where(F.col("n") >= DEEP_TREES).select("id")
    likely = found.where("kind = 0").select("a", "b")
    deep = written(deep, "deep")
    if not deep.isEmpty():
        likely = likely.union(forest_links(more_trees(classes.select("id", "labels").join(deep, "id", "left_semi")), MORE_DEPTH).where("kind = 0").select("a", "b"))
    clusters = written(connected_components(contracted(likely)), "clusters")

    members = clusters.select(F.col("component").alias("grp"), "id")
    small = clusters.count() <= BROADCAST_ROWS
    texts = documents.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(members) if small else members, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([s.tobytes() for _, s in shingle_sets(batch.column("text"), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("id"), found], names=["grp", "id", "payload"])

    full = written(texts.mapInArrow(sets, "grp long, id long, payload binary"), "sets")
    many = written(_blocks(members), "large-clusters")
    leaders = _modal_leaders(members.join(classes.select("id", "labels"), "id"), many)
    leaders = full.join(leaders, ["grp", "id"]).dropDuplicates(["grp", "id"])
    links = _links(full, many, leaders, lambda payload: _Sets(payload, percent))
    parts = connected_components(links)

    named = classes.select("set_key", "id").join(parts, "id", "left").select("set_key", F.coalesce("component", "id").alias("_component"))
    named = written(named, "components")
    joined = marks.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("_component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
