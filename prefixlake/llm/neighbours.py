"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The top of the tree is fitted on the driver from a bounded sample (``SAMPLE`` vectors drawn by hash).
Leaves of it that more than ``CELL`` points reach are split further inside the executors, each from
a bounded sample of its own points, into about ``FANOUT`` leaves, so the number of leaves follows the
rows up to a fixed bound, and every row is placed in a leaf. Neighbouring leaves are gathered to bins of about
``GATHER`` points, larger ones dealt to bins of about ``BLOCK``. Best bin first comes to a leaf by the greatest distance to
a centre on the way to it, and so orders the bins that a query would visit.
How many it visits is calibrated: twice ``PROBES`` vectors, drawn by hash from all rows, those first that
the tree was not fitted on, are compared with all rows exactly, and visits widen until the share
``RECALL`` of the true neighbours lies in visited bins for either half of them. What all of them found
at that width is a column of the result.

Equal vectors are one point with its smallest ids, so copies cost nothing however many there are.
Runs of bins make pieces of at most ``PIECE`` bytes, one a task. A query moves to a piece once, with the bins that it visits there,
and leaves one list there. A task holds its piece and ``CHUNK`` queries, however many visit it, and one that tells queries
where to go holds the bins of a few of them.

Distances are prefiltered by a matrix product of vectors less the sample's mean, with a bound on its
rounding error, and whatever may be among the nearest is measured again on the original vectors.

Defined results: vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part, as query or candidate; ties go to the smaller id; a query with
fewer candidates than ``k`` gets them all; rows repeated whole are one row; a query id with several
vectors asks with the least of them by bytes and is a candidate with each of them; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.shared import written

SAMPLE = 20_000
BRANCHES = 12
LEAF = 48
CELL, FANOUT = 1024, 256  # points a top leaf holds before it is split, and into about how many leaves
PROBES = 96
RECALL = 0.96
GATHER = 1024  # points up to which neighbouring leaves share a bin
BLOCK = 4096  # points of a bin, about, where a leaf has more
PIECE = 32 << 20  # bytes of the points that one task searches
CHUNK = 512  # queries that are compared with a bin at once
NUMBERS = 1 << 20  # numbers in an array that a task makes on its way


@dataclass
class Tree:
    """Centres of every node's children; a child is a node (>= 0) or a leaf (-1 - leaf)."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaves: int

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        out = np.zeros(len(vectors), np.int64)
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            nearest = _squared(vectors[rows], self.centres[node]).argmin(axis=1)
            for i, child in enumerate(self.children[node]):
                own = rows[nearest == i]
                if child < 0:
                    out[own] = -1 - child
                else:
                    waiting.append((child, own))
        return out

    def reach(self, queries: np.ndarray, bins: Bins) -> np.ndarray:
        """When best bin first comes to each bin: its least leaf's greatest distance on the way from the root."""
        out = np.full((len(queries), len(bins.like)), np.inf)
        waiting = [(0, np.zeros(len(queries)))]
        while waiting:
            node, so_far = waiting.pop()
            away = np.maximum(_squared(queries, self.centres[node]), so_far[:, None])
            for i, child in enumerate(self.children[node]):
                if child < 0:
                    at = bins.first[-1 - child]
                    np.minimum(out[:, at], away[:, i], out=out[:, at])
                else:
                    waiting.append((child, away[:, i]))
        return out[:, bins.like]

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        one = np.ones(self.leaves, np.int64)
        return iter(self.reach(query[None], deal(one, one, self.leaves, gather=0))[0].argsort(kind="stable").tolist())


@dataclass
class Bins:
    """Where the points of leaves lie."""

    first: np.ndarray  # of a leaf: its only bin, or the first of ``many``
    many: np.ndarray
    like: np.ndarray  # of a bin: itself, or the first bin of its leaf
    ids: np.ndarray  # of a bin: how many candidates it holds, about
    piece: np.ndarray  # of a bin: the piece that it is part of
    pieces: int


def deal(points: np.ndarray, ids: np.ndarray, most: int, gather: int | None = None) -> Bins:
    """Bins of leaves with so many points and candidates, in the order of leaves, and pieces of about ``most`` points."""
    gather = GATHER if gather is None else gather
    first, many, size, like, held = np.zeros(len(points), np.int64), np.ones(len(points), np.int64), [], [], []
    room = -1
    for leaf, (n, m) in enumerate(zip(points.tolist(), ids.tolist(), strict=True)):
        alone = n > gather
        if alone or room < n:
            several = max(1, -(-n // BLOCK)) if alone else 1
            first[leaf], many[leaf], at = len(size), several, len(size)
            size += [-(-n // several)] * several
            like += [at] * several
            held += [m // several] * several
            room = -1 if alone else gather - n
        else:
            first[leaf], room = len(size) - 1, room - n
            size[-1] += n
            held[-1] += m
    piece, filled, pieces = [], 0, 0
    for n in size:
        if filled and filled + n > most:
            filled, pieces = 0, pieces + 1
        filled += n
        piece.append(pieces)
    return Bins(first, many, np.array(like, np.int64), np.array(held, np.int64), np.array(piece, np.int64), pieces + 1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None], 0)


def graft(tree: Tree, parts: dict[int, Tree]) -> Tree:
    """``tree`` with the leaves in ``parts`` replaced by trees; leaves are numbered anew."""
    out, leaf = Tree(list(tree.centres), [], 0), 0

    def fresh() -> int:
        nonlocal leaf
        leaf += 1
        return -leaf

    for children in tree.children:
        own = []
        for child in children:
            if child >= 0:
                own.append(child)
            elif -1 - child in parts:
                own.append(("part", -1 - child))
            else:
                own.append(fresh())
        out.children.append(own)
    for at, part in parts.items():
        base = len(out.centres)
        out.centres += part.centres
        out.children += [[c + base if c >= 0 else fresh() for c in own] for own in part.children]
        for own in out.children[: len(tree.children)]:
            if ("part", at) in own:
                own[own.index(("part", at))] = base
    out.leaves = leaf
    return out


def fit_tree(vectors: np.ndarray, seed: int = 3, leaf: int = LEAF) -> Tree:
    """Split by k-means until a node holds at most ``leaf`` sample vectors."""
    rng = np.random.default_rng(seed)
    tree = Tree([], [], 0)

    def grow(rows: np.ndarray) -> int:
        own = vectors[rows]
        k = min(BRANCHES, max(2, -(-len(rows) // leaf)))
        centres = own[rng.choice(len(rows), min(k, len(rows)), replace=False)]
        for _ in range(8):
            near = _squared(own, centres).argmin(axis=1)
            centres = np.stack([own[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
        near = _squared(own, centres).argmin(axis=1)
        node = len(tree.centres)
        tree.centres.append(centres)
        tree.children.append([])
        for i in range(len(centres)):
            part = rows[near == i]
            if len(part) > leaf and len(part) < len(rows):
                child = grow(part)
            else:
                child = -1 - tree.leaves
                tree.leaves += 1
            tree.children[node].append(child)
        return node

    if len(vectors) > leaf:
        grow(np.arange(len(vectors)))
    else:
        tree = Tree([vectors.mean(axis=0, keepdims=True)], [[-1]], 1)
    return tree


def _matrix(column: pa.Array, dims: int, form: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), form).astype(np.float64).reshape(-1, dims)


def usable(vectors: DataFrame) -> tuple[DataFrame, int, str]:
    """(vec_id, v) with v the little-endian components of every usable vector, their number, and their numpy form."""
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    form, kind = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    some = vectors.select("vec_id", F.col("embedding").cast(kind).alias("e")).where(F.col("e").isNotNull() & fine)
    common = some.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = common["n"] if common else 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("e").flatten().to_numpy().astype(form)
            flat = flat + flat.dtype.type(0)
            rows = [r.tobytes() for r in flat.reshape(-1, dims)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.binary())], names=["vec_id", "v"])

    return some.where(F.size("e") == dims).mapInArrow(pack, "vec_id long, v binary"), dims, form


def closest(query: np.ndarray, points: np.ndarray, query_at: np.ndarray, points_at: np.ndarray, most: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, exact distance) of all that may be among the ``most`` nearest of a query, with all ties, and are no farther than its ``bound``.

    ``query_at`` and ``points_at`` are the same vectors less a common offset; they serve the matrix product.
    """
    size, own, eps = (points_at * points_at).sum(1), (query_at * query_at).sum(1), np.finfo(np.float64).eps
    # Rounding of three sums over the components, each of terms no larger than these.
    slack = eps * (2 * query.shape[1] + 8) * (own[:, None] + size[None])
    low = own[:, None] - 2 * (query_at @ points_at.T) + size[None] - slack
    limit = bound * bound * (1 + eps * (query.shape[1] + 8))
    new = np.flatnonzero(np.isinf(bound))
    if len(new) and len(points) > most:
        limit[new] = np.partition(low[new] + 2 * slack[new], most - 1, axis=1)[:, most - 1]
    q, p = np.nonzero(~(low > limit[:, None]))
    # Few as a rule; vectors that lie closer together than rounding can tell may all come here.
    step = max(1, NUMBERS // query.shape[1])
    exact = [np.sqrt(((points[p[at : at + step]] - query[q[at : at + step]]) ** 2).sum(axis=1)) for at in range(0, len(q), step)]
    d = np.concatenate([np.zeros(0), *exact])
    near = d <= bound[q]
    return q[near], p[near], d[near]


class Found:
    """The ``keep`` nearest so far of some queries, by distance and id."""

    none = np.iinfo(np.int64).max

    def __init__(self, queries: int, keep: int) -> None:
        self.d, self.ids, self.keep = np.full((queries, keep), np.inf), np.full((queries, keep), self.none), keep

    @property
    def bound(self) -> np.ndarray:
        return self.d[:, -1]

    def add(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        own, at = np.unique(rows, return_inverse=True)
        at, d, ids = np.concatenate([np.repeat(np.arange(len(own)), self.keep), at]), np.concatenate([self.d[own].ravel(), d]), np.concatenate([self.ids[own].ravel(), ids])
        order = np.lexsort((ids, d, at))
        place = np.arange(len(at)) - np.searchsorted(at[order], np.arange(len(own)))[at[order]]
        first = order[place < self.keep]
        self.d[own], self.ids[own] = d[first].reshape(-1, self.keep), ids[first].reshape(-1, self.keep)

    def lists(self, id_name: str = "id") -> pa.ListArray:
        some = self.ids < self.none
        ends = np.concatenate([[0], some.sum(axis=1).cumsum()])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(self.d[some]), pa.array(self.ids[some])], names=["d", id_name]))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score, measured_recall): the ``k`` nearest rows found for every row with ``is_query``.

    ``vectors`` has vec_id and embedding; ``is_query`` may use vec_id. Score is Euclidean distance.
    ``measured_recall`` is what the probes found in this run.
    """
    rows, dims, form = usable(vectors)
    rows = written(rows, "vectors")
    spark, total = rows.sparkSession, rows.count()
    schema = "query_id long, rank int, vec_id long, score double, measured_recall double"
    if not total:
        return spark.createDataFrame([], schema)
    keep = k + 1
    drawn_share = F.pmod(F.xxhash64(F.lit(29), "vec_id"), F.lit(total))
    fitted = drawn_share < min(SAMPLE, max(1, total // 2))
    drawn = rows.where(fitted).limit(2 * SAMPLE).orderBy("vec_id").select("v").toArrow()["v"].combine_chunks()
    sample = np.unique(_matrix(drawn, dims, form), axis=0)
    sample = sample[np.random.default_rng(3).permutation(len(sample))] if len(sample) else np.zeros((1, dims))
    middle = sample.mean(axis=0)
    tree = fit_tree(sample - middle)

    def placed(rows: DataFrame, tree: Tree) -> DataFrame:
        """(v, leaf, ids): every distinct vector, its leaf, and its ``keep`` smallest ids."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, ids = batch.column("v").to_pylist(), batch.column("vec_id").to_pylist()
                # Copies inside a batch: only the smallest ids of a vector can ever be answers.
                order, seen, own = sorted(range(len(v)), key=lambda i: (v[i], ids[i])), 0, []
                for at, i in enumerate(order):
                    new = not at or v[i] != v[order[at - 1]]
                    if not new and ids[i] == ids[order[at - 1]]:
                        continue
                    seen = 0 if new else seen + 1
                    if seen < keep:
                        own.append(i)
                part = batch.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tree.place(_matrix(part.column("v"), dims, form) - middle))], names=["vec_id", "v", "leaf"])

        found = rows.mapInArrow(place, "vec_id long, v binary, leaf long")
        return found.groupBy("v").agg(F.first("leaf").alias("leaf"), F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep).alias("ids"))

    def counted(points: DataFrame, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """How many points and candidates each leaf has; the number of leaves is bounded."""
        found = points.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("m")).toArrow()
        out = np.zeros((2, leaves), np.int64)
        out[:, found["leaf"].to_numpy()] = found["n"].to_numpy(), found["m"].to_numpy()
        return out[0], out[1]

    points = written(placed(rows, tree), "points")
    sizes, held = counted(points, tree.leaves)
    large = {int(leaf): int(sizes[leaf]) for leaf in np.flatnonzero(sizes > CELL)}
    if large:
        scale = 1 << 30
        # One row a leaf, whose number ``SAMPLE`` and ``FANOUT`` bound.
        shares = spark.createDataFrame([(leaf, min(scale, scale * FANOUT * LEAF // n)) for leaf, n in large.items()], "leaf long, share long")
        some = points.join(F.broadcast(shares), "leaf").where(F.pmod(F.xxhash64(F.lit(31), "v"), F.lit(scale)) < F.col("share")).select("v", "leaf", "ids")

        def split(key: tuple, own: pa.Table) -> pa.Table:
            x = _matrix(own["v"].combine_chunks(), dims, form) - middle
            part = fit_tree(x[np.lexsort(x.T)], seed=5, leaf=max(LEAF, 4 * len(x) // FANOUT))
            return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([pickle.dumps(part)], pa.binary())})

        parts = some.groupBy("leaf").applyInArrow(split, "leaf long, part binary").collect()
        tree = graft(tree, {r["leaf"]: pickle.loads(r["part"]) for r in sorted(parts, key=lambda r: r["leaf"])})

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(tree.place(_matrix(batch.column("v"), dims, form) - middle)), batch.column("ids")], names=["v", "leaf", "ids"])

        points = written(points.select("v", "leaf", "ids").mapInArrow(again, "v binary, leaf long, ids array<long>"), "points")
        sizes, held = counted(points, tree.leaves)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bins = deal(sizes, held, max(1, min(PIECE // (8 * dims), max(GATHER, int(sizes.sum()) // (2 * tasks)))))
    # One row a leaf and one a bin.
    leaves = spark.createDataFrame(pa.table({"leaf": np.arange(tree.leaves), "first": bins.first, "many": bins.many}))
    parts_of = spark.createDataFrame(pa.table({"bin": np.arange(len(bins.piece)), "piece": bins.piece}))
    points = points.join(F.broadcast(leaves), "leaf").withColumn("bin", F.col("first") + F.pmod(F.xxhash64("v"), F.col("many"))).join(F.broadcast(parts_of), "bin")

    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    known = F.exists("ids", lambda i: F.pmod(F.xxhash64(F.lit(29), i), F.lit(total)) < min(SAMPLE, max(1, total // 2)))
    probes = _matrix(points.orderBy(known, F.xxhash64(F.lit(37), "v"), "v").limit(2 * PROBES).select("v").toArrow()["v"].combine_chunks(), dims, form)
    width, recall = calibrate(points, tree, bins, probes, middle, keep, form)
    moved = max(1, NUMBERS // dims)  # queries moved at once

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, ask, step = batch.column("v"), batch.column("ask"), max(1, NUMBERS // len(bins.like))
            for at in range(0, batch.num_rows, step):
                away = tree.reach(_matrix(v.slice(at, step), dims, form) - middle, bins)
                order = away.argsort(axis=1, kind="stable")
                enough = (bins.ids[order].cumsum(axis=1) <= k).sum(axis=1) + 1
                met = np.zeros(away.shape, bool)
                np.put_along_axis(met, order, np.arange(away.shape[1]) < np.maximum(width, enough)[:, None], axis=1)
                row, own = np.nonzero(met)
                piece = bins.piece[own]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])]))
                ends = np.concatenate([new, [len(row)]])
                for i in range(0, len(new), moved):
                    some, edge = new[i : i + moved], ends[i : i + moved + 1]
                    which = pa.array(at + row[some])
                    lists = pa.ListArray.from_arrays(pa.array(edge - edge[0], pa.int32()), pa.array(own[edge[0] : edge[-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array(piece[some]), ask.take(which), v.take(which), lists], names=["piece", "ask", "v", "ids"])

    # A vector asks once, in the name of its smallest query id.
    asks = asked.groupBy("v").agg(F.min("query_id").alias("ask"))
    visits = asks.repartition(tasks, "ask").mapInArrow(visit, "piece long, ask long, v binary, ids array<long>")
    visits = visits.withColumn("asks", F.lit(True)).withColumn("bin", F.lit(None).cast("long"))
    dealt = visits.unionByName(points.select("piece", F.lit(None).cast("long").alias("ask"), "v", "ids", F.lit(False).alias("asks"), "bin"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The points of a piece in the order of bins, followed by the queries that visit it, whose ``ids`` are bins."""
        held, ready = [], None
        for batch in batches:
            n = batch.num_rows - batch.column("asks").true_count
            if n:
                own = batch.slice(0, n)
                held.append((_matrix(own.column("v"), dims, form), own.column("bin").to_numpy(), own.column("ids").value_lengths().to_numpy(), own.column("ids").flatten().to_numpy()))
            if n == batch.num_rows or not held:
                continue
            if ready is None:
                p, bin, many, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                cuts = np.flatnonzero(np.concatenate([[True], bin[1:] != bin[:-1]]))
                places = dict(zip(bin[cuts].tolist(), zip(cuts.tolist(), [*cuts[1:].tolist(), len(bin)], strict=True), strict=True))
                held, ready = [0], (p, places, many, many.cumsum() - many, ids)
            p, places, many, begins, ids = ready
            for at in range(n, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                q, found = _matrix(part.column("v"), dims, form), Found(part.num_rows, keep)
                q_at = q - middle
                visited = part.column("ids").flatten().to_numpy()
                order = visited.argsort(kind="stable")
                row = np.repeat(np.arange(part.num_rows), part.column("ids").value_lengths().to_numpy())[order]
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(visited[order]) != 0])).tolist()
                for i, j in zip(cuts, [*cuts[1:], len(row)], strict=True):
                    a, b = places.get(int(visited[order[i]]), (0, 0))
                    if a == b:
                        continue
                    own = row[i:j]
                    near, point, d = closest(q[own], p[a:b], q_at[own], p[a:b] - middle, keep, found.bound[own])
                    every = np.repeat(np.arange(len(point)), many[a + point])
                    nth = np.arange(len(every)) - np.repeat(many[a + point].cumsum() - many[a + point], many[a + point])
                    found.add(own[near[every]], d[every], ids[begins[a + point[every]] + nth])
                yield pa.RecordBatch.from_arrays([part.column("ask"), found.lists()], names=["ask", "found"])

    lists = dealt.repartitionById(bins.pieces, F.col("piece").cast("int")).sortWithinPartitions("asks", "bin", "ask").mapInArrow(search, "ask long, found array<struct<d: double, id: long>>")
    merged = lists.groupBy("ask").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, keep).alias("found"))
    merged = written(merged, "found")
    answers = asked.join(asks, "v").join(merged, "ask").select("query_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k).alias("found"))
    answers = answers.select("query_id", F.posexplode("found").alias("rank", "x"))
    return answers.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"), F.lit(recall).cast("double").alias("measured_recall"))


def calibrate(points: DataFrame, tree: Tree, bins: Bins, probes: np.ndarray, middle: np.ndarray, keep: int, form: str) -> tuple[int, float | None]:
    """How many bins a query visits so that either half of the probes reaches ``RECALL``, and what all of them reach."""
    dims = probes.shape[1]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Found(len(probes), keep)
        for batch in batches:
            own, bin = _matrix(batch.column("v"), dims, form), batch.column("bin").to_numpy()
            for at in range(0, len(own), BLOCK):
                part = own[at : at + BLOCK]
                probe, near, d = closest(probes, part, probes - middle, part - middle, keep, best.bound)
                best.add(probe, d, bin[at + near])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(probes))), best.lists("bin")], names=["p", "x"])

    near = points.select("v", "bin").mapInArrow(exact, "p long, x array<struct<d: double, bin: long>>")
    near = near.groupBy("p").agg(F.slice(F.sort_array(F.flatten(F.collect_list("x"))), 1, keep).alias("x")).collect()
    at = tree.reach(probes - middle, bins).argsort(axis=1, kind="stable").argsort(axis=1)
    # The first is the probe itself.
    places = {r["p"]: [int(at[r["p"], x["bin"]]) for x in r["x"][1:]] for r in near}
    half = -(-len(probes) // 2)
    halves = [np.sort([x for p, own in places.items() if (p < half) == first for x in own]) for first in (True, False)]
    halves = [h for h in halves if len(h)]
    # The visit at which the share is reached is the order statistic of that share.
    width = max((int(h[math.ceil(RECALL * len(h)) - 1]) + 1 for h in halves), default=1)
    return width, float((np.concatenate(halves) < width).mean()) if halves else None
