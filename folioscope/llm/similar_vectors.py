"""The most similar vectors of every vector: stable projections in a kd-tree, stopped by a chi-square test."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import materialize

SEED = 20260711
DIMENSIONS = 64
PROJECTED = 16
SAMPLE_ROWS = 65_536
LEAF_ROWS = 128
PART_ROWS = 65_536
LEAST_PART_ROWS = 8192
CONFIDENCE = 0.5
BLOCK = 128
CHUNK_ROWS = 2048
FIRST_LEAVES = 8
MARGIN = 5e-6  # above the error of a float32 product of two unit vectors of 64 elements
EXACT_ROWS = 65_536
POINT = "k1 bigint, k2 bigint, vec array<float>, ids array<bigint>"
TOP = "array<struct<cos:double,id:bigint>>"


def chi_square_quantile(p: float, df: int) -> float:
    """Wilson and Hilferty's approximation."""
    return df * (1 - 2 / (9 * df) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * df))) ** 3


@dataclass
class Tree:
    """A complete kd-tree over projected vectors: node i has the children 2i + 1 and 2i + 2; leaves are numbered from left to right."""

    projection: np.ndarray
    dims: np.ndarray
    cuts: np.ndarray
    depth: int

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.projection).astype(np.float32)

    def leaf(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        row = np.arange(len(projected))
        for _ in range(self.depth):
            node = 2 * node + 1 + (projected[row, self.dims[node]] > self.cuts[node])
        return node - (2**self.depth - 1)


def fit_tree(sample: np.ndarray, depth: int, projected: int = PROJECTED, seed: int = SEED) -> Tree:
    """Medians of the widest coordinate at every node, from a sample of unit vectors."""
    projection = np.random.default_rng(seed).standard_normal((sample.shape[1], projected))
    points = sample @ projection
    dims, cuts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1, np.float32)
    groups = [np.arange(len(points))]
    for node in range(2**depth - 1):
        rows = groups[node]
        groups[node] = None
        if len(rows):
            dims[node] = int(np.argmax(points[rows].var(axis=0)))
            cuts[node] = np.median(points[rows, dims[node]])
        right = points[rows, dims[node]] > cuts[node]
        groups += [rows[~right], rows[right]]
    return Tree(projection, dims, cuts, depth)


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def matrix(batch: pa.RecordBatch, column: str = "vec") -> np.ndarray:
    """The batch's vectors as a float32 matrix."""
    lists = batch.column(batch.schema.get_field_index(column))
    offsets = np.asarray(lists.offsets)
    return np.asarray(lists.values, np.float32)[offsets[0] : offsets[-1]].reshape(len(lists), -1)


def list_array(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mindist(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    total = np.zeros((len(points), len(low)), np.float32)
    for d in range(points.shape[1]):
        x = points[:, d, None]
        gap = np.maximum(low[None, :, d] - x, x - high[None, :, d])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        total += gap
    return total


def boxes_within(points: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the boxes within reach of any of the points, and the squared distances (points x boxes).

    Boxes that the points' own bounding box can't reach are left out first, so a block of points that lie together is
    compared with few boxes.
    """
    gap = np.maximum(np.maximum(low - points.max(axis=0), points.min(axis=0) - high), 0)
    some = np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= reach.max())
    near = mindist(points, low[some], high[some])
    kept = (near <= reach[:, None]).any(axis=0)
    return some[kept], near[:, kept]


def split_leaves(projected: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The kd-tree of one partition: rows in the order of their leaves, and where each leaf begins.

    Every group of more than ``leaf_rows`` rows is halved at the median of its widest coordinate, so leaves have about
    the same size however many rows the partition and the whole table have.
    """
    leaves, groups = [], [np.arange(len(projected))]
    while groups:
        rows = groups.pop()
        if len(rows) <= leaf_rows:
            leaves.append(rows)
            continue
        own = projected[rows]
        half = len(rows) // 2
        order = np.argpartition(own[:, int(np.argmax(own.var(axis=0)))], half)
        groups += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(leaves), np.cumsum([0, *map(len, leaves[:-1])])


class Part:
    """The vectors of one partition, in memory by the leaves of a kd-tree of their own, with the leaves' bounding boxes."""

    def __init__(self, batches: list[pa.RecordBatch], tree: Tree, wanted: int, leaf_rows: int):
        vectors = np.concatenate([matrix(b) for b in batches])
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
        projected = tree.project(vectors / norms[:, None])
        order, self.starts = split_leaves(projected, leaf_rows)
        self.ends = np.append(self.starts[1:], len(order))
        self.vectors, self.norms, self.projected = vectors[order], norms[order], projected[order]
        self.single = (self.vectors / self.norms[:, None]).astype(np.float32)
        self.keys = [np.concatenate([np.asarray(column(b, k)) for b in batches])[order] for k in ("k1", "k2")]
        ids = pa.chunked_array([column(b, "ids") for b in batches]).combine_chunks().take(pa.array(order))
        self.ids, self.id_starts = np.asarray(ids.flatten()), np.asarray(ids.offsets, np.int64)
        self.least = self.ids[self.id_starts[:-1]]  # ids ascend, and every row has one
        self.low = np.minimum.reduceat(self.projected, self.starts)
        self.high = np.maximum.reduceat(self.projected, self.starts)
        self.wanted = wanted

    def exact(self, rows: np.ndarray | slice) -> np.ndarray:
        return self.vectors[rows].astype(np.float64) / self.norms[rows, None]

    def rows_of(self, leaves: np.ndarray) -> np.ndarray:
        size = (self.ends - self.starts)[leaves]
        until = np.cumsum(size)
        return np.arange(until[-1]) + np.repeat(self.starts[leaves] - (until - size), size)

    def cosines(self, exact: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        parts = [slice(at, at + EXACT_ROWS) for at in range(0, len(rows), EXACT_ROWS)]
        return np.concatenate([np.einsum("ij,ij->i", exact[queries[p]], self.exact(rows[p])) for p in parts])

    def search(self, exact: np.ndarray, projected: np.ndarray, bound: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and double-precision similarity of the best in this partition for a block of queries.

        Float32 similarities only choose what is looked at: all rows within ``MARGIN`` of the k-th are compared in double
        precision, and the ``wanted`` best by the rounded value, then the lower id, are kept.

        Leaves are verified in the order of their projected distance, some at a time. After each step every query has
        a k-th similarity (or ``bound``, if that is better); by the chi-square test a leaf is left out once its squared
        projected distance is above ``stop`` times the squared k-th distance. Only rows at or above the k-th
        similarity are kept, so no step sorts more than a few rows a query.
        """
        single = exact.astype(np.float32)
        bound = bound.astype(np.float32)
        margin = np.float32(MARGIN)
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def verify(queries: np.ndarray, leaves: np.ndarray) -> None:
            nonlocal top
            rows = self.rows_of(leaves)
            similar = single[queries] @ self.single[rows].T
            if (bound[queries] <= -2).all() and len(rows) > self.wanted:  # nothing known yet
                edge = np.partition(similar, len(rows) - self.wanted, axis=1)[:, len(rows) - self.wanted]
            else:
                edge = bound[queries]
            q, c = np.divmod(np.flatnonzero(similar >= edge[:, None] - margin), len(rows))
            if not len(q):
                return
            cosine = np.round(self.cosines(exact, queries[q], rows[c]), 9)
            found = (np.concatenate((top[0], queries[q])), np.concatenate((top[1], rows[c])), np.concatenate((top[2], cosine)))
            order = np.lexsort((self.least[found[1]], -found[2], found[0]))
            nth = places_within(found[0][order])
            kept = order[nth < self.wanted]
            top = tuple(x[kept] for x in found)
            full = order[nth == self.wanted - 1]
            bound[found[0][full]] = np.maximum(bound[found[0][full]], found[2][full])

        reach = lambda: stop * np.maximum(2 - 2 * bound, 0) + np.float32(1e-6)
        everyone = np.arange(len(exact))
        first = mindist(projected.mean(axis=0)[None], self.low, self.high)[0].argsort(kind="stable")[:FIRST_LEAVES]
        verify(everyone, first)
        boxes, near = boxes_within(projected, self.low, self.high, reach())
        other = ~np.isin(boxes, first)
        boxes, near = boxes[other], near[:, other]
        order = near.min(axis=0).argsort(kind="stable") if len(boxes) else boxes
        sizes = np.cumsum((self.ends - self.starts)[boxes[order]]) // CHUNK_ROWS
        for step in np.unique(sizes).tolist():
            some = order[sizes == step]
            meets = near[:, some] <= reach()[:, None]
            some = some[meets.any(axis=0)]
            if len(some):
                verify(everyone[meets.any(axis=1)], boxes[some])
        return top

    def tops(self, n: int, query: np.ndarray, rows: np.ndarray, similar: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
        """The best ids of each query (similarity rounded, ties to the lower id), and the k-th similarity (-2: there is none)."""
        size = np.diff(self.id_starts)[rows]
        until = np.cumsum(size)
        ids = self.ids[np.arange(size.sum()) + np.repeat(self.id_starts[:-1][rows] - (until - size), size)]
        query, similar = np.repeat(query, size), np.repeat(np.round(similar, 9), size)
        order = np.lexsort((ids, -similar, query))
        nth = places_within(query[order])
        kth = np.full(n, -2.0)
        last = order[nth == self.wanted - 1]
        kth[query[last]] = similar[last]
        kept = order[nth < self.wanted]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(query[kept], minlength=n))))
        items = pa.StructArray.from_arrays([pa.array(similar[kept]), pa.array(ids[kept])], ["cos", "id"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items), kth


def places_within(groups: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal values."""
    place = np.arange(len(groups))
    fresh = np.append(True, groups[1:] != groups[:-1])[: len(groups)]
    return place - np.maximum.accumulate(np.where(fresh, place, 0))


def usable_vectors(df: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """key, vec: rows whose vector has all its elements, none of them null or NaN, and is not all zero."""
    good = (F.size("vec") == dimensions) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)) & F.exists("vec", lambda x: x != 0)
    return df.select(df[key].cast("bigint").alias("key"), df[vector].cast("array<float>").alias("vec")).where("key is not null").where(F.coalesce(good, F.lit(False)))


def keyed_vectors(points: DataFrame) -> DataFrame:
    """k1, k2 (128 bits of the vector's direction), key, vec: proportional vectors agree in k1, k2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch)
                directions = np.round(unit(rows), 12) + 0.0  # no negative zero
                digests = np.frombuffer(b"".join(hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in directions), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), column(batch, "key"), column(batch, "vec")], ["k1", "k2", "key", "vec"])

    return points.mapInArrow(run, "k1 bigint, k2 bigint, key bigint, vec array<float>")


def distinct_vectors(keyed: DataFrame, wanted: int) -> DataFrame:
    """A row per distinct direction with its ``wanted`` lowest keys: more can't be among the nearest of any other.

    The rank limit is applied before the shuffle, too, so a vector that a third of all rows share sends a few rows
    per task.
    """
    nth = F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("key"))
    return (
        keyed.withColumn("nth", nth).where(F.col("nth") <= wanted)
        .groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("key")).alias("ids"))
    )


def _stream(rows: DataFrame, parts: int, schema: str, tree: Tree, wanted: int, leaf_rows: int, stop: float, route) -> DataFrame:
    """Points (kind 0) and queries (kind 1) of each partition, points first; only the points are held in memory."""

    def answer(part: Part, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        exact = unit(matrix(batch))
        projected = tree.project(exact)
        order = np.argsort(tree.leaf(projected), kind="stable")
        bound = np.asarray(column(batch, "bound"))
        for at in range(0, len(order), BLOCK):
            own = order[at : at + BLOCK]
            query, found, similar = part.search(exact[own], projected[own], bound[own], stop)
            good = similar >= bound[own][query] - 1e-9
            lists, _ = part.tops(len(own), query[good], found[good], similar[good])
            take = np.flatnonzero(np.diff(np.asarray(lists.offsets)))
            picked = pa.array(own[take])
            yield pa.RecordBatch.from_arrays([column(batch, "k1").take(picked), column(batch, "k2").take(picked), lists.take(pa.array(take))], ["k1", "k2", "top"])

    def own_search(part: Part, pid: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(part.vectors), BLOCK):
            block = slice(at, at + BLOCK)
            own = part.exact(block)
            lists, kth = part.tops(len(own), *part.search(own, part.projected[block], np.full(len(own), -2.0), stop))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.keys[0][block]), pa.array(part.keys[1][block]), lists, pa.array(kth), list_array(part.vectors[block]), route(part.projected[block], kth, pid),
                ],
                ["k1", "k2", "top", "bound", "vec", "pids"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, current = None, None
        for batch in batches:
            pids, kinds = np.asarray(column(batch, "pid")), np.asarray(column(batch, "kind"))
            change = np.flatnonzero((np.diff(pids) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(pids)]):
                if a == b:
                    continue
                if pids[a] != current:
                    if route and held:
                        yield from own_search(Part(held, tree, wanted, leaf_rows), current)
                    held, part, current = [], None, int(pids[a])
                if kinds[a] == 0:
                    held.append(batch.slice(a, b - a))
                else:
                    if part is None and held:
                        part, held = Part(held, tree, wanted, leaf_rows), []
                    if part is not None:
                        yield from answer(part, batch.slice(a, b - a))
        if route and held:
            yield from own_search(Part(held, tree, wanted, leaf_rows), current)

    return rows.repartitionById(parts, F.col("pid")).sortWithinPartitions("pid", "kind").mapInArrow(run, schema)


def similar_vectors(
    df: DataFrame, key: str, vector: str, k: int = 5, dimensions: int = DIMENSIONS, projected: int = PROJECTED,
    confidence: float = CONFIDENCE, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, part_rows: int = PART_ROWS,
    least_part_rows: int = LEAST_PART_ROWS,
) -> DataFrame:
    """``key``, neighbour, cosine, rank: the ``k`` most similar other keys by cosine, ties to the lower key.

    Unit vectors are projected on ``projected`` Gaussian (2-stable) directions, so the squared projected distance over
    the squared distance is chi-square distributed. There are two levels of kd-trees. The top one is fitted on a sample
    of at most about ``sample_rows`` vectors and places every vector; its leaves (at most ``sample_rows`` / 8) make up
    partitions of about ``part_rows`` vectors, and a partition that gets more is cut at random into as many as that
    takes, so no task holds more however many vectors there are. Each partition then has a tree over all its own
    vectors, with leaves of ``leaf_rows`` at any size of the table. Every vector is searched in its own partition first;
    what remains are the partitions with a top leaf whose bounding box passes the chi-square test (``confidence``) at the
    vector's k-th distance, and only to them is it sent. As whole leaves are verified, far more neighbours are found
    than the confidence says (see the README for the measured recall). Equal and proportional vectors are searched once
    and answered for all their keys. Where ``part_rows`` would leave cores idle, partitions are smaller.

    Vectors that are null, of another length, all zero or hold null or NaN take no part. Redelivered rows count once;
    if rows of one key differ, each of its vectors is searched. An empty table gives an empty result.
    """
    wanted = k + 1
    keyed = keyed_vectors(usable_vectors(df, key, vector, dimensions))
    vectors = materialize(distinct_vectors(keyed, wanted), "vectors")
    n = vectors.count()
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / leaf_rows)), int(math.log2(sample_rows)) - 3)) if n else 0
    leaves = 2**depth
    part_rows = max(1, min(part_rows, max(least_part_rows, n // keyed.sparkSession.sparkContext.defaultParallelism)))
    groups = min(leaves, 2 ** math.ceil(math.log2(max(n / part_rows, 1))))
    share = min(1.0, sample_rows / max(n, 1))
    picked = vectors.where(F.pmod(F.xxhash64(F.lit("sample"), "k1"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vec")
    sample = picked.toArrow().column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dimensions)
    tree = fit_tree(unit(sample), depth, projected)
    per_group = leaves // groups
    stop = chi_square_quantile(confidence, projected)

    def bound_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((leaves, projected), np.inf, np.float32), np.full((leaves, projected), -np.inf, np.float32)
        count = np.zeros(leaves, np.int64)
        for batch in batches:
            points = tree.project(unit(matrix(batch)))
            leaf = tree.leaf(points)
            order = np.argsort(leaf, kind="stable")
            there, first = np.unique(leaf[order], return_index=True)
            low[there] = np.minimum(low[there], np.minimum.reduceat(points[order], first)) if len(there) else low[there]
            high[there] = np.maximum(high[there], np.maximum.reduceat(points[order], first)) if len(there) else high[there]
            count += np.bincount(leaf, minlength=leaves)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(count[there]), list_array(low[there]), list_array(high[there])], ["leaf", "n", "low", "high"])

    # At most sample_rows / 8 leaves come to the driver, whatever the size of the table.
    side = lambda how, name: [how(F.get(name, F.lit(d))).alias(f"{name}{d}") for d in range(projected)]
    boxes = (
        vectors.select("vec").mapInArrow(bound_boxes, "leaf int, n bigint, low array<float>, high array<float>")
        .groupBy("leaf").agg(F.sum("n").alias("n"), *side(F.min, "low"), *side(F.max, "high")).toPandas().sort_values("leaf")
    )
    low, high = (np.ascontiguousarray(boxes[[f"{c}{d}" for d in range(projected)]].to_numpy(np.float32)) for c in ("low", "high"))
    box_group = boxes["leaf"].to_numpy() // per_group
    counts = np.bincount(box_group, boxes["n"].to_numpy(), groups)
    salts = np.maximum(1, np.ceil(counts / (2 * part_rows)).astype(np.int64))
    first_part = np.concatenate(([0], np.cumsum(salts)))
    parts = int(first_part[-1])
    group_of = np.repeat(np.arange(groups), salts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = tree.leaf(tree.project(unit(matrix(batch)))) // per_group
            pid = first_part[group] + np.asarray(column(batch, "k2")) % salts[group]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pid.astype(np.int32))], [*batch.schema.names, "pid"])

    def route(points: np.ndarray, kth: np.ndarray, pid: int) -> pa.ListArray:
        """The other partitions each point must be searched in."""
        reach = stop * np.maximum(2 - 2 * kth, 0) + 1e-6
        near, distance = boxes_within(points, low, high, reach)
        meets = distance <= reach[:, None]
        owners, first = np.unique(box_group[near], return_index=True)  # box_group ascends
        needed = np.logical_or.reduceat(meets, first, axis=1) if len(near) else np.zeros((len(points), 0), bool)
        if salts[group_of[pid]] > 1:
            needed[:, owners == group_of[pid]] = True
        row, at = np.nonzero(needed)
        times = salts[owners[at]]
        until = np.cumsum(times)
        row, pids = np.repeat(row, times), np.arange(times.sum()) + np.repeat(first_part[owners[at]] - (until - times), times)
        row, pids = row[pids != pid], pids[pids != pid]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(points)))))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pids.astype(np.int32)))

    placed = vectors.mapInArrow(place, f"{POINT}, pid int").withColumn("kind", F.lit(0)).withColumn("bound", F.lit(-2.0))
    columns = ["pid", "kind", "k1", "k2", "vec", "ids", "bound"]
    own = _stream(
        placed.select(columns), parts, f"k1 bigint, k2 bigint, top {TOP}, bound double, vec array<float>, pids array<int>", tree, wanted, leaf_rows, stop, route
    )
    own = materialize(own, "own")
    sent = own.select(
        F.explode("pids").alias("pid"), F.lit(1).alias("kind"), "k1", "k2", "vec", F.array().cast("array<bigint>").alias("ids"), "bound"
    )
    away = _stream(placed.select(columns).unionByName(sent), parts, f"k1 bigint, k2 bigint, top {TOP}", tree, wanted, leaf_rows, stop, None)
    ordered = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("top"))), lambda x: F.struct((-x["cos"]).alias("far"), x["id"].alias("id"))))
    tops = own.select("k1", "k2", "top").unionByName(away).groupBy("k1", "k2").agg(F.slice(ordered, 1, wanted).alias("top"))
    others = F.slice(F.filter("top", lambda x: x["id"] != F.col("key")), 1, k)
    members = keyed.select("k1", "k2", "key").distinct()
    return members.join(tops, ["k1", "k2"]).select("key", F.posexplode(others).alias("pos", "x")).select(
        F.col("key").alias(key), F.col("x.id").alias("neighbour"), (-F.col("x.far")).alias("cosine"), (F.col("pos") + 1).alias("rank")
    )


def neighbour_pairs(df: DataFrame, key: str, vector: str, k: int = 5, **options) -> DataFrame:
    """``key``_a < ``key``_b: pairs of which at least one is among the ``k`` most similar of the other."""
    found = similar_vectors(df, key, vector, k, **options)
    return found.select(
        F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b")
    ).distinct()
