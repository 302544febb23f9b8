"""Exact cosine search in blocks, and embeddings with a cache."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.sparse import top_k

BLOCK_BYTES = 32 << 20  # of one side of a block pair, in double precision
SLICE_BYTES = 16 << 20  # of the product of two slices
BASE_SLICE = 4096
LEAST_ROWS = 4096


def has_direction(vector: Column) -> Column:
    """Not null, not empty, without null or NaN elements, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors, and the places of the rows that have one (a norm that is neither 0 nor infinite)."""
    lists = table.column(name).combine_chunks()
    rows = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    good = np.flatnonzero(np.isfinite(norms) & (norms > 0))
    return rows[good] / norms[good, None], good


def best_of_block(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of query and row and the similarity (9 decimals) of the k best rows of every query, ties to the lower place.

    The product is made slice by slice, at most ``SLICE_BYTES`` at a time; after each slice of rows only k per query and
    the similarity of the k-th are kept, so memory doesn't depend on the block's size.
    """
    step = max(1, SLICE_BYTES // (8 * BASE_SLICE))
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, len(queries), step):
        asked = queries[low : low + step]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        kth = np.full(len(asked), -2.0)
        for at in range(0, len(rows), BASE_SLICE):
            similar = asked @ rows[at : at + BASE_SLICE].T
            width = similar.shape[1]
            edge = kth if width <= k else np.maximum(kth, np.partition(similar, width - k, axis=1)[:, width - k])
            near, column = np.nonzero(similar >= np.maximum(edge, -2.0)[:, None] - 1e-9)
            score = np.round(similar[near, column], 9)
            best = (np.append(best[0], near), np.append(best[1], at + column), np.append(best[2], score))
            order = np.lexsort((best[1], -best[2], best[0]))
            own = best[0][order]
            place = np.arange(len(own))
            nth = place - np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), place, 0)) if len(own) else place
            last = order[nth == k - 1]
            kth[best[0][last]] = best[2][last]
            best = tuple(x[order[nth < k]] for x in best)
        found.append((low + best[0], best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def dense_topk(
    queries: DataFrame, query: str, query_vector: str, base: DataFrame, key: str, vector: str, k: int,
    block_bytes: int = BLOCK_BYTES, least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """query, key, score, rank: the k most similar vectors of every query by cosine, ties to the lower key.

    A stated query set against all rows, in blocks: queries and rows are hashed into blocks of at most ``block_bytes``
    (in double precision), each pair of blocks meets in one task, which multiplies them in slices and returns k rows per
    query. Rows are copied once per block of queries (65,536 of 64 elements) and no more; queries once per block of
    rows. Where there are few rows, they make more blocks of at least ``least_rows``, so that all cores work. Vectors
    without direction, and pairs of different length, have no score.
    """
    size_of = lambda df, v: df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(v)), F.lit(1)).alias("d")).first()
    (n_queries, q_size), (n_rows, b_size) = size_of(queries, query_vector), size_of(base, vector)
    per_block = max(1, block_bytes // (8 * max(q_size, b_size, 1)))
    q_blocks = max(1, math.ceil(n_queries / per_block))
    spread = min(queries.sparkSession.sparkContext.defaultParallelism, n_rows // least_rows)
    b_blocks = max(1, math.ceil(n_rows / per_block), spread)
    block = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.where(has_direction(F.col(query_vector))).select(
        F.col(query).alias("q"), F.col(query_vector).alias("v"), F.size(query_vector).alias("d"), block(query, q_blocks).alias("qb"), each(b_blocks).alias("bb")
    )
    rows = base.where(has_direction(F.col(vector))).select(
        F.col(key).alias("p"), F.col(vector).alias("v"), F.size(vector).alias("d"), block(key, b_blocks).alias("bb"), each(q_blocks).alias("qb")
    )
    kind = rows.schema["p"].dataType.simpleString()
    schema = pa.schema([("q", pa.int64()), ("p", pa.string() if kind == "string" else pa.int64()), ("score", pa.float64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        asked_vectors, mine = _matrix(left, "v")
        keys = right.column("p").combine_chunks()
        right = right.take(pa.array(np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable")))  # places ascend with the keys
        vectors, theirs = _matrix(right, "v")
        q, places, score = best_of_block(asked_vectors, vectors, k)
        keys = right.column("p").combine_chunks()
        return pa.table({"q": left.column("q").combine_chunks().take(pa.array(mine[q])), "p": keys.take(pa.array(theirs[places])), "score": score}, schema)

    met = asked.groupBy("d", "qb", "bb").cogroup(rows.groupBy("d", "qb", "bb")).applyInArrow(meet, f"q bigint, p {kind}, score double")
    return top_k(met, k, "q", "score", "p").select(F.col("q").alias(query), F.col("p").alias(key), "score", "rank")


def cached_vectors(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """input_hash, dense_vector: one stored vector (of the lowest point id) for every wanted input hash that has one."""
    known = stored.where("dense_vector is not null").join(wanted.select("input_hash").distinct(), "input_hash", "left_semi")
    return known.groupBy("input_hash").agg(F.min_by("dense_vector", "point_id").alias("dense_vector"))


def cache_misses(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """One row per input hash that has no stored vector."""
    return wanted.join(cached.select("input_hash"), "input_hash", "left_anti").dropDuplicates(["input_hash"])


Embed = Callable[[list[str]], list[list[float]]]


def embed_texts(misses: DataFrame, text: str, embed: Embed, batch: int = 64) -> DataFrame:
    """input_hash, dense_vector from an embedding function, called with at most ``batch`` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            hashes, texts = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("input_hash", "_text"))
            vectors: list[list[float]] = []
            for at in range(0, len(texts), batch):
                got = embed(texts[at : at + batch])
                if len(got) != len(texts[at : at + batch]):
                    raise ValueError("the embedder returned another number of vectors than it was given texts")
                vectors += got
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], ["input_hash", "dense_vector"])

    return misses.select("input_hash", F.col(text).alias("_text")).mapInArrow(run, "input_hash string, dense_vector array<float>")


def attach_vectors(points: DataFrame, stored: DataFrame | None, text: str, embed: Embed, batch: int = 64) -> DataFrame:
    """Points with ``dense_vector``: reused by input hash where stored, embedded once per distinct input otherwise."""
    if stored is None:
        fresh = embed_texts(points.dropDuplicates(["input_hash"]), text, embed, batch)
        return points.join(fresh, "input_hash")
    cached = cached_vectors(points, stored)
    fresh = embed_texts(cache_misses(points, cached), text, embed, batch)
    return points.join(cached.unionByName(fresh), "input_hash")


def reuse_counts(points: DataFrame, stored: DataFrame) -> DataFrame:
    """reused (chunks with a stored vector) and embedded (distinct inputs without one)."""
    marked = points.select("input_hash").join(cached_vectors(points, stored).select("input_hash", F.lit(True).alias("hit")), "input_hash", "left")
    return marked.agg(
        F.count_if(F.col("hit").isNotNull()).alias("reused"),
        F.count_distinct(F.when(F.col("hit").isNull(), F.col("input_hash"))).alias("embedded"),
    )
