"""Filling containers of fixed capacity: dominance reduction, then best fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import bpe
from folioscope.session import materialize

CAPACITY = 2048
ROWS_PER_BUCKET = 500_000


class Stock:
    """How many items of each size are left."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.filled: list[tuple[int, dict[int, int]]] = []

    def largest(self, room: int, used: dict[int, int]) -> int:
        """The largest size that fits and is left beside the items used; 0 if none."""
        for size in np.flatnonzero(self.left[: max(room, 0) + 1])[::-1].tolist():
            if self.left[size] > used.get(size, 0):
                return size
        return 0

    def smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest items, one of size ``without`` set aside."""
        found: list[int] = []
        for size in np.flatnonzero(self.left).tolist():
            found += [size] * min(n, int(self.left[size]) - (size == without))
            if len(found) >= n:
                break
        return found[:n]

    def fix(self, items: list[int]) -> None:
        """Fill as many containers with these items as there are items for."""
        used = {s: items.count(s) for s in set(items)}
        times = min(int(self.left[s]) // n for s, n in used.items())
        for s, n in used.items():
            self.left[s] -= times * n
        self.filled.append((times, used))


def smaller_of_best_pair(stock: Stock, room: int, used: dict[int, int]) -> int:
    """The largest y for which two items x >= y fit into the room together."""
    y = stock.largest(room // 2, used)
    while y:
        if stock.largest(room - y, used | {y: used.get(y, 0) + 1}) >= y:
            return y
        y = stock.largest(y - 1, used)
    return 0


def reduce_by_dominance(stock: Stock, capacity: int) -> None:
    """Martello and Toth's reduction over size classes: fix sets that dominate every other set with the same item.

    For an item, from the largest size on: alone, if nothing fits beside it; with an item that fills the container
    exactly; with the largest item that fits, if no two fit or (if no three do) it is as large as any two that fit;
    with the largest two, if no three fit and no other pair has a larger second item. All items of the size go the
    same way until one of the classes is used up; then the tests are made again.
    """
    for size in range(capacity, 0, -1):
        while stock.left[size]:
            room = capacity - size
            best = stock.largest(room, {size: 1})
            small = stock.smallest(3, size)
            if not best:
                stock.fix([size])
                continue
            only_one = len(small) < 2 or sum(small[:2]) > room
            if best == room or only_one:
                stock.fix([size, best])
                continue
            if len(small) > 2 and sum(small) <= room:
                break
            used = {size: 1}
            used[best] = used.get(best, 0) + 1
            second = stock.largest(room - best, used)
            pair = best_pair_sum(stock, room, {size: 1})
            if best >= pair:
                stock.fix([size, best])
            elif second and smaller_of_best_pair(stock, room, {size: 1}) <= second:
                stock.fix([size, best, second])
            else:
                break


def best_pair_sum(stock: Stock, room: int, used: dict[int, int]) -> int:
    top, x = 0, stock.largest(room, used)
    while x and 2 * x > top:
        y = stock.largest(min(x, room - x), used | {x: used.get(x, 0) + 1})
        top = max(top, x + y if y else 0)
        x = stock.largest(x - 1, used)
    return top


def fill_best(stock: Stock, capacity: int) -> None:
    """Best fit, largest item first: each container takes what leaves the least space.

    Into the space left goes an item, or else two, that fill it exactly; failing that the largest that fits.
    """
    while len(sizes := np.flatnonzero(stock.left)):
        items = [int(sizes[-1])]
        room = capacity - items[0]
        while room:
            used = {s: items.count(s) for s in set(items)}
            free = stock.left[: room + 1].copy()
            for s, n in used.items():
                if s <= room:
                    free[s] -= n
            fits = np.flatnonzero(free > 0)
            if not len(fits):
                break
            best = int(fits[-1])
            if best < room:
                first = fits[(fits * 2 >= room) & (free[room - fits] > (fits * 2 == room))]
                if len(first):
                    items += [int(first[-1]), room - int(first[-1])]
                    break
            items.append(best)
            room -= best
        stock.fix(items)


def pack_sizes(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: items of it}) of all containers, for a histogram of sizes up to the capacity."""
    stock = Stock(counts)
    reduce_by_dominance(stock, capacity)
    fill_best(stock, capacity)
    return [(times, used) for times, used in stock.filled if times]


def slots(filled: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows of size, first item of the size, first container, items per container; sorted by size and first item."""
    rows, given, container = [], {}, 0
    for times, used in filled:
        for size, n in used.items():
            rows.append((size, given.get(size, 0), container, n))
            given[size] = given.get(size, 0) + n * times
        container += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def fill_containers(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``key``, piece_no, first_unit, n_units, container_no: a container for every item.

    An item above the capacity is cut: full pieces have a container each, the rest is an item like any other. The
    sizes' histogram (at most ``capacity`` rows, whatever the number of items) is packed by dominance reduction and
    best fit in terms of whole size classes, which gives the best containers over all items, not per partition. Items
    then get their number within their size and so their place. A size of more than ``rows_per_bucket`` items is
    numbered in as many parts as that takes, so no task sorts more, whatever share of all items the size has. Rows whose
    key is null, or whose size is null or below 1, have no container; rows are not de-duplicated, equal rows are items
    of their own.
    """
    n, cap = F.col("size"), F.lit(capacity)
    rows = sizes.select(sizes[key].alias("key"), sizes[size].cast("bigint").alias("size")).where("key is not null and size > 0")
    cut = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / cap)), lambda i: F.struct(i.alias("piece_no"), F.least(cap, n - i * cap).alias("units")))
    items = materialize(rows.select("key", F.inline(cut)).select("key", F.col("piece_no").cast("int").alias("piece_no"), F.col("units").cast("int").alias("units")), "items")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in items.groupBy("units").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        histogram[row.units] = row.n
    table = slots(pack_sizes(histogram, capacity))
    parts = -(-histogram // rows_per_bucket)
    nth = F.row_number().over(Window.partitionBy("units", "bucket").orderBy("key", "piece_no"))
    if parts.max() <= 1:
        numbered = items.withColumn("bucket", F.lit(0)).select("key", "piece_no", "units", (nth - 1).cast("bigint").alias("number"))
    else:
        many = items.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(parts) if p > 1], "units int, parts int")  # at most `capacity` rows
        bucket = F.coalesce(F.pmod(F.xxhash64("key", "piece_no"), F.col("parts")), F.lit(0)).cast("int")
        placed = materialize(items.join(F.broadcast(many), "units", "left").withColumn("bucket", bucket).drop("parts"), "buckets")
        before = Window.partitionBy("units").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = placed.groupBy("units", "bucket").agg(F.count("*").alias("n"))
        offsets = counts.select("units", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        numbered = placed.withColumn("nth", nth).join(offsets, ["units", "bucket"]).select("key", "piece_no", "units", (F.col("offset") + F.col("nth") - 1).alias("number"))
    kind = numbered.schema["key"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = table[:, 0] << 42 | table[:, 1]
        for batch in batches:
            units, number = (np.asarray(batch.column(i)).astype(np.int64) for i in (2, 3))
            at = np.searchsorted(starts, units << 42 | number, "right") - 1
            container = table[at, 2] + (number - table[at, 1]) // table[at, 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(container)], ["key", "piece_no", "n_units", "container_no"])

    placed = numbered.mapInArrow(place, f"key {kind}, piece_no int, n_units int, container_no bigint")
    return placed.select(F.col("key").alias(key), "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("first_unit"), "n_units", "container_no")


def fill_documents(documents: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer_dir: str = bpe.TOKENIZER_DIR) -> DataFrame:
    """``fill_containers`` over the token counts (byte_bpe_50k) of all texts that are neither null nor empty."""
    return fill_containers(bpe.token_counts(documents, key, text, tokenizer_dir), key, "n_tokens", capacity)


def checked_containers(sizes: DataFrame, placed: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``key``, fits, whole of every sized item: whether no container of its pieces is overfull, and whether they are all of
    it, one after another, and more than one only above the capacity.
    """
    placed = placed.select(F.col(key).alias("_key"), "piece_no", "first_unit", "n_units", "container_no")
    loads = placed.groupBy("container_no").agg(F.sum("n_units").alias("load"))
    told = placed.join(loads, "container_no").groupBy("_key").agg(
        F.max("load").alias("most"), F.sum("n_units").alias("units"), F.count("*").alias("pieces"), F.max(F.col("first_unit") + F.col("n_units")).alias("end"),
        F.count_if(F.col("first_unit") != F.col("piece_no").cast("bigint") * capacity).alias("astray"),
    )
    own = F.col("_size")
    whole = (F.col("units") == own) & (F.col("end") == own) & (F.col("astray") == 0) & (F.col("pieces") == F.ceil(own / capacity))
    items = sizes.select(F.col(key).alias("_key"), F.col(size).alias("_size")).join(told, "_key", "left")
    return items.select(F.col("_key").alias(key), F.coalesce(F.col("most") <= capacity, F.lit(False)).alias("fits"), F.coalesce(whole, F.lit(False)).alias("whole"))
